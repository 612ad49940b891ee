"""Document quality by a sparse rule ensemble (operator 5).

Text statistics are Spark column expressions. Shallow trees of a random forest, grown on labelled
documents, give conjunctive rules (each node's path from the root); a logistic model with an L1
penalty weighs them and drops most; the rules left are compiled into one column expression that
scores every document in the same pass that takes its statistics.

Training takes at most ``MAX_TRAINING_ROWS`` labelled documents, those with the least hashes of
their doc_id; everything else runs over all rows. Only the text is ever an input of a score.

Defined cases: a null text counts as empty and is scored like it; a null doc_id is not held out
and never labelled; several labels of one document count by their mean; without labels of both kinds every
score is the share of label 1 (0.5 without labels); repeated rows get equal scores; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .rules import CLASS_NAMES, SPACE, with_class_counts, with_repeat_words

MAX_TRAINING_ROWS = 20_000
TREES = 20
DEPTH = 3
PENALTY = 0.002
HELD_OUT = 1

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above?, threshold) each


def statistics(docs: DataFrame) -> DataFrame:
    """Add the statistics of ``text`` (null: empty) as double columns named in ``STATISTICS``."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    rows = docs.withColumns({"_text": text, "_words": words, "_lines": lines})
    rows = with_class_counts(rows, "_text", "_classes").withColumn("_distinct", F.size(F.array_distinct("_words")))
    rows = with_repeat_words(rows, "_words", "_repeat")
    n_chars, n_words, n_lines = F.char_length("_text"), F.size("_words"), F.size("_lines")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0).cast("double")

    letters = n_chars - F.col("_classes")[CLASS_NAMES.index("space")]
    same_as_next = F.size(F.filter(F.zip_with("_words", F.slice("_words", 2, F.greatest(n_words - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    columns = {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(letters, n_words),
        "words_a_line": share(n_words, n_lines),
        "distinct_words": share(F.col("_distinct"), n_words),
        "repeated_words": share(F.col("_repeat"), n_words),
        "same_as_next": share(same_as_next, n_words),
        "distinct_lines": share(F.size(F.array_distinct("_lines")), n_lines),
        "short_words": share(F.size(F.filter("_words", lambda w: F.char_length(w) <= 3)), n_words),
        "words_in_capitals": share(F.size(F.filter("_words", lambda w: w == F.upper(w))), n_words),
        "words_with_marks": share(F.size(F.filter("_words", lambda w: w.rlike("[#*$%&|<>!@=_]"))), n_words),
        "exclamations": share(n_chars - F.char_length(F.translate("_text", "!", "")), n_words),
        "bars": share(n_chars - F.char_length(F.translate("_text", "|", "")), n_words),
        "stops": share(n_chars - F.char_length(F.translate("_text", ".", "")), n_words),
    }
    columns |= {f"share_{name}": share(F.col("_classes")[i], n_chars) for i, name in enumerate(CLASS_NAMES)}
    return rows.withColumns(columns).drop("_text", "_words", "_lines", "_classes", "_symbols", "_repeat", "_distinct")


STATISTICS = ["log_words", "word_length", "words_a_line", "distinct_words", "repeated_words", "same_as_next", "distinct_lines", "short_words", "words_in_capitals", "words_with_marks", "exclamations", "bars", "stops", *(f"share_{n}" for n in CLASS_NAMES)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Statistics and ``label`` of the labelled documents to learn from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return materialise(statistics(texts).select("label", *STATISTICS), "training")


def tree_rules(root) -> list[Rule]:
    """The path to every node of a tree (its JVM root node) but the root."""
    found: list[Rule] = []

    def walk(node, path: Rule) -> None:
        if path:
            found.append(path)
        if node.subtreeDepth() > 0:
            split = node.split()
            name, threshold = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, False, threshold)))
            walk(node.rightChild(), (*path, (name, True, threshold)))

    walk(root, ())
    return found


def holds(rule: Rule) -> Column:
    condition = F.lit(True)
    for name, above, threshold in rule:
        condition = condition & (F.col(name) > threshold if above else F.col(name) <= threshold)
    return condition


class RuleEnsemble:
    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self) -> Column:
        """The probability of label 1, over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self) -> Column:
        return F.lit(self.value)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> RuleEnsemble | Constant:
    rows = training_rows(docs, labels, max_rows)
    seen = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not seen["n"] or seen["ones"] in (0, seen["n"]):
        return Constant(float(seen["ones"] / seen["n"]) if seen["n"] else 0.5)
    rows = rows.coalesce(4)
    dense = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.4", seed=7, maxBins=64).fit(dense)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree._java_obj.rootNode())))
    marks = rows.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(marks)
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(vectors)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w != 0.0]
    return RuleEnsemble(kept, float(lasso.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Operator 5: ``doc_id, held_out, score, predicted`` for every document."""
    model = train(docs, labels, max_rows)
    rows = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().cast("double").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
