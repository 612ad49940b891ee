"""Quality rules by distribution divergence (operator 9), with DataFrame functions only.

Each language's reference is counted over all documents that name it: the histogram of character
classes, and that of its most frequent words (any other word counts as one more). A document
is compared with its language's references by Jensen-Shannon distance (base 2, from 0 to 1). Sampling noise
makes short texts diverge, so each comparison has a minimum length, and its limit is lenient: it rejects
texts made of something else (shouting, symbol noise, cells of tables, one word again and again).

Defined cases: a null or wordless text has no words and fails the base rule; a null language is a
language of its own; a language with fewer than ``MIN_REFERENCE_DOCS`` documents gives no
verdict, so the base rule alone decides; repeated rows get equal results and count as often as they occur in
the references; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialise

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
COMMON_WORDS = 24
MIN_REFERENCE_DOCS = 20
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.31
MAX_WORD_DISTANCE = 0.50
CLASS_NAMES = ("lower", "upper", "digit", "space", "sentence", "symbol", "beyond_ascii", "other")


def with_class_counts(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add array ``name``: how many code points of each class ``text`` has, in the order of ``CLASS_NAMES``; and ``_symbols``, those of ``SYMBOLS``.

    Each class is taken out of what the ones before it left, the most common first, so that only the first pass sees the whole text.
    """
    sets = {"lower": "[a-z]+", "space": SPACE, "beyond_ascii": "[^\\x00-\\x7F]+", "upper": "[A-Z]+", "sentence": "[.,;:'\"?()\\-]+", "digit": "[0-9]+", "symbol": "[#*$%&|<>!@\\^~_=+/\\\\{}\\[\\]]+"}
    left, before = text, None
    for i, (kind, pattern) in enumerate(sets.items()):
        rows = rows.withColumn(f"_left{i}", F.regexp_replace(left, pattern, ""))
        before, left = left, f"_left{i}"
        rows = rows.withColumn(f"_n_{kind}", (F.char_length(before) - F.char_length(left)).cast("long"))
    rows = rows.withColumn("_symbols", (F.char_length(before) - F.char_length(F.regexp_replace(before, f"[{SYMBOLS}]+", ""))).cast("long"))
    rows = rows.withColumn(name, F.array(*[F.char_length(left).cast("long") if k == "other" else F.col(f"_n_{k}") for k in CLASS_NAMES]))
    return rows.drop(*[f"_left{i}" for i in range(len(sets))], *[f"_n_{k}" for k in sets])


def with_words(docs: DataFrame) -> DataFrame:
    """Add ``_text`` (null: empty), ``_words`` and ``_lang``."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return docs.withColumns({"_text": text, "_lang": F.coalesce("lang", F.lit("")), "_words": words})


def with_repeat_words(rows: DataFrame, words: str, name: str) -> DataFrame:
    """Add how many words stand in a window of three that the text has twice or more.

    Windows are sorted as longs that hold a hash and, below it, the place; equal ones then stand side by side. Each place
    in such a run covers three words, less what it shares with the place before it.
    """
    n = F.size(words)
    hashed = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)))
    rows = rows.withColumn("_bits", F.coalesce(F.greatest(F.lit(14), F.ceil(F.log2(n + 1.0)).cast("int")), F.lit(14))).withColumn("_hashes", F.when(n >= 3, hashed))
    packed = F.transform("_hashes", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("_ordered", F.sort_array(packed))

    def equal(a: Column, b: Column) -> Column:
        return F.call_function("shiftright", a, F.col("_bits")) == F.call_function("shiftright", b, F.col("_bits"))

    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    twice = F.filter(F.zip_with("_ordered", F.slice("_ordered", 2, F.size("_ordered")), lambda a, b: F.when(equal(a, b), F.array(a.bitwiseAND(place), b.bitwiseAND(place)))), lambda p: p.isNotNull())
    rows = rows.withColumn("_places", F.sort_array(F.flatten(twice)))
    gaps = F.zip_with(F.slice("_places", 2, F.size("_places")), "_places", lambda b, a: F.when(b.isNull(), 3).otherwise(F.least(b - a, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)
    return rows.withColumn(name, F.when(n < 3, 0).otherwise(covered).cast("long")).drop("_bits", "_hashes", "_ordered", "_places")


def base_columns(rows: DataFrame) -> DataFrame:
    """The fixed rules' columns, ``_classes`` and ``base_failed``, from ``_text`` and ``_words``."""
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = with_class_counts(rows, "_text", "_classes").withColumn("_lines", lines)
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length("_text") - F.col("_classes")[CLASS_NAMES.index("space")],
            "n_symbols": F.col("_symbols"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    rows = with_repeat_words(rows, "_words", "n_repeat_words")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).drop("_lines", "_symbols")


def references(docs: DataFrame, common_words: int = COMMON_WORDS) -> DataFrame:
    """One row a language: ``_lang, class_ref, common, word_ref``, from all documents."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("_text"), F.coalesce("lang", F.lit("")).alias("_lang"))
    counted = with_class_counts(rows, "_text", "c")
    sums = counted.groupBy("_lang").agg(F.count("*").alias("n_docs"), *[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(len(CLASS_NAMES))])
    each = rows.select("_lang", F.explode(F.split(F.lower("_text"), SPACE)).alias("w")).where("w <> ''")
    words = materialise(each.groupBy("_lang", "w").agg(F.count("*").alias("n")), "words")
    totals = words.groupBy("_lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "w"))
    top = words.withColumn("rank", rank).where(F.col("rank") <= common_words)
    ordered = top.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "n"))).alias("top"))
    chars = sum((F.col(f"c{k}") for k in range(1, len(CLASS_NAMES))), F.col("c0"))
    both = sums.join(totals, "_lang").join(ordered, "_lang").where((F.col("n_docs") >= MIN_REFERENCE_DOCS) & (F.col("total") > 0))
    shares = F.transform("top", lambda x: x["n"] / F.col("total"))
    rest = 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return both.select("_lang", F.array(*[F.col(f"c{k}") / chars for k in range(len(CLASS_NAMES))]).alias("class_ref"), F.col("top.w").alias("common"), F.concat(shares, F.array(F.greatest(rest, F.lit(0.0)))).alias("word_ref"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Operator 9: ``docs`` with the base columns, both distances, ``base_failed`` and ``kept``.

    ``class_distance`` and ``word_distance`` are null where the text is shorter than the guard or the
    language has no reference.
    """
    refs = materialise(references(docs), "references") if refs is None else refs
    rows = join_small(base_columns(with_words(docs)), refs, ["_lang"], "left")
    n = F.col("n_words")
    # Each word's number in the list of common words, sorted, with every number once more in between: where a number
    # begins and where the next one does tells how often it stands there.
    numbers = F.filter(F.transform("_words", lambda w: F.coalesce(F.array_position(F.col("common"), F.lower(w)).cast("int"), F.lit(0))), lambda i: i > 0)
    marks = F.sequence(F.lit(1), F.size("common") + 1)
    rows = rows.withColumn("_numbers", F.when(F.col("common").isNotNull(), F.sort_array(F.concat(numbers, marks))))
    # Named twice, ``_numbers`` stays a column of its own: inlined, it would be made anew for every mark.
    rows = rows.withColumn("_starts", F.when(F.size("_numbers") > 0, F.transform(marks, lambda k: F.array_position("_numbers", k))))
    counts = F.zip_with(F.slice("_starts", 2, F.size("common")), F.slice("_starts", 1, F.size("common")), lambda b, a: (b - a - 1).cast("int"))
    rows = rows.withColumn("_counts", F.when(F.col("common").isNotNull(), counts)).withColumn("_found", F.aggregate("_counts", F.lit(0), lambda a, x: a + x))
    chars = F.char_length("_text")
    classes = F.transform("_classes", lambda x: x / chars)
    words = F.concat(F.transform("_counts", lambda x: x / n), F.array((n - F.col("_found")) / n))
    rows = rows.withColumns(
        {
            "class_distance": F.when((chars >= MIN_CHARS) & F.col("class_ref").isNotNull(), F.round(js_distance(classes, F.col("class_ref")), 6)),
            "word_distance": F.when((n >= MIN_WORDS) & F.col("word_ref").isNotNull(), F.round(js_distance(words, F.col("word_ref")), 6)),
        }
    )
    diverges = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    helpers = ["_text", "_words", "_lang", "_classes", "_numbers", "_starts", "_counts", "_found", "class_ref", "common", "word_ref"]
    judged = rows.withColumn("kept", ~(F.col("base_failed") | diverges)).drop(*helpers)
    # The counts are for monitoring. They also keep a filter on ``kept`` above the columns that it
    # needs: pushed below them, its condition would repeat each statistic wherever it is named.
    return judged.observe("quality_rules", F.count(F.lit(1)).alias("documents"), F.count_if("kept").alias("kept"))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def quality_rules(docs: DataFrame) -> DataFrame:
    """Each document's verdict, without its text."""
    return judge(docs.select(F.col("doc_id").cast("long"), "text", "lang")).select("doc_id", *COLUMNS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("_row"), "text", "lang")
    return judge(packed).where("kept").select("_row.*")
