"""Signals, safety, claims, conflicts and corroboration as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.storage import materialise


def signal_columns(text: Column) -> dict[str, Column]:
    return {name: T.marker_score(text, words, by) for name, (words, by) in fixed.SIGNAL_MARKERS.items()}


def chunk_signals(docs: DataFrame) -> DataFrame:
    """The five marker signals of each text, rounded to 6."""
    return docs.select("doc_id", *[F.round(c, 6).alias(name) for name, c in signal_columns(F.col("text")).items()])


#: For each safety category groups of words, one group of which a text must have a word of each of; its patterns cannot match else.
SAFETY_HINTS = {
    "instruction_override": [[["ignore", "disregard", "override", "reveal", "do not ", "you are now", "act as"]]],
    "role_confusion": [[["system", "developer", "assistant", "user"]]],
    "exfiltration": [[["api", "token", "password", "credential", "secret", "private key", "chain"]]],
    "tool_control": [[["run", "execute", "call", "invoke"], ["shell", "command", "tool", "function", "python", "powershell"]], [["click"], ["link"]], [["browse to"]], [["download"], ["file"]]],
    "hidden_text": [[["display", "visibility", "font-size", "color", "<!--"]]],
}


def _may_match(low: Column, category: str) -> Column:
    """Whether a text has the words without which no pattern of the category matches: cheap searches before the patterns."""
    some = F.lit(False)
    for groups in SAFETY_HINTS[category]:
        every = F.lit(True)
        for words in groups:
            one = F.lit(False)
            for w in words:
                one = one | low.contains(w)
            every = every & one
        some = some | every
    return some


def matches(low: Column, categories: list[str]) -> Column:
    """Whether a text in lower case matches a pattern of one of the safety categories."""
    found = F.lit(False)
    for name in categories:
        found = found | F.when(_may_match(low, name), low.rlike("(?s)" + "|".join(f"(?:{p})" for p in fixed.SAFETY_PATTERNS[name]))).otherwise(False)
    return found


def safety_scan(rows: DataFrame, text: str, risky: bool = False) -> DataFrame:
    """Add ``categories`` (sorted), ``risk_score`` and ``decision``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(T.nfkc(raw))
    flags = {name: F.when(_may_match(F.col("_low"), name), F.col("_low").rlike("(?s)" + "|".join(f"(?:{p})" for p in patterns))).otherwise(False) for name, patterns in fixed.SAFETY_PATTERNS.items()}
    controls = F.regexp_replace(raw, "[^\\p{Cf}\\p{Cc}]|[\\n\\r\\t]", "")
    flags["unicode_anomaly"] = F.char_length(controls) >= 2
    words = F.regexp_extract_all(F.col("_low"), F.lit("[a-z0-9_:-]{4,}"), F.lit(0))
    rows = rows.withColumn("_low", low).withColumns({f"_is_{n}": c for n, c in flags.items()} | {"_words": words}).drop("_low")
    rows = rows.withColumn("_words", F.when(F.size("_words") >= 24, F.sort_array("_words")).otherwise(F.array().cast("array<string>")))
    # The longest run of equal neighbours in the sorted words is the largest count.
    runs = F.aggregate("_words", F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most")), _count_run, lambda s: s["most"])
    rows = rows.withColumn("_is_retrieval_trigger_shape", (F.size("_words") >= 24) & (runs >= 0.25 * F.size("_words")))
    names = sorted(fixed.SAFETY_WEIGHTS)
    found = F.array_compact(F.array(*[F.when(F.col(f"_is_{n}"), F.lit(n)) for n in names]))
    risk = sum((F.when(F.col(f"_is_{n}"), fixed.SAFETY_WEIGHTS[n]).otherwise(0.0) for n in names), F.lit(0.0))
    if risky:
        risk = risk + F.when(F.size(found) > 0, 0.1).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), risk), 6)
    blocks = F.col("_is_exfiltration") & (F.col("_is_instruction_override") | F.col("_is_tool_control"))
    decision = F.when(blocks, "block").when(score >= fixed.QUARANTINE_FROM, "quarantine").when(score >= fixed.SANITIZE_FROM, "sanitize").otherwise("allow")
    return rows.withColumns({"categories": F.array_join(found, ","), "risk_score": score, "decision": decision}).drop("_words", *[f"_is_{n}" for n in names])


def _count_run(s: Column, w: Column) -> Column:
    n = F.when(w == s["w"], s["n"] + 1).otherwise(1)
    return F.struct(w.alias("w"), n.alias("n"), F.greatest(s["most"], n).alias("most"))


def claims(docs: DataFrame) -> DataFrame:
    """Every sentence that the linear marker model calls a claim."""
    each = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))
    each = each.withColumn("_tokens", T.tokens(F.col("sentence"))).withColumn("_set", F.array_distinct("_tokens"))
    m = fixed.CLAIM_MARKERS
    counted = {"claim_marker_count": sorted({*m["positive"], *m["negative"], *m["finding"], *m["evidence"]}), "finding_marker_count": m["finding"], "evidence_marker_count": m["evidence"], "method_marker_count": m["method"], "hedge_marker_count": m["hedge"], "positive": m["positive"], "negative": m["negative"]}
    each = each.withColumns({n: F.size(F.array_intersect("_set", T.literals(words))) for n, words in counted.items()} | {"sentence_token_count": F.least(F.size("_tokens"), F.lit(60))})
    raw = sum((F.col(n) * w for n, w in fixed.CLAIM_WEIGHTS.items()), F.lit(fixed.CLAIM_INTERCEPT))
    p, n = F.col("positive"), F.col("negative")
    stance = F.when(p > n, "supportive").when(n > p, "critical").when(p > 0, "mixed").otherwise("descriptive")
    scored = each.select("doc_id", "position", "sentence", "_tokens", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6).alias("confidence"), stance.alias("stance"))
    return scored.where(F.col("confidence") >= fixed.CLAIM_THRESHOLD)


def topic_tokens(words: Column, most: int = 8) -> Column:
    """The most frequent tokens of four characters or more, by count and then by name."""
    long = F.filter(words, lambda w: F.char_length(w) >= 4)
    ranked = F.array_sort(F.transform(F.array_distinct(long), lambda w: F.struct((-F.size(F.filter(long, lambda x: x == w))).alias("n"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda x: x["w"]), 1, most)


def sorted_topics(words: Column) -> Column:
    return F.array_sort(topic_tokens(words))


# Score of a conflict within one cluster and across clusters.
WITHIN, ACROSS = 0.65, 0.8


def conflicts(found: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Opposed claims on the same topic: a supportive one against critical or mixed ones, with two topic tokens in common.

    Claims with equal topic tokens, stance and cluster are one class, named by its first claim (by document, then position), so that copies make
    no pairs: a row a pair of classes, with how many claims each has, ``shared_tokens``, ``conflict_type`` and ``score``. Classes of one
    and the same document are no conflict. Two sets of at most eight tokens share two of them exactly if they share a pair of tokens, so classes
    meet by pairs of tokens, supportive ones on one side and opposed ones on the other: whatever meets is a conflict, and no token is left out.
    Classes bring their columns along and are handed on where they meet by their first two shared tokens, so that no pair of classes is shuffled.
    ``found`` has ``_tokens`` or their ``sorted_topics`` as ``topics``.
    """
    named = F.col(cluster) if cluster in found.columns else F.lit(None)
    topics = F.col("topics") if "topics" in found.columns else sorted_topics(F.col("_tokens"))
    rows = found.select("doc_id", "position", "stance", named.cast("string").alias("cluster"), topics.alias("topics")).where(F.size("topics") >= 2)
    rows = rows.where(F.col("stance").isin("supportive", "critical", "mixed"))
    classes = rows.groupBy("topics", "stance", "cluster").agg(F.min(F.struct("doc_id", "position")).alias("first"), F.count("*").alias("claims"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    classes = materialise(classes, "classes")
    pairs = F.flatten(F.transform("topics", lambda t, i: F.transform(F.slice("topics", i + 2, F.size("topics")), lambda u: F.xxhash64(t, u))))

    def side(name: str, opposed: bool) -> DataFrame:
        mine = classes.where((F.col("stance") != "supportive") if opposed else (F.col("stance") == "supportive"))
        own = [F.col("first.doc_id").alias(f"{name}_doc"), F.col("first.position").alias(f"{name}_position"), F.col("stance").alias(f"{name}_stance"), F.col("claims").alias(f"{name}_claims"), F.col("topics").alias(f"{name}_topics"), F.col("cluster").alias(f"{name}_cluster"), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high")]
        return mine.select(F.explode(F.array_distinct(pairs)).alias("key"), *own)

    # Topics are sorted, and so are the shared ones: of the keys at which two classes meet, one is that of their first two.
    met = side("left", False).join(side("right", True), "key").withColumn("_shared", F.array_intersect("left_topics", "right_topics"))
    both = met.where((F.size("_shared") >= 2) & (F.xxhash64(F.get("_shared", F.lit(0)), F.get("_shared", F.lit(1))) == F.col("key")))
    alone = (F.col("left_low") == F.col("left_high")) & (F.col("right_low") == F.col("right_high")) & (F.col("left_low") == F.col("right_low"))
    across = ~F.col("left_cluster").eqNullSafe(F.col("right_cluster"))
    return both.where(~alone).select(
        "left_doc", "left_position", "right_doc", "right_position", "right_stance", "left_claims", "right_claims", F.array_join("_shared", ",").alias("shared_tokens"),
        F.when(across, "cross_cluster_tension").otherwise("within_cluster_tension").alias("conflict_type"), F.when(across, ACROSS).otherwise(WITHIN).alias("score"),
    )


def sliding_windows(docs: DataFrame, size: int = 180, overlap: int = 40) -> DataFrame:
    """Windows of ``size`` white-space tokens, the next starting ``overlap`` before the end; the last ends with the text."""
    step = max(1, size - overlap)
    rows = docs.select("doc_id", T.rough_tokens(F.col("text")).alias("words")).where("size(words) > 0")
    last = F.greatest(F.ceil((F.size("words") - size) / step).cast("int"), F.lit(0))
    each = rows.select("doc_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = F.col("chunk") * step
    return each.select("doc_id", "chunk", start.alias("token_start"), F.least(start + size, F.size("words")).alias("token_end"), F.array_join(F.slice("words", start + 1, size), " ").alias("text"))


def parent_context(turns: DataFrame, parent: str, position: str, max_tokens: int = 220) -> DataFrame:
    """Each parent's first ``max_tokens`` tokens over its texts in order; the text that crosses the limit is cut there."""
    rows = turns.withColumn("_words", T.rough_tokens(F.col("text"))).withColumn("_n", F.size("_words"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(parent).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("_before", before).where((F.col("_before") < max_tokens) & (F.col("_n") > 0))
    kept = kept.withColumn("_words", F.slice("_words", F.lit(1), F.least(F.col("_n"), max_tokens - F.col("_before")).cast("int")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.array_join("_words", " ").alias("t")))), lambda x: x["t"]), "\n")
    return kept.groupBy(parent).agg(F.count("*").alias("parts"), F.sum(F.size("_words")).alias("tokens"), joined.alias("context"))


def sanitize(rows: DataFrame, text: str) -> DataFrame:
    """Add ``sanitized``: of texts with that ``decision``, the NFKC form with unsafe passages replaced; ``removed`` names the categories."""
    step = T.nfkc(F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_s0", step)
    removed = []
    for i, (name, patterns) in enumerate(fixed.SAFETY_PATTERNS.items()):
        out = F.col(f"_s{i}")
        for p in patterns:
            out = F.regexp_replace(out, "(?is)" + p, "[removed unsafe instruction]")
        rows = rows.withColumn(f"_s{i + 1}", F.when(F.col("decision") == "sanitize", out))
        removed.append(F.when(F.col(f"_s{i + 1}") != F.col(f"_s{i}"), F.lit(name)))
    last = f"_s{len(fixed.SAFETY_PATTERNS)}"
    clean = F.trim(F.regexp_replace(F.regexp_replace(last, "[\\p{Cf}\\p{Cc}&&[^\\n\\r\\t]]", ""), "\\s+", " "))
    names = F.array_join(F.array_compact(F.array(*removed)), ",")
    rows = rows.withColumns({"sanitized": F.when(F.col("decision") == "sanitize", clean).otherwise(F.col(text)), "removed": F.when(F.col("decision") != "sanitize", "").when(names == "", F.col("categories")).otherwise(names)})
    return rows.drop(*[f"_s{i}" for i in range(len(fixed.SAFETY_PATTERNS) + 1)])


def use_policy(rows: DataFrame) -> DataFrame:
    """Add ``allowed_uses`` and ``use_reason`` from ``safety_decision, decision, evidence_family, domain_fit_tier``."""
    c = F.col
    unsafe = c("safety_decision").isin("block", "quarantine")
    opinion, blocked = c("evidence_family") == "public_opinion", c("domain_fit_tier").isin("blocked", "quarantine_review")
    reason = F.when(unsafe, F.concat(F.lit("safety_"), c("safety_decision"))).when(c("decision") == "reject", "retrieval_decision_reject").when(opinion, "public_opinion_aggregate_only").when(blocked, F.concat(F.lit("domain_fit_"), c("domain_fit_tier"))).otherwise("generator_context_allowed")
    uses = F.when(unsafe | (c("decision") == "reject"), "audit").when(opinion, "audit,aggregate_public_opinion").when(blocked, "audit").when(c("safety_decision") == "sanitize", "audit,generator_context,sanitized_context").otherwise("audit,generator_context")
    return rows.withColumns({"allowed_uses": uses, "use_reason": reason})
