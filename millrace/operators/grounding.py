"""Answers and their evidence: composed answers, citation checks, faithfulness, and the sentences that stand behind a sentence.

Evidence is a table ``query_id, citation_id, doc_id, preview, claim, stance, safety_decision, allowed``; answers are ``query_id, variant,
answer``. Each sentence meets the evidence it cites by a join on the query and the citation's number, so a query's evidence is
the most that a row can meet.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.storage import materialise, small
from . import evidence

# Sentences of composed answers.
NOTHING = "The current corpus does not provide enough retrieved evidence to answer this query."
OPENING = "Across the retrieved literature, the strongest grounded answer is that the evidence is mixed and should be read through the specific claims and methods represented here."
WEAK = "The retrieved corpus provides weak support for this query, so this should be treated as an abstention rather than a grounded answer."
# Sentences that begin so ask for no support.
EXEMPT = ["the current corpus does not", "the retrieved corpus provides weak support"]
# Words that support nothing, of the citation check and of the faithfulness score.
CHECK_STOP = ["across", "answer", "claim", "cited", "evidence", "grounded", "retrieved", "reports", "should", "source", "that", "this", "treated", "with"]
SCORE_STOP = ["across", "answer", "claim", "evidence", "grounded", "literature", "reports", "retrieved", "strongest", "that", "this", "through", "with"]
# Least share of a sentence's words that its evidence must have, and the weights of the faithfulness score.
LEAST_SUPPORT = 0.12
SCORE = {"citation_validity": 0.35, "evidence_token_support": 0.35, "claim_backing_rate": 0.3}

# Sentences of documents with more words than this meet others by single words: their pairs would be too many.
LONG = 64
# So many pairs a sentence of the documents are shuffled at once, on the average; the others wait for the next pass.
PASS_PAIRS = 8
# So many words or sentences' numbers at most are sent to all tasks.
BROADCAST_WORDS = 500_000

CITATION = "\\bC[0-9]+\\b"
PREVIEW = 280


def content(text: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(T.tokens(text), lambda w: (F.char_length(w) >= 4) & ~w.isin(stop)))


def collected(ranked: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """The evidence of each query's first ``k`` documents; a document's claim is its surest, the earliest among equals."""
    top = ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    wanted = materialise(docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text"), "wanted")
    surest = evidence.claims(wanted).groupBy("doc_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "position", "sentence", "stance")).alias("s"))
    scanned = evidence.safety_scan(wanted, "text").select("doc_id", F.col("decision").alias("safety_decision"), T.preview(F.coalesce(F.col("text"), F.lit("")), PREVIEW).alias("preview"))
    rows = top.join(scanned, "doc_id").join(surest, "doc_id", "left")
    allowed = ~F.col("safety_decision").isin("block", "quarantine")
    return rows.select("query_id", F.concat(F.lit("C"), F.col("rank").cast("string")).alias("citation_id"), "rank", "doc_id", "preview", F.col("s.sentence").alias("claim"), F.col("s.stance").alias("stance"), "safety_decision", allowed.alias("allowed"))


def composed(queries: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, answer``: an opening, the query's focus terms, and a sentence for each of the first ``most`` pieces of evidence."""
    said = F.when(F.col("claim").isNotNull(), F.concat_ws("", "citation_id", F.lit(" reports a "), "stance", F.lit(" claim: "), "claim"))
    said = F.coalesce(said, F.concat_ws("", "citation_id", F.lit(" contributes contextual evidence from document "), F.col("doc_id").cast("string"), F.lit(".")))
    lines = found.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))).alias("lines"))
    focus = F.slice(F.filter(F.array_distinct(T.tokens(F.col("text"))), lambda w: (F.char_length(w) >= 4) & ~w.isin(fixed.GENERIC_QUERY_TERMS)), 1, 8)
    both = queries.select("query_id", focus.alias("focus")).join(lines, "query_id", "left")
    centred = F.when(F.size("focus") > 0, F.concat(F.lit(" The retrieval centered on: "), F.array_join("focus", ", "), F.lit("."))).otherwise("")
    answer = F.concat(F.lit(OPENING), centred, F.lit(" "), F.array_join(F.transform("lines", lambda x: x["said"]), " "))
    return both.select("query_id", F.when(F.col("lines").isNull(), F.lit(NOTHING)).otherwise(answer).alias("answer"))


def perturbed(answers: DataFrame) -> DataFrame:
    """Each answer as it is, with every citation's number raised by ten, and without its citations."""
    other = F.regexp_replace("answer", "\\bC([0-9]+)\\b", "C1$1")
    bare = F.regexp_replace("answer", CITATION, "It")
    return answers.select("query_id", F.inline(F.array(F.struct(F.lit("composed").alias("variant"), F.col("answer")), F.struct(F.lit("renumbered").alias("variant"), other.alias("answer")), F.struct(F.lit("uncited").alias("variant"), bare.alias("answer")))))


def sentence_reports(answers: DataFrame, found: DataFrame, stop: list[str], only_allowed: bool) -> DataFrame:
    """Each sentence's citations, and the share of its content words that stands in the evidence it cites.

    An answer without sentences counts as one empty sentence. ``only_allowed`` leaves out evidence that must not be used.
    """
    keys = ["query_id", "variant"]
    split = T.sentences(F.col("answer"))
    each = answers.select(*keys, F.posexplode(F.when(F.size(split) > 0, split).otherwise(F.array(F.lit("")))).alias("position", "sentence"))
    each = each.withColumns({"words": content(F.col("sentence"), stop), "cited": F.regexp_extract_all("sentence", F.lit(CITATION), F.lit(0))})
    text = F.concat_ws(" ", "preview", "claim")
    known = found.select("query_id", "citation_id", "allowed", F.col("claim").isNotNull().alias("claimed"), content(text, stop).alias("has"))
    cited = each.select(*keys, "position", "sentence", "words", F.explode_outer("cited").alias("citation_id")).join(known, ["query_id", "citation_id"], "left")
    valid, usable = F.col("allowed").isNotNull(), F.col("allowed") if only_allowed else F.col("allowed").isNotNull()
    covered = F.array_distinct(F.flatten(F.collect_list(F.when(usable, F.array_intersect("words", "has")).otherwise(F.array().cast("array<string>")))))
    rows = cited.groupBy(*keys, "position").agg(
        F.first("sentence").alias("sentence"), F.first(F.size("words")).alias("n_words"), F.count("citation_id").alias("n_cited"), F.count_if(valid).alias("n_valid"), F.size(covered).alias("n_covered"),
        F.coalesce(F.bool_or(usable & F.col("claimed")), F.lit(False)).alias("attached"), F.collect_set(F.when(F.col("allowed").isNull(), F.col("citation_id"))).alias("invalid"), F.collect_set(F.when(~F.col("allowed"), F.col("citation_id"))).alias("disallowed"),
    )
    return rows


def backed(support: Column) -> Column:
    return (F.col("n_valid") > 0) & ((support >= LEAST_SUPPORT) | F.col("attached"))


def verified(answers: DataFrame, found: DataFrame) -> DataFrame:
    """``status, failures, citation_validity, invalid_citations, disallowed_citations, blocked_leaks, unsupported, sentences`` of each answer."""
    keys = ["query_id", "variant"]
    rows = sentence_reports(answers, found, CHECK_STOP, True)
    low = F.lower("sentence")
    asks = (F.col("n_words") > 0) & ~F.startswith(low, F.lit(EXEMPT[0])) & ~F.startswith(low, F.lit(EXEMPT[1]))
    support = F.when(F.col("n_words") > 0, F.col("n_covered") / F.nullif("n_words", F.lit(0))).otherwise(1.0)
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",")
    report = rows.groupBy(*keys).agg(F.count("*").alias("sentences"), F.count_if(asks & ~backed(support)).alias("unsupported"), listed("invalid").alias("invalid_citations"), listed("disallowed").alias("disallowed_citations"))
    unsafe = found.where(F.col("safety_decision").isin("block", "quarantine")).select("query_id", "citation_id")
    leaks = answers.join(unsafe, "query_id").where(F.contains("answer", F.col("citation_id"))).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("citation_id")), ",").alias("blocked_leaks"))
    both = report.join(leaks, keys, "left").withColumn("blocked_leaks", F.coalesce("blocked_leaks", F.lit("")))
    failures = [("invalid_citations", F.col("invalid_citations") != ""), ("disallowed_citations", F.col("disallowed_citations") != ""), ("unsupported_sentences", F.col("unsupported") > 0), ("blocked_or_quarantined_evidence_leaked", F.col("blocked_leaks") != "")]
    named = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in failures])), ",")
    return both.select(*keys, F.when(named == "", "pass").otherwise("fail").alias("status"), named.alias("failures"), F.when(F.col("invalid_citations") == "", 1.0).otherwise(0.0).alias("citation_validity"), "invalid_citations", "disallowed_citations", "blocked_leaks", "unsupported", "sentences")


def faithfulness(answers: DataFrame, found: DataFrame) -> DataFrame:
    """``citation_validity, evidence_token_support, claim_backing_rate, unsupported_sentence_rate, faithfulness_score`` of each answer."""
    rows = sentence_reports(answers, found, SCORE_STOP, False)
    support = F.when(F.col("n_words") > 0, F.col("n_covered") / F.nullif("n_words", F.lit(0))).when(F.col("n_cited") == 0, 1.0).otherwise(0.0)
    validity = F.coalesce(F.round(F.col("n_valid") / F.nullif("n_cited", F.lit(0)), 6), F.lit(0.0))
    is_backed = backed(support).cast("double")
    means = {"citation_validity": validity, "evidence_token_support": F.round(support, 6), "claim_backing_rate": is_backed, "unsupported_sentence_rate": 1 - is_backed}
    g = rows.groupBy("query_id", "variant").agg(*[F.round(F.avg(c), 6).alias(n) for n, c in means.items()])
    return g.withColumn("faithfulness_score", F.round(sum((F.col(n) * w for n, w in list(SCORE.items())[1:]), F.col("citation_validity") * SCORE["citation_validity"]), 6))


def word_pairs(words: Column, part: int, parts: int) -> Column:
    """A hash of each pair of the sorted ``words`` whose first one is of the ``part`` of all words; equal hashes of other pairs only add candidates."""
    pairs = lambda x, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda y: F.xxhash64(x, y))
    mine = lambda x: F.pmod(F.xxhash64(F.lit(7), x), F.lit(parts)) == part
    return F.flatten(F.transform(words, lambda x, i: F.when(mine(x), pairs(x, i)).otherwise(F.array().cast("array<long>"))))


def meeting(wanted: DataFrame, told: DataFrame, least: float) -> DataFrame:
    """``asked, told``: all pairs of word sets of which the first may have a share ``least`` of its words in the second, and few others.

    Pairs of words are far more than the texts' words; they are dealt out in several passes by their first words, so that what is on disk at once
    grows with the sentences and not with the pairs.
    """
    words = wanted.select("asked", F.size("_words").alias("n"), F.explode("_words").alias("w")).withColumn("owed", F.ceil(F.col("n") * least))
    frequency = told.select(F.explode("_words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy("asked").orderBy(F.coalesce("df", F.lit(0)), "w"))
    ranked = words.join(frequency, "w", "left").withColumn("spare", F.col("n") - F.col("owed") - rare)
    kept = materialise(ranked.where((F.col("spare") >= -1) | ((F.col("spare") == -2) & (F.col("owed") >= 2))).select("asked", "w", "owed", "spare"), "kept")
    known = materialise(kept.select("w").distinct(), "known")
    known = F.broadcast(known) if small(known, BROADCAST_WORDS) else known
    postings = told.select("told", F.explode("_words").alias("w")).join(known, "w", "left_semi").groupBy("told").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    postings = materialise(postings, "postings")
    long = F.size("ws") > LONG
    two = materialise(kept.where("owed >= 2").groupBy("asked").agg(F.array_sort(F.collect_list("w")).alias("ws")), "two")
    size = F.size("ws").cast("long")
    sums = postings.where(~long).agg(F.count("*").alias("n"), F.sum(size * (size - 1) / 2).alias("pairs")).first()
    parts = max(1, math.ceil((sums["pairs"] or 0) / (PASS_PAIRS * max(1, sums["n"]))))
    found = []
    for part in range(parts):
        left = two.select("asked", F.explode(word_pairs(F.col("ws"), part, parts)).alias("w"))
        right = postings.where(~long).select("told", F.explode(word_pairs(F.col("ws"), part, parts)).alias("w"))
        found.append(materialise(left.join(right, "w").select("asked", "told").distinct(), "found"))
    by_two = reduce(DataFrame.unionByName, found)
    # By single words: all of the sentences asked that owe one word, and the others with long sentences alone.
    alone = materialise(kept.where("owed < 2 and spare >= -1").select("asked", "w"), "alone")
    first = alone.select("w").distinct()
    each = postings.select("told", F.explode("ws").alias("w")).join(F.broadcast(first) if small(alone, BROADCAST_WORDS) else first, "w", "left_semi")
    with_long = kept.where("owed >= 2 and spare >= -1").select("asked", "w").join(postings.where(long).select("told", F.explode("ws").alias("w")), "w")
    by_one = alone.join(each, "w").unionByName(with_long).select("asked", "told")
    return by_two.unionByName(by_one).distinct()


def aligned(sentences: DataFrame, docs: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """For each row of ``sentences`` the sentence of ``docs`` that has the largest share, at least ``least``, of its content words.

    Adds ``n_words, doc_id, doc_position, share``; they are null where no sentence has that share. Ties go to the smaller document, then to the
    earlier sentence. Equal word sets are looked up once. Of n words, two of the n - ceil(least n) + 2 rarest must be shared, so sentences meet by pairs
    of those; where one shared word is enough, and with sentences of more than ``LONG`` such words, by one of the n - ceil(least n) + 1 rarest. Which words are rare is counted
    over all documents' word sets.
    """
    asked = materialise(sentences.withColumn("_words", F.array_sort(content(F.col("sentence"), CHECK_STOP))), "asked")
    told = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("doc_position", "sentence")).withColumn("_words", F.array_sort(content(F.col("sentence"), CHECK_STOP)))
    told = materialise(told.where("size(_words) > 0").groupBy("_words").agg(F.min(F.struct("doc_id", "doc_position")).alias("first")).withColumn("told", F.monotonically_increasing_id()), "told")
    wanted = materialise(asked.where("size(_words) > 0").select("_words").distinct().withColumn("asked", F.monotonically_increasing_id()), "wanted")
    # A single word's best sentence is the first that has it: its many sentences need not meet it one by one.
    one = wanted.where("size(_words) = 1").select("asked", F.get("_words", F.lit(0)).alias("w"))
    words = F.broadcast(one.select("w").distinct()) if small(one, BROADCAST_WORDS) else one.select("w").distinct()
    firsts = told.select("first", F.explode("_words").alias("w")).join(words, "w", "left_semi").groupBy("w").agg(F.min("first").alias("first"))
    alone = one.join(firsts, "w").select("asked", F.struct(F.lit(-1.0).alias("s"), "first").alias("b"))
    pairs = materialise(meeting(wanted.where("size(_words) > 1"), told, least), "pairs")
    met = pairs.select("told").distinct()
    near = materialise(told.select("told", "first", F.col("_words").alias("_has")).join(F.broadcast(met) if small(pairs, BROADCAST_WORDS) else met, "told", "left_semi"), "near")
    both = pairs.join(wanted, "asked").join(near, "told")
    share = F.size(F.array_intersect("_words", "_has")) / F.size("_words")
    best = both.withColumn("share", F.round(share, 6)).where(F.size(F.array_intersect("_words", "_has")) >= F.ceil(F.size("_words") * least)).groupBy("asked").agg(F.min(F.struct((-F.col("share")).alias("s"), "first")).alias("b"))
    best = materialise(best.unionByName(alone), "best")
    named = wanted.join(best, "asked").select("_words", F.col("b.first.doc_id").alias("doc_id"), F.col("b.first.doc_position").alias("doc_position"), (-F.col("b.s")).alias("share"))
    return asked.join(named, "_words", "left").select(*keys, F.size("_words").alias("n_words"), "doc_id", "doc_position", "share")
