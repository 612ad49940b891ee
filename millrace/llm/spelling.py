"""Spelling variants by a relational trie frontier (operator 12).

Words are letter runs of the whole texts that keep at least ``MIN_LENGTH`` code points and occur ``MIN_COUNT`` times; two are near if
one edit of a code point leads from one to the other. The trie is a table: ``(depth, node, chars)``, a row a prefix, whose id is a chained
64-bit hash. States ``(word, position, node, edits)`` are joined with the edges of their depth, level by level: a state without an edit goes along every
edge (one edit unless the edge is the word's own next character) or skips a character of its word; a state with an edit follows
its word. States at their word's end whose node ends another word are neighbours. Insertions are the deletions of the other word.

Each word is read forwards and backwards, and its edit lies in the second half of one of the two readings. States therefore
start at half the word, where few words share a node. A shared prefix costs a join on a table with one row a node, never pairs.

Words over ``LONG`` code points would need a level each: they meet by the hashes of themselves without one character instead, which
finds the same pairs. All pairs are confirmed by their edit distance, so a collision of hashes adds none and hides none.

Defined cases: null and empty texts have no words; a null doc_id is hashed as an empty one; repeated rows count as often as they stand
there; no words give an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

MIN_LENGTH = 6
MIN_COUNT = 5
#: One run in so many (by its hash with the document's id) loses a character.
DROP_ONE_IN = 199
#: A form is at least so many times as frequent as its word.
TIMES = 5
#: Longest word of the trie.
LONG = 48
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: A level's edges are broadcast up to so many rows (some 40 bytes each).
SMALL_LEVEL = 200_000
RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")


def noisy_words(doc_id: int | None, text: str) -> Counter:
    """The words of one text and how often each occurs: runs with A-Z in lower case, of which some lose a character."""
    found: Counter = Counter()
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in Counter(RUN.findall(text.encode("utf-8", "replace").lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP_ONE_IN == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        found[run] += n
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts, handed on whenever a task holds many words."""
    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid:
                held.update(noisy_words(doc_id, text.as_py()))
            if len(held) > HELD_WORDS:
                yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                held.clear()
    if held:
        yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words that occur often enough."""
    partial = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _char(word: str, at: str):
    return F.expr(f"substring({word}, {at} + 1, 1)")


def _readings(words: DataFrame) -> DataFrame:
    """``back, w, half, nodes``: each word in both directions with the ids of its prefixes from half its length on."""
    both = words.select(F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("word").alias("w")), F.struct(F.lit(1).alias("back"), F.reverse("word").alias("w")))).alias("x")).select("x.*")
    step = "aggregate({0}, {1}, (a, k) -> xxhash64(a, substring(w, k, 1)))"
    first = step.format("sequence(1, half)", "cast(back as bigint)")
    grown = f"aggregate(sequence(half + 1, length(w)), array({first}), (a, k) -> concat(a, array(xxhash64(element_at(a, -1), substring(w, k, 1)))))"
    return both.withColumn("half", F.expr("cast(length(w) div 2 as int)")).withColumn("nodes", F.expr(grown))


def _with_skips(states: DataFrame) -> DataFrame:
    """The states, and those that have just skipped the last of a run of equal characters of their word."""
    skips = F.col("edits").eqNullSafe(0) & (F.col("pos") < F.length("w")) & (_char("w", "pos") != _char("w", "(pos + 1)"))
    both = F.when(skips, F.array(F.struct("pos", "edits"), F.struct((F.col("pos") + 1).alias("pos"), F.lit(1).alias("edits")))).otherwise(F.array(F.struct("pos", "edits")))
    return states.select("back", "w", "node", F.explode(both).alias("s")).select("back", "w", "node", "s.pos", "s.edits")


def trie_pairs(words: DataFrame) -> DataFrame:
    """Candidate pairs ``a, b`` of a written table of ``word``, by the frontier over both tries."""
    readings = materialise(_readings(words), "readings")
    depths = readings.select("back", "w", F.posexplode("nodes").alias("k", "node"), "half").select("back", "w", (F.col("half") + F.col("k")).alias("depth"), "node")
    chars = depths.withColumn("c", _char("w", "depth")).where("c <> ''").select("depth", "node", "c").distinct()
    edges = materialise(chars.groupBy("depth", "node").agg(F.concat_ws("", F.array_sort(F.collect_list("c"))).alias("chars")).repartitionByRange("depth", "node").sortWithinPartitions("depth"), "edges")
    levels = {r["depth"]: r["count"] for r in edges.groupBy("depth").count().collect()}  # at most LONG rows
    entering = readings.select("back", "w", F.col("half").alias("pos"), F.expr("nodes[0]").alias("node"), F.lit(0).alias("edits"))
    live, ended = None, []
    for depth in range(min(levels, default=0), max(levels, default=-1) + 2):
        if live is None and depth not in levels:
            continue
        fresh = entering.where(F.col("pos") == depth)
        states = fresh if live is None else fresh.unionByName(live)
        states = materialise(_with_skips(states), "frontier")
        ended.append(states.where("edits = 1 and pos = length(w)").select("back", "w", "node"))
        if depth not in levels:  # words end here, and none is longer but those that enter further down
            live = None
            continue
        here = edges.where(F.col("depth") == depth).select("node", "chars")
        open_ = states.where("pos < length(w)").withColumn("own", _char("w", "pos"))
        moved = open_.join(F.broadcast(here) if levels[depth] <= SMALL_LEVEL else here, "node")
        ways = F.expr("case when edits = 0 then split(chars, '') when instr(chars, own) > 0 then array(own) else array() end")
        moved = moved.withColumn("c", F.explode(ways))
        live = moved.select("back", "w", (F.col("pos") + 1).alias("pos"), F.xxhash64("node", "c").alias("node"), (F.col("edits") + (F.col("c") != F.col("own")).cast("int")).alias("edits"))
    if not ended:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    ends = readings.select(F.element_at("nodes", -1).alias("node"), F.col("w").alias("v"))
    whole = F.when(F.col("back") == 1, F.reverse("w")).otherwise(F.col("w")), F.when(F.col("back") == 1, F.reverse("v")).otherwise(F.col("v"))
    return found.join(ends, "node").select(whole[0].alias("a"), whole[1].alias("b"))


def long_pairs(words: DataFrame) -> DataFrame:
    """Candidate pairs ``a, b`` with a word over ``LONG`` code points: equal without one character."""
    words = words.where(F.length("word") >= LONG).select("word", F.xxhash64("word").alias("id"))
    holes = words.where(F.length("word") > LONG).select("id", "word", F.explode(F.expr("sequence(0, length(word) - 1)")).alias("at"))
    holes = holes.select("id", "at", F.expr("xxhash64(concat(substring(word, 1, at), substring(word, at + 2)))").alias("key"))
    holes = materialise(holes, "holes")
    other = holes.select(F.col("id").alias("other"), "at", "key")
    replaced = holes.join(other, ["at", "key"]).where("id < other").select("id", "other")
    shorter = holes.join(words.select(F.col("id").alias("other")), F.col("key") == F.col("other")).select("id", "other")
    pairs = replaced.union(shorter).distinct()
    return pairs.join(words.withColumnRenamed("word", "a"), "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("b")), "other").select("a", "b")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near``: all pairs of a written table of words at one edit, both ways."""
    found = trie_pairs(words.where(F.length("word") <= LONG))
    if words.where(F.length("word") > LONG).limit(1).count():
        found = found.union(long_pairs(words))
    found = found.where(F.levenshtein("a", "b", 1) == 1)
    return found.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: every chain's last form, by pointer doubling.

    A form is ``TIMES`` times as frequent as its word, so that chains are short and have no rings.
    """
    found = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            return found


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Operator 12: ``word, form, root, n, n_near, form_n``."""
    words = materialise(word_counts(docs), "words")
    near = near_pairs(words).join(words.select(F.col("word").alias("near"), "n"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus_n"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    has_form = -F.col("best.minus_n") >= TIMES * F.col("n")
    known = materialise(
        known.select("word", F.when(has_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, -F.col("best.minus_n")).alias("form_n")), "forms"
    )
    last = roots(known.where("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
