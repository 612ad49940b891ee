"""A Merkle manifest of the documents, folded by resumed hash states (operator 13).

Each row is a leaf: SHA-256 of its fields, a null as ``-``, any other as byte count, ``:`` and value. Within a source the
leaves stand by doc_id; every ``FANOUT`` consecutive nodes become the SHA-256 of their digests' hexadecimal text, level by
level, until one is left, the source's subroot. The subroots, by source, give the root in the same way.

A parent's 16 children of 64 characters are 16 blocks of SHA-256, so its state before each child slot is worth keeping:
``Parent`` retains a copy a slot. To fold a document into the root, the state before its slot takes the replacement and the
siblings to its right only; nothing left of it is hashed again.

Trees are built and folded in units of 4096 nodes, three levels at once: a unit's subtree lies in one task, and its
root is a node of the next round, which has 4096 times fewer. What lies above a unit (at each level the siblings before and
after) comes down with one row a unit, never a row a document. So a source of any size is spread over all
tasks, and the leaves are shuffled three times: to be ordered, as units to be built, and as units to be folded.

Defined cases: nulls of any field are hashed as ``-``; a null doc_id comes first in its source, a null source first of
all; rows that repeat a doc_id stand by their leaf's digest, equal rows in any order (their digests agree). An empty table gives
an empty result. Columns other than the five are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FANOUT = 16
#: Levels of a unit: it has 4096 nodes at most.
LEVELS = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Parent:
    """A parent's digest, with a copy of the hash state before each child slot."""

    __slots__ = ("after", "before", "digest")

    def __init__(self, children: list[str]) -> None:
        state, self.before = hashlib.sha256(), []
        for child in children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()
        tail = "".join(children[1:]).encode()
        self.after = [tail[64 * k :] for k in range(len(children))]

    def fold(self, slot: int, replacement: str) -> str:
        """The digest with another child in the slot: its state, the replacement, the right siblings."""
        state = self.before[slot].copy()
        state.update(replacement.encode())
        state.update(self.after[slot])
        return state.hexdigest()


class Resumed:
    """A parent as a unit below sees it: the state before one slot and the siblings after it."""

    __slots__ = ("after", "before")

    def __init__(self, left: list[str], right: list[str]) -> None:
        self.before, self.after = hashlib.sha256("".join(left).encode()), "".join(right).encode()

    def fold(self, replacement: str) -> str:
        state = self.before.copy()
        state.update(replacement.encode())
        state.update(self.after)
        return state.hexdigest()


class Unit:
    """A unit's subtree: parents level by level, up to one node if the unit is the ``whole`` tree, else through all ``height`` levels."""

    def __init__(self, nodes: list[str], whole: bool, height: int) -> None:
        self.nodes, self.levels = [nodes], []
        while len(self.nodes[-1]) > 1 if whole else len(self.levels) < height:
            below = self.nodes[-1]
            self.levels.append([Parent(below[k : k + FANOUT]) for k in range(0, len(below), FANOUT)])
            self.nodes.append([p.digest for p in self.levels[-1]])
        self.root = self.nodes[-1][0]

    def siblings(self, at: int, level: int = 0) -> list[tuple[list[str], list[str]]]:
        """From a level upwards, the other nodes of the run of node ``at``: those before it and those after it."""
        out = []
        for nodes in self.nodes[level:-1]:
            run = at // FANOUT
            out.append((nodes[run * FANOUT : at], nodes[at + 1 : (run + 1) * FANOUT]))
            at = run
        return out

    def fold(self, at: int, replacement: str) -> str:
        for parents in self.levels:
            at, slot = divmod(at, FANOUT)
            replacement = parents[at].fold(slot, replacement)
        return replacement


def _field(c: str, text: Column | None = None) -> Column:
    value = F.col(c).cast("string") if text is None else text
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def tampered_text() -> Column:
    """The text with A-Z in lower case in every document that the audit tampers with (5 divides the id's crc32)."""
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def leaves(docs: DataFrame, replacement: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf`` and, where a changed text is given, ``replaced``: the leaf with that text."""
    own = [_field(c) for c in FIELDS]
    found = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.sha2(F.concat(*own), 256).alias("leaf")]
    if replacement is not None:
        found.append(F.sha2(F.concat(*own[:-1], _field("text", replacement)), 256).alias("replaced"))
    return docs.select(*found)


def ordered(rows: DataFrame, group: str, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``idx``, their place from 0 in each group (never null) by the keys, nulls first; and ``group, n_nodes``.

    Rows are dealt by ranges of (group, keys), so that a large group has many parts; a part's rows are numbered on their own and moved
    by what the group has in earlier parts.
    """
    by = [F.col(c).asc_nulls_first() for c in [group, *keys]]
    parts = materialise(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), f"{name}-parts")
    sizes = materialise(parts.groupBy(group, "part").agg(F.count("*").alias("n")), f"{name}-sizes")
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(*by[1:])) - 1
    numbered = parts.withColumn("own", own).join(offsets, [group, "part"]).select(*rows.columns, (F.col("own") + F.col("first")).alias("idx"))
    return numbered, sizes.groupBy(group).agg(F.sum("n").alias("n_nodes"))


def _units(nodes: DataFrame, sizes: DataFrame, height: int, *values: str) -> DataFrame:
    """Units of at most 16 ** ``height`` nodes: ``tree, unit, nodes`` (by place) and ``whole`` if there is no other in the tree."""
    size, packed = FANOUT**height, F.array_sort(F.collect_list(F.struct("idx", *values)))
    units = nodes.groupBy("tree", F.floor(F.col("idx") / size).alias("unit")).agg(packed.alias("nodes"))
    return units.join(sizes.select("tree", (F.col("n_nodes") <= size).alias("whole"), F.lit(height).alias("height")), "tree")


def _rows(make: Callable[[dict], Iterator[tuple]], names: list[str], types: list[pa.DataType]):
    """A function of Arrow batches that gives the tuples of ``make`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = list(make(batch.slice(k, 1).to_pylist()[0]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return run


def _unit(row: dict, value: str) -> Unit:
    return Unit([x[value] for x in row["nodes"]], row["whole"], row["height"])


def _build(row: dict) -> Iterator[tuple]:
    yield row["tree"], row["unit"], _unit(row, "digest").root


PATH = "array<struct<l:array<string>,r:array<string>>>"
PATH_TYPE = pa.list_(pa.struct([("l", pa.list_(pa.string())), ("r", pa.list_(pa.string()))]))


def _paths(row: dict) -> Iterator[tuple]:
    """The siblings above each node of a unit, up to the tree's root."""
    unit = _unit(row, "digest")
    for at, x in enumerate(row["nodes"]):
        yield row["tree"], x["idx"], [{"l": a, "r": b} for a, b in unit.siblings(at)] + (row["path"] or [])


PATHS = _rows(_paths, ["tree", "unit", "path"], [pa.int64(), pa.int64(), PATH_TYPE]), f"tree long, unit long, path {PATH}"


def trees(nodes: DataFrame, sizes: DataFrame, height: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``tree, idx, digest`` and ``tree, n_nodes``: the first round's units, ``tree, root``, and ``tree, unit, path`` of those units.

    Rounds go up until each tree has one unit, then paths come down round by round.
    """
    rounds = []
    while True:
        units = materialise(_units(nodes, sizes, height, "digest"), "units")
        roots = materialise(units.mapInArrow(_rows(_build, ["tree", "unit", "digest"], [pa.int64(), pa.int64(), pa.string()]), "tree long, unit long, digest string"), "unit-roots")
        rounds.append((units, roots))
        if sizes.where(F.col("n_nodes") > FANOUT**height).limit(1).count() == 0:
            break
        # A finished tree goes on as a tree of one node, whose root is itself.
        nodes, sizes = roots.select("tree", F.col("unit").alias("idx"), "digest"), sizes.select("tree", F.ceil(F.col("n_nodes") / FANOUT**height).alias("n_nodes"))
    paths = None
    for units, _ in rounds[:0:-1]:
        known = units.withColumn("path", F.lit(None).cast(PATH)) if paths is None else units.join(paths, ["tree", "unit"], "left")
        paths = materialise(known.mapInArrow(*PATHS), "paths")
    first, roots = rounds[0][0], rounds[-1][1].select("tree", F.col("digest").alias("root"))
    if paths is None:
        paths = first.select("tree", "unit", F.array().cast(PATH).alias("path"))
    return first, roots, paths


def _joined(path: list[tuple[list[str], list[str]]]) -> str:
    return "".join(d for left, right in path for d in (*left, *right))


def _fold(row: dict) -> Iterator[tuple]:
    """Every document of a unit: its proof, and the root that its replaced leaf leads to."""
    unit = _unit(row, "leaf")
    path = [(x["l"], x["r"]) for x in row["path"]]
    above, upper = [Resumed(*x) for x in path], _joined(path)
    for at, x in enumerate(row["nodes"]):
        if at % FANOUT == 0:  # what a run has in common
            higher = _joined(unit.siblings(at // FANOUT, 1)) + upper
        found = unit.fold(at, x["replaced"])
        for parent in above:
            found = parent.fold(found)
        run = unit.nodes[0][at // FANOUT * FANOUT : (at // FANOUT + 1) * FANOUT] if unit.levels else []
        del run[at % FANOUT : at % FANOUT + 1]
        yield x["doc_id"], x["leaf"], row["subroot"], row["root"], digest([*run, higher]), found, found == row["root"]


def manifest(docs: DataFrame, replacement: Column | None = None, height: int = LEVELS) -> DataFrame:
    """Operator 13: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``replacement`` is the text that each row is audited with, the operator's tampered text by default.
    """
    rows = leaves(docs, tampered_text() if replacement is None else replacement)
    # Sources in order of their bytes, numbered as the trees of the leaves.
    leaf_rows = materialise(rows, "leaves")
    sources, _ = ordered(leaf_rows.select(F.lit(0).alias("all"), F.struct(F.col("source").isNotNull().alias("named"), "source").alias("name")).distinct(), "all", ["name"], "sources")
    sources = materialise(sources.select(F.col("name.source").alias("s"), F.col("idx").alias("tree")), "sources")
    named = leaf_rows.join(sources, leaf_rows["source"].eqNullSafe(sources["s"])).select("tree", "doc_id", "leaf", "replaced")
    placed, sizes = ordered(named, "tree", ["doc_id", "leaf", "replaced"], "leaves")
    placed, sizes = materialise(placed, "placed"), materialise(sizes, "tree-sizes")
    _, subroots, paths = trees(placed.select("tree", "idx", F.col("leaf").alias("digest")), sizes, height)
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("root").alias("digest"))
    n_sources = subroots.agg(F.count("*").alias("n_nodes")).select(F.lit(0).cast("long").alias("tree"), "n_nodes")
    top_units, top_root, top_paths = trees(top, n_sources, height)
    root = top_root.first()
    upper = materialise(top_units.join(top_paths, ["tree", "unit"]).mapInArrow(*PATHS).select(F.col("unit").alias("tree"), F.col("path").alias("upper")), "source-paths")
    above = subroots.select("tree", F.col("root").alias("subroot")).join(upper, "tree").withColumn("root", F.lit(root and root["root"]).cast("string"))
    units = _units(placed, sizes, height, "doc_id", "leaf", "replaced").join(paths, ["tree", "unit"]).join(above, "tree")
    units = units.withColumn("path", F.concat("path", "upper")).drop("upper")
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return units.mapInArrow(_rows(_fold, names, types), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
