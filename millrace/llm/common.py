"""Helpers that the training-data operators share: written tables and size-checked joins."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import discard, keeping_last, materialise, scratch_uri, small

__all__ = ["discard", "frugal", "join_counted", "join_small", "keeping_last", "materialise", "read", "scratch_uri"]

Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function of Arrow batches that gives free memory back to the system when its task ends.

    Python workers are used again by later stages, and those of several stages in a row share an executor's memory.
    """

    @functools.wraps(run)
    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task

#: So many of the most frequent keys at most are broadcast by ``join_counted``.
HOT_KEYS = 50_000


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, max_rows: int = 500_000) -> DataFrame:
    """Join a written table ``right``; broadcast it only when it has at most ``max_rows`` rows.

    ``right`` must be narrow (ids and numbers, some 40 bytes a row). Above the bound the same join shuffles both sides.
    """
    return left.join(F.broadcast(right) if small(right, max_rows) else right, on, how)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of a written table ``right`` with one row a key, whose column ``n`` counts the key's rows in ``left``.

    Of N rows in all, fewer than ``HOT_KEYS`` keys can have a share of 1 / ``HOT_KEYS``: those are broadcast, and the
    rows of the others are shuffled, of which no key has many.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_KEYS > total
    if total <= HOT_KEYS:
        return left.join(F.broadcast(right), on)
    usual = left.join(F.broadcast(right.where(hot).select(*on)), on, "left_anti").join(right.where(~hot), on)
    return left.join(F.broadcast(right.where(hot)), on).unionByName(usual)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
