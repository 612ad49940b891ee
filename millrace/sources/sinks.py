"""Sinks: reports, keyed refresh, review sheets and load scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def refreshed(previous: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """The next state of a keyed table: unchanged rows keep their old values, stale keys go.

    Only rows whose digest changed come from ``current``, so what was derived from the others need not be redone.
    """
    same = previous.join(current.select(key, digest), [key, digest], "left_semi")
    fresh = current.join(same.select(key), key, "left_anti")
    return same.unionByName(fresh, allowMissingColumns=True)


def stale_keys(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return previous.select(key).join(current.select(key), key, "left_anti")


def review_sheet(df: DataFrame) -> DataFrame:
    """Strings for a spreadsheet: lists joined by semicolons, maps as JSON."""

    def cell(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        c = F.col(name)
        return F.array_join(c.cast("array<string>"), ";") if kind == "array" else F.to_json(c) if kind in ("map", "struct") else c.cast("string")

    return df.select(*[cell(n).alias(n) for n in df.columns])


def sql_literal(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One insert statement a row, which leaves rows that exist alone."""
    values = F.concat_ws(", ", *[sql_literal(F.col(n)) for n in df.columns])
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(") ON CONFLICT DO NOTHING;")).alias("value"))
