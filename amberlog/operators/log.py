"""The append log: newest row per key shadows the older ones, and only then are empty rows hidden.

The newest row is a maximum over a struct.  Each task sorts its own rows by key and combines them before the shuffle, so a key with very many
rows is one row per task there and no hot group, as it would be in a window.
Null keys are keys of their own kind and are left out of the current view.  Ties of the order take the greatest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(log: DataFrame, key: str, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest order, tombstones included."""
    columns = [c for c in (columns or log.columns) if c != key]
    rest = [c for c in columns if c not in order]
    top = F.max(F.struct(*order, *rest))
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(top.alias("__top")).select(key, *(F.col("__top").getField(c).alias(c) for c in columns))


def current(log: DataFrame, key: str, order: list[str], is_empty: Column, columns: list[str] | None = None) -> DataFrame:
    """The current view: newest row per key, then rows that ``is_empty`` holds for are hidden."""
    return newest(log, key, order, columns).where(~F.coalesce(is_empty, F.lit(False)))


def load(rows: DataFrame, is_empty: Column) -> DataFrame:
    """What a bulk load keeps: rows that are not empty."""
    return rows.where(~F.coalesce(is_empty, F.lit(False)))


def with_delta(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """A static part and appended rows, each with one row per key: base rows not shadowed by the delta, then the delta."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def replay(log: DataFrame, order: str, saved: int) -> DataFrame:
    """Rows appended since a saved position; a filter that reaches the scan."""
    return log.where(F.col(order) >= saved)


def compact(log: DataFrame, key: str, order: list[str], is_empty: Column, path: str) -> None:
    """Writes the current view as the new static part."""
    current(log, key, order, is_empty).write.mode("overwrite").parquet(path)


def append(log: DataFrame, rows: DataFrame, order: str, by: list[str]) -> DataFrame:
    """``rows`` with positions after the last of ``log``, in the order of ``by``; they are ranked by ranges, not in one task."""
    from amberlog.operators.lookup import ranked

    last = log.agg(F.coalesce(F.max(order) + 1, F.lit(0))).first()[0]
    return ranked(rows, by, "__at").withColumn(order, F.col("__at") - 1 + F.lit(last)).drop("__at")


def between(log: DataFrame, order: str, first: int, n: int) -> DataFrame:
    """n rows from a position on: a range that reaches the scan."""
    return log.where((F.col(order) >= first) & (F.col(order) < first + n))


def without_flagged(rows: DataFrame, flag: str) -> DataFrame:
    """Rows that are not flagged as deleted; a null flag is none."""
    return rows.where(~F.coalesce(F.col(flag), F.lit(False)))


def collisions(rows: DataFrame, code: Column, *keys: str) -> DataFrame:
    """(n_rows, n_codes, n_keys): how often different keys share a code."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(code).alias("n_codes"), F.count_distinct(*keys).alias("n_keys"))


def stored_order(rows: DataFrame, order: str) -> DataFrame:
    """All rows in the order in which they were stored: a sort by ranges."""
    return rows.orderBy(order)


def at(rows: DataFrame, order: str, position: int) -> DataFrame:
    """The row at a position: a filter that reaches the scan."""
    return rows.where(F.col(order) == position)


def overwritten(rows: DataFrame, order: str, changes: DataFrame) -> DataFrame:
    """Rows with those at the positions of ``changes`` replaced by them (columns that changes lack stay); other positions of changes are ignored."""
    given = [c for c in changes.columns if c != order]
    new = changes.select(F.col(order).alias("__at"), *(F.col(c).alias(f"__{c}") for c in given), F.lit(True).alias("__hit"))
    x = rows.join(new, F.col(order) == F.col("__at"), "left")
    return x.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in rows.columns))
