"""Lookups by key, value, prefix and order over the current view.  All are filters or equi-joins that the optimizer can push to the scan.

Results are bags: a row whose list holds a match twice comes back twice; callers that want sets drop duplicates by key.  A null sample
matches nothing; an empty prefix matches every row with a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """Point lookup: an equality on the stored column, which Parquet row groups and partitions can skip by."""
    return rows.where(F.col(key) == F.lit(value))


def by_keys(rows: DataFrame, key: str, probes: DataFrame, probe: str) -> DataFrame:
    """Batched lookup as one semi-join; which side is broadcast, if any, is decided by its measured size."""
    return rows.join(probes.select(F.col(probe).alias("__probe")), F.col(key) == F.col("__probe"), "left_semi")


def by_value(rows: DataFrame, column: str, value, ignore_case: bool = False) -> DataFrame:
    """Equality on one column."""
    return rows.where(F.upper(column) == F.upper(F.lit(value))) if ignore_case else rows.where(F.col(column) == F.lit(value))


def by_any_value(rows: DataFrame, values: Column, value, ignore_case: bool = False) -> DataFrame:
    """Equality with any element of a list: one row per element that matches.

    Counting the matches before the explode keeps rows without one out of it, and a row is never multiplied by its other elements.
    """
    fold = (lambda c: F.upper(c)) if ignore_case else (lambda c: c)
    hits = F.size(F.filter(values, lambda v: fold(v) == fold(F.lit(value))))
    return rows.withColumn("__n", hits).where("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "__i")


def with_upper(rows: DataFrame, *columns: str) -> DataFrame:
    """Stored upper-case twins (``<column>_upper``): prefixes of them push down to the scan, while upper(column) does not."""
    return rows.withColumns({f"{c}_upper": F.upper(c) for c in columns})


def by_prefix(rows: DataFrame, column: str, prefix: str, ignore_case: bool = True, stored_upper: str | None = None) -> DataFrame:
    """Rows whose value begins with ``prefix``; on a stored upper-case column if there is one."""
    if not ignore_case:
        return rows.where(F.col(column).startswith(prefix))
    return rows.where((F.col(stored_upper) if stored_upper else F.upper(column)).startswith(prefix.upper()))


def by_sample(rows: DataFrame, sample: dict) -> DataFrame:
    """Rows equal to a sample in all of its columns (a comparator's key columns)."""
    for c, v in sample.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows


def by_level(rows: DataFrame, column: str, low, high) -> DataFrame:
    """Rows where a monotone level function is 0, written as the range that it stands for, so that it pushes down."""
    return rows.where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))


def head(rows: DataFrame, *order: Column, n: int, skip: int = 0) -> DataFrame:
    """The first n rows of an order after ``skip``: a top-k, not a sort of everything."""
    x = rows.orderBy(*order)
    return (x.offset(skip) if skip else x).limit(n)


def ranked(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Every row with its position (from 1) in a total order over all rows, without a single-partition window.

    Rows are range-partitioned and sorted; each partition then adds the sizes of those before it.  The written table fixes the sampled bounds.
    """
    from pyspark.sql import Window

    from amberlog.plans.scratch import cut

    part = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return part.withColumn("__in", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")
