"""Dictionary encoding: strings to dense codes in the order of their first occurrence.  Null strings have no code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberlog.operators.lookup import ranked


def encode_table(strings: DataFrame, string: str, order: str) -> DataFrame:
    """(s, code): codes from 0 by first occurrence; the total order is ranked by ranges, not in one task."""
    first = strings.where(F.col(string).isNotNull()).groupBy(F.col(string).alias("s")).agg(F.min(order).alias("__first"))
    return ranked(first, ["__first", "s"], "__pos").select("s", (F.col("__pos") - 1).cast("bigint").alias("code"))


def extend(table: DataFrame, strings: DataFrame, string: str, order: str) -> DataFrame:
    """The table with codes for strings that it lacks, from its greatest code on; known codes never change."""
    new = strings.join(table.select(F.col("s").alias("__s")), F.col(string) == F.col("__s"), "left_anti")
    top = table.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
    return table.unionByName(encode_table(new, string, order).withColumn("code", F.col("code") + F.lit(top)))


def codes_of(rows: DataFrame, column: str, table: DataFrame, name: str) -> DataFrame:
    """Rows with the code of a column, null where the string has none."""
    t = table.select(F.col("s").alias("__s"), F.col("code").alias(name))
    return rows.join(t, F.col(column) == F.col("__s"), "left").drop("__s")


def strings_of(rows: DataFrame, column: str, table: DataFrame, name: str) -> DataFrame:
    """Rows with the string of a code column, null where the code is unknown."""
    t = table.select(F.col("code").alias("__code"), F.col("s").alias(name))
    return rows.join(t, F.col(column) == F.col("__code"), "left").drop("__code")
