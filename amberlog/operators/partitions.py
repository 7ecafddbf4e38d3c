"""Hash-partitioned tables: routing by key, tables of secondary keys, and lookups through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section(key: str, n: int) -> Column:
    """The section of a key; never negative, whatever the key."""
    return F.pmod(F.col(key), F.lit(n))


def write_sections(rows: DataFrame, key: str, n: int, path: str) -> None:
    """A table with a directory per section, for lookups that read one of them."""
    rows.withColumn("section", section(key, n)).repartition(n, "section").write.mode("overwrite").partitionBy("section").parquet(path)


def read_key(spark, path: str, key: str, value: int, n: int) -> DataFrame:
    """A point lookup that reads one section: the partition filter prunes the others, the key filter the row groups."""
    return spark.read.parquet(path).where((F.col("section") == value % n) & (F.col(key) == value)).drop("section")


def secondary(rows: DataFrame, external: str, primary: list[str]) -> DataFrame:
    """The table of a secondary key: (external, primary...); several rows per external key."""
    return rows.where(F.col(external).isNotNull()).select(external, *primary)


def latest_offset(log: DataFrame, key: str, offset: str) -> DataFrame:
    """(key, off): one entry per key, the largest offset kept."""
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(offset).alias("off"))


def configuration(spark, tables: dict[str, list[str]], nodes: int, sections: int) -> tuple[DataFrame, DataFrame]:
    """(tables, sections): (tab, name, external) with the secondary keys of each table, and (tab, part, node) with each section's owner in turn."""
    named = [(i, n, list(e)) for i, (n, e) in enumerate(tables.items())]
    placed = [(i, p, p % nodes) for i, _, _ in named for p in range(sections)]
    return spark.createDataFrame(named, "tab int, name string, external array<string>"), spark.createDataFrame(placed, "tab int, part int, node int")


def routed(rows: DataFrame, key: str, tab: int, sections: DataFrame) -> DataFrame:
    """Rows with the section and the node that own their key, by the configuration (a row per section)."""
    own = sections.where(F.col("tab") == tab).select(F.col("part").alias("__part"), F.col("node").alias("__node"))
    n = own.count()
    return rows.withColumn("__s", section(key, n)).join(own, F.col("__s") == F.col("__part")).withColumn("node", F.col("__node")).withColumn("part", F.col("__part").cast("int")).drop("__s", "__part", "__node")


def append_rows(rows: DataFrame, key: str, n: int, path: str, secondary_keys: tuple[str, ...] = ()) -> None:
    """Appends rows to their sections, and to the table of each secondary key under the same path."""
    rows.withColumn("section", section(key, n)).repartition(n, "section").write.mode("append").partitionBy("section").parquet(f"{path}/rows")
    for s in secondary_keys:
        ext = secondary(rows, s, [key])
        ext.withColumn("section", F.pmod(F.xxhash64(s), F.lit(n))).repartition(n, "section").write.mode("append").partitionBy("section").parquet(f"{path}/by_{s}")


def by_secondary(spark, path: str, key: str, external: str, value, n: int) -> DataFrame:
    """The rows of a secondary key: one section of its table, then the sections of the keys found there."""
    found = spark.read.parquet(f"{path}/by_{external}")
    kind = found.schema[external].dataType
    found = found.where((F.col("section") == F.pmod(F.xxhash64(F.lit(value).cast(kind)), F.lit(n))) & (F.col(external) == F.lit(value)))
    keys = found.select(F.col(key).alias("__k"), section(key, n).alias("__s")).distinct()
    return spark.read.parquet(f"{path}/rows").join(keys, (F.col("section") == F.col("__s")) & (F.col(key) == F.col("__k"))).drop("section", "__k", "__s")
