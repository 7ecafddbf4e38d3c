"""Equi-width histograms over integer keys, and the range of sorted positions in which a key must lie.

With n = number of keys / 16 buckets, a key belongs to bucket (key - min) * (n - 1) / (max - min), divided as integers toward zero; with
fewer than 16 keys, or one distinct key, there is one bucket.  A key outside the buckets has the empty range.  Keys are counted per bucket
before the shuffle; only bucket counts move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys per bucket on average.
PER_BUCKET = 16


def bounds(keys: DataFrame, key: str, per_bucket: int = PER_BUCKET) -> tuple[int, int, int] | None:
    """(min, max, buckets), or None without keys; one aggregate over the key column (from file statistics where the source has them)."""
    r = keys.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    if not r["n"]:
        return None
    n = r["n"] // per_bucket
    return (int(r["lo"]), int(r["hi"]), 1 if n < 1 or r["lo"] == r["hi"] else n)


def bucket(key: Column, lo: int, hi: int, n: int) -> Column:
    if n == 1:
        return F.lit(0).cast("bigint")
    x = (key.cast("decimal(20,0)") - lo) * (n - 1)
    return F.when(x >= 0, F.floor(x / (hi - lo))).otherwise(F.ceil(x / (hi - lo))).cast("bigint")


def histogram(keys: DataFrame, key: str, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(pos, c, start): bucket, keys in it, keys before it; buckets without keys are left out."""
    b = bounds(keys, key, per_bucket)
    if b is None:
        return keys.select(F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("start")).limit(0)
    counts = keys.where(F.col(key).isNotNull()).groupBy(bucket(F.col(key), *b).alias("pos")).agg(F.count(F.lit(1)).alias("c"))
    # bucket counts are a sixteenth of the keys; their running sum goes by blocks of buckets, so no task holds all of them
    block = F.floor(F.col("pos") / 65_536)
    inner = counts.withColumn("block", block).withColumn("in_block", F.sum("c").over(Window.partitionBy("block").orderBy("pos")) - F.col("c"))
    blocks = inner.groupBy("block").agg(F.sum("c").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("block")) - F.col("n")).select("block", "before")
    return inner.join(blocks, "block").select("pos", "c", (F.col("before") + F.col("in_block")).cast("bigint").alias("start"))


def key_range(keys: DataFrame, key: str, value: int) -> DataFrame:
    """(start, numb): the range of sorted positions of one key; (0, 0) where the key lies outside all buckets."""
    b = bounds(keys, key)
    spark = keys.sparkSession
    if b is None:
        return spark.createDataFrame([(0, 0)], "start bigint, numb bigint")
    lo, hi, n = b
    at = 0 if n == 1 else int((value - lo) * (n - 1) / (hi - lo)) if abs((value - lo) * (n - 1)) < 1 << 53 else (value - lo) * (n - 1) // (hi - lo)
    if not 0 <= at < n:
        return spark.createDataFrame([(0, 0)], "start bigint, numb bigint")
    pos = bucket(F.col(key), *b)
    return keys.where(F.col(key).isNotNull()).agg(
        F.coalesce(F.sum((pos < at).cast("bigint")), F.lit(0)).alias("start"), F.coalesce(F.sum((pos == at).cast("bigint")), F.lit(0)).alias("numb")
    )
