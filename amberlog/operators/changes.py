"""Applying a stream of inserts, updates and deletes with delete vectors.

A table is a set of files of row images that are never rewritten.  A row image has a position: its file and its row number there.  Three
things are kept beside the files:

* the *index*, key -> position and order of the image that counts (tombstones too, so that a late older change cannot revive a record);
* the *delete vectors*, one bit per position for superseded or deleted images, in blocks of 32,768 positions (4 KB) per file;
* nothing else: a reader scans the files and filters positions by the vectors.

The image that counts has the latest change time; of equal times the one with the smallest sequence number; an unreadable time is older than
any other.  Choosing it is a maximum over a struct per key, which each task sorts and combines before the shuffle: a key with a third of all
rows is no hot group.  The vector of a block is the complement of the positions that the index points to, so no row is joined to find
superseded rows, and what moves is one bit per live row.  Blocks without a set bit have no vector.

A table that takes batches (:class:`MergeOnReadTable`) keeps its index in buckets of keys.  A batch reads and rewrites the buckets of its keys
alone, and adds vectors of just the bits that it sets; a reader puts the vectors of a block together with a bitwise or.

Defined results.  Rows with a null or empty key are changes of nothing and never live.  Repeated changes are harmless.  Null in any other
column is carried along.  Empty tables give empty states.  Other columns of the log, whatever their names, stay in the images.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlog.functions.names import is_delete, key_of
from amberlog.functions.times import change_time
from amberlog.plans.scratch import discard, written

#: Positions per block of a delete vector: the bitmap size of Spark's bitmap functions.
BLOCK = 32_768
#: Vectors up to this many bytes are sent to every executor; larger ones are joined by (file, block).
BROADCAST_BYTES = 32 << 20
#: Reserved names of the position columns, so that columns of the log cannot clash with them.
FILE, POS = "__file", "__pos"


def with_positions(log: DataFrame) -> DataFrame:
    """The rows of Parquet files with the position of each: file and row number in it."""
    return log.withColumns({FILE: F.col("_metadata.file_path"), POS: F.col("_metadata.row_index")})


def order_of(seq: Column, mt: Column) -> Column:
    """A struct that is greatest for the change that counts."""
    return F.struct(F.coalesce(change_time(mt), F.lit(-(1 << 62))).alias("at"), F.bitwise_not(seq).alias("first"))


def packed_order(seq: Column, mt: Column, tombstone: Column) -> Column:
    """The order of a change as one number that is greatest for the change that counts, and odd for a tombstone.

    A maximum over numbers is kept in a hash table, without the sort that one over structs takes.  Times lie between the years 1 and 9999, so
    the number has at most 38 digits: time * 4e19 + (2^63 - 1 - seq) * 2 + flag.
    """
    at = F.coalesce(change_time(mt), F.lit(-(10**17))).cast("decimal(18,0)")
    later = F.coalesce(F.lit(Decimal((1 << 63) - 1)) - seq.cast("decimal(19,0)"), F.lit(Decimal(-1)))  # a row without number comes after all others of its time
    return (at * F.lit(Decimal(4 * 10**19)) + later * F.lit(Decimal(2)) + tombstone.cast("int").cast("decimal(1,0)")).cast("decimal(38,0)")


def key_index(positions: DataFrame, key: Column, order: Column, tombstone: Column) -> DataFrame:
    """(key, ord, file, pos, dead): the image that counts for each key."""
    x = positions.select(key.alias("key"), F.struct(order.alias("ord"), F.col(FILE).alias("file"), F.col(POS).alias("pos"), tombstone.alias("dead")).alias("v")).where("key <> ''")
    return x.groupBy("key").agg(F.max("v").alias("v")).select("key", "v.*")


def _blocks(positions: DataFrame, file: str, pos: str, bits: str) -> DataFrame:
    """(file, block, bits): a bitmap of the given positions of each block."""
    return positions.groupBy(F.col(file).alias("file"), F.floor(F.col(pos) / BLOCK).alias("block")).agg(F.bitmap_construct_agg((F.col(pos) % BLOCK).cast("bigint")).alias(bits))


def _complement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    full = np.full(BLOCK // 8, 0xFF, np.uint8)
    for b in batches:
        out = [(full if live is None else ~np.frombuffer(live, np.uint8)) for live in b.column("alive").to_pylist()]
        kept = [i for i, x in enumerate(out) if x.any()]
        yield pa.RecordBatch.from_arrays([b.column("file").take(kept), b.column("block").take(kept), pa.array([out[i].tobytes() for i in kept], pa.binary())], ["file", "block", "dead"])


def delete_vectors(positions: DataFrame, index: DataFrame) -> DataFrame:
    """(file, block, dead): a bitmap of the superseded or deleted positions of each block that has any; bits beyond the end of a file mean nothing."""
    last = positions.groupBy(F.col(FILE).alias("file")).agg(F.max(POS).alias("last"))
    there = last.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / BLOCK))).alias("block"))
    x = there.join(_blocks(index.where("not dead"), "file", "pos", "alive"), ["file", "block"], "left").select("file", "block", "alive")
    return x.mapInArrow(_complement, "file string, block bigint, dead binary")


def _bit(bits: str, at: Column) -> Column:
    """Whether bit ``at`` of a bitmap is set; bit i is bit i % 8 of byte i / 8, as bitmap_construct_agg sets it."""
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return F.call_function("getbit", byte, (at % 8).cast("int")) == 1


def read_live(positions: DataFrame, vectors: DataFrame) -> DataFrame:
    """The live images: positions whose bit is not set.  Vectors are broadcast only below BROADCAST_BYTES, a measured size."""
    v = vectors.select(F.col("file").alias("__vf"), F.col("block").alias("__vb"), F.col("dead").alias("__dead"))
    held = vectors.agg(F.coalesce(F.sum(F.length("dead") + F.length("file") + 16), F.lit(0))).first()[0]
    v = F.broadcast(v) if held <= BROADCAST_BYTES else v
    at = F.col(POS) % BLOCK
    joined = positions.join(v, (F.col(FILE) == F.col("__vf")) & (F.floor(F.col(POS) / BLOCK) == F.col("__vb")), "left")
    return joined.where(F.col("__dead").isNull() | ~_bit("__dead", at)).drop("__vf", "__vb", "__dead")


def current_state(log: DataFrame, key: str = "id", seq: str = "seq", mt: str = "mt", tp: str = "tp") -> DataFrame:
    """The rows of ``log`` (read from Parquet) that hold a state after all changes, with their key in the column ``__key``."""
    rows = with_positions(log)
    index = key_index(rows, key_of(key), order_of(F.col(seq), F.col(mt)), is_delete(tp))
    vectors = written(delete_vectors(rows.select(FILE, POS), index), "vectors")
    return read_live(rows, vectors).withColumn("__key", key_of(key)).drop(FILE, POS)


class MergeOnReadTable:
    """A table under ``root`` to which batches of changes are applied one after the other; each batch adds files and versions, rewrites none.

    The index lies in ``buckets`` of keys; a manifest per version says which version wrote each bucket last.  What a batch reads and writes
    grows with the batch and the buckets that its keys fall into, not with the table: no image and no vector of an earlier batch is read.
    Applying a version again overwrites just what it wrote, so a batch that runs twice counts once.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "id", seq: str = "seq", mt: str = "mt", tp: str = "tp", buckets: int = 64, version: int = -1):
        self.spark, self.root, self.key, self.seq, self.mt, self.tp = spark, root.rstrip("/"), key, seq, mt, tp
        self.buckets, self.version = buckets, version

    def _at(self, what: str, version: int) -> str:
        return f"{self.root}/{what}/v={version}"

    def _manifest(self, version: int) -> dict[int, int]:
        """Bucket -> version that holds it; at most ``buckets`` rows."""
        return {r["bucket"]: r["held"] for r in self.spark.read.parquet(self._at("manifest", version)).collect()} if version >= 0 else {}

    def _index(self, held: dict[int, int], schema: str) -> DataFrame:
        paths = [f"{self._at('index', v)}/bucket={b}" for b, v in held.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, changes: DataFrame) -> None:
        """Appends the images of a batch, moves the index of its keys on, and sets the bits of the images that it superseded."""
        v = self.version + 1
        changes.write.mode("overwrite").parquet(self._at("images", v))
        fresh = with_positions(self.spark.read.schema(changes.schema).parquet(self._at("images", v)))
        best = key_index(fresh, key_of(self.key), order_of(F.col(self.seq), F.col(self.mt)), is_delete(self.tp))
        best = written(best.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")), "batch")
        manifest = self._manifest(v - 1)
        touched = sorted(r["bucket"] for r in best.select("bucket").distinct().collect())
        schema = "key string, ord struct<at: bigint, first: bigint>, file string, pos bigint, dead boolean"
        old = self._index({b: manifest[b] for b in touched if b in manifest}, schema)
        image = ("ord", "file", "pos", "dead")
        both = best.select("key", F.struct(*image).alias("new"), "bucket").join(old.select("key", F.struct(*image).alias("old"), F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("b")), "key", "full")
        top = written(both.select("key", F.coalesce("bucket", "b").alias("bucket"), "new", "old", F.greatest("new", "old").alias("top")), "moved")
        top.select("key", *(F.col(f"top.{c}") for c in image), "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._at("index", v))
        won = top.where("new is not null and (old is null or new > old)")
        in_batch = delete_vectors(fresh.select(FILE, POS), won.select("new.*"))
        before = _blocks(won.where("old is not null and not old.dead").select("old.file", "old.pos"), "file", "pos", "dead")
        in_batch.unionByName(before).write.mode("overwrite").parquet(self._at("vectors", v))
        held = manifest | dict.fromkeys(touched, v)
        self.spark.createDataFrame(sorted(held.items()), "bucket int, held int").coalesce(1).write.mode("overwrite").parquet(self._at("manifest", v))
        self.version = v
        discard(top)
        discard(best)

    def _images(self) -> DataFrame:
        return with_positions(self.spark.read.parquet(*(self._at("images", i) for i in range(self.version + 1))))

    def read(self) -> DataFrame:
        """The current state."""
        vectors = self.spark.read.parquet(*(self._at("vectors", i) for i in range(self.version + 1)))
        merged = written(vectors.groupBy("file", "block").agg(F.bitmap_or_agg("dead").alias("dead")), "vectors")
        return read_live(self._images(), merged).drop(FILE, POS)
