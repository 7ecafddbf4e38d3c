"""A keyed table with numbered indexes over an append log, and the written form of its indexes.

The table is the log: the newest row of a key counts, and then empty rows are hidden.  An index says by what rows are found; which plan a lookup
takes follows from the kind of the index:

* ``value``: equality with a value (or, for a list-valued expression, with any of its elements: one row per element that matches);
* ``ordered``: equality, prefixes and ranges, in the order of the value.

:meth:`Table.build` writes each index as a table of (value, key): value indexes in hash buckets of the value, ordered ones in ranges sorted by
it, so that a lookup reads one bucket or the row groups of a range, then fetches the rows of the few keys it found.

Defined results.  Null keys are no records, null values are found by nothing.  Rows appended after a build are found by the indexes of the rows
themselves, as long as they are not built in.  A lookup by value gives a row per match, so a list that holds a value twice gives its row twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amberlog.operators import log


@dataclass(frozen=True)
class Index:
    """What rows are found by; with ``ignore_case`` values compare in upper case; ``where`` says which rows are in it (all if null)."""

    value: Column
    kind: str = "value"
    ignore_case: bool = False
    where: Column | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("value", "ordered"):
            raise ValueError(f"no such kind of index: {self.kind}")


class Table:
    def __init__(self, rows: DataFrame, key: str, order: list[str], is_empty: Column | None = None, indexes: tuple[Index, ...] = ()):
        self.rows, self.key, self.order, self.indexes = rows, key, order, indexes
        self.is_empty = F.lit(False) if is_empty is None else is_empty
        self.built: dict[int, str] = {}
        self.buckets = 0

    def current(self) -> DataFrame:
        return log.current(self.rows, self.key, self.order, self.is_empty)

    def get(self, value) -> DataFrame:
        """The current row of a key: the key filter reaches the scan before anything is grouped."""
        return log.current(self.rows.where(F.col(self.key) == F.lit(value)), self.key, self.order, self.is_empty)

    def versions(self, value) -> DataFrame:
        """All rows of a key, superseded and empty ones too."""
        return self.rows.where(F.col(self.key) == F.lit(value))

    def appended(self, rows: DataFrame) -> Table:
        """The table with more rows; what was built is not used any more."""
        return Table(self.rows.unionByName(rows), self.key, self.order, self.is_empty, self.indexes)

    def _entries(self, i: int) -> DataFrame:
        """(__key, __value): a row per value of each current row."""
        x, own = self.indexes[i], self.current()
        own = own.where(x.where) if x.where is not None else own
        listed = isinstance(own.select(x.value.alias("v")).schema["v"].dataType, T.ArrayType)
        entries = own.select(F.col(self.key).alias("__key"), (F.explode(x.value) if listed else x.value).alias("__value")).where("__value is not null")
        return entries.withColumn("__value", F.upper("__value")) if x.ignore_case else entries

    def _fold(self, i: int, value):
        return value.upper() if self.indexes[i].ignore_case and isinstance(value, str) else value

    def build(self, path: str, buckets: int = 64) -> None:
        """Writes all indexes under a path."""
        self.buckets = buckets
        for i, x in enumerate(self.indexes):
            at, entries = f"{path.rstrip('/')}/index={i}", self._entries(i)
            if x.kind == "ordered":
                entries.repartitionByRange("__value", "__key").sortWithinPartitions("__value").write.mode("overwrite").parquet(at)
            else:
                placed = entries.withColumn("__bucket", F.pmod(F.xxhash64("__value"), F.lit(buckets)))
                placed.repartition("__bucket").sortWithinPartitions("__bucket", "__value").write.mode("overwrite").partitionBy("__bucket").parquet(at)
            self.built[i] = at

    def _index(self, i: int) -> DataFrame:
        return self.rows.sparkSession.read.parquet(self.built[i]) if i in self.built else self._entries(i)

    def _rows_of(self, found: DataFrame) -> DataFrame:
        """The current rows of the keys found, a row per find; only rows of these keys are grouped."""
        keys = found.select("__key").distinct()
        own = log.current(self.rows.join(keys, F.col(self.key) == F.col("__key"), "left_semi"), self.key, self.order, self.is_empty)
        return own.join(found.select("__key"), F.col(self.key) == F.col("__key")).drop("__key")

    def all_using(self, i: int, value) -> DataFrame:
        """The rows that an index finds by a value."""
        value = self._fold(i, value)
        found = self._index(i).where(F.col("__value") == F.lit(value))
        if i in self.built and self.indexes[i].kind == "value":
            kind = found.schema["__value"].dataType
            found = found.where(F.col("__bucket") == F.pmod(F.xxhash64(F.lit(value).cast(kind)), F.lit(self.buckets)))
        return self._rows_of(found)

    def like_using(self, i: int, prefix: str) -> DataFrame:
        """The rows whose value in an ordered index begins with a prefix."""
        return self._rows_of(self._index(i).where(F.col("__value").startswith(self._fold(i, prefix))))

    def range_using(self, i: int, low, high) -> DataFrame:
        """The rows whose value in an ordered index is at least ``low`` and below ``high``."""
        return self._rows_of(self._index(i).where((F.col("__value") >= F.lit(low)) & (F.col("__value") < F.lit(high))))
