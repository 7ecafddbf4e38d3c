"""How often every term occurs in a corpus, in how many records, and which terms are too rare or too common.

Each task turns its rows into term counts per record and sums them in a hash table before anything moves (Spark's partial aggregation after
the counting of each batch); a first shuffle by (field, term, record) makes records distinct, a second, of one row per (field, term, task),
sums.  A record with a third of all rows, or a term in every row, is spread by the other columns of the first key and combined before the
second.  No list of records or terms is kept anywhere.

Defined results.  Null and blank values have no terms.  A row with an empty key belongs to no record and is left out, like rows of
deletions.  Repeated rows count again as occurrences, not as records.  An empty corpus has no terms.  Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberlog.functions.entries import narrowed
from amberlog.functions.names import is_delete, key_of, local_lower

#: Terms in fewer records than this are rare; terms in more than this share of the records are common.
RARE_BELOW, COMMON_ABOVE = 3, 0.05
_RUNS = regex.compile(r"[\p{L}\p{Nd}]+")
FORMAT_CHARACTERS = regex.compile(r"\p{Cf}+")
_ASCII = re.compile(r"[A-Za-z0-9]+")


def terms(value: str | None) -> list[str]:
    """The longest runs of letters and digits of a value without format characters, composed and in lower case."""
    if not value:
        return []
    if value.isascii():
        return _ASCII.findall(value.lower())
    text = unicodedata.normalize("NFC", FORMAT_CHARACTERS.sub("", value)).lower()
    return _RUNS.findall(text)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: Counter = Counter()
        known: dict[str, list[str]] = {}
        for rec, tp, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if tp:
                counts["tp", tp, rec] += 1
            for v in values or ():
                if v:
                    found = known.get(v)
                    if found is None:
                        found = terms(v)
                        if len(v) < 64:
                            known[v] = found
                    for t in found:
                        counts["value", t, rec] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(counts.values()), pa.int64())], ["field", "term", "rec", "n"])


def record_terms(log: DataFrame) -> DataFrame:
    """(field, term, rec, n): occurrences of each term in each record."""
    values = F.transform(F.filter(narrowed("props", "tag", "value"), lambda e: e["tag"] == 1), lambda e: e["value"])
    rows = log.where(~is_delete("tp")).select(key_of("id").alias("rec"), local_lower("tp").alias("tp"), values.alias("values")).where("rec <> ''")
    counted = rows.mapInArrow(_count, "field string, term string, rec string, n bigint")
    return counted.groupBy("field", "term", "rec").agg(F.sum("n").alias("n"))


def term_frequencies(log: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """(field, term, n_occurrences, n_records, mark): mark is rare, common or null."""
    n_all = log.where(~is_delete("tp")).select(key_of("id").alias("rec")).where("rec <> ''").agg(F.count_distinct("rec")).first()[0]
    summed = record_terms(log).groupBy("field", "term").agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records"))
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * n_all, "common")
    return summed.select("field", "term", "n_occurrences", "n_records", mark.alias("mark"))
