"""Edits of records: new ids and stamps, puts, updates and deletions, all as rows appended to the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberlog.operators.lookup import ranked
from amberlog.plans.scratch import cut


def stamped(rows: DataFrame, prefix: str, counter: int, at: str, by: list[str]) -> tuple[DataFrame, int]:
    """(rows, next counter): rows with ids where they have none (prefix and counter, in the order of ``by``), the time ``at`` and no blank fields."""
    new = ranked(rows.where("id is null or id = ''"), by, "__n").withColumn("id", F.concat(F.lit(prefix), (F.col("__n") - 1 + F.lit(counter)).cast("string"))).drop("__n")
    old = rows.where("id is not null and id <> ''")
    kept = F.filter("props", lambda e: (e["tag"] != 1) | (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))
    out = old.unionByName(new).withColumn("mt", F.lit(at)).withColumn("props", F.coalesce(kept, F.col("props")))
    return out, counter + new.count()


def deletion(ids: DataFrame, like: DataFrame, at: str) -> DataFrame:
    """Tombstones for ids, with the columns of ``like``."""
    x = ids.select(F.col("id"), F.lit("delete").alias("tp"), F.lit(at).alias("mt"))
    return x.select(*(F.col(c) if c in x.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns))


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    """New versions of records, with the fields of the old ones whose property and language they do not mention; old links are not carried.

    The entries of one record meet in one row, as they lie in both inputs already.
    """
    before = old.select(F.col("id").alias("__id"), F.col("props").alias("__old"))
    joined = new.join(before, F.col("id") == F.col("__id"), "left")
    same = lambda a, b: (a["prop"] == b["prop"]) & F.coalesce(a["lang"], F.lit("")).eqNullSafe(F.coalesce(b["lang"], F.lit("")))
    kept = F.filter(F.coalesce("__old", F.array().cast(old.schema["props"].dataType)), lambda o: (o["tag"] == 1) & ~F.exists("props", lambda n: (n["tag"] == 1) & same(o, n)))
    return joined.withColumn("props", F.concat(F.coalesce("props", F.array().cast(new.schema["props"].dataType)), kept)).drop("__id", "__old")


def put(log_rows: DataFrame, record_rows: DataFrame, order: str, at: str, prefix: str = "r", counter: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the log with the records appended, the records as they were put): stamped, with ids and positions after all others."""
    from amberlog.operators.log import append

    known = record_rows.columns
    x = record_rows.withColumn("__by", F.xxhash64(*(F.col(c) for c in known if c != "props")))
    done, _ = stamped(x, prefix, counter, at, ["__by"])
    placed = append(log_rows, done.drop("__by"), order, ["id"])
    shaped = placed.select(*(F.col(c) if c in placed.columns else F.lit(None).cast(log_rows.schema[c].dataType).alias(c) for c in log_rows.columns))
    return log_rows.unionByName(shaped), shaped


def without_records(record_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Records without those of ``ids``, and without the link entries that point to them.

    Only records that hold such a link are rewritten; which links those are is found by a join of links, not by a list of ids.
    """
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    kept = cut(record_rows.join(gone, F.col("id") == F.col("__gone"), "left_anti").withColumn("__row", F.monotonically_increasing_id()))  # written, so that numbers stay what they are
    hit = kept.select("__row", F.explode(F.transform("props", lambda e: F.coalesce(e["link"], e["sourcelink"]))).alias("__to")).join(gone, F.col("__to") == F.col("__gone"))
    lost = hit.groupBy(F.col("__row").alias("__r")).agg(F.collect_set("__gone").alias("__lost"))
    stays = lambda e: ~F.array_contains(F.col("__lost"), F.coalesce(e["link"], e["sourcelink"], F.lit("")))
    props = F.when(F.col("__lost").isNull(), F.col("props")).otherwise(F.filter("props", stays))
    return kept.join(lost, F.col("__row") == F.col("__r"), "left").withColumn("props", props).drop("__row", "__r", "__lost")
