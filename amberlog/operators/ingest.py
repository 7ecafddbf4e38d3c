"""Ingest rules: deletions, substitutions of ids, newest definition wins, redirected links.

Null ids define nothing.  A deletion beats every definition of its id.  Substitutions are followed to the end of their chain; those in a
cycle keep the id they have.  Of equal times the definition that comes first counts, and a missing time is older than any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlog.plans.scratch import cut


def without_deleted(rows: DataFrame, key: str, deletions: DataFrame, deleted: str) -> DataFrame:
    return rows.join(deletions.select(F.col(deleted).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def latest_substitutes(rows: DataFrame, old: str, new: str, order: str, deleted: DataFrame | None = None, deleted_id: str = "id") -> DataFrame:
    """(a, b): one pair per old id, the last in ``order`` (of equal ones the greatest new id); ids that are deleted are substituted by nothing."""
    last = rows.where(F.col(old).isNotNull() & F.col(new).isNotNull()).groupBy(F.col(old).alias("a")).agg(F.max_by(new, F.struct(order, new)).alias("b"))
    return last if deleted is None else last.join(deleted.select(F.col(deleted_id).alias("__gone")), F.col("a") == F.col("__gone"), "left_anti")


def substitutes(pairs: DataFrame, old: str = "a", new: str = "b") -> DataFrame:
    """(old_id, new_id): the end of the chain of every id, by pointer doubling: a chain of length L takes log L joins, not L.

    pairs has one row per old id.  What still moves after as many rounds as the longest possible chain needs leads into a cycle.
    """
    step = cut(pairs.select(F.col(old).alias("old_id"), F.col(new).alias("new_id"), F.lit(True).alias("moved")))
    n = step.count()
    for r in range(n.bit_length() + 1):
        ahead = step.select(F.col("old_id").alias("__via"), F.col("new_id").alias("__to"))
        step = cut(step.join(ahead, F.col("new_id") == F.col("__via"), "left").select("old_id", F.coalesce("__to", "new_id").alias("new_id"), F.col("__to").isNotNull().alias("moved")))
        if step.where("moved").isEmpty() or 1 << r > n:
            break
    return step.select("old_id", F.when(F.col("moved"), F.col("old_id")).otherwise(F.col("new_id")).alias("new_id"))


def last_definition(rows: DataFrame, key: str, time: Column, order: str, columns: list[str]) -> DataFrame:
    """One row per key: latest time, of equal times the first; a maximum over a struct, so no group is sorted in one task."""
    top = F.max_by(F.struct(*columns), F.struct(time.isNotNull(), time, -F.col(order)))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(top.alias("__v")).select(key, *(F.col("__v").getField(c).alias(c) for c in columns))


def redirect(rows: DataFrame, link: str, ends: DataFrame) -> DataFrame:
    """Links to substituted ids point to what stands for them; all others stay."""
    e = ends.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
    return rows.join(e, F.col(link) == F.col("__old"), "left").withColumn(link, F.coalesce("__new", link)).drop("__old", "__new")


def redirect_entries(records: DataFrame, ends: DataFrame, props: str = "props") -> DataFrame:
    """Records whose links to substituted ids point to what stands for them, entry by entry and in order.

    Only records that hold such a link are taken apart; the entries of one record lay in one row and do so again.
    """
    e = ends.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
    x = cut(records.withColumn("__row", F.monotonically_increasing_id()))  # written, so that numbers stay what they are
    moved = x.select("__row", F.explode(F.filter(F.transform(props, lambda e: e["link"]), lambda v: v.isNotNull())).alias("__old")).distinct().join(e, "__old")
    maps = moved.groupBy(F.col("__row").alias("__r")).agg(F.map_from_entries(F.collect_set(F.struct("__old", "__new"))).alias("__map"))
    to = lambda e: F.when(e["link"].isNotNull(), F.coalesce(F.try_element_at(F.col("__map"), e["link"]), e["link"]))
    done = F.when(F.col("__map").isNull(), F.col(props)).otherwise(F.transform(props, lambda e: e.withField("link", to(e))))
    return x.join(maps, F.col("__row") == F.col("__r"), "left").withColumn(props, done).drop("__row", "__r", "__map")


def ingested(rows: DataFrame, change_time: Column, seed: tuple[str, str] | None = None) -> DataFrame:
    """(id, tp, mt, props) from the rows of record files: deleted and substituted ids left out, the last definition of each other id, links redirected.

    rows: (file, place, kind, id, new_id, tp, mt, props), in the order of file and place.
    """
    order = F.struct("file", "place")
    deleted = rows.where("kind = 'delete'").select("id").distinct()
    pairs = latest_substitutes(rows.where("kind = 'substitute'").withColumn("__at", order), "id", "new_id", "__at", deleted)
    ends = substitutes(pairs)
    own = without_deleted(rows.where("kind = 'record'"), "id", deleted, "id")
    own = own.join(ends.select(F.col("old_id").alias("__gone")), F.col("id") == F.col("__gone"), "left_anti")
    at = F.struct(change_time.isNotNull().alias("known"), change_time.alias("time"))
    # the latest time counts, and of equal times the first row
    best = own.groupBy("id").agg(F.max(at).alias("__at")).withColumnRenamed("id", "__id")
    tied = own.withColumn("__own", at).join(best, (F.col("id") == F.col("__id")) & F.col("__own").eqNullSafe(F.col("__at")))
    last = tied.groupBy("id").agg(F.min_by(F.struct("tp", "mt", "props"), order).alias("__v")).select("id", "__v.*")
    out = redirect_entries(last, ends)
    return with_seed(out, *seed) if seed else out


def with_seed(records: DataFrame, id_: str, tp: str) -> DataFrame:
    """Records with the one row that every base starts from, unless it is there."""
    seed = records.sparkSession.createDataFrame([(id_, tp)], "id string, tp string")
    missing = seed.join(records.where(F.col("id") == id_).select("id"), "id", "left_anti")
    return records.unionByName(missing, allowMissingColumns=True)
