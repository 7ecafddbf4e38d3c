"""References to records that do not exist: missing, deleted or defined later.

References and parents are co-partitioned by key, sorted, and merged in one linear pass: Spark's sort-merge join, asked for by a hint.  A
parent is one row per key with its validity: the first row that defines it, and whether it still exists in the end.  A key with more references
than a PARTS-th of all (and than PIECE) is salted into as many pieces as it has such portions, and only its parent is repeated: no task gets
more than a portion of one key, however large the log, and fewer than PARTS keys are salted, whatever the data.

Defined results.  Null or blank links are no references.  Referring rows of deletions are left out, null entries and other tags too.  Null
ids define nothing.  Repeated rows refer once each.  An empty log has no references.  Other columns of the log are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from amberlog.functions.entries import narrowed
from amberlog.functions.names import is_delete, key_of
from amberlog.operators.changes import packed_order
from amberlog.plans.scratch import cut

#: References that a piece of a hot key has at least, and the portions that all references are thought of as.
PIECE, PARTS = 10_000, 2_048


def references(log: DataFrame) -> DataFrame:
    """(seq, pos, tp, arrived, target): one row per link entry of rows that are not deletions."""
    e = log.where(~is_delete("tp")).select("seq", "tp", "arrived", F.posexplode(narrowed("props", "tag", "link", "sourcelink")).alias("pos", "e"))
    target = F.when(F.col("e.tag") == 2, key_of("e.link")).when(F.col("e.tag") == 3, key_of("e.sourcelink"))
    return e.select("seq", "pos", "tp", "arrived", target.alias("target")).where("target <> ''")


def parents(log: DataFrame) -> DataFrame:
    """(key, since, exists): first defining sequence number (null: only deletions) and whether the record exists after all changes."""
    dead = is_delete("tp")
    x = log.select(key_of("id").alias("key"), packed_order(F.col("seq"), F.col("mt"), dead).alias("order"), F.when(~dead, F.col("seq")).alias("defined")).where("key <> ''")
    return x.groupBy("key").agg(F.min("defined").alias("since"), F.max("order").alias("last")).select("key", "since", (F.col("last") % 2 == 0).alias("exists"))


def orphans(refs: DataFrame, known: DataFrame) -> DataFrame:
    """The references of ``refs`` whose target is missing, deleted or late, with that status."""
    # found in one pass that sums before it shuffles and counts all references on the way; at most PARTS rows, whatever the data
    all_ = Observation()
    counts = refs.observe(all_, F.count(F.lit(1)).alias("n")).groupBy("target").agg(F.count(F.lit(1)).alias("n_refs"))
    top = cut(counts.orderBy(F.desc("n_refs"), "target").limit(PARTS))
    portion = PIECE if top.isEmpty() else max(PIECE, all_.get["n"] // PARTS)
    hot = F.broadcast(top.where(F.col("n_refs") > portion).select(F.col("target").alias("hot_key"), F.ceil(F.col("n_refs") / portion).cast("int").alias("pieces")))
    salted = refs.join(hot, F.col("target") == F.col("hot_key"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("seq", "pos"), F.col("pieces")).cast("int"), F.lit(0))).drop("pieces")
    spread = known.join(hot, F.col("key") == F.col("hot_key"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces") - 1, F.lit(0))))).drop("pieces")
    r, k = salted.drop("hot_key").hint("merge").alias("r"), spread.drop("hot_key").alias("k")
    status = F.when(F.col("k.since").isNull(), "missing").when(~F.col("k.exists"), "deleted").when(F.col("k.since") > F.col("r.seq"), "late")
    return (
        r.join(k, (F.col("r.target") == F.col("k.key")) & (F.col("r.salt") == F.col("k.salt")), "left")
        .select("r.seq", "r.pos", "r.tp", "r.arrived", "r.target", status.alias("status"))
        .where("status is not null")
    )


def orphan_report(found: DataFrame, local_type) -> DataFrame:
    """(tp, month, status, n_refs, n_targets): orphans by type of the referring record and month of arrival."""
    return found.groupBy(local_type.alias("tp"), F.date_format("arrived", "yyyy-MM").alias("month"), "status").agg(
        F.count(F.lit(1)).alias("n_refs"), F.count_distinct("target").alias("n_targets")
    )
