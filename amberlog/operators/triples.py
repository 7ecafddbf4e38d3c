"""Triples (s, p, tag, o): tag 1 for links, 2 for texts; and records {id, directs, fields} made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlog.operators import names
from amberlog.operators.lookup import ranked
from amberlog.plans.scratch import cut


def by_subject(triples: DataFrame, s: str) -> DataFrame:
    return triples.where(F.col("s") == s)


def by_target(triples: DataFrame, o: str) -> DataFrame:
    """Triples that link to ``o``; texts that happen to be equal are none."""
    return triples.where((F.col("tag") == 1) & (F.col("o") == o))


def by_text_prefix(triples: DataFrame, predicate: str, prefix: str) -> DataFrame:
    return triples.where((F.col("tag") == 2) & (F.col("p") == predicate) & F.upper("o").startswith(prefix.upper()))


def encode(triples: DataFrame, table: DataFrame) -> DataFrame:
    """(s, p, tag, iri, str): subjects, predicates and linked objects as codes of a name table, texts kept."""
    x = names.codes_of(names.codes_of(triples, "s", table, "s_code"), "p", table, "p_code").withColumn("link", F.when(F.col("tag") == 1, F.col("o")))
    x = names.codes_of(x, "link", table, "iri")
    return x.select(F.col("s_code").alias("s"), F.col("p_code").alias("p"), "tag", "iri", F.when(F.col("tag") == 2, F.col("o")).alias("str"))


#: Entries of a subject that one record row holds.
ENTRIES_A_ROW = 10_000


def records(triples: DataFrame, lang: Column | None = None, a_row: int = ENTRIES_A_ROW) -> DataFrame:
    """Records {id, part, directs[{prop, entity}], fields[{prop, value, lang}]}, entries in order of predicate, object and language.

    A subject with more than ``a_row`` triples takes several rows, numbered by ``part``: every row is bounded, and a hot subject is sorted and
    gathered by many tasks.  Subjects of the usual size have the one row of part 0.
    """
    x = triples.select(F.col("s").alias("id"), "p", "tag", "o", (lang if lang is not None else F.lit(None).cast("string")).alias("lang")).where("tag in (1, 2)")
    ordered = ranked(x, ["id", "p", "o", "lang", "tag"], "__pos")
    first = ordered.groupBy(F.col("id").alias("__f_id")).agg(F.min("__pos").alias("__first"))
    placed = ordered.join(first, F.col("id").eqNullSafe(F.col("__f_id"))).withColumn("part", F.floor((F.col("__pos") - F.col("__first")) / a_row).cast("int"))
    direct = F.when(F.col("tag") == 1, F.struct(F.col("p").alias("prop"), F.col("o").alias("entity")))
    field = F.when(F.col("tag") == 2, F.struct(F.col("p").alias("prop"), F.col("o").alias("value"), F.col("lang")))
    return placed.groupBy("id", "part").agg(F.array_sort(F.collect_list(direct)).alias("directs"), F.array_sort(F.collect_list(field)).alias("fields"))


def refers(record_rows: DataFrame, target: str) -> DataFrame:
    """Records with a link to ``target``."""
    return record_rows.where(F.exists("directs", lambda d: d["entity"] == target))


def first_field(record_rows: DataFrame, prop: str, name: str) -> DataFrame:
    return record_rows.withColumn(name, F.get(F.filter("fields", lambda f: f["prop"] == prop), F.lit(0))["value"])


def replace(record_rows: DataFrame, changed: DataFrame, is_delete: Column) -> DataFrame:
    """Records with those of ``changed`` put in the place of all of the same id; changed records that are deletions only remove."""
    kept = record_rows.join(changed.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti")
    return kept.unionByName(changed.where(~is_delete))


def encode_records(record_rows: DataFrame, table: DataFrame) -> DataFrame:
    """Records with ids, properties and linked entities as codes of a name table, values kept; strings that have no code give null.

    Entries are coded as rows and come together again by record and place, so no record is more than it was.
    """
    x = cut(record_rows.withColumn("__row", F.monotonically_increasing_id()))  # written, so that numbers stay what they are

    def coded(column: str, value: Column, kept: tuple[str, ...]) -> DataFrame:
        e = x.select("__row", F.posexplode(column).alias("at", "e")).select("__row", "at", F.col("e.prop").alias("__p"), value.alias("__v"), *(F.col(f"e.{c}").alias(c) for c in kept))
        return names.codes_of(e, "__p", table, "prop")

    d = names.codes_of(coded("directs", F.col("e.entity"), ()), "__v", table, "entity")
    d = d.groupBy(F.col("__row").alias("__d")).agg(F.array_sort(F.collect_list(F.struct("at", "prop", "entity"))).alias("__directs"))
    f = coded("fields", F.lit(None).cast("string"), ("value", "lang"))
    f = f.groupBy(F.col("__row").alias("__f")).agg(F.array_sort(F.collect_list(F.struct("at", "prop", "value", "lang"))).alias("__fields"))
    out = names.codes_of(x, "id", table, "code").join(d, F.col("__row") == F.col("__d"), "left").join(f, F.col("__row") == F.col("__f"), "left")
    directs = F.transform("__directs", lambda e: F.struct(e["prop"].alias("prop"), e["entity"].alias("entity")))
    fields_ = F.transform("__fields", lambda e: F.struct(e["prop"].alias("prop"), e["value"].alias("value"), e["lang"].alias("lang")))
    return out.select(F.col("code").alias("id"), F.coalesce(directs, F.array()).alias("directs"), F.coalesce(fields_, F.array()).alias("fields"))
