"""Entity-attribute-value rows to one wide, typed row per entity.

The attributes and their types are discovered first (a declared list, as long as the wide table has columns); then one pass groups by entity with one
conditional aggregate per attribute, in plans of at most A_PLAN attributes each.  All aggregates are minima, maxima and counts, which combine before the shuffle: an entity with a third
of all rows costs its group no more than another.  Duplicates are resolved explicitly: of the values that fit the type, the least counts
(for strings by code point); how many values there were and fitted is kept beside.

Defined results.  Null or blank objects and undeclared attributes say nothing; an entity with only such rows is a row of nulls.  Null
entities are left out.  Repeated rows change nothing but the count.  Values out of range of their type do not fit.  Empty input, no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlog.functions.names import local_lower, trimmed

#: Attributes that one plan takes, since each is a handful of its expressions; more of them are pivoted by several plans.
A_PLAN = 500
_DIGITS = r"^[+-]?\d+$"
_GROUPED = r"^[+-]?\d{1,3}(?:[ \x{00a0}\x{202f}\x{2009}]\d{3})+$"
_REAL = r"^[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?$"


def _date(s: Column) -> Column:
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
    dotted = F.when(s.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.concat(F.substring(s, 7, 4), F.lit("-"), F.substring(s, 4, 2), F.lit("-"), F.substring(s, 1, 2)))
    month = F.when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01")))
    year = F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01")))
    return F.coalesce(iso, dotted, month, year).try_cast("date")


def typed(s: Column, kind: str) -> Column:
    """The trimmed text as a value of a declared type, null if it does not fit."""
    if kind == "integer":
        return F.when(s.rlike(_DIGITS) | s.rlike(_GROUPED), F.regexp_replace(s, r"[^0-9-]", "").try_cast("decimal(38,0)"))
    if kind == "real":
        return F.when(s.rlike(_REAL), F.translate(s, ",", ".").try_cast("double"))
    if kind == "boolean":
        return F.when(F.lower(s).isin("t", "true", "1"), True).when(F.lower(s).isin("f", "false", "0"), False)
    if kind == "date":
        return _date(s)
    return s


def discover(declared: DataFrame) -> list[tuple[str, str, bool]]:
    """[(attribute, type, single_valued)] in order of priority and name; the first row of a name counts."""
    rows = declared.select(local_lower("about").alias("a"), F.coalesce("range_of", F.lit("string")).alias("t"), F.coalesce("single_valued", F.lit(False)).alias("s"), "priority")
    first: dict[str, tuple[str, str, bool]] = {}
    for r in sorted(rows.where("a <> ''").collect(), key=lambda r: (r.priority is None, r.priority or 0, r.a, r.t)):
        first.setdefault(r.a, (r.a, r.t.strip().lower(), r.s))
    return list(first.values())


def portions(attributes: list[tuple[str, str, bool]]) -> list[list[tuple[str, str, bool]]]:
    """The attributes in portions that a plan takes; one empty portion if there are none."""
    return [attributes[i : i + A_PLAN] for i in range(0, len(attributes), A_PLAN)] or [[]]


def wide_table(facts: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    """The wide rows of any number of attributes: portions are pivoted one by one and joined by entity."""
    first, *others = (wide_rows(pivot(facts, some), some) for some in portions(attributes))
    for more in others:
        first = first.join(more, "subj")
    return first


def unclean(facts: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    """The unclean cells of any number of attributes."""
    return functools.reduce(DataFrame.unionByName, (unclean_cells(pivot(facts, some), some) for some in portions(attributes)))


def all_counts(facts: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, (counts(pivot(facts, some), some) for some in portions(attributes)))


def pivot(facts: DataFrame, attributes: list[tuple[str, str, bool]], entity: str = "subj", attribute: str = "pred", value: str = "obj") -> DataFrame:
    """One row per entity: for attribute number i the columns v{i} (its value), n{i} (values given), f{i} (of those, fitting), d{i} (whether two differ)."""
    a, s = F.col("a"), F.col("s")
    x = facts.where(F.col(entity).isNotNull()).select(F.col(entity).alias("subj"), local_lower(attribute).alias("a"), F.nullif(trimmed(value), F.lit("")).alias("s"))
    # a row has one attribute, so its value is cast once, in the column of that attribute's type, before the aggregates pick it up
    of_type: dict[str, list[str]] = {}
    for name, kind, _ in attributes:
        of_type.setdefault(kind, []).append(name)
    columns = {kind: f"x{i}" for i, kind in enumerate(of_type)}
    x = x.withColumns({columns[kind]: F.when(a.isin(names), typed(s, kind)) for kind, names in of_type.items()}) if of_type else x
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, (name, kind, _) in enumerate(attributes):
        v = F.when(a == name, F.col(columns[kind]))
        aggs += [F.min(v).alias(f"v{i}"), F.count(F.when(a == name, s)).alias(f"n{i}"), F.count(v).alias(f"f{i}"), (F.max(v) != F.min(v)).alias(f"d{i}")]
    return x.groupBy("subj").agg(*aggs)


def wide_rows(pivoted: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    """subj and one typed column per attribute, named by it."""
    return pivoted.select("subj", *(F.col(f"v{i}").alias(name if name != "subj" else "subj_value") for i, (name, _, _) in enumerate(attributes)))


def counts(pivoted: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    """(subj, pred, n_values, n_fitting): how many values the cells that have any were given, and how many of them fit."""
    cells = [F.struct(F.lit(name).alias("pred"), F.col(f"n{i}").alias("n_values"), F.col(f"f{i}").alias("n_fitting")) for i, (name, _, _) in enumerate(attributes)]
    if not cells:
        return pivoted.select("subj", F.lit("").alias("pred"), F.lit(0).cast("bigint").alias("n_values"), F.lit(0).cast("bigint").alias("n_fitting")).limit(0)
    return pivoted.select("subj", F.explode(F.filter(F.array(*cells), lambda c: c["n_values"] > 0)).alias("c")).select("subj", "c.*")


def values(facts: DataFrame, attributes: list[tuple[str, str, bool]], entity: str = "subj", attribute: str = "pred", value: str = "obj") -> DataFrame:
    """(subj, pred, value, n): every different value that fits its attribute's type, as text of that type, and how often it was given."""
    a, s = F.col("pred"), F.col("s")
    x = facts.where(F.col(entity).isNotNull()).select(F.col(entity).alias("subj"), local_lower(attribute).alias("pred"), F.nullif(trimmed(value), F.lit("")).alias("s"))
    of_type: dict[str, list[str]] = {}
    for name, kind, _ in attributes:
        of_type.setdefault(kind, []).append(name)
    texts = [F.when(a.isin(names), typed(s, kind).cast("string")) for kind, names in of_type.items()]
    v = F.coalesce(*texts, F.lit(None).cast("string"))
    return x.select("subj", "pred", v.alias("value")).where("value is not null").groupBy("subj", "pred", "value").agg(F.count(F.lit(1)).alias("n"))


def unclean_cells(pivoted: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    """(subj, pred, status): cells that cannot be filled cleanly, ``untyped`` or ``conflict``."""
    cells = [
        F.struct(
            F.lit(name).alias("pred"),
            F.when((F.col(f"n{i}") > 0) & (F.col(f"f{i}") == 0), "untyped").when(F.lit(single) & F.coalesce(F.col(f"d{i}"), F.lit(False)), "conflict").alias("status"),
        )
        for i, (name, _, single) in enumerate(attributes)
    ]
    if not cells:
        return pivoted.select("subj", F.lit("").alias("pred"), F.lit("").alias("status")).limit(0)
    return pivoted.select("subj", F.explode(F.filter(F.array(*cells), lambda c: c["status"].isNotNull())).alias("c")).select("subj", "c.*")
