"""A class tree and the properties that types inherit.  Loops are cut; a type without properties gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amberlog.operators import graph, hierarchy


def with_self(tree: DataFrame) -> DataFrame:
    """(anc, id): every class with itself and all of its ancestors, from the paths of the tree."""
    return tree.where("path is not null").select(F.explode("path").alias("anc"), F.col("name").alias("id"))


def tree_of(rows: DataFrame, id_: str, parent: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.newest_links(rows, F.col(id_), F.col(parent), F.lit(0)))


def descendant_counts(rows: DataFrame, id_: str, parent: str) -> DataFrame:
    """(anc, n): descendants of every class, itself counted; sizes come from the peeling, without any list."""
    return tree_of(rows, id_, parent).where("descendants is not null").select(F.col("name").alias("anc"), (F.col("descendants") + 1).alias("n"))


def inherited(ancestors: DataFrame, declared: DataFrame) -> DataFrame:
    """(tp, prop): own and inherited properties.  ancestors (anc, id), declared (prop, cls)."""
    return ancestors.join(declared, F.col("anc") == F.col("cls")).select(F.col("id").alias("tp"), "prop").distinct()


def direct_props(ancestors: DataFrame, declared: DataFrame) -> DataFrame:
    """(tp, prop, pos): own and inherited properties of every class, by the classes they are declared for, in order of priority (null last) and name."""
    return _ordered(ancestors, declared, "domain_of")


def inverse_props(ancestors: DataFrame, declared: DataFrame) -> DataFrame:
    """(tp, prop, pos): the object properties that may point to a class, by the classes of their range, own and inherited."""
    return _ordered(ancestors, declared.where("kind = 'ObjectProperty'"), "range_of")


def _ordered(ancestors: DataFrame, declared: DataFrame, side: str) -> DataFrame:
    x = ancestors.join(declared.select(F.col("about").alias("prop"), F.col(side).alias("__side"), "priority"), F.col("anc") == F.col("__side"))
    x = x.groupBy(F.col("id").alias("tp"), "prop").agg(F.min("priority").alias("priority"))
    w = Window.partitionBy("tp").orderBy(F.col("priority").asc_nulls_last(), "prop")  # a class has as many rows as properties are declared
    return x.select("tp", "prop", (F.row_number().over(w) - 1).alias("pos"))


def domains(declared: DataFrame, prop: str) -> DataFrame:
    return declared.where(F.col("about") == prop).select(F.col("domain_of").alias("tp")).where("tp is not null").distinct()


def ranges(declared: DataFrame, prop: str) -> DataFrame:
    return declared.where(F.col("about") == prop).select(F.col("range_of").alias("tp")).where("tp is not null").distinct()


def positions(declared: DataFrame, by: str = "domain_of") -> DataFrame:
    """(tp, prop, pos, total): the properties of each type in order of priority (null last) and name, from 0."""
    w = Window.partitionBy(by).orderBy(F.col("priority").asc_nulls_last(), "about")
    return declared.select(F.col(by).alias("tp"), F.col("about").alias("prop"), (F.row_number().over(w) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("total"))


def enumerated(rows: DataFrame, value: str, states: DataFrame, lang: str, fallback: str = "ru") -> DataFrame:
    """Rows with the ``label`` of an enumerated value in a language, else in the fallback, else null.  states: (value, lang, label)."""
    best = states.where(F.col("lang").isin(lang, fallback)).groupBy(F.col("value").alias("__v")).agg(F.min_by("label", F.struct(F.col("lang") != lang, F.col("label"))).alias("label"))
    return rows.join(best, F.col(value) == F.col("__v"), "left").drop("__v")


def labels(declared: DataFrame, names: DataFrame, lang: str, inverse: bool = False) -> DataFrame:
    """(about, label): the label of each class or property in a language, else its name.  names: (about, lang, label, inverse)."""
    own = names.where((F.col("lang") == lang) & (F.col("inverse") == F.lit(inverse))).groupBy(F.col("about").alias("__a")).agg(F.min("label").alias("__label"))
    return declared.select("about").distinct().join(own, F.col("about") == F.col("__a"), "left").select("about", F.coalesce("__label", "about").alias("label"))


def template(tp: str, declared: DataFrame, ancestors: DataFrame, depth: int = 2, most: int = 2_000) -> graph.Template:
    """A template of a type from the class tree: its own and inherited fields, direct links one level down, inverse links above that.

    The declarations are a bounded list (checked), and the depth cuts what types say about each other.
    """
    props = [r.asDict() for r in declared.limit(most + 1).collect()]
    if len(props) > most:
        raise ValueError(f"more than {most} properties")
    wanted = {p[c] for p in props for c in ("domain_of", "range_of")} | {tp}
    up: dict[str, set[str]] = {}
    for r in ancestors.where(F.col("id").isin(list(wanted))).collect():
        up.setdefault(r["id"], {r["id"]}).add(r["anc"])

    def shape(t: str, level: int, skip: str | None) -> graph.Template:
        mine = up.get(t, {t})
        own = sorted((p for p in props if p["domain_of"] in mine), key=lambda p: (p["priority"] is None, p["priority"] or 0, p["about"]))
        fields = tuple(p["about"] for p in own if p["kind"] == "DatatypeProperty")
        direct = {p["about"]: shape(p["range_of"], 0, None) for p in own if p["kind"] == "ObjectProperty" and level > 0 and p["about"] != skip}
        back = [p for p in props if p["kind"] == "ObjectProperty" and p["range_of"] in mine] if level > 1 else []
        return graph.Template(fields=fields, direct=direct, inverse={p["about"]: shape(p["domain_of"], level - 1, p["about"]) for p in back})

    return shape(tp, depth, None)


def portrait_tree(id_: str, records: DataFrame, declared: DataFrame, ancestors: DataFrame, depth: int = 2) -> DataFrame:
    """The tree of one record by the template of its type, in one call; no rows if there is no such record."""
    own = records.where(F.col("id") == id_).select("id", "tp").limit(1)
    found = own.first()
    if found is None:
        return graph.tree(own, records, graph.Template())
    return graph.tree(own, records, template(found["tp"], declared, ancestors, depth), ancestors)
