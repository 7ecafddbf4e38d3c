"""Linked records: inverse links, aliases, trees by template, and edits.

Records are rows {id, tp, props[{tag, prop, value, lang, link, sourcelink}]}; tag 1 is a field, 2 a link, 3 an inverse link.  Inverse links are
derived, never stored, so edits have nothing to carry over.  Links to missing records give no subtree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlog.operators.lookup import ranked


def links(records: DataFrame) -> DataFrame:
    """(id, tp, prop, target): one row per link."""
    x = records.select("id", "tp", F.explode("props").alias("e")).where("e.tag = 2")
    return x.select("id", "tp", F.col("e.prop").alias("prop"), F.col("e.link").alias("target")).where("target <> ''")


def fields(records: DataFrame) -> DataFrame:
    """(id, tp, prop, value, lang): one row per field."""
    x = records.select("id", "tp", F.explode("props").alias("e")).where("e.tag = 1")
    return x.select("id", "tp", F.col("e.prop").alias("prop"), F.col("e.value").alias("value"), F.col("e.lang").alias("lang"))


def inverse(rows: DataFrame, target: str, source: str, predicate: Column) -> DataFrame:
    """(target, pred, n_sources, first_source): links seen from the other end.  Sums and minima, so a hot target needs no list."""
    x = rows.select(F.col(target).alias("target"), predicate.alias("pred"), F.col(source).alias("source"))
    return x.groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n_sources"), F.min("source").alias("first_source"))


def resolve_aliases(rows: DataFrame, key: str, kind: str, alias_kind: str, ref: str, records: DataFrame) -> DataFrame:
    """(id): each row stands for itself, an alias row for the record it refers to; distinct."""
    there = records.select(F.col(key).alias("__there"))
    x = rows.join(there, (F.col(kind) == alias_kind) & (F.col(ref) == F.col("__there")), "left")
    return x.select(F.coalesce("__there", key).alias("id")).distinct()


def two_hops(start: DataFrame, middle: DataFrame, end: DataFrame, first: Column, second: Column) -> DataFrame:
    """start -> middle -> end along two equi-joins (three where middle is itself a join)."""
    return start.join(middle, first).join(end, second)


@dataclass
class Template:
    """What a tree shows of a record: properties of fields, and templates by property for direct and inverse links.

    ``types`` are the types of the records that a template is for (any if empty): those at the end of a direct link match with their
    subclasses, those at the other end of an inverse link exactly.  Several templates of a property tell its types apart; the first that
    matches counts.
    """

    fields: tuple[str, ...] = ()
    direct: dict[str, Template | tuple[Template, ...]] = field(default_factory=dict)
    inverse: dict[str, Template | tuple[Template, ...]] = field(default_factory=dict)
    types: tuple[str, ...] = ()


def tree(ids: DataFrame, records: DataFrame, template: Template, ancestors: DataFrame | None = None) -> DataFrame:
    """(root, path, level, id, tp, prop, value, lang): the tree of every id in ``ids`` at once, one row per field of every node.

    One join per level of the template for all ids together, instead of a lookup per link.  ``path`` spells the predicates walked, with ^ for
    inverse ones.  Rows rather than nested values, so a hot node has no list to hold.  ancestors: (anc, id), each class with itself.
    """
    all_links, all_fields = links(records), fields(records)
    types = records.select(F.col("id").alias("__t_id"), F.col("tp").alias("__tp"))

    def matching(nodes: DataFrame, options: tuple[Template, ...], subclasses: bool) -> list[tuple[DataFrame, Template]]:
        """The nodes that each template is for."""
        if not any(t.types for t in options):
            return [(nodes, options[0])]
        typed = nodes.join(types, F.col("id") == F.col("__t_id"))
        chosen = F.lit(None).cast("int")
        for i, t in reversed(list(enumerate(options))):
            fits = F.lit(True) if not t.types else F.col("__kinds").isNotNull() & F.arrays_overlap("__kinds", F.array(*map(F.lit, t.types)))
            chosen = F.when(fits, i).otherwise(chosen)
        if subclasses and ancestors is not None:
            up = ancestors.groupBy(F.col("id").alias("__c")).agg(F.collect_set("anc").alias("__up"))  # as long as the class tree is deep
            typed = typed.join(up, F.col("__tp") == F.col("__c"), "left").withColumn("__kinds", F.coalesce("__up", F.array("__tp")))
        else:
            typed = typed.withColumn("__kinds", F.array("__tp"))
        typed = typed.withColumn("__i", chosen)
        return [(typed.where(F.col("__i") == i).select(*nodes.columns), t) for i, t in enumerate(options)]

    def walk(nodes: DataFrame, t: Template, path: str, level: int) -> list[DataFrame]:
        f = all_fields.where(F.col("prop").isin(list(t.fields))) if t.fields else all_fields
        out = [nodes.join(f, "id").select("root", F.lit(path).alias("path"), F.lit(level).alias("level"), "id", "tp", "prop", "value", "lang")]
        for p, sub in t.direct.items():
            step = all_links.where(F.col("prop") == p).select("id", "target")
            reached = nodes.join(step, "id").select("root", F.col("target").alias("id"))
            for some, shape in matching(reached, sub if isinstance(sub, tuple) else (sub,), True):
                out += walk(some, shape, f"{path}/{p}", level + 1)
        for p, sub in t.inverse.items():
            step = all_links.where(F.col("prop") == p).select(F.col("id").alias("source"), F.col("target").alias("id"))
            reached = nodes.join(step, "id").select("root", F.col("source").alias("id"))
            for some, shape in matching(reached, sub if isinstance(sub, tuple) else (sub,), False):
                out += walk(some, shape, f"{path}/^{p}", level + 1)
        return out

    start = ids.select(F.col("id").alias("root"), "id").distinct()
    parts = [x for some, t in matching(start, (template,), False) for x in walk(some, t, "", 0)]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def plain_tree(ids: DataFrame, records: DataFrame) -> DataFrame:
    """(root, path, level, id, tp, prop, value, lang, target): fields and links of records, of what they link to and of what links to them, and the
    fields of what these link to.

    Of a record that links to the root, the links by the predicate that led to it are left out, so the tree does not lead back.
    """
    all_links, shown = links(records), ("id", "tp", "prop", "value", "lang", "target")
    nothing = F.lit(None).cast("string")
    entries = fields(records).withColumn("target", nothing).select(*shown).unionByName(all_links.select("id", "tp", "prop", nothing.alias("value"), nothing.alias("lang"), "target"))
    step = all_links.select(F.col("id").alias("a"), F.col("prop").alias("p"), F.col("target").alias("b"))
    roots = ids.select(F.col("id").alias("root")).distinct()

    def node(x: DataFrame, id_: str, path: Column, level: int, back: Column) -> DataFrame:
        return x.select("root", F.col(id_).alias("__id"), path.alias("path"), F.lit(level).alias("level"), back.alias("back"))

    own = node(roots, "root", F.lit(""), 0, nothing)
    direct = node(roots.join(step, F.col("root") == F.col("a")), "b", F.concat(F.lit("/"), "p"), 1, nothing)
    inverse_ = node(roots.join(step, F.col("root") == F.col("b")), "a", F.concat(F.lit("/^"), "p"), 1, F.col("p"))
    near = direct.unionByName(inverse_)
    forward = F.col("back").isNull() | (F.col("p") != F.col("back"))
    far = node(near.join(step, (F.col("__id") == F.col("a")) & forward), "b", F.concat("path", F.lit("/"), "p"), 2, nothing)
    nodes = own.unionByName(near).unionByName(far)
    x = nodes.join(entries, F.col("__id") == F.col("id"))
    return x.where(F.col("target").isNull() | ((F.col("level") < 2) & (F.col("back").isNull() | (F.col("prop") != F.col("back"))))).select("root", "path", "level", *shown)


def tree_records(rows: DataFrame, records: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tp, props): the records that trees of ``ids`` are of, with the fields that the trees show and their links."""
    shown = rows.where("level = 0 and value is not null").select("id", "tp", F.struct(F.lit(1).alias("tag"), "prop", "value", "lang", F.lit(None).cast("string").alias("link")).alias("e"))
    roots = ids.select("id").distinct()
    own = links(records).join(roots, "id", "left_semi").select("id", "tp", F.struct(F.lit(2).alias("tag"), "prop", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("lang"), F.col("target").alias("link")).alias("e"))
    return shown.unionByName(own).groupBy("id", "tp").agg(F.array_sort(F.collect_list("e")).alias("props"))


def generic_tree(ids: DataFrame, records: DataFrame) -> DataFrame:
    """(root, level, direction, prop, id, tp): a record, what it links to, and what links to it, by predicate and type."""
    here = ids.join(records.select("id"), "id", "left_semi").select(F.col("id").alias("root")).distinct()
    types = records.select(F.col("id").alias("n_id"), F.col("tp").alias("n_tp"))
    out_ = here.join(links(records), F.col("root") == F.col("id")).select("root", F.lit(1).alias("level"), F.lit("direct").alias("direction"), "prop", F.col("target").alias("id"))
    in_ = here.join(links(records), F.col("root") == F.col("target")).select("root", F.lit(2).alias("level"), F.lit("inverse").alias("direction"), "prop", "id")
    return out_.unionByName(in_).join(types, F.col("id") == F.col("n_id")).select("root", "level", "direction", "prop", "id", F.col("n_tp").alias("tp"))


def link_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(side, k): links removed and links that appeared, as sets."""
    o, n = old.select(F.col(key).alias("k")), new.select(F.col(key).alias("k"))
    return o.subtract(n).select(F.lit("removed").alias("side"), "k").unionByName(n.subtract(o).select(F.lit("appeared").alias("side"), "k"))


def merge_fields(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """New values, and old ones whose (property, language) the new version does not mention."""
    return new.unionByName(old.join(new.select(*on).distinct(), on, "left_anti"))


def name_in(fields_: Column, lang: str, name_prop: str = "name", unlabelled: str = "ru") -> Column:
    """The name in a language, else the first name with its language in parentheses; null without a name."""
    named = F.filter(fields_, lambda f: (f["tag"] == 1) & (f["prop"] == name_prop))
    exact = F.get(F.filter(named, lambda f: f["lang"] == lang), F.lit(0))["value"]
    any_, its = F.get(named, F.lit(0))["value"], F.coalesce(F.get(named, F.lit(0))["lang"], F.lit(unlabelled))
    return F.coalesce(exact, F.when(its == lang, any_).otherwise(F.concat(any_, F.lit(" ("), its, F.lit(")"))))


def record(records: DataFrame, id_: str, with_inverse: bool = False) -> DataFrame:
    """The record of an id; its entries without inverse links unless asked for."""
    x = records.where(F.col("id") == id_)
    return x if with_inverse else x.withColumn("props", F.filter("props", lambda e: e["tag"] != 3))


#: Inverse entries that one row of a record holds.
ENTRIES_A_ROW = 10_000


def with_inverse_entries(records: DataFrame, a_row: int = ENTRIES_A_ROW) -> DataFrame:
    """Records with an entry of tag 3 for every link that points to them, in order of property and source.

    A record with more than ``a_row`` inverse entries takes several rows: ``part`` 0 has its own entries and the first inverse ones, the
    others have its id, tp and the next ones.  So no row grows with a hot record, and none of its entries is left out.  Parts are numbered by
    positions within ranges of (id, property, source), so a hot record is sorted by many tasks.
    """
    back = links(records).select(F.col("target").alias("id"), "prop", F.col("id").alias("source"))
    back = back.join(records.select("id").distinct(), "id", "left_semi")
    ordered = ranked(back, ["id", "prop", "source"], "__pos")
    # positions run through all records, so a record's parts begin with the block in which its first entry lies
    first = ordered.groupBy(F.col("id").alias("__f_id")).agg(F.min("__pos").alias("__first"))
    placed = ordered.join(first, F.col("id") == F.col("__f_id")).withColumn("part", F.floor((F.col("__pos") - F.col("__first")) / a_row).cast("int"))
    like = records.schema["props"].dataType.elementType
    filled = {"tag": F.lit(3), "prop": F.col("prop"), "sourcelink": F.col("source")}
    entry = F.struct(*((filled[f.name] if f.name in filled else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.fields))
    lists = placed.groupBy(F.col("id").alias("__id"), F.col("part").alias("__part")).agg(F.array_sort(F.collect_list(F.struct("__pos", entry.alias("e")))).alias("__in"))
    lists = lists.select("__id", "__part", F.transform("__in", lambda x: x["e"]).alias("__in"))
    empty = F.array().cast(records.schema["props"].dataType)
    joined = records.join(lists, F.col("id") == F.col("__id"), "left").withColumn("part", F.coalesce("__part", F.lit(0)))
    own = F.when(F.col("part") == 0, F.coalesce("props", empty)).otherwise(empty)
    return joined.withColumn("props", F.concat(own, F.coalesce("__in", empty))).drop("__id", "__part", "__in")


def portrait(records: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, prop, target, target_tp): the direct links of each id with the type of the record they lead to, existing ones only."""
    types = records.select(F.col("id").alias("__t"), F.col("tp").alias("target_tp"))
    mine = links(records).join(ids.select("id").distinct(), "id", "left_semi")
    return mine.join(types, F.col("target") == F.col("__t")).select("id", "prop", "target", "target_tp")


# accessors to the entries of one record


def field_of(props: Column, prop: str) -> Column:
    """The first value of a property, null without one."""
    return F.get(F.filter(props, lambda e: (e["tag"] == 1) & (e["prop"] == prop)), F.lit(0))["value"]


def texts_of(props: Column, prop: str) -> Column:
    """All values of a property with their languages, in order."""
    return F.transform(F.filter(props, lambda e: (e["tag"] == 1) & (e["prop"] == prop)), lambda e: F.struct(e["value"].alias("value"), e["lang"].alias("lang")))


def text_of(props: Column, prop: str, lang: str = "ru") -> Column:
    """The value in a language if there is one, else the last value."""
    all_ = texts_of(props, prop)
    return F.coalesce(F.get(F.filter(all_, lambda t: t["lang"] == lang), F.lit(0))["value"], F.element_at(F.when(F.size(all_) > 0, all_), -1)["value"])


def link_of(props: Column, prop: str) -> Column:
    """The first link of a property, null without one."""
    return F.get(F.filter(props, lambda e: (e["tag"] == 2) & (e["prop"] == prop)), F.lit(0))["link"]


def sources_of(props: Column, prop: str) -> Column:
    """The sources of all inverse links of a property, in order."""
    return F.transform(F.filter(props, lambda e: (e["tag"] == 3) & (e["prop"] == prop)), lambda e: e["sourcelink"])


def with_entry(props: Column, at: Column | int, **changes: Column) -> Column:
    """The entries with parts of the one at a position set anew; a position outside changes nothing."""

    def set_parts(e: Column, i: Column) -> Column:
        out = e
        for name, value in changes.items():
            out = out.withField(name, value)
        return F.when(i == at, out).otherwise(e)

    return F.transform(props, set_parts)


def dates_of(props: Column, start: str = "from-date", end: str = "to-date") -> Column:
    """The dates of a record as one label."""
    from amberlog.functions.labels import date_range

    return date_range(field_of(props, start), field_of(props, end))
