import pytest
from pyspark.sql import functions as F

from amberlog.functions import places
from amberlog.operators import classes, edits, graph, histogram, log
from amberlog.sources import settings

ENTRY = "array<struct<tag int, prop string, value string, lang string, link string, sourcelink string>>"
LOG = f"id string, tp string, mt string, props {ENTRY}"


def field(p, v, lang=None):
    return (1, p, v, lang, None, None)


def link(p, t):
    return (2, p, None, None, t, None)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("a", "person", "t", [field("name", "A", "en"), field("name", "А", "ru"), link("father", "b"), (3, "old", None, None, None, "z")]), ("b", "person", "t", [field("text", "x"), field("text", "y")]), ("c", "photo", "t", None), ("d", "photo", "t", [link("of", "a"), link("of", "b"), link("at", "nobody")])], LOG)


def test_record_and_inverse_entries(spark, people):
    assert [e.tag for e in graph.record(people, "a").first().props] == [1, 1, 2]
    assert len(graph.record(people, "a", with_inverse=True).first().props) == 4
    assert graph.record(people, "zz").collect() == []
    got = {r.id: [(e.prop, e.sourcelink) for e in r.props if e.tag == 3] for r in graph.with_inverse_entries(people).collect()}
    assert got == {"a": [("old", "z"), ("of", "d")], "b": [("father", "a"), ("of", "d")], "c": [], "d": []}
    parts = sorted((r.id, r.part, sum(e.tag == 3 for e in r.props), len(r.props)) for r in graph.with_inverse_entries(people, a_row=1).collect())
    assert parts == [("a", 0, 2, 5), ("b", 0, 1, 3), ("b", 1, 1, 1), ("c", 0, 0, 0), ("d", 0, 0, 3)]


def test_no_entry_of_a_hot_record_is_lost(spark, people):
    links = spark.range(10_001).select(F.concat(F.lit("s"), F.col("id")).alias("id"), F.lit("photo").alias("tp"), F.lit("t").alias("x"), F.array(F.struct(F.lit(2).alias("tag"), F.lit("of").alias("prop"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("lang"), F.lit("hot").alias("link"), F.lit(None).cast("string").alias("sourcelink"))).alias("props"))
    hot = spark.createDataFrame([("hot", "person", "t", [])], people.schema)
    rows = graph.with_inverse_entries(hot.unionByName(spark.createDataFrame(links.rdd, people.schema))).where("id = 'hot'").orderBy("part").collect()
    assert [(r.part, len(r.props)) for r in rows] == [(0, 10_000), (1, 1)]
    assert len({e.sourcelink for r in rows for e in r.props}) == 10_001


def test_no_triple_of_a_hot_subject_is_lost(spark):
    from amberlog.operators import triples

    t = spark.range(25).select(F.lit("hot").alias("s"), F.lit("p").alias("p"), (F.col("id") % 2 + 1).cast("int").alias("tag"), F.col("id").cast("string").alias("o"))
    rows = triples.records(t, a_row=10).orderBy("part").collect()
    assert [len(r.directs) + len(r.fields) for r in rows] == [10, 10, 5]
    assert {d.entity for r in rows for d in r.directs} | {f.value for r in rows for f in r.fields} == {str(i) for i in range(25)}



def test_portrait_and_accessors(spark, people):
    got = sorted(map(tuple, graph.portrait(people, people.where("id in ('d', 'a')")).collect()))
    assert got == [("a", "father", "b", "person"), ("d", "of", "a", "person"), ("d", "of", "b", "person")]
    p = F.col("props")
    x = {r.id: r for r in people.select("id", graph.field_of(p, "name").alias("f"), graph.text_of(p, "name").alias("ru"), graph.text_of(p, "text").alias("last"), graph.link_of(p, "father").alias("l"), graph.sources_of(p, "old").alias("s"), graph.texts_of(p, "text").alias("all")).collect()}
    assert (x["a"].f, x["a"].ru, x["a"].l, x["a"].s) == ("A", "А", "b", ["z"])
    assert x["b"].last == "y" and [t.value for t in x["b"].all] == ["x", "y"] and x["b"].f is None and x["c"].last is None


def test_edits(spark, people):
    new = spark.createDataFrame([(None, "person", None, [field("name", "N"), field("blank", " ")]), ("", "photo", None, None), ("k", "person", None, [])], LOG)
    rows, counter = edits.stamped(new, "own_", 7, "2020-01-01", ["tp"])
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {"own_7", "own_8", "k"} and counter == 9 and len(got["own_7"].props) == 1 and {r.mt for r in got.values()} == {"2020-01-01"}
    dead = edits.deletion(spark.createDataFrame([("a",)], "id string"), people, "2021").first()
    assert (dead.id, dead.tp, dead.mt, dead.props) == ("a", "delete", "2021", None)
    change = spark.createDataFrame([("a", "person", "u", [field("name", "B", "en"), link("mother", "m")]), ("new", "x", "u", None)], LOG)
    up = {r.id: [(e.prop, e.value, e.link) for e in r.props] for r in edits.updated(people, change).collect()}
    assert up == {"a": [("name", "B", None), ("mother", None, "m"), ("name", "А", None)], "new": []}


def test_class_properties(spark):
    declared = spark.createDataFrame([("name", "DatatypeProperty", "entity", "string", 1), ("birth", "DatatypeProperty", "person", "date", None), ("father", "ObjectProperty", "person", "person", 0), ("shows", "ObjectProperty", "photo", "person", 2)], "about string, kind string, domain_of string, range_of string, priority int")
    tree = classes.tree_of(spark.createDataFrame([("entity", ""), ("person", "entity"), ("photo", "entity")], "id string, parent string"), "id", "parent")
    t = classes.template("person", declared, classes.with_self(tree))
    assert t.fields == ("name", "birth") and set(t.direct) == {"father"} and t.direct["father"].fields == ("name", "birth") and not t.direct["father"].direct
    assert set(t.inverse) == {"father", "shows"} and t.inverse["shows"].fields == ("name",) and not t.inverse["father"].direct
    assert classes.template("unknown", declared, classes.with_self(tree)) == graph.Template()
    with pytest.raises(ValueError):
        classes.template("person", declared, classes.with_self(tree), most=2)
    assert {(r.tp, r.prop): (r.pos, r.total) for r in classes.positions(declared).collect()}[("person", "birth")] == (1, 2)
    states = spark.createDataFrame([("1", "ru", "да"), ("1", "en", "yes"), ("2", "ru", "нет"), ("3", "fr", "x")], "value string, lang string, label string")
    vals = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "v string")
    assert {r.v: r.label for r in classes.enumerated(vals, "v", states, "en").collect()} == {"1": "yes", "2": "нет", "3": None, None: None}
    names = spark.createDataFrame([("name", "en", "Name", False), ("name", "en", "Name of", True)], "about string, lang string, label string, inverse boolean")
    assert {r.about: r.label for r in classes.labels(declared, names, "en", inverse=True).collect()}["name"] == "Name of"


def test_log_positions(spark):
    base = spark.createDataFrame([(3,), (9,)], "at bigint")
    rows = spark.createDataFrame([("y",), ("x",)], "v string")
    assert {r.v: r.at for r in log.append(base, rows, "at", ["v"]).collect()} == {"x": 10, "y": 11}
    assert {r.v: r.at for r in log.append(base.limit(0), rows, "at", ["v"]).collect()} == {"x": 0, "y": 1}
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, gone boolean")
    assert sorted(r.id for r in log.without_flagged(flags, "gone").collect()) == [2, 3]
    assert tuple(log.collisions(flags, F.lit(1), "id").first()) == (3, 1, 3)
    assert histogram.histogram(spark.range(64), "id", per_bucket=32).count() == 2


def test_places(spark):
    uri = "store://Store@cass.invalid/0001/0038/3259"
    df = spark.createDataFrame([(uri,), ("other",), (None,)], "u string")
    got = [tuple(r) for r in df.select(places.store_name("u"), *(places.file_path("u", F.lit("/x"), s) for s in (None, "small", "huge"))).collect()]
    assert got == [("store", "/x/originals/0038/3259", "/x/documents/small/0038/3259", "/x/documents/normal/0038/3259"), (None,) * 4, (None,) * 4]


def test_settings():
    text = '<c><database connectionstring="kind:/a:b"/><LoadCassette write="yes">D:\\x\\one</LoadCassette><LoadCassette>/y/two/</LoadCassette></c>'
    assert [(s.name, s.writable) for s in settings.stores(text)] == [("one", True), ("two", False)]
    assert settings.attached(text) == ("kind", "/a:b") and settings.attached("<c/>") is None
