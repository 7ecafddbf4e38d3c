import random

import pytest
from pyspark.sql import functions as F

from amberlog.functions import hashes, labels, names as name_rules, times
from amberlog.operators import classes, graph, histogram, ingest, log, lookup, names, partitions, triples, words
from amberlog.operators.changes import MergeOnReadTable
from amberlog.operators.graph import Template
from amberlog.streaming import append
from tests import brute

ENTRY = "array<struct<tag int, prop string, value string, lang string, link string, sourcelink string>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# names and times


@pytest.mark.parametrize("s", [None, "", " a|b ", "|", " x\t", "{n}b", "o:b", " {urn:x}b c ", "a:b:c", "{a}{b}c", "plain", "é ж"])
def test_names(spark, s):
    c = F.lit(s).cast("string")
    assert one(spark, name_rules.key_of(c)) == brute.key(s)
    assert one(spark, name_rules.local_name(c)) == brute.local(s)


@pytest.mark.parametrize(
    "mt",
    [None, "", "n/a", "2016-01-04T15:49:08+07:00", "2016-01-04 15:49:08", "2016-01-04T15:49:08.123456Z", "2016-01-04T15:49:08-05:00", "1/4/2016 3:49:08 PM", "12/31/2016 12:00:00 AM", "12/1/2016 12:30:00 PM", "2016-02-30T00:00:00Z", "2016-13-01", "2016-03-01", "13/13/2016 1:00:00 AM", " 2016-01-04T15:49:08Z "],
)
@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_times(spark, mt, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = one(spark, times.change_time(F.lit(mt).cast("string")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    want = brute.change_time(mt)
    assert got == (None if want == float("-inf") else round(want * 1e6))


# codes and labels

TEXTS = ["", "a", "Иванов", "иванов123", "x\U0001f600y", "hello world", "ЁЖ~ё", "IVХК", "\x00é"]


def units(s):
    b = s.encode("utf-16-be")
    return [b[i] << 8 | b[i + 1] for i in range(0, len(b), 2)]


def low_byte_hash(s):
    h = 0
    for u in units(s):
        h = (h + (u & 255)) % 2**32
        h = (h - ((h << 13) % 2**32 | h >> 19)) % 2**32
    return h - 2**32 if h >= 2**31 else h


def first4(s):
    code = 0
    for c in (s + "    ")[:4]:
        code = code << 7 | max(hashes.ALPHABET.find(c.upper()), 0)
    return code


@pytest.mark.parametrize("s", TEXTS)
def test_codes(spark, s):
    assert one(spark, hashes.low_byte_hash(F.lit(s))) == low_byte_hash(s)
    assert one(spark, hashes.first4_code(F.lit(s))) == first4(s)


def test_labels(spark):
    for d, want in ((None, ""), ("", ""), ("1960", "1960"), ("1960-01", "1960янв"), ("1960-12-05", "1960дек05"), ("1960-13-05", "1960"), ("196", "")):
        assert one(spark, labels.partial_date(F.lit(d).cast("string"))) == want
    assert one(spark, labels.date_range(F.lit("1960"), F.lit("1961-02"))) == "1960-1961фев"
    assert one(spark, labels.date_range(F.lit("1960"), F.lit(None).cast("string"))) == "1960"
    assert tuple(one(spark, labels.split_name(F.lit("http://x.y/o#name")))) == ("http://x.y/o#", "name")
    assert tuple(one(spark, labels.split_name(F.lit("name")))) == ("", "name")


# the log


def test_current_equals_replay(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 3, 4, None]), i, rng.choice(["", None, "x", "y"]), "clash") for i in range(200)]
    df = spark.createDataFrame(rows, "key int, ord int, val string, top string")
    state = {}
    for k, i, v, _ in rows:
        if k is not None:
            state[k] = (i, v)
    want = sorted((k, i, v) for k, (i, v) in state.items() if v != "")
    empty = F.col("val") == ""
    got = log.current(df, "key", ["ord"], empty, ["key", "ord", "val"])
    assert sorted(map(tuple, got.collect())) == want
    assert log.current(df, "key", ["ord"], empty).columns == df.columns or set(log.current(df, "key", ["ord"], empty).columns) == set(df.columns)
    base, delta = log.newest(df.where("ord < 90"), "key", ["ord"]), log.newest(log.replay(df, "ord", 90), "key", ["ord"])
    both = log.with_delta(base, delta, "key").where(~F.coalesce(empty, F.lit(False)))
    assert sorted((r.key, r.ord, r.val) for r in both.collect()) == want
    assert log.current(df.limit(0), "key", ["ord"], empty).collect() == []


def test_compact(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "")], "key int, ord int, val string")
    log.compact(df, "key", ["ord"], F.col("val") == "", str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "c")).collect()] == [(1, 2, "b")]


# lookups


def test_any_value_keeps_multiplicity(spark):
    df = spark.createDataFrame([(1, ["a", "A", "b"]), (2, ["c"]), (3, None), (4, [None, "a"])], "id int, vs array<string>")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(lookup.by_any_value(df, F.col("vs"), "a", ignore_case=True)) == [1, 1, 4]
    assert ids(lookup.by_any_value(df, F.col("vs"), "a")) == [1, 4]
    assert ids(lookup.by_any_value(df, F.col("vs"), "zz")) == []


def test_prefix(spark, tmp_path):
    df = lookup.with_upper(spark.createDataFrame([(1, "Small x"), (2, "tall"), (3, None), (4, "")], "id int, n string"), "n")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(lookup.by_prefix(df, "n", "sMa", stored_upper="n_upper")) == ids(lookup.by_prefix(df, "n", "sma")) == [1]
    assert ids(lookup.by_prefix(df, "n", "sma", ignore_case=False)) == []
    assert ids(lookup.by_prefix(df, "n", "")) == [1, 2, 4]
    df.write.parquet(str(tmp_path / "p"))
    plan = lookup.by_prefix(spark.read.parquet(str(tmp_path / "p")), "n", "sma", stored_upper="n_upper")._jdf.queryExecution().toString()
    assert "StringStartsWith(n_upper,SMA)" in plan


def test_ranked(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = lookup.ranked(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.pos)] == sorted(rows) and sorted(r.pos for r in got) == list(range(1, 501))
    assert lookup.ranked(spark.createDataFrame([], "a int, b int"), ["a", "b"]).collect() == []


def test_ordered(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert [r.id for r in lookup.head(df, F.desc("v"), n=2, skip=1).collect()] == [98, 97]
    assert sorted(r.id for r in lookup.by_level(df, "v", 10, 14).collect()) == [5, 6]
    assert [r.id for r in lookup.by_sample(df, {"id": 3, "v": 6}).collect()] == [3]
    assert sorted(r.id for r in lookup.by_keys(df, "id", spark.createDataFrame([(1,), (1,), (None,)], "k long"), "k").collect()) == [1]


# histograms


def test_histogram_holds_every_key(spark):
    keys = spark.range(160).select(F.col("id").alias("key"))
    r = histogram.key_range(keys, "key", 81).first()
    assert r.start <= 81 < r.start + r.numb
    h = {x.pos: (x.start, x.c) for x in histogram.histogram(keys, "key").collect()}
    assert sum(c for _, c in h.values()) == 160 and len(h) == 10
    for outside in (-1_000, 10_000):
        assert tuple(histogram.key_range(keys, "key", outside).first()) == (0, 0)
    assert histogram.key_range(keys, "key", -1).first().numb == h[0][1]  # divided toward zero
    few = spark.createDataFrame([(5,), (5,), (None,)], "key int")
    assert [tuple(x) for x in histogram.histogram(few, "key").collect()] == [(0, 2, 0)]
    assert tuple(histogram.key_range(few, "key", 5).first()) == (0, 2)
    assert histogram.histogram(few.limit(0), "key").collect() == [] and tuple(histogram.key_range(few.limit(0), "key", 1).first()) == (0, 0)


# words, names, triples


def test_words(spark):
    df = spark.createDataFrame([(1, "The cat, the DOG-the\\x"), (2, "cats"), (3, None), (4, " ,. "), (0, "the cat")], "id int, t string")
    t = words.word_table(df, "id", "t")
    assert sorted(map(tuple, t.where("id = 1").collect())) == [(1, w) for w in ("cat", "dog", "the", "the", "the", "x")]
    assert [tuple(r) for r in words.search(t, "id", "THE cat").collect()] == [(1, 4), (0, 2)]
    forms = words.normal_forms(spark.createDataFrame([(0, "cat cats Cat"), (1, "other cats")], "pos int, value string"))
    assert {r.form: r.norm for r in forms.collect()} == {"cat": "cat", "cats": "cat", "Cat": "cat", "other": "other"}
    assert [tuple(r) for r in words.search(t, "id", "cats", forms=forms).collect()] == [(0, 1), (1, 1), (2, 1)]
    assert words.search(t, "id", "").collect() == []


def test_names_table(spark):
    df = spark.createDataFrame([("b", 2), ("a", 3), ("b", 1), (None, 0), ("c", 4)], "s string, at int")
    table = names.encode_table(df, "s", "at")
    assert {r.s: r.code for r in table.collect()} == {"b": 0, "a": 1, "c": 2}
    longer = names.extend(table, spark.createDataFrame([("a", 1), ("z", 5), ("y", 4)], "s string, at int"), "s", "at")
    assert {r.s: r.code for r in longer.collect()} == {"b": 0, "a": 1, "c": 2, "y": 3, "z": 4}
    coded = names.codes_of(df, "s", table, "code")
    assert sorted((r.s or "", -1 if r.code is None else r.code) for r in coded.collect()) == [("", -1), ("a", 1), ("b", 0), ("b", 0), ("c", 2)]
    assert sorted(r.back or "" for r in names.strings_of(coded, "code", table, "back").collect()) == ["", "a", "b", "b", "c"]


def test_triple_records(spark):
    t = spark.createDataFrame([("a", "type", 1, "person"), ("a", "name", 2, "Anna"), ("b", "knows", 1, "a"), ("b", "name", 2, "a")], "s string, p string, tag int, o string")
    assert [r.s for r in triples.by_target(t, "a").collect()] == ["b"]
    assert sorted(r.s for r in triples.by_text_prefix(t, "name", "A").collect()) == ["a", "b"]
    recs = triples.records(t)
    assert [r.id for r in triples.refers(recs, "a").collect()] == ["b"]
    assert {r.id: r.n for r in triples.first_field(recs, "name", "n").collect()} == {"a": "Anna", "b": "a"}
    changed = recs.where("id = 'a'").withColumn("fields", F.expr("cast(array() as array<struct<prop:string,value:string,lang:string>>)"))
    is_delete = F.exists("directs", lambda d: d["entity"] == "delete")
    assert sorted((r.id, len(r.fields)) for r in triples.replace(recs, changed, is_delete).collect()) == [("a", 0), ("b", 1)]
    assert sorted(r.id for r in triples.replace(recs, changed, F.lit(True)).collect()) == ["b"]


# linked records


def records(spark):
    f = lambda p, v, lang=None: (1, p, v, lang, None, None)
    d = lambda p, t: (2, p, None, None, t, None)
    return spark.createDataFrame([
        ("p1", "person", [f("name", "Анна", "ru"), f("name", "Anna", "en"), d("father", "p2")]), ("p2", "person", [f("name", "Boris", "en")]), ("d1", "photo", [f("name", "DSP1"), d("missing", "nobody")]),
        ("r1", "reflection", [d("reflected", "p1"), d("in-doc", "d1")]), ("r2", "reflection", [d("reflected", "p1"), d("in-doc", "gone")]), ("e", "empty", None),
    ], f"id string, tp string, props {ENTRY}")


def test_tree(spark):
    template = Template(fields=("name",), direct={"father": Template(fields=("name",))}, inverse={"reflected": Template(direct={"in-doc": Template(fields=("name",))})})
    ids = spark.createDataFrame([("p1",), ("p1",), ("nobody",)], "id string")
    got = sorted((r.root, r.path, r.level, r.id, r.value) for r in graph.tree(ids, records(spark), template).collect())
    assert got == [("p1", "", 0, "p1", "Anna"), ("p1", "", 0, "p1", "Анна"), ("p1", "/^reflected/in-doc", 2, "d1", "DSP1"), ("p1", "/father", 1, "p2", "Boris")]
    around = sorted((r.level, r.direction, r.prop, r.id, r.tp) for r in graph.generic_tree(ids, records(spark)).collect())
    assert around == [(1, "direct", "father", "p2", "person"), (2, "inverse", "reflected", "r1", "reflection"), (2, "inverse", "reflected", "r2", "reflection")]


def test_names_by_language(spark):
    got = {r.id: (r.ru, r.en, r.de) for r in records(spark).select("id", *(graph.name_in(F.col("props"), x).alias(x) for x in ("ru", "en", "de"))).collect()}
    assert got["p1"] == ("Анна", "Anna", "Анна (ru)") and got["p2"] == ("Boris (en)", "Boris", "Boris (en)") and got["d1"] == ("DSP1", "DSP1 (ru)", "DSP1 (ru)") and got["e"] == (None, None, None)


def test_inverse_and_changes(spark):
    inv = graph.inverse(graph.links(records(spark)), "target", "id", F.col("prop"))
    assert ("p1", "reflected", 2, "r1") in {tuple(r) for r in inv.collect()}
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 1, 2], [2, 3]))
    assert sorted(map(tuple, graph.link_changes(a, b, "k").collect())) == [("appeared", 3), ("removed", 1)]


# ingest, classes, partitions


def test_substitutes(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(200)]
    pairs = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("into", "x"), ("self", "self")], "a string, b string")
    got = {r.old_id: r.new_id for r in ingest.substitutes(pairs).collect()}
    assert all(got[f"c{i}"] == "c200" for i in range(200))
    assert all(got[k] == k for k in ("x", "y", "into", "self"))
    assert ingest.substitutes(pairs.limit(0)).collect() == []
    links = spark.createDataFrame([("c0",), ("other",), (None,)], "link string")
    assert sorted(str(r.link) for r in ingest.redirect(links, "link", ingest.substitutes(pairs)).collect()) == ["None", "c200", "other"]


def test_last_definition_and_seed(spark):
    df = spark.createDataFrame([("a", 5, 1, "old"), ("a", 9, 2, "first"), ("a", 9, 3, "second"), ("b", None, 4, "x"), ("b", 1, 5, "y"), (None, 9, 6, "z")], "id string, mt int, at int, v string")
    assert sorted(map(tuple, ingest.last_definition(df, "id", F.col("mt"), "at", ["v"]).collect())) == [("a", "first"), ("b", "y")]
    assert sorted(r.id for r in ingest.with_seed(df.select("id", F.col("v").alias("tp")).where("id = 'b'"), "root", "collection").collect()) == ["b", "b", "root"]
    assert ingest.without_deleted(df, "id", spark.createDataFrame([("a",), (None,)], "d string"), "d").count() == 3


def test_classes(spark):
    rows = spark.createDataFrame([("entity", ""), ("person", "entity"), ("author", "person"), ("l1", "l2"), ("l2", "l1")], "id string, parent string")
    tree = classes.tree_of(rows, "id", "parent")
    assert {(r.anc, r.id) for r in classes.with_self(tree).collect()} == {("entity", "entity"), ("entity", "person"), ("entity", "author"), ("person", "person"), ("person", "author"), ("author", "author")}
    assert {r.anc: r.n for r in classes.descendant_counts(rows, "id", "parent").collect()} == {"entity": 3, "person": 2, "author": 1}


def test_partitions(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(-50, 50)], "id int, v string")
    assert {r.s for r in df.select(partitions.section("id", 7).alias("s")).collect()} == set(range(7))
    partitions.write_sections(df, "id", 7, str(tmp_path / "s"))
    got = partitions.read_key(spark, str(tmp_path / "s"), "id", -3, 7)
    assert [tuple(r) for r in got.collect()] == [(-3, "v-3")]
    assert "PartitionFilters: [isnotnull(section" in got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# streams


def test_streams(spark, tmp_path):
    schema = f"seq bigint, mt string, id string, tp string, props {ENTRY}"
    source = tmp_path / "in"
    table = MergeOnReadTable(spark, str(tmp_path / "table"))
    parts = [[(0, "2016-01-01", "a", "x", None), (1, "2016-01-02", "b", "x", None)], [(2, "2016-01-05", "a", "delete", None), (3, "2015-01-01", "b", "y", None)]]
    done = []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        done += rows
        stream = spark.readStream.schema(schema).parquet(str(source))
        append.apply_stream(stream, table, str(tmp_path / "c1")).awaitTermination(120)
        append.append_stream(stream, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination(120)
        want = brute.current([dict(zip(("seq", "mt", "id", "tp"), r[:4], strict=True)) for r in done])
        assert sorted((r.id, r.seq) for r in table.read().collect()) == want
        assert spark.read.parquet(str(tmp_path / "log")).count() == len(done) and table.version == i
