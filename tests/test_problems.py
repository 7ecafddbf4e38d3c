"""The general problems against brute force: on the small tables, and on rows made to hurt."""

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amberlog.functions.names import class_key, is_delete, key_of
from amberlog.operators import changes, hierarchy, nested, orphans, wide
from amberlog.plans import problems
from tests import brute

ENTRY = "array<struct<tag int, prop string, value string, lang string, link string, sourcelink string>>"
LOG = f"seq bigint, arrived timestamp, mt string, id string, tp string, props {ENTRY}, key string, pos int, since bigint, salt int, target string"


def found(spark, sf, name):
    return sorted(map(tuple, problems.queries()[name](spark, sf).collect()))


def rows_of(spark, sf, table):
    return [r.asDict(recursive=True) for r in spark.read.parquet(f"{sf}/{table}.parquet").collect()]


def test_p1(spark, sf):
    want = brute.classes((r["def_seq"], r["about"], r["subclassof"]) for r in rows_of(spark, sf, "ontology_class"))
    assert found(spark, sf, "p1_found") == sorted((k, *v) for k, v in want.items())


def test_p2_p4(spark, sf):
    log = rows_of(spark, sf, "rrecord_log")
    assert found(spark, sf, "p2_found") == brute.current(log)
    assert found(spark, sf, "p4_found") == brute.orphans(log)


def test_p3(spark, sf):
    assert found(spark, sf, "p3_found") == brute.entries((r["raw_id"], r["body"]) for r in rows_of(spark, sf, "fog_raw"))


def test_p5(spark, sf):
    declared = {r["about"].lower(): (r["range_of"], r["single_valued"]) for r in rows_of(spark, sf, "onto_props")}
    assert found(spark, sf, "p5_found") == brute.unclean(((r["subj"], r["pred"], r["obj"]) for r in rows_of(spark, sf, "triples")), declared)


# hierarchies


def tree_of(spark, rows, paths=True, residue=None):
    df = spark.createDataFrame(rows, "def_seq bigint, about string, subclassof string, root string, k string, path string")
    return hierarchy.hierarchy(hierarchy.newest_links(df, class_key("about"), class_key("subclassof"), F.col("def_seq")), paths, residue=residue)


def class_rows(pairs):
    return [(i, a, p, "x", "y", "z") for i, (a, p) in enumerate(pairs)]


@pytest.mark.parametrize("residue", [40, None])
def test_hierarchy_shapes(spark, residue):
    rng = random.Random(3)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)]
    star = [(f"s{i}", "hub") for i in range(40)] + [("hub", "c030")]
    loops = [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("below", "l2"), ("lower", "o:below"), ("self", "self"), ("kid", "{n}se|lf ")]
    odd = [(None, "x"), ("", "x"), ("  |", "x"), ("top", None), ("alone", "no|where"), ("o:re|peat", "top"), ("repeat", "alone"), ("Top", "top")]
    rand = [(f"r{i}", f"r{rng.randrange(i)}") for i in range(1, 60)] + [("r0", "")]
    pairs = chain + star + loops + odd + rand
    rng.shuffle(pairs)
    pairs += [("repeat", "top")]
    rows = class_rows(pairs)
    want = brute.classes((r[0], r[1], r[2]) for r in rows)
    got = tree_of(spark, rows, residue=residue).collect()
    assert {(r.name, r.root, r.steps) for r in tree_of(spark, rows, False, residue).collect()} == {(k, *v) for k, v in want.items()}
    assert {r.name: (r.root, r.steps) for r in got} == want
    below = {}
    for r in got:
        assert r.in_loop == (r.steps < 0)
        if r.in_loop:
            assert r.path is None and r.depth is None and r.descendants is None
            continue
        assert r.path[-1] == r.name and r.path[0] == r.root and len(r.path) == r.depth + 1 == r.steps + 1
        assert r.parent == (r.path[-2] if r.depth else None)
        for a in r.path[:-1]:
            below.setdefault(a, set()).add(r.name)
    assert all(r.descendants == len(below.get(r.name, ())) for r in got if not r.in_loop)
    pairs_below = {(x.ancestor, x.descendant) for x in hierarchy.closure(spark.createDataFrame(got, tree_of(spark, rows[:1]).schema)).collect()}
    assert pairs_below == {(a, d) for a, ds in below.items() for d in ds}


def test_hierarchy_of_nothing_and_of_one_loop(spark):
    assert tree_of(spark, []).collect() == []
    got = tree_of(spark, class_rows([("a", "b"), ("b", "a")]), False).collect()
    assert sorted((r.name, r.root, r.steps) for r in got) == [("a", "a", -1), ("b", "a", -1)]
    ring = [(f"n{i:02}", f"n{(i + 1) % 50:02}") for i in range(50)]
    for residue in (0, 10, None):
        assert {(r.root, r.steps) for r in tree_of(spark, class_rows(ring), False, residue).collect()} == {("n00", -1)}
        assert {(r.root, r.steps, r.on_loop, r.path) for r in tree_of(spark, class_rows(ring), True, residue).collect()} == {("n00", -1, True, None)}


def test_rows_do_not_grow_with_chains_and_rings(spark):
    """Without paths an edge carries a number and a name, however much was taken out of it."""
    n = 4_000
    ring = spark.range(n).select(F.concat(F.lit("r"), F.col("id")).alias("k"), F.concat(F.lit("r"), (F.col("id") + 1) % n).alias("p"))
    chain = spark.range(n).select(F.concat(F.lit("c"), F.col("id")).alias("k"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("p"))
    finished, gone = hierarchy.peel(ring.unionByName(chain), residue=2_000)
    assert gone and all(dict(g.dtypes)["n"] == "bigint" and "via" not in g.columns for g in gone)
    got = hierarchy.hierarchy(ring.unionByName(chain), paths=False, residue=2_000)
    assert got.where("name like 'r%'").select("root", "steps").distinct().collect() == [("r0", -1)]
    assert got.where("name like 'c%' and (root <> 'c0' or steps <> cast(substring(name, 2) as int))").count() == 0


def test_descendants_below_loops(spark):
    loops = [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("below", "l2"), ("lower", "below"), ("least", "lower"), ("side", "below"), ("self", "self"), ("kid", "self"), ("kid2", "kid"), ("top", None), ("under", "top")]
    loops += [(f"c{i:02}", f"c{i - 1:02}" if i else "l3") for i in range(30)]
    parent = dict(loops)
    on_loop = {"l1", "l2", "l3", "self"}
    want = set()
    for name in set(parent) - on_loop:
        up, steps = parent[name], 1
        while up and up not in on_loop:
            want.add((up, name, steps))
            up, steps = parent[up], steps + 1
    links = spark.createDataFrame(loops, "k string, p string")
    for residue in (0, 10_000):
        _check_below_loops(links, residue, want, set(parent) - on_loop)


def _check_below_loops(links, residue, want, names):
    tree = hierarchy.hierarchy(links, below_loops=True, residue=residue)
    assert {(r.ancestor, r.descendant, r.distance) for r in hierarchy.closure(tree).collect()} == want
    got = {r.name: (r.path[0], r.depth, r.descendants) for r in tree.where("not on_loop").collect()}
    assert got.keys() == names
    assert got["below"] == ("below", 0, 3) and got["least"] == ("below", 2, 0) and got["kid"] == ("kid", 0, 1) and got["c00"] == ("c00", 0, 29) and got["top"] == ("top", 0, 1)


# changes and orphans


def log_frame(spark, tmp_path, rows, files=3):
    full = [(s, None, mt, i, tp, props, "a", 1, 2, 3, "b") for s, mt, i, tp, props in rows]
    df = spark.createDataFrame(full, LOG)
    df.repartition(files).write.parquet(str(tmp_path / "log"))
    return spark.read.parquet(str(tmp_path / "log")), [dict(zip(("seq", "mt", "id", "tp", "props"), r, strict=True)) for r in rows]


def links(*targets):
    return [(2, "p", None, None, t, None) for t in targets]


def nasty_log(n=400):
    rng = random.Random(5)
    times = [None, "", "n/a", "2016-01-04T15:49:08+07:00", "2016-01-04 08:49:08", "1/4/2016 8:49:08 AM", "2016-01-04T08:49:08.000Z", "12/31/2016 11:59:59 PM", "2016-02-30T00:00:00Z", "2017-03-01T00:00:00.5Z"]
    ids = ["a", " a ", "|a", "b", "c|", "d", "", None, "hot"]
    types = ["person", "o:person", "{n}Delete ", "delete", "deletion-act", None]
    rows = []
    for s in range(n):
        i = "hot" if s % 3 == 0 else rng.choice(ids)
        props = rng.choice([None, [], links("a", "hot", " d|", "nobody", "", None), [(3, "p", None, None, None, "b"), (0, None, None, None, None, None), (1, "v", "x", None, None, None)]])
        rows.append((s, rng.choice(times), i, rng.choice(types), props))
    return rows


def as_dicts(rows):
    names = ("tag", "prop", "value", "lang", "link", "sourcelink")
    return [{**r, "props": None if r["props"] is None else [dict(zip(names, p, strict=True)) for p in r["props"]]} for r in rows]


def test_current_state_of_hard_rows(spark, tmp_path):
    df, rows = log_frame(spark, tmp_path, nasty_log())
    got = changes.current_state(df)
    assert sorted((r["__key"], r["seq"]) for r in got.collect()) == brute.current(rows)
    assert {"salt", "target", "props"} <= set(got.columns)


def test_current_state_of_nothing(spark, tmp_path):
    df, _ = log_frame(spark, tmp_path, [])
    assert changes.current_state(df).collect() == []


def test_batches_equal_one_batch(spark, tmp_path):
    """Changes that come late and out of order, batch after batch, give the state of all of them at once."""
    rows = nasty_log(200)
    random.Random(1).shuffle(rows)
    table = changes.MergeOnReadTable(spark, str(tmp_path / "table"))
    for i in range(0, 200, 70):
        table.apply(spark.createDataFrame([(s, None, mt, k, tp, p, "a", 1, 2, 3, "b") for s, mt, k, tp, p in rows[i : i + 70]], LOG))
        want = brute.current([dict(zip(("seq", "mt", "id", "tp", "props"), r, strict=True)) for r in rows[: i + 70]])
        assert sorted((r.k, r.seq) for r in table.read().select(key_of("id").alias("k"), "seq").collect()) == want


def test_empty_batches(spark, tmp_path):
    schema = "seq bigint, mt string, id string, tp string"
    table = changes.MergeOnReadTable(spark, str(tmp_path / "t"), buckets=4)
    table.apply(spark.createDataFrame([], schema))
    assert table.read().collect() == []
    table.apply(spark.createDataFrame([(1, None, "a", "x"), (2, None, None, "x"), (3, None, " ", "x")], schema))
    table.apply(spark.createDataFrame([], schema))
    assert [(r.id, r.seq) for r in table.read().select("id", "seq").collect()] == [("a", 1)]


def test_a_batch_touches_only_its_own_buckets(spark, tmp_path):
    """A small batch rewrites the index buckets of its keys and adds vectors of the files it superseded rows in; a batch applied twice counts once."""
    schema = "seq bigint, mt string, id string, tp string"
    table = changes.MergeOnReadTable(spark, str(tmp_path / "t"), buckets=16)
    table.apply(spark.createDataFrame([(i, None, f"k{i}", "x") for i in range(200)], schema).repartition(4))
    assert len(table._manifest(0)) == 16
    small = spark.createDataFrame([(900, "2020-01-01", "k7", "y"), (901, "2020-01-01", "k8", "delete"), (902, None, "k9", "late")], schema)
    for _ in range(2):
        table.version = 0
        table.apply(small)
        touched = {b for b, v in table._manifest(1).items() if v == 1}
        assert 0 < len(touched) <= 3
        assert spark.read.parquet(table._at("index", 1)).select("bucket").distinct().count() == len(touched)
        bits = spark.read.parquet(table._at("vectors", 1)).select(F.sum(F.bitmap_count("dead"))).first()[0]
        assert bits >= 4  # k7 and k8 of the first batch, the tombstone and the late row of the second
        got = {r.id: r.seq for r in table.read().select("id", "seq").collect()}
        assert got == {f"k{i}": i for i in range(200) if i != 8} | {"k7": 900}


def test_blocks_of_vectors(spark, tmp_path, monkeypatch):
    """Files longer than a block, with vectors joined instead of broadcast."""
    n = changes.BLOCK + 500
    rows = spark.range(n).select(F.col("id").alias("seq"), F.lit(None).cast("string").alias("mt"), F.concat(F.lit("k"), F.col("id") % 20_000).alias("id"), F.when(F.col("id") % 7 == 0, "delete").otherwise("x").alias("tp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "big"))
    monkeypatch.setattr(changes, "BROADCAST_BYTES", 0)
    got = {r.seq for r in changes.current_state(spark.read.parquet(str(tmp_path / "big"))).select("seq").collect()}
    assert got == {s for s in range(20_000) if s % 7}


def test_packed_order(spark):
    """One number orders changes as time and sequence number do, at the ends of both, and says which are tombstones."""
    rows = [(s, mt, d) for s in (None, -(1 << 63), -1, 0, 7, (1 << 63) - 1) for mt in (None, "bad", "0001-01-01", "2016-01-04T08:49:08.000001Z", "1/4/2016 8:49:08 AM", "9999-12-31T23:59:59.999999Z") for d in (True, False)]
    df = spark.createDataFrame(rows, "seq bigint, mt string, dead boolean")
    got = df.select("seq", "dead", changes.order_of(F.col("seq"), F.col("mt")).alias("o"), changes.packed_order(F.col("seq"), F.col("mt"), F.col("dead")).alias("n")).collect()
    assert all(r.n is not None and int(r.n) % 2 == r.dead for r in got)
    key = lambda r: (r.o["at"], float("-inf") if r.seq is None else ~r.seq, r.dead)
    assert all((r.o["first"] is None) == (r.seq is None) for r in got)
    assert [key(r) for r in sorted(got, key=lambda r: int(r.n))] == sorted(map(key, got))
    plan = orphans.parents(spark.createDataFrame([], LOG))._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan


def test_orphans_of_hard_rows(spark, tmp_path, monkeypatch):
    df, rows = log_frame(spark, tmp_path, nasty_log())
    want = brute.orphans(as_dicts(rows))
    for piece in (1, 20, 10_000):  # with only hot targets, some, none
        monkeypatch.setattr(orphans, "PIECE", piece)
        got = orphans.orphans(orphans.references(df), orphans.parents(df))
        assert sorted((r.seq, r.pos, r.status) for r in got.collect()) == want
    assert orphans.orphans(orphans.references(df.limit(0)), orphans.parents(df.limit(0))).collect() == []


def test_delete_marker(spark):
    df = spark.createDataFrame([("delete",), ("{x}DELETE ",), ("o:delete",), ("deletion-act",), (None,)], "tp string")
    assert [r[0] for r in df.select(is_delete("tp")).collect()] == [True, True, True, False, False]


# nested records


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (None, []), ("", []), ("  ", []), ("{", []), ("[NaN]", []), ("null", []), ("3", []), ('"{}"', []), ('{"props":null}', []), ("[]", []), ('{"a":1} x', []),
        ('{"id":"r","props":{"field":{"prop":"a"}}}', [("0.0", "field", "r")]),
        ('{"props":[null,{},{"tag":0},[0,null],[1,{"prop":"a"}],{"tag":"3","prop":"b"}]}', [("0.4", "field", ""), ("0.5", "invlink", "")]),
        ('[1,{"id":"x","props":[[2,{"prop":"p","record":"[{\\"id\\":\\"y\\",\\"props\\":[{\\"field\\":{\\"prop\\":\\"q\\"}}]}]"}]]}]', [("1.0", "objprop", "x"), ("1.0.0.0", "field", "y")]),
        ('{"props":[{"objprop":{"prop":"p","record":"broken"}},{"objprop":{"prop":"p","record":7}}]}', [("0.0", "objprop", ""), ("0.1", "objprop", "")]),
        ('{"props":[1,{"prop":"a"}]}', [("0.0", "field", "")]),
    ],
)
def test_bodies(spark, body, want):
    df = spark.createDataFrame([(5, body, "x", 1)], "raw_id bigint, body string, kind string, pre int")
    got = nested.held(nested.label_nodes(df))
    assert sorted((r.entry_path, r.kind, r.holder_id or "") for r in got.collect()) == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('{"props":[{"tag":"²","prop":"a"},{"tag":"++3","prop":"a"},{"tag":1e999,"prop":"a"},{"tag":"+3","prop":"b"},{"tag":2.0,"prop":"c"},{"tag":true,"prop":"d"}]}', [("0.3", "invlink"), ("0.4", "objprop")]),
        ('{"props":[{"field":null,"objprop":{"prop":"a"}},{"field":{},"invlink":{"prop":"b"}},{"field":null}]}', [("0.0", "objprop"), ("0.1", "invlink")]),
        ('{"id":' + "7" * 9_000 + ',"props":[{"field":{"prop":"a","value":' + "8" * 5_000 + '}},{"tag":' + "1" * 5_000 + ',"prop":"b"}]}', [("0.0", "field")]),
    ],
)
def test_dirty_bodies_lose_nothing_and_stop_nothing(body, want):
    assert [(n["at"], n["kind"]) for n in nested.walk(body) if n["node"] == "entry"] == want


def test_numbers_and_values_of_any_size():
    node = nested.walk('{"id":' + "7" * 9_000 + ',"props":[{"field":{"prop":"a","value":{"x":[1,' + "8" * 5_000 + ',null,"é"]}}}]}')
    assert node[0]["id"] == "7" * 9_000 and node[1]["value"] == '{"x": [1, ' + "8" * 5_000 + ', null, "é"]}'
    deep = "[" * 200_000 + "]" * 200_000
    assert nested.walk('{"props":[{"field":{"prop":"a","value":' + deep + "}}]}")[1]["value"] == deep


def test_deep_body_and_intervals(spark):
    depth = 3_000
    body = '{"id":"r","props":[[2,{"prop":"p","record":' * depth + '{"id":"leaf","props":[{"field":{"prop":"v"}}]}' + "}]]}" * depth
    nodes = nested.walk(body)
    assert len(nodes) == 2 * depth + 2 and nodes[-1]["kind"] == "field" and nodes[-1]["at"].count(".") == 2 * depth + 1
    spans = [(n["pre"], n["post"]) for n in nodes]
    assert all(a < b for a, b in spans) and len({x for s in spans for x in s}) == 2 * len(spans)
    df = spark.createDataFrame([(1, body), (1, body), (2, None)], "raw_id bigint, body string")
    assert nested.held(nested.label_nodes(df.where("raw_id = 2"))).collect() == []
    assert nested.records(nested.label_nodes(df.limit(1))).count() == depth + 1


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4)), st.sampled_from([None, 1]), st.integers(0, 60))
def test_stack_parser_equals_the_usual_one(value, indent, cut_at):
    text = json.dumps(value, indent=indent)
    assert nested._parse_deep(text) == json.loads(text)
    assert nested._text(value) == json.dumps(value, ensure_ascii=False)
    for bad in (text[:cut_at], text + ",", text[:cut_at] + "}" + text[cut_at:]):
        try:
            want = json.loads(bad, parse_constant=nested._no)
        except ValueError:
            with pytest.raises(ValueError):
                nested._parse_deep(bad)
        else:
            assert nested._parse_deep(bad) == want


# wide tables


def test_wide_of_hard_rows(spark):
    rng = random.Random(2)
    declared = [("age", "integer", True, 1), ("Height", "real", True, None), ("born", "date", True, 2), ("alive", "boolean", True, 3), ("name", "string", False, 0), ("link", "iri", True, 4), ("subj", "string", True, 9)]
    props = spark.createDataFrame([(a, r, s, p) for a, r, s, p in declared], "about string, range_of string, single_valued boolean, priority int")
    values = [None, "", " ", "12", "+12", "1 200", "12 00", "1.5", "1,50", "-.5", "1e3", "t", "FALSE", "0", "2001-02-30", "28.02.2001", "2001", "2001-01", "01.01.2001", "x", "9" * 40, "½"]
    preds = ["age", "o:AGE", "{n}height ", "born", "alive", "name", "link", "undeclared", None]
    rows = [(rng.choice(["a", "b", "hot", "hot", None]), rng.choice(preds), rng.choice([1, 2, None]), rng.choice(values), "clash") for _ in range(600)]
    facts = spark.createDataFrame(rows, "subj string, pred string, tag int, obj string, v0 string")
    attributes = wide.discover(props)
    assert [a for a, _, _ in attributes] == ["name", "age", "born", "alive", "link", "subj", "height"]
    pivoted = wide.pivot(facts, attributes)
    kinds = {a.lower(): (r, s) for a, r, s, _ in declared}
    want = [x for x in brute.unclean(((s, p, o) for s, p, _, o, _ in rows if o != "9" * 40), kinds)]
    clean = wide.unclean_cells(wide.pivot(facts.where(F.col("obj") != "9" * 40), attributes), attributes)
    assert sorted(map(tuple, clean.collect())) == want
    out = wide.wide_rows(pivoted, attributes)
    assert out.columns == ["subj", "name", "age", "born", "alive", "link", "subj_value", "height"]
    assert dict(out.dtypes)["age"] == "decimal(38,0)" and dict(out.dtypes)["height"] == "double" and dict(out.dtypes)["born"] == "date"
    assert sorted(r.subj for r in out.collect()) == ["a", "b", "hot"]
    assert wide.unclean_cells(wide.pivot(facts.limit(0), attributes), attributes).collect() == []


def test_more_attributes_than_a_plan_takes(spark, monkeypatch):
    monkeypatch.setattr(wide, "A_PLAN", 2)
    attributes = [(f"a{i}", "integer", True) for i in range(5)]
    rows = [("x", f"a{i}", v) for i in range(5) for v in ("1", "no" if i % 2 else "2")] + [("y", "a4", "old")]
    facts = spark.createDataFrame(rows, "subj string, pred string, obj string")
    assert {tuple(r) for r in wide.unclean(facts, attributes).collect()} == {("x", "a0", "conflict"), ("x", "a2", "conflict"), ("x", "a4", "conflict"), ("y", "a4", "untyped")}
    got = {r.subj: tuple(r)[1:] for r in wide.wide_table(facts, attributes).collect()}
    assert got == {"x": (1, 1, 1, 1, 1), "y": (None,) * 5}
    assert wide.unclean(facts, []).collect() == [] and wide.wide_table(facts, []).count() == 2


def test_no_value_of_many_is_lost(spark):
    attributes = [("part", "string", False), ("age", "integer", True)]
    rows = [("x", "part", "b"), ("x", "o:Part", " a "), ("x", "part", "b"), ("x", "age", "1 000"), ("x", "age", "1000"), ("x", "age", "old"), ("y", "part", " "), ("y", "else", "z")]
    facts = spark.createDataFrame(rows, "subj string, pred string, obj string")
    assert {tuple(r) for r in wide.values(facts, attributes).collect()} == {("x", "part", "a", 1), ("x", "part", "b", 2), ("x", "age", "1000", 2)}
    assert {tuple(r) for r in wide.counts(wide.pivot(facts, attributes), attributes).collect()} == {("x", "part", 3, 3), ("x", "age", 3, 2)}
