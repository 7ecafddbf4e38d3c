"""Record files, ontologies and sequences read as streams, and what the ingest makes of them."""

import random

import pytest
from pyspark.sql import functions as F

from amberlog.functions.times import change_time
from amberlog.operators import classes, edits, graph, ingest
from amberlog.operators.table import Index, Table
from amberlog.sources import files, ontology_file, record_xml, text_form
from amberlog.sources.typed import INTEGER, STRING, record, sequence

HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" owner="me" prefix="p_" counter="17">\n'
ONE = (
    HEAD
    + """<person rdf:about=" a|1 " mT="2016-01-04T10:00:00"><name xml:lang="ru">Анна &amp; Co</name><father rdf:resource="b|"/><empty/><iisstore uri="u" contenttype="text" w="1;2" h="3"/></person>
<person rdf:about="a1" mT="2016-01-04T10:00:00"><name>second of a tie</name></person>
<person rdf:about="a1"><name>no time</name></person>
<photo rdf:about="d"><of rdf:resource="s1"/><of rdf:resource="a1"/><of rdf:resource="s3"/></photo>
<photo rdf:about="s1"><name>substituted</name></photo>
<photo rdf:about="gone"><name>deleted</name></photo>
<photo><name>without id</name></photo>
<substitute old-id="s1" new-id="s2"/><substitute old-id="s1" new-id="b"/><substitute old-id="s3" new-id="gone"/><substitute old-id="gone" new-id="a1"/>
</rdf:RDF>"""
)
TWO = HEAD.replace(' owner="me"', "") + '<delete id="gone"/><person rdf:about="b" mT="1/4/2016 1:00:00 AM"><name>B</name></person><person rdf:about="gone" mT="2030-01-01"><name>redefined</name></person>'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.xml").write_text(ONE, encoding="utf-8")
    (tmp_path / "f" / "2.xml").write_text(TWO, encoding="utf-8")  # breaks off
    return str(tmp_path / "f")


def test_record_files_are_read(spark, folder):
    rows = sorted(record_xml.read(spark, folder, "ns:").collect(), key=lambda r: (r.file, r.place))
    first = rows[0]
    assert (first.id, first.tp, first.mt, first.owner, first.prefix, first.counter) == ("a1", "ns:person", "2016-01-04T10:00:00", "me", "p_", "17")
    assert [(e.tag, e.prop, e.value, e.lang, e.link) for e in first.props] == [
        (1, "ns:name", "Анна & Co", "ru", None), (2, "ns:father", None, None, "b"), (1, "ns:empty", "", "", None), (1, "ns:uri", "u", "", None), (1, "ns:contenttype", "text", "", None), (1, "ns:docmetainfo", "w:1|2;h:3;", "", None),
    ]
    assert [(r.kind, r.id, r.new_id) for r in rows if r.kind != "record"] == [("substitute", "s1", "s2"), ("substitute", "s1", "b"), ("substitute", "s3", "gone"), ("substitute", "gone", "a1"), ("delete", "gone", None)]
    assert sum(r.kind == "record" for r in rows) == 8 and rows[-1].owner is None


def test_ingest_of_record_files(spark, folder):
    out = ingest.ingested(record_xml.read(spark, folder), change_time("mt"), ("root", "collection"))
    got = {r.id: r for r in out.collect()}
    assert got.keys() == {"a1", "b", "d", "root"}  # s1, s3 are substituted, gone is deleted though it was defined and substituted again
    assert got["a1"].props[0].value == "Анна & Co"  # of equal times the first
    assert [e.link for e in got["d"].props] == ["b", "a1", "gone"]  # the last substitution counts; a chain ends at a deleted id


def test_records_as_xml_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("a<1", "x/y#person", "t", [(1, "ns}name", 'A "b" & <c>', "en", None, None), (2, "f:of", None, None, 'q"&', None), (3, "f:back", None, None, None, "z")]), ("b", "person", None, None)], f"id string, tp string, mt string, props {record_xml.ENTRIES}")
    files.write_records(rows, str(tmp_path / "out"), owner="o&o")
    files.write_records(rows.where("id = 'b'"), str(tmp_path / "out"), mode="append")
    back = record_xml.read(spark, str(tmp_path / "out")).collect()
    a = next(r for r in back if r.id == "a<1")
    assert (a.tp, a.mt, a.owner) == ("person", "t", "o&o") and [(e.tag, e.prop, e.value, e.lang, e.link) for e in a.props] == [(1, "name", 'A "b" & <c>', "en", None), (2, "of", None, None, 'q"&')]
    assert sum(r.id == "b" for r in back) == 2


def test_text_sequences_in_pieces_of_any_size(spark, tmp_path):
    kind = record(id=INTEGER, name=STRING, more=sequence(STRING))
    values = [(i, 'a"],[}\\' + str(i), ["x,y", "]"][: i % 3]) for i in range(7)]
    text = " [" + " ,\n".join(text_form.write(v, kind) for v in values) + "] "
    for size in (1, 2, 3, 7, 1_000):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        assert [(a, b, list(c)) for a, b, c in text_form.read_pieces(iter(pieces), kind)] == values
    assert list(text_form.elements(iter(["[", " ", "]"]))) == []
    with pytest.raises(ValueError):
        list(text_form.elements(iter(["[{1", "},"])))
    (tmp_path / "t.txt").write_text(text)
    assert files.read_text(spark, str(tmp_path / "t.txt"), kind).count() == 7


ONTOLOGY = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
<Class rdf:about="entity" priority="1"><label xml:lang="en">Entity</label></Class>
<Class rdf:about="person" priority="2"><SubClassOf rdf:resource="entity"/></Class>
<Class rdf:about="author"><SubClassOf rdf:resource="person"/></Class>
<DatatypeProperty rdf:about="name" priority="b"><domain rdf:resource="entity"/><label xml:lang="ru">имя</label></DatatypeProperty>
<ObjectProperty rdf:about="father" priority="a"><domain rdf:resource="person"/><range rdf:resource="person"/><inverse-label xml:lang="en">child</inverse-label></ObjectProperty>
<ObjectProperty rdf:about="both"><domain rdf:resource="person"/><domain rdf:resource="author"/><range rdf:resource="entity"/></ObjectProperty>
<EnumerationType rdf:about="sex"><state value="m" xml:lang="en">male</state><state value="m" xml:lang="ru">муж</state></EnumerationType>
</rdf:RDF>"""


def test_ontology_file(spark, tmp_path):
    (tmp_path / "o.xml").write_text(ONTOLOGY, encoding="utf-8")
    o = ontology_file.read(spark, str(tmp_path / "o.xml"))
    assert sorted(r.about for r in o.classes.collect()) == ["author", "entity", "person"]
    assert {tuple(r) for r in o.labels.collect()} == {("entity", "en", "Entity", False), ("name", "ru", "имя", False), ("father", "en", "child", True)}
    assert o.states.count() == 2 and o.props.where("about = 'both'").count() == 2
    up = classes.with_self(classes.tree_of(o.classes, "about", "subclassof"))
    direct = {(r.tp, r.pos): r.prop for r in classes.direct_props(up, o.props).collect()}
    assert [direct["author", i] for i in range(3)] == ["father", "name", "both"] and ("author", 3) not in direct and direct["entity", 0] == "name"
    inverse = {(r.tp, r.prop) for r in classes.inverse_props(up, o.props).collect()}
    assert inverse == {("person", "father"), ("author", "father"), ("entity", "both"), ("person", "both"), ("author", "both")}
    assert {r.tp for r in classes.domains(o.props, "both").collect()} == {"person", "author"} and [r.tp for r in classes.ranges(o.props, "father").collect()] == ["person"]
    records = spark.createDataFrame([("x", "author", [(1, "name", "X", None, None, None), (2, "father", None, None, "y", None)]), ("y", "person", [(1, "name", "Y", None, None, None)])], f"id string, tp string, props {record_xml.ENTRIES}")
    assert {(r.path, r.value) for r in classes.portrait_tree("x", records, o.props, up).collect()} >= {("", "X"), ("/father", "Y")}
    assert classes.portrait_tree("nobody", records, o.props, up).collect() == []


def test_templates_match_by_subclass_forwards_and_exactly_backwards(spark):
    f = lambda v: (1, "name", v, None, None, None)
    to = lambda p, t: (2, p, None, None, t, None)
    records = spark.createDataFrame([("r", "thing", [f("R"), to("of", "a"), to("of", "b"), to("of", "c")]), ("a", "author", [f("A"), to("in", "r")]), ("b", "person", [f("B"), to("in", "r")]), ("c", "stone", [f("C"), to("in", "r")])], f"id string, tp string, props {record_xml.ENTRIES}")
    up = spark.createDataFrame([("author", "author"), ("person", "author"), ("person", "person"), ("stone", "stone")], "anc string, id string")
    person = graph.Template(fields=("name",), types=("person",))
    shape = graph.Template(fields=("name",), direct={"of": person}, inverse={"in": person})
    got = {(r.path, r.value) for r in graph.tree(spark.createDataFrame([("r",)], "id string"), records, shape, up).collect()}
    assert got == {("", "R"), ("/of", "A"), ("/of", "B"), ("/^in", "B")}
    plain = {(r.path, r.prop, r.value, r.target) for r in graph.plain_tree(spark.createDataFrame([("r",)], "id string"), records).collect()}
    assert ("/^in", "in", None, "r") not in plain and ("/of", "in", None, "r") in plain and ("/^in", "name", "A", None) in plain and ("/of/in", "name", "R", None) in plain
    gone = edits.without_records(records, spark.createDataFrame([("r",), ("b",)], "id string"))
    assert {r.id: len(r.props) for r in gone.collect()} == {"a": 1, "c": 1}


def test_table_with_indexes(spark, tmp_path):
    rows = [(1, 0, "Ab", ["x", "y", "x"], "p"), (1, 1, "ab", ["x"], "p"), (2, 2, "AC", ["y", None], "p"), (3, 3, None, None, "p"), (4, 4, "abc", ["x"], ""), (None, 5, "ab", ["x"], "p")]
    df = spark.createDataFrame(rows, "k int, at int, name string, tags array<string>, kind string")
    t = Table(df, "k", ["at"], F.col("kind") == "", (Index(F.col("tags")), Index(F.col("name"), "ordered", ignore_case=True), Index(F.col("at"), "ordered", where=F.col("at") > 1)))

    def check(t):
        ids = lambda found: sorted((r.k, r.at) for r in found.collect())
        assert ids(t.get(1)) == [(1, 1)] and ids(t.get(4)) == [] and ids(t.versions(1)) == [(1, 0), (1, 1)]
        assert ids(t.all_using(0, "x")) == [(1, 1)] and ids(t.all_using(0, "y")) == [(2, 2)] and ids(t.all_using(0, "none")) == []
        assert ids(t.like_using(1, "A")) == [(1, 1), (2, 2)] and ids(t.all_using(1, "aB")) == [(1, 1)] and ids(t.like_using(1, "")) == [(1, 1), (2, 2)]
        assert ids(t.range_using(2, 0, 10)) == [(2, 2), (3, 3)]

    check(t)
    t.build(str(tmp_path / "i"), buckets=4)
    check(t)
    more = t.appended(spark.createDataFrame([(2, 9, "zz", ["x"], "p")], df.schema))
    assert sorted(r.k for r in more.all_using(0, "x").collect()) == [1, 2] and more.like_using(1, "ac").collect() == []


def test_positions_and_sections(spark, tmp_path):
    from amberlog.operators import log, partitions

    base = spark.createDataFrame([(i, f"n{i}", i) for i in range(5)], "at int, name string, x int")
    changes = spark.createDataFrame([(1, "new"), (3, None), (9, "outside")], "at int, name string")
    assert [(r.at, r.name, r.x) for r in log.stored_order(log.overwritten(base, "at", changes), "at").collect()] == [(0, "n0", 0), (1, "new", 1), (2, "n2", 2), (3, None, 3), (4, "n4", 4)]
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.choice("abc")) for i in range(40)], "k bigint, ext string")
    for i in range(2):
        partitions.append_rows(rows.where(F.col("k") % 2 == i), "k", 4, str(tmp_path / "s"), ("ext",))
    want = sorted(r.k for r in rows.where("ext = 'b'").collect())
    assert sorted(r.k for r in partitions.by_secondary(spark, str(tmp_path / "s"), "k", "ext", "b", 4).collect()) == want
