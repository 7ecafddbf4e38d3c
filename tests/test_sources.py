import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amberlog.sources import binary_form, files, text_form, typed
from amberlog.sources.typed import BOOLEAN, BYTE, CHARACTER, INTEGER, LONG, NONE, REAL, STRING, Kind, record, sequence, union

PERSON = record(id=INTEGER, name=STRING, age=REAL)
POINT = record(x=REAL, y=REAL)
FIGURES = sequence(union(nothing=NONE, point=POINT, polygon=sequence(POINT), circle=record(center=POINT, radius=REAL)))
SHAPES = [(1, (3.5, 7.8)), (2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]), (3, ((5.0, 5.0), 4.99)), (0, None)]


def kinds_and_values(depth=2):
    atoms = st.sampled_from([
        (BOOLEAN, st.booleans()), (BYTE, st.integers(0, 255)), (INTEGER, st.integers(-(2**31), 2**31 - 1)), (LONG, st.integers(-(2**63), 2**63 - 1)),
        (REAL, st.floats(allow_nan=False)), (STRING, st.text(st.characters(exclude_categories=["Cs"]))), (NONE, st.none()),
    ])
    if not depth:
        return atoms
    inner = kinds_and_values(depth - 1)

    def rec(parts):
        return record(**{f"f{i}": k for i, (k, _) in enumerate(parts)}), st.tuples(*(v for _, v in parts))

    def seq(part):
        return sequence(part[0]), st.lists(part[1], max_size=3)

    def uni(parts):
        return union(**{f"v{i}": k for i, (k, _) in enumerate(parts)}), st.one_of(*(v.map(lambda x, i=i: (i, x)) for i, (_, v) in enumerate(parts)))

    filled = inner.filter(lambda kv: kv[0].name != "none")
    return st.one_of(atoms, st.lists(filled, min_size=1, max_size=3).map(rec), filled.map(seq), st.lists(inner, min_size=1, max_size=3).map(uni))


values = kinds_and_values().flatmap(lambda kv: st.tuples(st.just(kv[0]), kv[1]))


@given(values)
def test_round_trips(kv):
    kind, v = kv
    assert text_form.read(text_form.write(v, kind), kind) == v
    assert binary_form.read(binary_form.write(v, kind), kind) == v
    assert text_form.read(text_form.write_pretty(v, kind), kind) == v
    assert typed.from_value(typed.as_value(kind)) == kind
    assert typed.from_spark(typed.to_spark(v, kind), kind) == v or kind.name == "none"


def test_golden_forms():
    assert text_form.write((777, "Pupkin", 9.9999), PERSON) == typed.readable((777, "Pupkin", 9.9999), PERSON) == '{777,"Pupkin",9.9999}'
    assert typed.readable((777, "Pupkin", 9.9999), PERSON, names=True) == '{id:777,name:"Pupkin",age:9.9999}'
    assert text_form.write([99, 98, 97], sequence(INTEGER)) == "[99,98,97]"
    assert text_form.write(SHAPES[:1], FIGURES) == "[1^{3.5,7.8}]"
    assert typed.readable(SHAPES[0], FIGURES.element) == "point^{3.5,7.8}"
    assert typed.readable('a"b\\', STRING) == '"a\\"b\\"' and text_form.write('a"b\\', STRING) == '"a\\"b\\\\"'
    assert binary_form.write((7777, "Пупкин", 0.0001), PERSON)[:5] == (7777).to_bytes(4, "little") + bytes([12])
    assert binary_form.write([1], sequence(BYTE)) == bytes([1, 0, 0, 0, 0, 0, 0, 0, 1])


@pytest.mark.parametrize(("x", "text"), [(1e20, "1E+20"), (1e-5, "1E-05"), (0.0001, "0.0001"), (-0.0, "-0"), (123456789012345.0, "123456789012345"), (1e15, "1E+15"), (math.inf, "Infinity"), (2.5, "2.5")])
def test_reals(x, text):
    assert text_form.write(x, REAL) == text and text_form.read(text, REAL) == x


def test_strings_and_flows():
    assert text_form.read('"a\nb\\n\\t\\q\\\\"', STRING) == "a\nb\n\tq\\"
    assert list(text_form.read_flow("[ ]", INTEGER)) == []
    assert "".join(text_form.write_flow(iter([1, 2]), INTEGER)) == "[1,2]"
    assert text_form.read(" [ 1 , 2 ] ", sequence(INTEGER)) == [1, 2]
    assert text_form.write("x", CHARACTER) == "x" and text_form.read("x", CHARACTER) == "x"
    assert text_form.write_pretty([(1, "a", 2.0)], sequence(PERSON)) == '[\n    {1,"a",2}\n]'
    assert typed.to_spark(None, STRING) == "" and text_form.write(None, STRING) == '""'


def test_errors():
    for bad in ("{1,2}", '{1,"a}', "[1", "x"):
        with pytest.raises(ValueError):
            text_form.read(bad, PERSON)
    with pytest.raises(ValueError):
        text_form.write((1,), PERSON)
    with pytest.raises(ValueError):
        binary_form.write((9, None), FIGURES.element)
    with pytest.raises(ValueError):
        binary_form.read(b"\x01", INTEGER)
    with pytest.raises(ValueError):
        text_form.write("x", Kind("fstring", size=3))
    with pytest.raises(ValueError):
        Kind("objpair")
    assert typed.from_value(typed.as_value(Kind("fstring", size=3))).size == 3
    assert typed.from_value(typed.as_value(sequence(INTEGER, growing=True))).growing


def test_files(spark, tmp_path):
    rows = [(1, 'a"b', 0.5), (2, "Пупкин\nx", -3.0)]
    for i, part in enumerate((rows, [], rows[:1])):
        (tmp_path / f"t{i}.txt").write_text("".join(text_form.write_flow(iter(part), PERSON)))
        (tmp_path / f"b{i}.bin").write_bytes(binary_form.write(part, sequence(PERSON)))
    want = sorted([*rows, rows[0]])
    assert sorted(map(tuple, files.read_text(spark, f"{tmp_path}/*.txt", PERSON).collect())) == want
    df = files.read_binary(spark, f"{tmp_path}/*.bin", PERSON)
    assert sorted(map(tuple, df.collect())) == want
    assert sorted(binary_form.read(bytes(r.content), PERSON) for r in files.binary_column(df, PERSON).collect()) == want
    pairs = record(id=INTEGER, tags=sequence(STRING))
    lines = spark.createDataFrame([(1, ["a", 'b"']), (2, [])], "id int, tags array<string>")
    files.write_text(lines, pairs, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{1,["a","b\\""]}', "{2,[]}"]


def test_text_column_of_unions(spark):
    kind = union(none=NONE, link=STRING, flag=BOOLEAN)
    df = spark.createDataFrame([((0, None, None),), ((1, 'x"', None),), ((2, None, True),)], "u struct<tag int, link string, flag boolean>")
    assert [r[0] for r in df.select(typed.text_column(F.col("u"), kind)).collect()] == ["0^", '1^"x\\""', "2^t"]


def test_record_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<all><person about="p|1 " mT="x"><name>A</name></person><person about="p2"/><photo about="q"/></all>')
    df = files.canonical(files.read_records(spark, str(tmp_path / "a.xml"), "person", "_about string, _mT string, name string"), "_about")
    assert sorted((r._about, r._mT, r.name) for r in df.collect()) == [("p1", "x", "A"), ("p2", None, None)]


def test_triple_text(spark):
    df = spark.createDataFrame([("a", "p", 1, "b", None), ("a", "q", 2, 'x"', "en"), ("a", "q", 2, "y", None)], "s string, p string, tag int, o string, l string")
    got = [r[0] for r in df.select(files.triple_text(F.col("s"), F.col("p"), F.col("tag"), F.col("o"), F.col("l"))).collect()]
    assert got == ["<a> <p> <b>.", '<a> <q> "x\\""@en.', '<a> <q> "y".']
