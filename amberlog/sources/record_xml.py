"""Record files in XML: one element per record, besides deletions and substitutions of ids, under a head that names owner, prefix and counter.

A record element has rdf:about and perhaps mT; each child is a link (rdf:resource) or a field (text, perhaps xml:lang).  Files are read as streams,
element by element, one file per task.

Defined results.  Ids and links lose bars and outer white space; names become the given namespace and their local name.  An ``iisstore`` child
becomes the fields uri, contenttype and docmetainfo (its other attributes as name:value; with ; in values written as |).  Records without id are
left out.  Elements of other names under a record keep their order.  A file that breaks off gives what was complete before that.
"""

from __future__ import annotations

import xml.etree.ElementTree as Xml
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amberlog.sources import streams

#: The public namespaces of the attributes, and the names of elements that are no records.
RDF, XML = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/XML/1998/namespace}"
DELETE, SUBSTITUTE, STORED = "delete", "substitute", "iisstore"
ENTRIES = "array<struct<tag:int,prop:string,value:string,lang:string,link:string,sourcelink:string>>"
ROWS = f"file string, place bigint, owner string, prefix string, counter string, kind string, id string, tp string, mt string, new_id string, props {ENTRIES}"
_ENTRY = ("tag", "prop", "value", "lang", "link", "sourcelink")
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _id(s: str | None) -> str | None:
    return None if s is None else s.replace("|", "").strip(_SPACE)


def entries(element: Xml.Element, namespace: str) -> list[dict]:
    """The entries of a record element."""
    field = lambda name, value, lang="": dict(zip(_ENTRY, (1, namespace + name, value, lang, None, None), strict=True))
    out, stored = [], []
    for e in element:
        name = _local(e.tag)
        if name == STORED:
            rest = "".join(f"{_local(k)}:{v.replace(';', '|')};" for k, v in e.attrib.items() if _local(k) not in ("uri", "contenttype"))
            stored += [field(n, v) for n, v in (("uri", e.get("uri")), ("contenttype", e.get("contenttype")), ("docmetainfo", rest or None)) if v is not None]
        elif (resource := e.get(f"{RDF}resource")) is not None:
            out.append(dict(zip(_ENTRY, (2, namespace + name, None, None, _id(resource), None), strict=True)))
        else:
            out.append(field(name, "".join(e.itertext()), e.get(f"{XML}lang", "")))
    return out + stored


def elements(stream, namespace: str = "") -> Iterator[dict]:
    """The rows of one file, read as a stream."""
    head: dict[str, str | None] = {}
    root, place = None, 0
    parser = Xml.iterparse(stream, events=("start", "end"))
    depth = 0
    while True:
        try:
            event, e = next(parser)
        except (StopIteration, Xml.ParseError):
            return
        if event == "start":
            depth += 1
            if depth == 1:
                root, head = e, {n: e.get(n) for n in ("owner", "prefix", "counter")}
            continue
        depth -= 1
        if depth != 1:
            continue
        name = _local(e.tag)
        row = {"place": place, **head, "kind": "record", "id": _id(e.get(f"{RDF}about")), "tp": None, "mt": e.get("mT"), "new_id": None, "props": None}
        if name == DELETE:
            row |= {"kind": DELETE, "id": row["id"] if row["id"] is not None else _id(e.get("id"))}
        elif name == SUBSTITUTE:
            row |= {"kind": SUBSTITUTE, "id": _id(e.get("old-id")), "new_id": _id(e.get("new-id"))}
        else:
            row |= {"tp": namespace + name, "props": entries(e, namespace)}
        root.clear()
        if row["id"]:
            yield row
            place += 1


def read(spark: SparkSession, path: str, namespace: str = "") -> DataFrame:
    """The rows of all record files under a path, as in ROWS; ``place`` is the position in the file."""
    names = [f.name for f in T._parse_datatype_string(ROWS).fields]
    entry = pa.struct([(n, pa.int32() if n == "tag" else pa.string()) for n in _ENTRY])
    schema = pa.schema([(n, pa.int64() if n == "place" else pa.list_(entry) if n == "props" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                held: list[dict] = []
                with streams.opened(file) as stream:
                    for row in elements(stream, namespace):
                        held.append({"file": file, **row})
                        if len(held) == 5_000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    return streams.paths(spark, path).mapInArrow(run, ROWS)


def xml_text(id_: Column, tp: Column, mt: Column, props: Column) -> Column:
    """A record as the text of an XML element, by expressions alone; inverse entries are left out, names are those of tp and prop without namespace."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(safe(c), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    short = lambda c: F.regexp_extract(c, r"([^/#}:]*)$", 1)

    def child(e: Column) -> Column:
        lang = F.when(F.coalesce(e["lang"], F.lit("")) != "", F.concat(F.lit(" xml:lang="), quoted(e["lang"]))).otherwise("")
        link = F.concat(F.lit("<"), short(e["prop"]), F.lit(" rdf:resource="), quoted(F.coalesce(e["link"], F.lit(""))), F.lit("/>"))
        return F.when(e["tag"] == 2, link).otherwise(F.concat(F.lit("<"), short(e["prop"]), lang, F.lit(">"), safe(F.coalesce(e["value"], F.lit(""))), F.lit("</"), short(e["prop"]), F.lit(">")))

    inner = F.array_join(F.transform(F.filter(F.coalesce(props, F.array().cast(ENTRIES)), lambda e: e["tag"].isin(1, 2)), child), "")
    stamp = F.when(mt.isNotNull(), F.concat(F.lit(" mT="), quoted(mt))).otherwise("")
    return F.concat(F.lit("<"), short(tp), F.lit(" rdf:about="), quoted(id_), stamp, F.lit(">"), inner, F.lit("</"), short(tp), F.lit(">"))


def document(rows: list[str], owner: str | None = None, prefix: str | None = None, counter: str | None = None) -> str:
    """A record file of element texts with its head."""
    head = "".join(f" {n}={quoteattr(v)}" for n, v in (("owner", owner), ("prefix", prefix), ("counter", counter)) if v is not None)
    return f'<rdf:RDF xmlns:rdf="{RDF[1:-1]}"{head}>\n' + "\n".join(rows) + "\n</rdf:RDF>\n"


def deletion_text(id_: str) -> str:
    return f"<{DELETE} id={quoteattr(escape(id_))}/>"
