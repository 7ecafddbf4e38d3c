"""An ontology in XML: classes, properties and enumerations with their labels, as small tables.  The specification is read on the driver."""

from __future__ import annotations

import xml.etree.ElementTree as Xml
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from amberlog.sources.record_xml import RDF, XML

#: The kinds of elements.
CLASS, PROPERTIES, ENUMERATION = "Class", ("DatatypeProperty", "ObjectProperty"), "EnumerationType"


@dataclass
class Ontology:
    """classes (about, subclassof, priority), props (about, kind, domain_of, range_of, priority), labels (about, lang, label, inverse), states (about, value, lang, label)."""

    classes: DataFrame
    props: DataFrame
    labels: DataFrame
    states: DataFrame


def rows(text: str) -> dict[str, list[tuple]]:
    """The tables of an ontology as rows.  A property with several domains or ranges has a row for each pair; a label without text is none."""
    out: dict[str, list[tuple]] = {"classes": [], "props": [], "labels": [], "states": []}
    resource = lambda e: e.get(f"{RDF}resource")
    for e in Xml.fromstring(text):
        about, kind = e.get(f"{RDF}about"), e.tag.rsplit("}", 1)[-1]
        if about is None:
            continue
        for name, inverse in (("label", False), ("inverse-label", True)):
            out["labels"] += [(about, x.get(f"{XML}lang"), x.text, inverse) for x in e.findall(name) if x.text]
        if kind == CLASS:
            parent = e.find("SubClassOf")
            out["classes"].append((about, None if parent is None else resource(parent), e.get("priority")))
        elif kind in PROPERTIES:
            domains, ranges = ([resource(x) for x in e.findall(n)] or [None] for n in ("domain", "range"))
            out["props"] += [(about, kind, d, r, e.get("priority")) for d in domains for r in ranges]
        elif kind == ENUMERATION:
            out["states"] += [(about, x.get("value"), x.get(f"{XML}lang"), x.text) for x in e.findall("state")]
    return out


def read(spark: SparkSession, path: str) -> Ontology:
    """The tables of an ontology file (a specification of a few thousand elements at most, in one text)."""
    text = spark.read.text(path, wholetext=True).first()[0]
    found = rows(text)
    return Ontology(
        spark.createDataFrame(found["classes"], "about string, subclassof string, priority string"),
        spark.createDataFrame(found["props"], "about string, kind string, domain_of string, range_of string, priority string"),
        spark.createDataFrame(found["labels"], "about string, lang string, label string, inverse boolean"),
        spark.createDataFrame(found["states"], "about string, value string, lang string, label string"),
    )
