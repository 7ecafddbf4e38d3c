"""Files of typed values as DataFrames: text and binary sequences, record files in XML, dictionaries of normal forms."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlog.functions.names import key_of
from amberlog.sources import binary_form, record_xml, streams, text_form
from amberlog.sources.typed import Kind, from_spark, spark_type, text_column, to_spark


def _rows(values: Iterator, kind: Kind, columns: list[str]) -> Iterator[pd.DataFrame]:
    batch: list = []
    for v in values:
        batch.append(to_spark(v, kind))
        if len(batch) == 5_000:
            yield pd.DataFrame(batch, columns=columns)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=columns)


def read_text(spark: SparkSession, path: str, kind: Kind) -> DataFrame:
    """A table from text sequences of records, one per file; a file is one task and is read in pieces, whatever its size."""
    names = [n for n, _ in kind.parts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file in f["path"]:
                yield from _rows(text_form.read_pieces(streams.texts(file), kind), kind, names)

    return streams.paths(spark, path).mapInPandas(run, spark_type(kind))


def read_binary(spark: SparkSession, path: str, kind: Kind) -> DataFrame:
    """A table from binary files of a count and that many records each; a file is one task and is read as a stream."""
    names = [n for n, _ in kind.parts]

    def values(file: str) -> Iterator:
        with streams.opened(file) as stream:
            r = binary_form.Reader(io.BufferedReader(_Raw(stream)))
            for _ in range(r.value(Kind("longinteger"))):
                yield r.value(kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file in f["path"]:
                yield from _rows(values(file), kind, names)

    return streams.paths(spark, path).mapInPandas(run, spark_type(kind))


class _Raw(io.RawIOBase):
    """An Arrow stream as a raw one of Python, so that small reads are buffered."""

    def __init__(self, stream):
        self._stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self._stream.read(len(b))
        b[: len(data)] = data
        return len(data)


def write_text(rows: DataFrame, kind: Kind, path: str) -> None:
    """One record per line, by an expression where the types allow it."""
    record = F.struct(*(F.col(n) for n, _ in kind.parts))
    rows.select(text_column(record, kind).alias("value")).write.mode("overwrite").text(path)


def _between(rows: DataFrame, first: str, last: str, separated: bool, texts) -> DataFrame:
    """(value): the lines of each partition as the lines of one file: a first one, those of the rows, a last one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [first]})
        some = False
        for f in frames:
            lines = texts(f)
            if separated:
                lines = [("," if some or i else "") + t for i, t in enumerate(lines)]
            some = some or bool(lines)
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": [last]})

    return rows.mapInPandas(run, "value string")


def write_sequences(rows: DataFrame, kind: Kind, path: str) -> None:
    """One text sequence per partition, as a file with a line per record."""
    texts = lambda f: [text_form.write(from_spark(r, kind), kind) for r in f.itertuples(index=False)]
    _between(rows.select(*(n for n, _ in kind.parts)), "[", "]", True, texts).write.mode("overwrite").text(path)


def write_records(rows: DataFrame, path: str, owner: str | None = None, prefix: str | None = None, counter: str | None = None, mode: str = "overwrite") -> None:
    """Record files in XML, one per partition, from rows (id, tp, mt, props); with mode append, more files of edits beside those that are there."""
    head, last = record_xml.document([], owner, prefix, counter).split("\n")[0], "</rdf:RDF>"
    text = record_xml.xml_text(F.col("id"), F.col("tp"), F.col("mt"), F.col("props"))
    _between(rows.select(text.alias("value")), head, last, False, lambda f: list(f["value"])).write.mode(mode).text(path)


def binary_column(rows: DataFrame, kind: Kind) -> DataFrame:
    """(content): the binary form of every record, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"content": [binary_form.write(from_spark(r, kind), kind) for r in f.itertuples(index=False)]})

    return rows.select(*(n for n, _ in kind.parts)).mapInPandas(run, "content binary")


def read_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of XML files: one row per element ``row_tag``, attributes as _name, by the built-in reader with a declared schema."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema(schema).load(path)


def canonical(rows: DataFrame, id_: str, *links: str) -> DataFrame:
    """Ids and links without bars and outer white space."""
    return rows.withColumns({c: key_of(c) for c in (id_, *links)})


def triple_text(s: Column, p: Column, tag: Column, o: Column, lang: Column | None = None) -> Column:
    """A triple as a line of text: links in angle brackets, texts quoted with their language."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(o, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    at = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).otherwise("") if lang is not None else F.lit("")
    wrap = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    return F.concat(wrap(s), F.lit(" "), wrap(p), F.lit(" "), F.when(tag == 1, wrap(o)).otherwise(F.concat(quoted, at)), F.lit("."))
