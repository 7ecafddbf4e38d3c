"""Words: tokenizing, normal forms, and ranked search.  Null texts have no words; empty words are dropped; ties of rank go by key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the characters that separate words.
DELIMITERS = " \n\t,.:-!?\"'=\\|/()[]{};*<>"
_CLASS = "[" + "".join("\\" + c if c not in " \n\t" else c for c in DELIMITERS) + "]+"


def words(text: Column | str) -> Column:
    """The lower-case words of a text as a list, in order."""
    return F.filter(F.split(F.lower(text), _CLASS), lambda w: w != "")


def word_table(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w): one row per occurrence."""
    return rows.select(key, F.explode(words(text)).alias("w"))


def normalize(table: DataFrame, word: str, forms: DataFrame) -> DataFrame:
    """The table with ``word`` replaced by its normal form; words without one pass through.  forms: (form, norm), one row per form."""
    f = forms.select(F.col("form").alias("__form"), F.col("norm").alias("__norm"))
    return table.join(f, F.col(word) == F.col("__form"), "left").withColumn(word, F.coalesce("__norm", word)).drop("__form", "__norm")


def normal_forms(lines: DataFrame, line: str = "value") -> DataFrame:
    """(form, norm) from lines of a normal form followed by its surface forms; the first line of a form counts (lines in order of ``pos``)."""
    parts = F.split(F.trim(line), r"\s+")
    x = lines.select("pos", parts.alias("p")).where(F.size("p") > 0).select("pos", F.col("p")[0].alias("norm"), F.explode("p").alias("form"))
    return x.where("form <> ''").groupBy("form").agg(F.min_by("norm", "pos").alias("norm"))


def occurrences(text: Column | str, wanted: list[str]) -> Column:
    """How often any of some words occurs in a text: one expression over the text, which makes no list of all of its words."""
    if not wanted:
        return F.lit(0)
    outside = "[^" + _CLASS[1:-2] + "]"
    words_ = "|".join(re.escape(w) for w in sorted(set(wanted)))
    return F.regexp_count(F.lower(text), F.lit(f"(?<!{outside})(?:{words_})(?!{outside})"))


def search_texts(rows: DataFrame, key: str, text: str, query: str, n: int = 20) -> DataFrame:
    """(key, c) as :func:`search`, from the texts themselves: texts without a hit are dropped before anything is shuffled."""
    wanted = [w for w in re.split(_CLASS, query.lower()) if w]
    hits = rows.select(key, occurrences(text, wanted).cast("bigint").alias("c")).where("c > 0").groupBy(key).agg(F.sum("c").alias("c"))
    return hits.orderBy(F.desc("c"), key).limit(n)


def search(table: DataFrame, key: str, query: str, n: int = 20, forms: DataFrame | None = None) -> DataFrame:
    """(key, c): keys by the number of occurrences of query words, most first, then by key.

    The query's few words are literals of a filter, so only hits are shuffled, summed before they move.
    """
    wanted = [w for w in re.split(_CLASS, query.lower()) if w]
    if forms is not None:
        norm = {r["form"]: r["norm"] for r in forms.where(F.col("form").isin(wanted)).collect()}
        wanted = [norm.get(w, w) for w in wanted]
        table = normalize(table, "w", forms)
    hits = table.where(F.col("w").isin(wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return hits.orderBy(F.desc("c"), key).limit(n)
