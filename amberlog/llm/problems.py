"""Queries of the text problems over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlog.llm import frequencies, languages, mixing, quality, tokens
from amberlog.plans.problems import key_sql, local_sql

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequencies.term_frequencies(_table(spark, sf, "rrecord_log")).where("mark is not null").select("field", "term", "mark")


def p6_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return frequencies.term_frequencies(_table(spark, sf, "rrecord_log"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = languages.texts_of(_table(spark, sf, "rrecord_log"))
    return languages.doubtful_labels(languages.stretches(texts, languages.fit(texts)))


def p7_stretches(spark: SparkSession, sf: str) -> DataFrame:
    texts = languages.texts_of(_table(spark, sf, "rrecord_log"))
    return languages.stretches(texts, languages.fit(texts))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(_table(spark, sf, "documents"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # documents have no topic of their own; whether a mail opens a thread or answers one stands in for it
    topic = F.when(F.col("in_reply_to").isNull(), "opening").otherwise("answer")
    return mixing.mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"), topic)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outliers(_table(spark, sf, "documents")).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outliers(_table(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    made = (p6_found, p6_frequencies, p7_found, p7_stretches, p8_ids, p9_mix, p9_shares, p10_found, p10_statistics)
    return {f.__name__: f for f in made}


_TERMS = f"""with log as (select {key_sql("id")} as rec, lower({local_sql("tp")}) as tp, props from rrecord_log),
kept as (select * from log where rec <> '' and tp <> 'delete'),
entry as (select rec, unnest(props) as e from kept),
occurrence as (select 'tp' as field, tp as term, rec from kept where tp <> ''
union all select 'value', unnest(regexp_extract_all(lower(nfc_normalize(regexp_replace(e.value, '\\p{{Cf}}', '', 'g'))), '[\\p{{L}}\\p{{Nd}}]+')), rec from entry where e.tag = 1 and e.value is not null),
counted as (select field, term, count(*) as n_occurrences, count(distinct rec) as n_records from occurrence group by 1, 2),
marked as (select *, case when n_records < 3 then 'rare' when n_records > 0.05 * (select count(distinct rec) from kept) then 'common' end as mark from counted)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _TERMS + " select field, term, mark from marked where mark is not null",
        "p6_frequencies": _TERMS + " select field, term, n_occurrences, n_records, mark from marked",
    }
