import random

import duckdb
import pytest
from pyspark.sql import functions as F

from amberlog.llm import mixing


def test_water_fill():
    assert mixing.water_fill({"a": 1, "b": 1}, {"a": 100, "b": 100}, 50) == {"a": 25, "b": 25}
    assert mixing.water_fill({"a": 1, "b": 1}, {"a": 10, "b": 100}, 50) == {"a": 10, "b": 40}
    assert mixing.water_fill({"a": 1, "b": 3}, {"a": 5, "b": 6}, 50) == {"a": 5, "b": 6}
    assert mixing.water_fill({"a": 1, "b": 1}, {"a": 0, "b": 100}, 50) == {"a": 0, "b": 50}
    assert mixing.water_fill({}, {}, 0) == {}


def test_rake_meets_sources_and_caps():
    held = {("a", "x", "1"): 60.0, ("a", "y", "1"): 40.0, ("b", "x", "1"): 10.0, ("b", "y", "2"): 10.0}
    raked = mixing.rake(held, {"a": 80.0, "b": 40.0}, {"a": 1, "b": 3})
    got = raked.wanted
    assert raked.converged and raked.rounds > 1
    assert sum(v for c, v in got.items() if c[0] == "a") == pytest.approx(80, rel=1e-6)
    assert sum(v for c, v in got.items() if c[0] == "b") == pytest.approx(40, rel=1e-6)
    assert all(v <= held[c] * {"a": 1, "b": 3}[c[0]] * (1 + 1e-9) for c, v in got.items())


def test_shares(spark, sf, tmp_path):
    path = sf.replace("sf0.001", "sf0.01")
    docs, targets = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/mix_targets.parquet")
    used, shares = mixing.mix(docs, targets, F.when(F.col("in_reply_to").isNull(), "opening").otherwise("answer"))
    repeat = {r.source.strip().lower(): r.max_repeat for r in targets.collect()}
    rows, shares = used.collect(), shares.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies <= repeat[r.source] for r in rows)
    assert {r.axis for r in shares} == {"source", "lang", "topic"} and all(r.converged for r in shares)
    for r in shares:  # languages and topics are met as far as the caps of sources allow
        assert r.reached_share == pytest.approx(r.wanted_share, abs=0.005 if r.axis == "source" else 0.05), r
    for axis in ("source", "lang", "topic"):
        assert sum(r.reached_share for r in shares if r.axis == axis) == pytest.approx(1)
    used.write.parquet(str(tmp_path / "mix"))
    by_sql = " union all ".join(f"select '{a}' as axis, {a} as name, sum(n_tokens * copies) as tokens, count(*) as documents, max(copies) as most_copies from mix group by {a}" for a in ("source", "lang", "topic"))
    con = duckdb.connect()
    con.execute(f"create view mix as select * from read_parquet('{tmp_path}/mix/*.parquet')")
    want = {(a, n): (int(t), d, c) for a, n, t, d, c in con.execute(by_sql).fetchall()}
    assert {(r.axis, r.name): (r.tokens, r.documents, r.most_copies) for r in shares if r.tokens} == want


def test_thresholds_to_within_a_document(spark):
    """The tokens below the threshold of a cell differ from those wanted by less than its largest document, however the draws lie."""
    rng = random.Random(7)
    rows = [(i, "a", "en" if i % 3 else "ru", None if i % 5 == 0 else "t", rng.randrange(0, 400), rng.randrange(1 << (mixing.BITS * mixing.LEVELS)) if i % 2 else rng.randrange(50)) for i in range(3_000)]
    pool = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, n_tokens bigint, draw bigint")
    held = {}
    for _, s, lang, t, n, _ in rows:
        held[s, lang, t] = held.get((s, lang, t), 0) + n
    cells = [(*c, 0, n * f) for (c, n), f in zip(held.items(), (0.0, 0.3, 0.617, 0.999), strict=True)]
    for r in mixing.thresholds(pool, spark.createDataFrame(cells, mixing.CELLS)).collect():
        mine = [(n, d) for _, s, lang, t, n, d in rows if (s, lang, t) == (r.c_source, r.c_lang, r.c_topic)]
        below = sum(n for n, d in mine if d < r.below)
        ties = {}
        for n, d in mine:
            ties[d] = ties.get(d, 0) + n
        assert abs(below - r.part) <= max(ties.values())


def test_only_targeted_documents_are_tokenized(spark, sf):
    docs, targets = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "mix_targets"))
    weights, _ = mixing._targets(targets)
    text = mixing.sized(docs, list(weights), mixing.label_code(), F.lit("t"))._jdf.queryExecution().executedPlan().toString()
    assert text.index("MapInArrow") < text.index("Filter")  # plans are printed from the result down: the filter comes first


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "A", "en"), (2, "", " a", None), (3, "some words here", "A ", "en"), (4, "more words", None, "en"), (5, "x", "zz", "en")], "doc_id bigint, text string, source string, lang string")
    targets = spark.createDataFrame([("a", 1.0, 2), ("A", None, None), ("b", 3.0, 5), (None, 1.0, 1)], "source string, weight double, max_repeat int")
    used, shares = mixing.mix(docs, targets, F.lit("t"))
    assert [(r.doc_id, r.copies) for r in used.collect()] == [(3, 1)]
    assert {r.name: r.reached_share for r in shares.where("axis = 'source'").collect()} == {"a": 1.0, "b": 0.0}
    used, shares = mixing.mix(docs.limit(0), targets, F.lit("t"))
    assert used.collect() == [] and all(r.reached_share == 0 for r in shares.collect())
    assert mixing.mix(docs, targets.limit(0), F.lit("t"))[0].collect() == []
