import unicodedata
from collections import defaultdict

from amberlog.llm import frequencies as fr

ENTRY = "array<struct<tag int, prop string, value string, lang string, link string, sourcelink string>>"
SCHEMA = f"seq bigint, mt string, id string, tp string, props {ENTRY}, term string, rec string"


def field(value, tag=1):
    return (tag, "name", value, None, None, None)


def brute(rows, rare=3, share=0.05):
    recs, ids = defaultdict(set), set()
    for id_, tp, values in rows:
        local = (tp or "").strip().split("}")[-1].split(":")[-1].strip().lower()
        key = (id_ or "").replace("|", "").strip()
        if local == "delete" or not key:
            continue
        ids.add(key)
        if local:
            recs["tp", local].add(key)
        for v in values:
            text = unicodedata.normalize("NFC", "".join(c for c in v or "" if unicodedata.category(c) != "Cf")).lower()
            run = ""
            for c in text + " ":
                if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
                    run += c
                elif run:
                    recs["value", run].add(key)
                    run = ""
    return sorted((f, t, "rare" if len(r) < rare else "common") for (f, t), r in recs.items() if len(r) < rare or len(r) > share * len(ids))


def test_terms():
    assert fr.terms("При​вет, МИР_2 été x½y") == ["привет", "мир", "2", "été", "x", "y"]
    assert fr.terms(None) == fr.terms("") == fr.terms(" \t-") == []


def test_small_cases(spark):
    rows = [(f"r{i}", "o:Person", ["alpha beta", "Alpha"] if i % 2 else ["gamma­"]) for i in range(30)]
    rows += [("r|1", "person", ["solo"]), (" r1 ", "delete", ["gone"]), (None, "person", ["nobody"]), ("r5", None, []), ("q", "{n}delete", ["x"])]
    df = spark.createDataFrame([(i, None, a, b, [field(v) for v in c] + [field("no", 2)], "t", "u") for i, (a, b, c) in enumerate(rows)] + [(99, None, "z", "person", None, None, None)], SCHEMA)
    got = fr.term_frequencies(df)
    marked = sorted(map(tuple, got.where("mark is not null").select("field", "term", "mark").collect()))
    assert marked == brute([*rows, ("z", "person", [])])
    alpha = got.where("term = 'alpha'").first()
    assert (alpha.n_occurrences, alpha.n_records) == (30, 15)
    assert fr.term_frequencies(df.limit(0)).collect() == []


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/rrecord_log.parquet")
    rows = [(r.id, r.tp, [p.value for p in r.props or [] if p.tag == 1]) for r in df.collect()]
    assert sorted(map(tuple, fr.term_frequencies(df).where("mark is not null").select("field", "term", "mark").collect())) == brute(rows)
