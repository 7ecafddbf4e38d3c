import math
import random
from collections import Counter, defaultdict

from amberlog.llm import mail, quality

BODY = "The keeper of the boxes could not find the letters. She was looking for the missing pages\nin the evening, and nobody asked why. The whole family is still waiting by the river."
HEAD = "From: A B <a@b.example>\nTo: c@d.example\nSubject: x\nContent-Type: text/plain; charset=utf-8\n"


def form(text):
    s = quality.statistics(text)
    best = max(("table", "junk", "list"), key=lambda f: s[f"{f}_share"])
    return best if s[f"{best}_share"] > quality.MOST else "prose" if s["word_count"] else None


def test_own_part():
    text = HEAD + "\nHello,\n\n" + BODY + "\n\nRegards,\nA B\n\nOn 1.2.2014, C wrote:\n> - a\n> - b\n"
    assert mail.own_part(text) == BODY
    assert mail.own_part(text.replace("\n", "\r\n")) == BODY
    assert mail.own_part(HEAD + "\n" + BODY + "\n-- \nA B\n1 2 3") == BODY
    assert mail.own_part(HEAD + "\n" + BODY + "\n\n-----Original Message-----\nFrom: C <c@d.example>\nSubject: y\n\n- a\n- b\n") == BODY
    assert mail.own_part(None) == mail.own_part("") == mail.own_part(" \r\n\t") == ""


def test_encodings_and_parts():
    import base64
    import quopri

    raw = "Ключи от подвала и письма соседям. Никто не спросил почему."
    b64 = HEAD + "Content-Transfer-Encoding: base64\n\n" + base64.encodebytes(raw.encode()).decode()
    qp = HEAD + "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(raw.encode()).decode()
    assert mail.own_part(b64) == mail.own_part(qp).strip() == raw
    multi = (
        'Content-Type: multipart/alternative; boundary="x1"\n\nparts\n--x1\nContent-Type: text/plain\n\n' + BODY + "\n--x1\nContent-Type: text/html\n\n<p>other</p>\n--x1\n"
        "Content-Type: application/octet-stream\nContent-Disposition: attachment\n\nAAAA"
    )
    assert mail.own_part(multi) == BODY  # the last part is not closed
    assert mail.own_part("Content-Type: text/html\n\n<div>one<br>\ntwo &amp; three</div>") == "one\ntwo & three"


def test_forms():
    assert form(HEAD + "\n" + BODY) == "prose"
    for mark in ("- ", "* ", "• ", "1. ", "a) ", "[x] ", ""):
        assert form(HEAD + "\n" + "\n".join(mark + x for x in ("the keys", "two cups of tea", "Anna", "an album, 1912", "ribbons", "a map"))) == "list", mark
    rows = [["Ab", "Cd", "Ef"], ["12", "x", "1.5"], ["", "y", "2.5"], ["7", "z", "3"]]
    for sep in ("\t", ";", " | ", "     "):
        assert form(HEAD + "\n" + "\n".join(sep.join(c or "0" for c in r) for r in rows)) == "table", sep
    assert form("Content-Type: text/html\n\n<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>") == "table"
    for bad in ("=-=-=-=-=-=-=-=-=\n" * 5, "O8MFSI3Sg0B72Szv7xR2AVFPNuEVJNs9Z8HZAj9P6XNo\n" * 3 + "GMpJ4ZIess4NafB1KhRlSK573rpiBAMN1aEl5ZS0KY4zkgul\n", ".a { margin:4px; padding:0 }\n.b { margin:3px; padding:1 }\nvar x=8;if(!y){}"):
        assert form(HEAD + "\n" + bad) == "junk", bad
    assert form(None) is None and form("  ") is None


def test_very_long_text():
    assert form(HEAD + "\n" + (BODY + "\n\n") * 3_000) == "prose"
    part = ("ba", "dor", "kan", "lek", "mi", "nov", "or", "pe", "qui", "ra", "so", "tur", "ul")
    assert form(HEAD + "\n" + "\n".join(f"- {part[i % 13]}{part[i % 11]} {part[i % 7]}{part[i % 12]}" for i in range(30_000))) == "list"


def test_ranks_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.outliers(docs).collect()
    assert len(out) == docs.count()
    groups = defaultdict(list)
    for r in out:
        groups[r.lang].append(r)
    for rows in groups.values():
        for s, side in quality.STATISTICS.items():
            values = [r[s] for r in rows]
            for r in rows:
                tail = sum(v >= r[s] if side == 1 else v <= r[s] for v in values) / len(values)
                assert math.isclose(r[f"{s}_score"], -math.log(tail), abs_tol=1e-9)


def test_edge_rows(spark):
    rows = [(1, None, None, 1), (2, "", "EN", 2), (2, "", "en-GB", 2), (3, HEAD + "\n" + BODY, "xx", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kind int")
    got = quality.outliers(df).collect()
    assert sorted((r.doc_id, r.lang, r.kind) for r in got) == [(1, "und", None), (2, "en", None), (2, "en", None), (3, "und", "prose")]
    assert quality.outliers(df.limit(0)).collect() == []


def test_statistics_are_true_values(spark):
    texts = [HEAD + "\n" + " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(n)) + "." for n in (990, 997, 1000)]
    assert [quality.statistics(t)["word_count"] for t in texts] == [990, 997, 1000]
    # 1251 of 2500 lines are items: more than half, but 0.500 in thousandths
    name = ["".join("bdfgklmnrt"[int(c)] + "aeiouaeiou"[int(c)] for c in f"{i:04}") for i in range(2500)]
    long = HEAD + "\n" + "\n".join([f"- box of {x}" for x in name[:1251]] + [f"The keeper of {x} went to the river and was not seen again." for x in name[1251:]])
    s = quality.statistics(long)
    assert s["list_share"] == 1251 / 2500 and form(long) == "list"
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in quality.outliers(docs).collect()}
    assert [out[i].word_count for i in range(4)] == [990, 997, 1000, 990] and isinstance(out[0].word_count, int)
    assert [round(4 * math.exp(-out[i].word_count_score)) for i in range(4)] == [2, 3, 4, 2]


def test_most_of_a_form_counts_whatever_the_peers(spark):
    junk = HEAD + "\n" + "=-=-=-=-=-=-=-=-=\n" * 5
    items = HEAD + "\n" + "\n".join("- " + x for x in ("the keys", "two cups of tea", "Anna", "an album, 1912", "ribbons", "a map"))
    rows = [(1, items, "fr"), (2, junk, "de"), (3, junk, "de"), (4, HEAD + "\n" + BODY, "en"), (5, items, "en"), (6, junk, "en"), (7, BODY, "es"), (8, None, "it")]
    got = quality.outliers(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {r.doc_id: r.kind for r in got} == {1: "list", 2: "junk", 3: "junk", 4: "prose", 5: "list", 6: "junk", 7: "prose", 8: None}
    assert all(r.distance >= 1 for r in got if r.kind in ("list", "junk"))


def _mails(n):
    """Ordinary mails of words put together anew, all different in their statistics."""
    rng = random.Random(4)
    words = BODY.replace(".", "").lower().split()
    return [HEAD + "\n" + "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(8, 14))).capitalize() + "." for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_distances_decide_what_makes_no_sense(spark, monkeypatch):
    """Mash, broken characters and one word over and over look like prose line by line; only the ranks tell them apart, and without them they are prose."""
    mash = HEAD + "\n" + "\n".join("kjhgf qwrtz sdfgh wxcvb nmlkj hgfds qwtrp zxcvq wrtpl kjhgf dsqwx cvbnm, lkjhg fdsqw rtzpl" for _ in range(4))
    over = HEAD + "\n" + "lumora lumora lumora lumora lumora lumora lumora lumora lumora lumora lumora lumora lumora.\n" * 6
    broken = HEAD + "\n" + BODY.replace("e", "Ð\u008f").replace("a", "Ñ\u0081")
    texts = [*_mails(1_500), mash, over, broken]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    kinds = {r.doc_id: r.kind for r in quality.outliers(docs).collect()}
    assert [kinds[i] for i in (1_500, 1_501, 1_502)] == ["junk"] * 3
    assert sum(k != "prose" for k in kinds.values()) <= 3 + 0.01 * 1_500
    assert {form(t) for t in (mash, over, broken)} == {"prose"}  # no form of lines makes up most of any of them
    monkeypatch.setattr(quality, "SENSELESS", 9.0)
    assert all(r.kind == "prose" for r in quality.outliers(docs).collect())


def test_distances_equal_brute_force(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    out = quality.outliers(spark.read.parquet(f"{path}/documents.parquet")).collect()
    share = lambda r: max(r.list_share, r.table_share, r.junk_share)
    ordinary = [r for r in out if r.word_count and share(r) <= quality.MOST and r.outlier_score <= quality.ORDINARY]
    per = Counter(r.lang for r in ordinary)
    group = lambda r: r.lang if per[r.lang] >= quality.PEERS else "few"
    for s in quality.PEERED:
        for r in out[::7]:
            peers = [x[s] for x in ordinary if group(x) == group(r)]
            beyond = sum(v >= r[s] if quality.STATISTICS[s] == 1 else v <= r[s] for v in peers)
            want = min(1.0, math.log((1 + len(peers)) / (1 + beyond)) / math.log(quality.PEERS))
            want = 1.0 if s.endswith("_share") and r[s] > quality.MOST else want
            assert math.isclose(r[f"{s}_distance"], want, abs_tol=1e-9)


def test_disclaimers_and_deep_parts():
    for end in (
        "This message is meant only for the person it is addressed to. If it reached you by mistake, tell the sender and remove every copy.",
        "The information in this e-mail is confidential and intended for the recipient. Delete it if you got it in error.",
        "Diese Nachricht ist vertraulich und nur für den Empfänger. Haben Sie sie irrtümlich erhalten, löschen Sie sie bitte.",
        "Содержание этого письма предназначено адресату. Получив его по ошибке, удалите все копии.",
    ):
        assert mail.own_part(HEAD + "\n" + BODY + "\n\n" + end) == BODY
    assert mail.own_part(HEAD + "\n" + BODY + "\n\nThe letter came back by mistake and nobody kept it.") == BODY + "\n\nThe letter came back by mistake and nobody kept it."
    deep = "Content-Type: text/plain\n\n" + BODY
    for i in range(300):
        deep = f'Content-Type: multipart/mixed; boundary="b{i}x"\n\n--b{i}x\n{deep}\n--b{i}x--\n'
    assert mail.own_part(deep).strip() == BODY


def test_own_part_below_an_original():
    first, second, third = BODY.replace("\n", " "), "Nobody has seen the second album since the spring.", "The river was high and the bridge was closed for a week."
    fore = HEAD + "\n-----Original Message-----\nFrom: C <c@d.example>\nSubject: y\n\n"
    for end in ("", "\n\nRegards,\nA B", "\n\n-- \nA B\n1 2 3", "\n\nThanks,\nA B\n\n***\nThis message is meant only for the person it is addressed to.\n"):
        assert mail.own_part(fore + "\n\n".join((first, second, third)) + end) == f"{second}\n\n{third}"
        assert mail.own_part(fore + f"{first}\n\nRegards,\nC\n\n{second}\n\n{third}" + end) == f"{second}\n\n{third}"
        assert mail.own_part(fore + "00000000  9b 66 f2 21 78 34 c2 9b\n\n" + f"{second}\n\n{third}" + end) == f"{second}\n\n{third}"
        assert mail.own_part(fore + f"Ключи от подвала и письма соседям.\n\n{second}\n\n{third}" + end) == f"{second}\n\n{third}"
