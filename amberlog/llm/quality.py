"""Quality statistics of texts, ranks within their language, and outlier scores that tell prose from lists, tables and junk.

Per document (one pass in Arrow batches, whole texts): statistics of the writer's own part.  Then the exact rank of every document in every
statistic among the documents of its language: the distinct values are counted (combined before the shuffle, so a value that a third of all
rows share is one row), range-partitioned and sorted, and each partition adds the totals of the partitions before it.  The empirical tail
probability of a value is the share of the language's documents at or beyond it; the outlier score is the sum of -log of the tails of a
document's statistics.

Documents below ORDINARY nats of which no form makes up most are the ordinary ones of their language.  In the statistics PEERED every
document is ranked a second time, among these alone: a value has the distance -log((1 + ordinary documents at or beyond it) / (1 + ordinary
documents)), as a share of the distance of a value that at most a thousandth reaches, 1 at most.  The distances decide:

* a document is a *candidate* if they add up to at least 1, that of one value which no ordinary document reaches;
* *junk* is a candidate whose distances in the statistics of sense (words that are none, broken characters, repetition, no common words) add
  up to SENSELESS: whatever its lines look like, there is nothing to read;
* *list*, *table* and (machine output) *junk* are candidates whose form passes an exact check: it makes up more than MOST of the part.

A share beyond MOST is by definition beyond all ordinary documents, so no document that is mostly one form is lost, whatever its language is
made up of.  Languages with fewer than PEERS ordinary documents are compared as one group; if even those are fewer, distances shrink, since
few peers say little.

Statistics are true values: counts are whole, shares are quotients of whole numbers and never rounded, so documents tie only where they are
equal.  The rank table may thus have as many rows as the documents have statistics; it is joined by a shuffle, row by row of document and
statistic.  Values that a thousandth of all documents share (at most a thousand a statistic) are broadcast, so that none is a hot group.

Defined results.  Null, empty and blank texts have statistics 0 and no kind; so does a text without own part.  Unknown and null labels of
language form one group.  Repeated rows count each.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amberlog.llm.languages import CODES
from amberlog.llm.mail import own_part
from amberlog.plans.scratch import cut

#: Statistic -> whether the upper (1) or lower (-1) tail is unusual for prose.
STATISTICS = {
    "word_count": -1, "mean_word_length": 1, "symbol_ratio": 1, "digit_ratio": 1, "end_punctuation": -1, "common_words": -1, "repetition": 1, "odd_words": 1, "broken_ratio": 1,
    "list_share": 1, "table_share": 1, "junk_share": 1,
}
#: What makes sense of a text, and all statistics that are ranked among ordinary documents too.
SENSE = ("odd_words", "broken_ratio", "repetition", "common_words")
PEERED = (*SENSE, "list_share", "table_share", "junk_share")
#: A form makes up most of a part beyond this share; values that this share of all documents have are broadcast with their ranks.
MOST, HOT = 0.5, 0.001
#: Nats of outlier score up to which a document is ordinary, distances of sense that make junk, and the fewest ordinary documents of a language.
ORDINARY, SENSELESS, PEERS = 6.0, 1.8, 1_000
#: The forms other than prose; of equal shares the first counts.
FORMS = ("table", "junk", "list")
#: Length from which a line weighs more than one, in code points; weights are whole numbers of its parts.
FULL_LINE = 72
#: Words over which repetition is measured.
WINDOW = 100
#: Frequent words of the languages.
COMMON = frozenset(
    "the of and to in a is that it was for on with he as his they be at had this she not which but by what all one her up out an so about has were from there their or"
    " и в не на что с он как по это она но из у за так от все его ещё до для же бы о вы мы они к а то был"
    " і й та на що не як до з за він вона це але від по у про для ми ви вони ще був його бо"
    " der die das und ist nicht ein eine zu den mit von auf für im dem des als auch es an er sie aber noch nach bei aus war wir"
    " le la les de des un une et est pas que qui dans pour sur avec il elle ce cette nous au du en par on mais plus"
    " el los las del que y en un una por con para no se su al lo es pero más como ya sin nos ha"
    " il lo gli i di che e è un una per con non si del della nel sul ma anche più ha ci le da".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BULLET = re.compile(r"\s*(?:[-*•·–—+▪◦‣o]\s+|\[[ xX✓v]?\]\s*|\(?\d{1,3}[.)]\s+|\(?[A-Za-zА-Яа-яіїє][.)]\s+|[ivxIVX]{1,5}[.)]\s+|#\d*\s+)\S")
_BORDER = re.compile(r"\s*[+|][-=+:| ]{3,}[+|]?\s*$|\s*[-=]{3,}(?:[ +|]+[-=]{3,})+\s*$|\s*\|?(?:\s*:?-{2,}:?\s*\|)+\s*(?::?-{2,}:?)?\s*$")
_QUOTED_CELLS = re.compile(r"\s*\"[^\"]*\"(?:[,;]\"[^\"]*\")+\s*$")
_GAPS = re.compile(r"\S(?: {2,}|\t)\S")
_CODE = re.compile(r"[{}]|;\s*$|=>|&&|\|\||^\s*</?\w+[^>]*>|\w\(\)")
_BLOB = re.compile(r"[A-Za-z0-9+/=_%-]{32,}$")
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|(?:ERROR|WARN|INFO|DEBUG|TRACE)\b|at [\w$.]+\(|0x[0-9a-fA-F]+|[0-9a-fA-F]{4,8}[: ] ?(?:[0-9a-fA-F]{2,4} ){4})")


def _cells(line: str) -> tuple[int, bool]:
    """How many cells a line has by its best separator (0 if it does not look like a row), and whether every row must have as many."""
    s = line.strip()
    if s.startswith("|") or s.count("|") >= 2:
        return s.strip("|").count("|") + 1, False
    if "\t" in s:
        return line.count("\t") + 1, False
    if s.count(";") >= 2 and not s.endswith(";") or s.count(";") >= 3:
        return s.count(";") + 1, True
    if _QUOTED_CELLS.match(s):
        return s.count('","') + s.count('";"') + 1, False
    if s.count(",") >= 2 and " " not in s.replace(", ", " x"):
        return s.count(",") + 1, True
    gaps = len(_GAPS.findall(s))
    return (gaps + 1, False) if gaps else (0, False)


_SIGNS = re.compile(r"[\w\s]+")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_NO_DIGITS = re.compile(r"\D+")
_LETTER = re.compile(r"[^\W\d_]")
#: Inside words that no writing has: a capital after a small letter, five consonants (four small ones of the keyboard), two scripts.
_ODD = re.compile(r"(?<=[a-zа-яёіїєґ])[A-ZА-ЯЁІЇЄҐЂЃЉЊЌЋЏ]|[bcdfghjklmnpqrstvwxz]{5,}|[jqvwxz][bcdfgjklmnpqstvwxz][bcdfghjklmnpqrstvwxz]|[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
_BROKEN = re.compile(r"[\ufffd\x80-\x9f\x00-\x08\x0e-\x1f]|[ÐÑÃÂ][^\x00-\x7f]|[РС][^\sА-Яа-яёіїєґЁІЇЄҐ.,!?()\w-]|[РС][°±µ¶·»¤¦§©«¬®ЃЌѓЉЊЋЏђљњќћџЎўЈјѕЅ]")


def _blob_line(s: str) -> bool:
    """Encoded bytes: long, without blanks, letters and digits only or with many kinds of signs."""
    n = len(s)
    return n >= 24 and " " not in s and (bool(_BLOB.match(s)) or n >= 40 and len(set(_SIGNS.sub("", s))) >= 7)


def _junk_line(s: str) -> bool:
    signs = _SIGNS.sub("", s)
    if len(signs) < 3:
        return len(s) >= 50 and " " not in s
    if len(s) >= 6 and len(signs) >= 0.4 * len(s) or len(s) >= 50 and " " not in s:
        return True
    return len(signs) >= 0.06 * len(s) and bool(_CODE.search(s))


def _odd_line(s: str) -> bool:
    """Mostly words that are none: no cells of a table, whatever signs are between them."""
    return len(_ODD.findall(s)) > 0.4 * max(1, len(_WORD.findall(s)))


def _same_words(s: str) -> bool:
    """One word over and over: no item of a list."""
    words = _WORD.findall(s)
    return len(words) >= 3 and len(set(words)) == 1


def statistics(text: str | None) -> dict[str, float]:
    """The statistics of the writer's own part of a text."""
    own = own_part(text)
    lines = [x for x in own.split("\n") if x.strip()]
    zero = dict.fromkeys(STATISTICS, 0.0) | {"word_count": 0}
    if not lines:
        return zero
    words = _WORD.findall(own.lower())
    n_words, n_chars = len(words), len("".join(own.split()))
    letters, digits = len(_NO_LETTERS.sub("", own)), len(_NO_DIGITS.sub("", own))
    # by stretches of WINDOW words, since the share of distinct words falls with the length of any text
    distinct = sum(len(set(words[i : i + WINDOW])) for i in range(0, n_words, WINDOW))
    stripped = [x.strip() for x in lines]
    cells = [(-1, False) if _BORDER.match(x) else _cells(x) for x in lines]
    widths = Counter(n for n, _ in cells if n > 1)
    common_width = max(widths, key=lambda w: (widths[w], w)) if widths else 0
    tabular = bool(widths) and widths[common_width] >= 2
    weight = dict.fromkeys(("list", "table", "junk", "prose"), 0)
    plain_short = 0
    for x, s, (r, exact) in zip(lines, stripped, cells, strict=True):
        n = len(s)
        w = max(n, FULL_LINE)
        if n <= 110 and _BULLET.match(x) and not (s[0] == "—" and n > 60):
            weight["list"] += w
        elif _blob_line(s) or _LOG.match(s) or s[-1] == "}" and "{" in s:
            weight["junk"] += w
        elif r == -1 and (widths or s[0] in "+|"):
            weight["table"] += w
        elif r > 1 and tabular and abs(r - common_width) <= (not exact) and not _odd_line(s):
            weight["table"] += w
        elif _junk_line(s) or not _LETTER.search(s):
            weight["junk"] += w
        else:
            weight["prose"] += w
            if n <= 45 and s[-1] not in ".!?…:" and not _same_words(s) and not _odd_line(s):
                plain_short += w
    total = sum(weight.values())
    if len(lines) >= 4 and plain_short > 0.7 * total and not weight["table"]:  # items without marks
        weight["list"], weight["prose"] = weight["list"] + plain_short, weight["prose"] - plain_short
    return zero | {
        "word_count": n_words,
        "mean_word_length": sum(map(len, words)) / max(n_words, 1),
        "symbol_ratio": max(0, n_chars - letters - digits) / n_chars,
        "digit_ratio": digits / n_chars,
        "end_punctuation": sum(x[-1] in ".!?…:;\"»)" for x in stripped) / len(lines),
        "common_words": sum(w in COMMON for w in words) / max(n_words, 1),
        "repetition": (max(n_words, 1) - max(distinct, 1)) / max(n_words, 1),
        "odd_words": len(_ODD.findall(own)) / max(n_words, 1),
        "broken_ratio": len(_BROKEN.findall(own)) / n_chars,
        "list_share": weight["list"] / total,
        "table_share": weight["table"] / total,
        "junk_share": weight["junk"] / total,
    }


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array([r[s] for r in rows], pa.int64() if s == "word_count" else pa.float64()) for s in STATISTICS)], ["doc_id", "lang", *STATISTICS])


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang (as labelled, by code; null and unknown labels are 'und') and one column per statistic."""
    code = F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]+)", 1))
    names = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    x = documents.select("doc_id", F.coalesce(F.try_element_at(names, code), F.lit("und")).alias("lang"), "text")
    return x.mapInArrow(_run, "doc_id bigint, lang string, " + ", ".join(f"{s} {'bigint' if s == 'word_count' else 'double'}" for s in STATISTICS))


def _pairs(names: Iterable[str]) -> Column:
    """The statistics of a document as rows of statistic and value."""
    return F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in names)))


def ranks(rows: DataFrame, group: str, names: Iterable[str], peers: Column) -> DataFrame:
    """(group, statistic, value, here, at_least, at_most, n) for every value that occurs: how many ``peers`` of the group reach it, how many do
    not exceed it, and how many there are; ``here`` counts the documents that have it, peers or not."""
    counts = rows.select(group, peers.cast("bigint").alias("peer"), _pairs(names).alias("x")).groupBy(group, "x.statistic", "x.value")
    counts = counts.agg(F.count(F.lit(1)).alias("here"), F.sum("peer").alias("peers"))
    # written once with the number of its partition, since the bounds of a range partitioning are sampled anew each time
    ranged = cut(counts.repartitionByRange(group, "statistic", "value").sortWithinPartitions(group, "statistic", "value").withColumn("part", F.spark_partition_id()))
    of_group = Window.partitionBy(group, "statistic")
    inside = F.sum("peers").over(Window.partitionBy(group, "statistic", "part").orderBy("value"))
    totals = ranged.groupBy(group, "statistic", "part").agg(F.sum("peers").alias("in_part"))
    offsets = totals.select(group, "statistic", "part", F.sum("in_part").over(of_group).alias("n"), (F.sum("in_part").over(of_group.orderBy("part")) - F.col("in_part")).alias("before"))
    x = ranged.withColumn("inside", inside).join(offsets, [group, "statistic", "part"])
    most = F.col("before") + F.col("inside")
    return x.select(group, "statistic", "value", "here", (F.col("n") - most + F.col("peers")).alias("at_least"), most.alias("at_most"), "n")


def scored(rows: DataFrame, group: str, names: tuple[str, ...], peers: Column, score: Column, n_rows: int) -> DataFrame:
    """(row, one column per statistic) of the score of each value, an expression over ``beyond`` (peers at or beyond the value) and ``n``."""
    sides = F.create_map(*(F.lit(x) for s in names for x in (s, STATISTICS[s])))
    beyond = F.when(sides[F.col("statistic")] == 1, F.col("at_least")).otherwise(F.col("at_most"))
    key = [group, "statistic", "value"]
    table = cut(ranks(rows, group, names, peers).withColumn("beyond", beyond).select(*key, "here", score.alias("score")))
    hot, others = (table.where(c).drop("here") for c in (F.col("here") > HOT * n_rows, F.col("here") <= HOT * n_rows))
    long = rows.select("row", group, _pairs(names).alias("x")).select("row", group, "x.statistic", "x.value")
    known = long.join(F.broadcast(hot), key).unionByName(long.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key))
    # brought together as narrow rows first: a partial aggregation would make each a wide one
    together = known.select("row", "statistic", "score").repartition("row").groupBy("row")
    return together.agg(*(F.max(F.when(F.col("statistic") == s, F.col("score"))).alias(s) for s in names))


def _with(rows: DataFrame, found: DataFrame, suffix: str) -> DataFrame:
    names = [c for c in found.columns if c != "row"]
    return rows.join(found.select(F.col("row").alias("__row"), *(F.col(c).alias(f"{c}{suffix}") for c in names)), F.col("row") == F.col("__row"), "left").drop("__row")


def outliers(documents: DataFrame) -> DataFrame:
    """The statistics of every document with a score per statistic (``<statistic>_score``, -log of its tail), their sum ``outlier_score``, the
    distances from ordinary documents (``<statistic>_distance``), their sums ``distance`` and ``senseless`` (those of SENSE), and kind.

    kind is prose unless the distances make it list, table or junk; null without own part.
    """
    # numbered before they are written, since a document may occur more than once
    stats = cut(text_statistics(documents).withColumn("row", F.monotonically_increasing_id()))
    n_rows = stats.count()
    tails = scored(stats, "lang", tuple(STATISTICS), F.lit(1), -F.log(F.col("beyond") / F.col("n")), n_rows)
    add = lambda names, suffix: sum((F.coalesce(f"{s}{suffix}", F.lit(0.0)) for s in names), F.lit(0.0))
    first = _with(stats, tails, "_score").withColumn("outlier_score", add(STATISTICS, "_score"))
    greatest = F.greatest(*(F.col(f"{f}_share") for f in FORMS))
    first = cut(first.withColumn("ordinary", (F.col("word_count") > 0) & (greatest <= MOST) & (F.col("outlier_score") <= ORDINARY)))
    # languages are a fixed list, so this is a handful of rows
    few = first.groupBy(F.col("lang").alias("__lang")).agg(F.sum(F.col("ordinary").cast("bigint")).alias("__n")).where(F.col("__n") < PEERS)
    grouped = first.join(F.broadcast(few), F.col("lang") == F.col("__lang"), "left").withColumn("compared", F.when(F.col("__n").isNull(), F.col("lang")).otherwise("few")).drop("__lang", "__n")
    full = math.log(PEERS)
    distance = F.least(F.lit(1.0), (F.log(1.0 + F.col("n")) - F.log(1.0 + F.col("beyond"))) / full)
    # no ordinary document has a share beyond MOST: fully distant, however few peers there are
    distance = F.when(F.col("statistic").isin(*(f"{f}_share" for f in FORMS)) & (F.col("value") > MOST), 1.0).otherwise(distance)
    out = _with(grouped, scored(grouped, "compared", PEERED, F.col("ordinary"), distance, n_rows), "_distance")
    out = out.withColumns({"distance": add(PEERED, "_distance"), "senseless": add(SENSE, "_distance")}).drop("row", "compared", "ordinary")
    form = F.lit("prose")
    for f in reversed(FORMS):
        form = F.when((F.col(f"{f}_share") > MOST) & (F.col(f"{f}_share") >= greatest), f).otherwise(form)
    kind = F.when(form != "prose", form).when(F.col("senseless") >= SENSELESS, "junk").otherwise("prose")
    own = (F.col("word_count") > 0) | (greatest > 0)
    return out.withColumn("kind", F.when(own, F.when(F.col("distance") >= 1, kind).otherwise("prose")))
