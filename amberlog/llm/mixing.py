"""A collection from several sources with target shares of its tokens, small sources repeated up to a cap.

1. Every document of a source with a target is sized in tokens of a public tokenizer and put into a cell: source, language, topic.
2. The size of the collection is that of all these documents.  It is shared out by weight; a source that would need more than ``max_repeat``
   uses of all its documents gets just those, and the others share the rest by their weights (water filling).
3. Cell totals are raked in turn to the marginals of language and topic (those of the pool) and of source, by iterative proportional fitting,
   no cell above ``max_repeat`` times what it holds.  The source marginal comes last and is met exactly; how far language and topic were met,
   and whether the rounds converged, is part of the report.
4. A document of a cell with factor f is used floor(f) times, and once more with the probability of the rest.  The draw is a hash of its id of
   LEVELS x BITS bits.  The threshold of a cell is calibrated on the tokens that lie below it: a histogram of the first BITS bits of the draws
   finds the bin in which the tokens wanted are reached, one of the next bits within that bin the place in it.  So shares are met to within a
   document or two per cell, however few and uneven the documents.

Only cell totals reach the driver: (sources with a target) x languages x topics rows, a number that is checked.  Histograms stay distributed.

Defined results.  Sources compare without case and outer white space; documents of null or untargeted sources are not used, nor tokenized.
Null and empty texts have no tokens and are never drawn.  A target with null or negative weight counts as 0, with null or less than 1 repeat as
1; of a repeated target the greatest weight counts.  Without any usable document or target the collection is empty.  Repeated rows are drawn
each for itself, by id.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amberlog.functions.names import trimmed
from amberlog.llm.languages import CODES
from amberlog.llm.tokens import DEFAULT_VOCABULARY, token_counts
from amberlog.plans.scratch import cut

#: Bits of a level of the histograms of draws, levels, most rounds of raking, and most cells (rows of totals on the driver).
BITS, LEVELS, ROUNDS, MAX_CELLS = 12, 2, 200, 1_000_000
AXES = ("source", "lang", "topic")


def source_key(c: str) -> Column:
    return F.lower(trimmed(c))


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Amounts by weight that add up to ``total`` as far as the caps allow."""
    open_, out, left = {s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}, dict.fromkeys(weights, 0.0), total
    while open_ and left > 0:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * unit >= caps[s]}
        for s in full or open_:
            out[s] = caps[s] if full else weights[s] * unit
        if not full:
            break
        left -= sum(caps[s] for s in full)
        open_ -= full
    return out


def _capped(x: np.ndarray, cap: np.ndarray, total: float) -> np.ndarray:
    """x scaled to a total, nowhere above cap."""
    for _ in range(len(x) + 1):
        free = x < cap
        room = total - cap[~free].sum()
        if room <= 0 or not free.any() or x[free].sum() <= 0:
            break
        y = np.where(free, x * room / x[free].sum(), cap)
        if (y <= cap * (1 + 1e-12)).all():
            return np.minimum(y, cap)
        x = np.minimum(y, cap)
    return np.minimum(x, cap)


@dataclass
class Raked:
    """Tokens wanted of each cell, how many rounds it took, and whether the last one moved nothing any more."""

    wanted: dict[tuple[str, str, str], float]
    rounds: int = 0
    converged: bool = True


def rake(held: dict[tuple[str, str, str], float], amounts: dict[str, float], repeat: dict[str, int]) -> Raked:
    """Tokens wanted of each (source, language, topic) cell."""
    cells = [c for c in sorted(held, key=str) if held[c] > 0 and amounts.get(c[0], 0) > 0]
    if not cells:
        return Raked({})
    have = np.array([held[c] for c in cells])
    cap = have * np.array([repeat[c[0]] for c in cells])
    x, total = have.copy(), sum(amounts[s] for s in {c[0] for c in cells})
    groups = []
    for axis in range(3):
        rows: dict[str, list[int]] = defaultdict(list)
        for i, c in enumerate(cells):
            rows[c[axis]].append(i)
        groups.append({k: np.array(v) for k, v in rows.items()})
    converged = False
    for r in range(ROUNDS):
        before = x.copy()
        for axis in (1, 2):
            for rows in groups[axis].values():
                x[rows] = np.minimum(x[rows] * (total * have[rows].sum() / have.sum()) / max(x[rows].sum(), 1e-9), cap[rows])
        for s, rows in groups[0].items():
            x[rows] = _capped(np.maximum(x[rows], 1e-9), cap[rows], amounts[s])
        if converged := bool(np.abs(x - before).max() <= 1e-6 * total):
            break
    return Raked(dict(zip(cells, x.tolist(), strict=True)), r + 1, converged)


def label_code(c: str = "lang") -> Column:
    """The language that a label names by its code, und for none; a better known language can take its place in :func:`mix`."""
    code = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]+)", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv)), code), F.lit("und"))


def sized(documents: DataFrame, sources: list[str], lang: Column, topic: Column, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of every document of the given sources."""
    x = documents.select("doc_id", source_key("source").alias("source"), lang.alias("lang"), topic.alias("topic"), "text")
    return token_counts(x.where(F.col("source").isin(sources)), ["doc_id", *AXES], path=path)


def _targets(targets: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    """Weights and repeats by source: the list that describes the mixture, a row per source."""
    weights: dict[str, float] = {}
    repeat: dict[str, int] = {}
    rows = targets.select(source_key("source").alias("s"), F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeat", F.lit(1)).alias("r")).where("s is not null").collect()
    for r in sorted(rows, key=lambda r: (r.w, r.r)):
        weights[r.s], repeat[r.s] = max(0.0, r.w), max(1, r.r)
    return weights, repeat


def plan(held: dict[tuple[str, str, str], float], weights: dict[str, float], repeat: dict[str, int]) -> tuple[list[tuple], dict[str, float], Raked]:
    """([(source, lang, topic, whole uses, tokens of one more use)], tokens wanted by source, the raking) from the tokens of each cell."""
    by_source: dict[str, float] = defaultdict(float)
    for c, n in held.items():
        by_source[c[0]] += n
    amounts = water_fill(weights, {s: by_source[s] * repeat[s] for s in weights}, sum(by_source[s] for s in weights))
    raked = rake(held, amounts, repeat)
    out = []
    for c, n in raked.wanted.items():
        f = min(n / held[c], repeat[c[0]])
        whole = int(f + 1e-9)
        out.append((*c, whole, max(0.0, f - whole) * held[c] if whole < repeat[c[0]] else 0.0))
    return out, amounts, raked


CELLS = "c_source string, c_lang string, c_topic string, whole int, part double"


def thresholds(pool: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells with ``below``, the draw below which the documents of a cell add up to ``part`` tokens, to within one document.

    Level by level: of the draws that share the bits fixed so far, the tokens are summed by the next BITS bits (at most 2^BITS rows a cell),
    and the bin is found in which the sum reaches what is still wanted.  In the end a cell has two thresholds, on either side of what is
    wanted; they are chosen so that what one cell of a source misses the next makes up for (a row per cell on the driver).
    """
    same = (F.col("source") == F.col("c_source")) & (F.col("lang") == F.col("c_lang")) & F.col("topic").eqNullSafe(F.col("c_topic"))
    key = ["c_source", "c_lang", "c_topic"]
    at = cells.withColumns({"base": F.lit(0).cast("bigint"), "rest": F.col("part")})
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        fixed = F.shiftright("draw", shift + BITS) == F.shiftright("base", shift + BITS)
        bins = pool.where("n_tokens > 0").join(at.select(*key, "base"), same & fixed).groupBy(*key, F.shiftright("draw", shift).alias("bin")).agg(F.sum("n_tokens").alias("n"))
        sums = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))).alias("y")
        x = at.alias("x")
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key]
        whole_bin = F.col("y.upto") <= F.col("x.rest")
        found = x.join(sums, on, "left").groupBy(*(F.col(f"x.{c}").alias(c) for c in (*key, "whole", "part", "rest", "base")))
        found = found.agg(F.max(F.when(whole_bin, F.col("y.bin"))).alias("lo"), F.coalesce(F.max(F.when(whole_bin, F.col("y.upto"))), F.lit(0)).alias("lo_n"), F.min(F.when(~whole_bin, F.col("y.bin"))).alias("hi"), F.min(F.when(~whole_bin, F.col("y.upto"))).alias("hi_n"))
        if level < LEVELS - 1:
            # on into the bin in which what is wanted is reached; where there is none, beyond the last
            base = F.shiftleft(F.coalesce(F.col("hi"), F.col("lo") + 1, F.shiftright("base", shift)), shift)
            at = cut(found.select(*key, "whole", "part", base.alias("base"), (F.col("rest") - F.col("lo_n")).alias("rest")))
    carried: dict[str, float] = defaultdict(float)
    chosen = []
    for r in sorted(found.collect(), key=lambda r: (r.c_source, r.c_lang, str(r.c_topic))):
        wanted = r.rest + carried[r.c_source]
        more = r.hi is not None and r.part > 0 and abs(r.hi_n - wanted) < abs(r.lo_n - wanted)
        carried[r.c_source] = wanted - (r.hi_n if more else r.lo_n)
        chosen.append((*(r[c] for c in key), r.whole, r.part, r.hi + 1 if more else r.base if r.lo is None else r.lo + 1))
    return cells.sparkSession.createDataFrame(chosen, f"{CELLS}, below bigint")


def mix(documents: DataFrame, targets: DataFrame, topic: Column, path: str = DEFAULT_VOCABULARY, lang: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, lang, topic, n_tokens, copies) of the documents used, and the report of :func:`report`."""
    spark = documents.sparkSession
    weights, repeat = _targets(targets)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 64 - BITS * LEVELS)
    pool = cut(sized(documents, list(weights), label_code() if lang is None else lang, topic, path).withColumn("draw", draw))
    totals = pool.groupBy(*AXES).agg(F.sum("n_tokens").alias("n"))
    held = totals.limit(MAX_CELLS + 1).collect()
    if len(held) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic; coarser topics are needed")
    cells, amounts, raked = plan({tuple(r[a] for a in AXES): float(r.n) for r in held}, weights, repeat)
    at = thresholds(pool, spark.createDataFrame(cells, CELLS))
    same = (F.col("source") == F.col("c_source")) & (F.col("lang") == F.col("c_lang")) & F.col("topic").eqNullSafe(F.col("c_topic"))
    used = (
        pool.join(at, same)
        .withColumn("copies", F.col("whole") + ((F.col("draw") < F.col("below")) & (F.col("part") > 0)).cast("int"))
        .where("copies > 0 and n_tokens > 0")
        .select("doc_id", *AXES, "n_tokens", "copies")
    )
    return used, report(used, weights, amounts, raked, {tuple(r[a] for a in AXES): float(r.n) for r in held})


def report(used: DataFrame, weights: dict[str, float], amounts: dict[str, float], raked: Raked, held: dict[tuple[str, str, str], float]) -> DataFrame:
    """(axis, name, weight_share, wanted_share, tokens, documents, most_copies, reached_share, rounds, converged) by source, lang and topic.

    weight_share is the share by weight of a source, and that of the pool for a language or topic; wanted_share what caps leave of it.
    """
    total, all_w, pool = sum(amounts.values()) or 1.0, sum(weights.values()) or 1.0, sum(held.values()) or 1.0
    rows = [("source", s, w / all_w, amounts[s] / total) for s, w in sorted(weights.items())]
    for i in (1, 2):
        own: dict[str, float] = defaultdict(float)
        for c, n in held.items():
            own[c[i]] += n
        rows += [(AXES[i], k, n / pool, n / pool) for k, n in own.items()]
    asked = used.sparkSession.createDataFrame(rows, "axis string, name string, weight_share double, wanted_share double")
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.col(a).cast("string").alias("k")) for a in AXES)))
    reached = used.select(each.alias("x"), "n_tokens", "copies").groupBy("x.a", "x.k").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    x = asked.join(reached, (F.col("axis") == F.col("a")) & F.col("name").eqNullSafe(F.col("k")), "left")
    x = x.select("axis", "name", "weight_share", "wanted_share", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_copies")))
    share = F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy("axis")), F.lit(1))
    return x.withColumns({"reached_share": share, "rounds": F.lit(raked.rounds), "converged": F.lit(raked.converged)})
