"""Language of texts and of the stretches of mixed ones, by averaged hashed subword embeddings with a linear softmax.

A sentence is lower-cased and composed, and every run of one to five characters of it is hashed to a row of an embedding table; the mean of the
rows goes through a linear softmax.  Table and softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled
texts.  Labels lie, so training runs in rounds: sentences that one round's model puts elsewhere are left out of the next.  Cyrillic
sentences are also shown in Latin letters, so that a language counts in either script.  A temperature fitted on held-out sentences calibrates
the confidence.

A softmax is sure of languages that it never saw, so what is rejected is decided apart from it, by familiarity: the share of a sentence's runs
of three to five characters that occur in the training sentences.  The bound is fitted on held-out sentences with the languages left out one by
one: FOREIGN of the sentences of a language that is left out (for the median language) shall lie below it, but no more than REJECTED of those
of known languages.  So what is unlike all training texts has no language, be it another language or no text at all.

The sentences of a text are then labelled together (the likeliest sequence of languages and of none, with a price on every change), so a stretch
is a run of sentences; it comes out with its place in the text.  A change of language within a sentence is not seen.  The model is a few MB, whatever the data; texts are labelled whole, in Arrow batches, without any shuffle.

Defined results.  Null, blank and letterless texts have no language (null, with confidence 0 and no place), unfamiliar stretches neither.  Repeated rows are labelled each for itself.  With no usable label in the
data there is no model and no text gets a language.  Nulls in labels are absent labels.  Extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberlog.functions.entries import narrowed
from amberlog.functions.names import is_delete, local_lower

#: Most labelled texts that a model is trained on, and how many times as many labelled rows are looked at to find as many distinct ones.
TRAINING_TEXTS, OVERSAMPLING = 6_000, 8
#: The languages told apart and their codes of two and three letters.
CODES = {"en": "en", "eng": "en", "ru": "ru", "rus": "ru", "uk": "uk", "ukr": "uk", "de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "fre": "fr", "es": "es", "spa": "es", "it": "it", "ita": "it"}
LANGUAGES = ("en", "ru", "uk", "de", "fr", "es", "it")
#: Cyrillic letters in Latin spelling, first as commonly written for Russian, then where Ukrainian differs.
LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}
LATIN_UK = {"г": "h", "ґ": "g", "є": "ye", "и": "y", "і": "i", "ї": "yi", "й": "y", "'": "", "’": ""}
LATIN_OTHER = {"х": "h", "ц": "c", "щ": "sch", "ж": "j", "й": "j", "ю": "ju", "я": "ja", "ё": "jo", "є": "ie", "ї": "i"}
BUCKETS, WIDTH, GRAMS, EPOCHS = 1 << 16, 16, (1, 2, 3, 4, 5), 4
#: Steps of descent at least, so that few texts are shown more often.
STEPS = 40_000
#: Nats that a change of language within a text costs, and the share of right held-out sentences whose confidence counts as unsure.
CHANGE, UNSURE = 5.0, 0.002
#: Lengths of the runs of which familiarity is the known share, bits of the table of known ones, and nats that a whole share is worth.
LONG_RUNS, KNOWN_BITS, FAMILIAR_NATS = (3, 4, 5), 22, 20.0
#: Shares of held-out sentences that may be rejected, and of those of a left-out language that are to be.
REJECTED, FOREIGN = 0.005, 0.9
_ENDS = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|\s+-{1,3}\s+|\s*\n\s*\n\s*")


FORMAT_CHARACTERS = regex.compile(r"\p{Cf}+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Characters whose embeddings are summed at once.
CHUNK = 200_000


def clean(text: str) -> str:
    """Without format characters, composed, in lower case, letters only, single blanks between and around."""
    kept = text if text.isascii() else unicodedata.normalize("NFC", FORMAT_CHARACTERS.sub("", text))
    return " " + " ".join(_WORDS.findall(kept.lower())) + " "


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(begin, end, cleaned) of the sentences of a text that have letters; places in code points."""
    out, begin, text = [], 0, text or ""
    for at, end in [(m.start(), m.end()) for m in _ENDS.finditer(text)] + [(len(text), len(text))]:
        piece = text[begin:at]
        if piece and len(c := clean(piece)) > 2:
            lead = len(piece) - len(piece.lstrip())
            out.append((begin + lead, begin + len(piece.rstrip()), c))
        begin = end
    return out


def sentences(text: str | None) -> list[str]:
    """The cleaned sentences of a text that have letters."""
    return [c for *_, c in spans(text)]


def _hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each length in GRAMS the mixed hash of the run of characters that begins at each place (the last ones are shorter by a place each)."""
    c = points.astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, min(max(GRAMS), len(c)) + 1):
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
        yield (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _bucket(mixed: np.ndarray) -> np.ndarray:
    return ((mixed >> np.uint64(48)) % np.uint64(BUCKETS)).astype(np.int64)


def _slot(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def features(cleaned: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the runs of characters of the lengths in GRAMS: each bucket once, with its share of all runs."""
    found, n = np.unique(np.concatenate([_bucket(h) for h in _hashes(_points(cleaned))]), return_counts=True)
    return found, (n / n.sum()).astype(np.float32)


def long_runs(cleaned: str) -> np.ndarray:
    """The slots of the runs of the lengths in LONG_RUNS."""
    return np.concatenate([np.zeros(0, np.int64), *(_slot(h) for n, h in enumerate(_hashes(_points(cleaned)), 1) if n in LONG_RUNS)])


def latin(cleaned: str, lang: str, other: bool = False) -> str:
    table = LATIN | (LATIN_UK if lang == "uk" else {}) | (LATIN_OTHER if other else {})
    return "".join(table.get(c, c) for c in cleaned)


@dataclass
class Model:
    """What labelling needs; a few MB.  The last row of the table stays 0: it is for runs that would cross into the next sentence."""

    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    unsure: float = 0.0
    known: np.ndarray | None = None
    unfamiliar: float = 0.0

    def logits(self, f: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return f[1] @ self.table[f[0]] @ self.weights + self.bias

    def judge(self, cleaned: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(a row of probabilities, the familiarity) of each cleaned sentence; sentences are embedded many at once."""
        out, familiar, i = np.zeros((len(cleaned), len(LANGUAGES))), np.zeros(len(cleaned)), 0
        while i < len(cleaned):
            j, held = i, 0
            while j < len(cleaned) and (j == i or held + len(cleaned[j]) <= CHUNK):
                held += len(cleaned[j])
                j += 1
            sizes = np.array([len(s) for s in cleaned[i:j]])
            ends = np.cumsum(sizes)
            room = np.repeat(ends, sizes) - np.arange(held)
            total, known = np.zeros((j - i, WIDTH)), np.zeros(j - i)
            for n, h in enumerate(_hashes(_points("".join(cleaned[i:j]))), 1):
                inside = room[: len(h)] >= n
                b = np.append(np.where(inside, _bucket(h), BUCKETS), np.full(held - len(h), BUCKETS))
                total += np.add.reduceat(self.table[b], ends - sizes, axis=0)
                if n in LONG_RUNS and self.known is not None:
                    known += np.add.reduceat(np.append(self.known[_slot(h)] & inside, np.zeros(held - len(h), bool)).astype(float), ends - sizes)
            runs = {n: np.maximum(sizes - n + 1, 0) for n in GRAMS}
            z = ((total / sum(runs.values())[:, None]) @ self.weights + self.bias) / self.temperature
            e = np.exp(z - z.max(1, keepdims=True))
            out[i:j] = e / e.sum(1, keepdims=True)
            familiar[i:j] = known / np.maximum(sum(runs[n] for n in LONG_RUNS), 1)
            i = j
        return out, familiar


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _descend(data: list[tuple[tuple[np.ndarray, np.ndarray], int]], seed: int, epochs: int) -> Model:
    rng = np.random.default_rng(seed)
    m = Model(rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS + 1, WIDTH)).astype(np.float32), np.zeros((WIDTH, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32))
    m.table[BUCKETS] = 0
    counts = np.bincount([y for _, y in data], minlength=len(LANGUAGES)).astype(float)
    scale = np.sqrt(len(data) / len(LANGUAGES) / np.maximum(counts, 1)).clip(0.7, 2.5)  # rare languages weigh more
    steps, step = epochs * len(data), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            (buckets, share), y = data[i]
            rate = np.float32(0.4 * (1 - step / steps) * scale[y])
            step += 1
            rows = m.table[buckets]
            hidden = share @ rows
            p = _softmax(hidden @ m.weights + m.bias).astype(np.float32)
            p[y] -= 1
            back = m.weights @ p
            m.weights -= rate * np.outer(hidden, p)
            m.bias -= rate * 0.1 * p
            # every bucket takes the gradient of all of its runs; the factor undoes the smallness of a mean over many of them
            m.table[buckets] = rows - np.outer(share * 20, rate * back)
    return m


def known_runs(rows: list[tuple[str, int]]) -> np.ndarray:
    """Per language which long runs its sentences have."""
    known = np.zeros((len(LANGUAGES), 1 << KNOWN_BITS), bool)
    for s, y in rows:
        known[y][long_runs(s)] = True
    return known


def unfamiliar_below(known: np.ndarray, held: list[tuple[str, int]]) -> float:
    """The familiarity below which sentences are rejected, from held-out right ones, with their languages known and left out one by one."""
    if not held:
        return 0.0
    runs = [(long_runs(s), y) for s, y in held]
    all_ = known.any(0)
    own = np.array([all_[r].mean() if len(r) else 1.0 for r, _ in runs])
    foreign = []
    for lang in {y for _, y in runs}:
        others = np.delete(known, lang, 0).any(0)
        foreign.append(float(np.quantile([others[r].mean() if len(r) else 0.0 for r, y in runs if y == lang], FOREIGN)))
    return min(float(np.quantile(own, REJECTED)), float(np.median(foreign)))


def train(texts: list[tuple[str, str]]) -> Model | None:
    """A calibrated model from (text, language); None if no text has letters."""
    rows: list[tuple[str, int]] = []
    for text, lang in texts:
        if lang in LANGUAGES:
            rows += [(s, LANGUAGES.index(lang)) for s in dict.fromkeys(sentences(text)) if len(s) > 12]
    if not rows:
        return None
    cyrillic = [(s, y) for s, y in rows if LANGUAGES[y] in ("ru", "uk") and re.search(r"[а-яіїєґ]{3}", s)]
    shown = rows + [(latin(s, LANGUAGES[y], k % 4 == 3), y) for k, (s, y) in enumerate(cyrillic) if k % 2]
    held, used = shown[::7], [r for i, r in enumerate(shown) if i % 7]
    used = used or held
    data = [(features(s), y) for s, y in used]
    agreed = list(range(len(data)))
    for seed in (1, 2):  # what a model trained on the labels so far puts elsewhere is left out of the next
        m = _descend([data[i] for i in agreed], seed, max(1, STEPS // 4 // len(agreed)))
        agreed = [i for i, (f, y) in enumerate(data) if m.logits(f).argmax() == y] or list(range(len(data)))
    model = _descend([data[i] for i in agreed], 3, max(EPOCHS, STEPS // len(agreed)))
    known = known_runs([used[i] for i in agreed])
    model.known = known.any(0)
    z = np.array([model.logits(features(s)) for s, _ in held])
    truth = np.array([y for _, y in held], int)
    right = z.argmax(1) == truth  # wrong ones are mostly wrong labels, which must not flatten the confidence
    if right.any():
        best = min((float(np.mean([-np.log(_softmax(a / t)[y] + 1e-12) for a, y in zip(z[right], truth[right], strict=True)])) + 0.02 * abs(np.log(t)), t) for t in (0.5, 0.75, 1.0, 1.5, 2.0))
        model.temperature = best[1]
        confidence = np.array([_softmax(a / model.temperature).max() for a in z[right]])
        model.unsure = float(min(0.8, np.quantile(confidence, UNSURE)))
        model.unfamiliar = unfamiliar_below(known, [h for h, ok in zip(held, right, strict=True) if ok])
    return model


#: (language or None, confidence, sentences, begin, end) of a stretch.
Stretch = tuple[str | None, float, int, int, int]


def label(text: str | None, model: Model) -> list[Stretch]:
    """The stretches of a text."""
    return label_all([text], model)[0]


def label_all(texts: list[str | None], model: Model) -> list[list[Stretch]]:
    """The stretches of each text."""
    parts = [spans(t) for t in texts]
    p, familiar = model.judge([s for x in parts for *_, s in x])
    ends = np.cumsum([len(x) for x in parts])
    return [_stretches(x, p[e - len(x) : e], familiar[e - len(x) : e], model) for x, e in zip(parts, ends, strict=True)]


def _stretches(parts: list[tuple[int, int, str]], p: np.ndarray, familiar: np.ndarray, model: Model) -> list[Stretch]:
    if not parts:
        return []
    sizes = np.array([len(s) for *_, s in parts])
    sure = (p.max(1) >= model.unsure) & (sizes > 12)
    sure = sure if sure.any() else p.max(1) >= model.unsure
    weight = np.where(sure, 1.0, 0.1)[:, None]
    # the last column is no language: the likelier, the less familiar a sentence is
    none = FAMILIAR_NATS * (model.unfamiliar - familiar) * np.where(sizes > 12, 1.0, 0.1)
    score = np.hstack([np.log(p + 1e-9) * weight, none[:, None]])
    best, back = score[0].copy(), []
    for row in score[1:]:
        jump = best.max() - CHANGE
        back.append(np.where(best >= jump, np.arange(len(best)), best.argmax()))
        best = np.maximum(best, jump) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    out: list[Stretch] = []
    start = 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[start]:
            here = path[start]
            named = here < len(LANGUAGES)
            confidence = float(np.average(p[start:i, here], weights=sizes[start:i])) if named else 0.0
            out.append((LANGUAGES[here] if named else None, confidence, i - start, parts[start][0], parts[i - 1][1]))
            start = i
    return out


def language_of_label(label_text: str | None) -> str | None:
    """The language that a label names: by its code alone, case and region ignored; None if it names none of those told apart."""
    return CODES.get(re.split(r"[-_]", (label_text or "").strip().lower())[0])


def texts_of(log: DataFrame) -> DataFrame:
    """(seq, pos, value, lang): description and comment fields of rows that are no deletions."""
    e = log.where(~is_delete("tp")).select("seq", F.posexplode(narrowed("props", "tag", "prop", "value", "lang")).alias("pos", "e")).where("e.tag = 1")
    return e.where(local_lower("e.prop").isin("description", "comment")).select("seq", "pos", F.col("e.value").alias("value"), F.col("e.lang").alias("lang"))


def fit(texts: DataFrame, bound: int = TRAINING_TEXTS) -> Model | None:
    """A model trained on at most ``bound`` distinct labelled texts: those with the least hashes of a share of all labelled rows.

    The share (1 up to OVERSAMPLING times the bound) is taken by the hash before anything is shuffled, so no more than the sample moves.
    """
    code = F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    usable = texts.select("value", code.alias("code")).where(code.isin(*CODES) & (F.length(F.trim("value")) > 0))
    share = min(1.0, OVERSAMPLING * bound / max(usable.count(), 1))
    place = F.pmod(F.xxhash64("value"), F.lit(1 << 40))
    chosen = usable.where(place < int(share * (1 << 40))) if share < 1 else usable
    sample = chosen.groupBy("value").agg(F.min("code").alias("code")).orderBy(place, "value").limit(bound).collect()
    return train([(r.value, CODES[r.code]) for r in sample])


STRETCHES = "seq bigint, pos int, label_lang string, stretch int, lang string, confidence double, n_sentences int, begin int, end int"


def stretches(texts: DataFrame, model: Model | None) -> DataFrame:
    """(seq, pos, label_lang, stretch, lang, confidence, n_sentences, begin, end): one row per stretch of each text with its place in code points
    (from begin up to, not with, end), and one with a null lang and place for a text without sentences."""
    if model is None:
        return texts.sparkSession.createDataFrame([], STRETCHES)
    held = texts.sparkSession.sparkContext.broadcast(model)  # a few MB by construction

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
        names = [c.split()[0] for c in STRETCHES.split(", ")]
        for b in batches:
            given = [c.to_pylist() for c in b.columns]
            distinct = list(dict.fromkeys(given[2]))
            known = dict(zip(distinct, label_all(distinct, held.value), strict=True))
            rows = [(seq, pos, language_of_label(lang), i, *x) for seq, pos, value, lang in zip(*given, strict=True) for i, x in enumerate(known[value] or [(None, 0.0, 0, None, None)])]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return texts.select(F.col("seq").cast("bigint"), F.col("pos").cast("int"), "value", "lang").mapInArrow(run, STRETCHES)


def doubtful_labels(stretch_rows: DataFrame) -> DataFrame:
    """(seq, pos, lang): one row per language of each text whose label is absent or wrong, or that holds two languages."""
    # the stretches of a text leave one batch, but a text is one group of a handful of rows, so this shuffle is small and even
    x = stretch_rows.where("lang is not null").groupBy("seq", "pos").agg(F.collect_set("lang").alias("langs"), F.first("label_lang").alias("named"))
    bad = (F.size("langs") > 1) | F.col("named").isNull() | (F.col("named") != F.col("langs")[0])
    return x.where(bad).select("seq", "pos", F.explode("langs").alias("lang"))
