"""Encoding of a corpus with a public byte-level BPE tokenizer, by a pair occurrence index.

Per chunk of a partition: all texts are split into pieces as the tokenizer's pattern says, equal pieces are kept once, and the bytes of the
distinct pieces lie in one array of symbols.  The index maps ranks of mergeable pairs to all positions where they occur, in blocks of
neighbouring ranks.  Blocks are taken in ascending order; within one, every piece has its occurrences of its lowest active rank merged, again
and again, which is the ascending order of ranks in each piece.  A merge changes at most the pairs to its left and right, whose
positions go to the lists of their new ranks; a new pair's rank is always above that of the merge that made it, so no block is visited twice.
Everything is array arithmetic over the chunk, without a Python loop over texts, pieces or symbols.

The pattern splits a text into letter runs, number runs, other runs (each with one space before it, if there is one), white space, and the
English contractions; it is applied by character classes rather than by a regular expression engine.

Defined results.  Null and empty texts have no ids (an empty list).  Special tokens in a text are ordinary text.  Texts are encoded whole,
however long; a chunk grows with its longest text.  Repeated rows are encoded each for itself; extra columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies on the driver, unless given, and the most bytes that it may have, since it is sent to every executor.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MAX_VOCABULARY_BYTES = 64 << 20
#: UTF-8 bytes of text that are encoded together, and ranks per block of the index.
CHUNK_BYTES, BLOCK_RANKS = 6_000_000, 1_024
#: Fixed values of the pattern: contractions that are pieces of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_NEVER = np.int32(1 << 30)


@functools.lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    import regex

    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0
    text = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            table[m.start() : m.end()] = kind
    return table


class Vocabulary:
    """Symbols of single bytes and the pairs that merge, from a tokenizer file with a vocabulary and ordered merges."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        vocab: dict[str, int] = model["vocab"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.n_ranks = len(pairs)
        # an open hash table of pairs, probed by whole arrays
        self._bits = 18
        size = 1 << self._bits
        self._keys, self._ranks = np.full(size, -1, np.int64), np.full(size, _NEVER, np.int32)
        self._probes = 1
        keys = left << 20 | right
        todo = np.arange(len(keys))
        at = self._slot(keys)
        while len(todo):
            free = self._keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self._keys[slots], self._ranks[slots] = keys[put], put
            todo = np.setdiff1d(todo, put)
            if len(todo):
                at[todo] = (at[todo] + 1) & (size - 1)
                self._probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, _NEVER where a pair does not merge or a side is -1."""
        keys = left.astype(np.int64) << 20 | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._ranks[at], _NEVER)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self._probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self._bits) - 1)
            found = self._keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.astype(np.int32)


def file_bytes(path: str) -> bytes:
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary {path} has {size} bytes, more than {MAX_VOCABULARY_BYTES}")
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(file_bytes(path))


#: What this process has read from broadcasts, by digest; a worker parses a vocabulary once, whatever number of tasks it runs.
_parsed: dict[str, Vocabulary] = {}


def parsed(digest: str, data: Callable[[], bytes]) -> Vocabulary:
    """The vocabulary of a digest.  Workers find this function by its name, so all tasks of a process share what it holds."""
    if digest not in _parsed:
        _parsed[digest] = Vocabulary(data())
    return _parsed[digest]


def shipped(spark: SparkSession, path: str) -> Callable[[], Vocabulary]:
    """A function that gives the vocabulary wherever it runs: the file is read on the driver, its size checked, and its bytes are broadcast."""
    data = file_bytes(path)
    digest, held = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    return lambda: parsed(digest, lambda: held.value)


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern begins at each character.  text_starts: where the texts begin, each not empty."""
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    space = kind == SPACE
    start = change.copy()
    # the last character of a white-space run that more text follows: a plain space joins what follows, any other stands alone
    last = np.flatnonzero(space & ~first[1:] & np.append(~space[1:], False))
    start[last] = True
    plain = last[points[last] == 0x20]
    start[plain + 1] = False
    # contractions: an apostrophe that begins a piece and is not joined to a space
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.append(points, np.zeros(3, points.dtype))
        fence = np.append(first[1:], np.ones(3, bool))  # fence[i]: a text ends after character i
        a, b = padded[quote + 1], padded[quote + 2]
        one = ~fence[quote]
        two = one & ~fence[quote + 1]
        short, long = np.zeros(len(quote), bool), np.zeros(len(quote), bool)
        for c in CONTRACTIONS:
            if len(c) == 2:
                short |= one & (a == ord(c[1]))
            else:
                long |= two & (a == ord(c[1])) & (b == ord(c[2]))
        start[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long & ~short] + 3])
        start[after[after < n]] = True
        # of "'re" the r is inside the piece even where the class changes there; nothing else can begin inside
        start[quote[long & ~short] + 2] = False
    return start


def _distinct(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one piece of each kind, the kind of each piece) for pieces data[at : at + size]; equality is checked byte by byte."""
    inside = np.arange(len(data), dtype=np.int64) - np.repeat(at, size)
    powers = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15 | 1, np.uint64))
    digest = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[inside], at) ^ (size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, one, kind = np.unique(digest, return_index=True, return_inverse=True)
    twin = at[one][kind]
    same = (size == size[one][kind]) & True
    if same.all():
        differs = np.flatnonzero(data != data[np.repeat(twin, size) + inside])
        same[np.searchsorted(at, differs, "right") - 1] = False
    odd = np.flatnonzero(~same)  # pieces whose digest is that of another piece
    if len(odd):
        kind = kind.copy()
        kind[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, odd])
    return one, kind


def merge_pieces(data: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many ids each piece has) of pieces whose bytes lie one after the other."""
    n = len(data)
    ends = np.cumsum(sizes)
    tok = np.append(vocab.byte_ids[data], np.int32(-1))  # position n is the fence
    nxt = np.arange(1, n + 2, dtype=np.int32)
    nxt[ends - 1] = n
    nxt[n] = n
    prv = np.arange(-1, n, dtype=np.int32)
    prv[ends - sizes] = n
    prv[n] = n
    piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rank = np.full(n + 1, _NEVER, np.int32)  # of the pair that begins at each position
    rank[:n] = vocab.ranks(tok[:n], tok[nxt[:n]])
    n_blocks = vocab.n_ranks // BLOCK_RANKS + 1
    where = np.flatnonzero(rank < _NEVER).astype(np.int32)
    order = np.argsort(rank[where] // BLOCK_RANKS, kind="stable")
    where = where[order]
    cuts = np.searchsorted(rank[where] // BLOCK_RANKS, np.arange(n_blocks + 1))
    index: list[list[np.ndarray]] = [[where[cuts[b] : cuts[b + 1]]] for b in range(n_blocks)]
    for b in range(n_blocks):
        top = (b + 1) * BLOCK_RANKS
        lists, index[b] = index[b], []
        now = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int32)
        while len(now):
            r = rank[now]
            now = now[(r >= top - BLOCK_RANKS) & (r < top)]  # the others were merged away or have got another rank since
            if not len(now):
                break
            r, own = rank[now], piece[now]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            go = r == np.repeat(np.minimum.reduceat(r, heads), np.diff(np.append(heads, len(now))))
            # occurrences of one pair overlap only in runs of one symbol: there every other one is merged, from the left
            g = np.flatnonzero(go)
            chained = np.append(False, nxt[now[g[:-1]]] == now[g[1:]])
            if chained.any():
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(g))))
                go[g[(np.arange(len(g)) - begin) % 2 == 1]] = False
            p = now[go]
            q = nxt[p]
            after = nxt[q]
            tok[p] = vocab.made[rank[p]]
            tok[q] = -1
            rank[q] = _NEVER
            nxt[p] = after
            prv[after] = p
            prv[n] = n
            rank[p] = vocab.ranks(tok[p], tok[after])
            before = prv[p]
            before = before[before < n]
            rank[before] = vocab.ranks(tok[before], tok[nxt[before]])
            changed = np.concatenate([p, before])
            to = rank[changed] // BLOCK_RANKS
            inside = to == b
            later = ~inside & (rank[changed] < _NEVER)
            now = np.unique(np.concatenate([now[~go], changed[inside]]))
            if later.any():
                changed, to = changed[later], to[later]
                order = np.argsort(to, kind="stable")
                changed, to = changed[order], to[order]
                heads = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                for h, e in zip(heads.tolist(), [*heads[1:].tolist(), len(to)], strict=True):
                    index[to[h]].append(changed[h:e])
    alive = tok[:n] >= 0
    return tok[:n][alive], np.add.reduceat(alive, ends - sizes).astype(np.int64)


def encode(data: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many ids each text has) of UTF-8 texts whose bytes lie one after the other; sizes in bytes."""
    counts = np.zeros(len(sizes), np.int64)
    if not len(data):
        return np.zeros(0, np.int32), counts
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    full = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[full]
    start = piece_starts(points, np.searchsorted(lead, begins))
    at = lead[start]
    size = np.diff(np.append(at, len(data)))
    one, kind = _distinct(data, at, size)
    kept = size[one]
    offsets = np.cumsum(kept) - kept
    ids, n_ids = merge_pieces(data[np.arange(kept.sum()) + np.repeat(at[one] - offsets, kept)], kept, vocab)
    heads = np.cumsum(n_ids) - n_ids
    per_piece = n_ids[kind]
    ends = np.cumsum(per_piece)
    out = ids[np.arange(ends[-1]) + np.repeat(heads[kind] - (ends - per_piece), per_piece)]
    counts[full] = np.add.reduceat(per_piece, np.searchsorted(at, begins))
    return out, counts


def chunks(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if held and held + s > CHUNK_BYTES:
            yield begin, i
            begin, held = i, 0
        held += s
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_array(text: pa.Array, vocab: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, ids, ids per row) for chunks of a string array."""
    for i, j in chunks(text):
        part = pc.fill_null(text.slice(i, j - i), "").cast(pa.large_binary())
        sizes = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
        first = int(np.frombuffer(part.buffers()[1], np.int64)[part.offset])
        data = np.frombuffer(part.buffers()[2], np.uint8, int(sizes.sum()), first) if sizes.sum() else np.zeros(0, np.uint8)
        ids, counts = encode(data, sizes, vocab)
        yield i, j, ids, counts


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text."""
    vocab = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, ids, counts in encode_array(b.column(1), vocab()):
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every text, without keeping its ids."""
    vocab = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([c for *_, c in encode_array(b.column(len(keep)), vocab())]) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    x = documents.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in keep)
    return x.mapInArrow(run, f"{fields}, n_tokens bigint")
