"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, encoding with offsets, decoding.

Pre-tokenisation uses no regular expression. Every code point gets a symbol (letter, number, other,
apostrophe that opens a contraction, three kinds of white space); each symbol is a function on the ten
states of a small automaton; an associative scan composes these functions (as elements of their finite
transition monoid) and gives the state before every character, hence every slice border. The slices
are hashed, looked up in a bounded cache and only unseen ones go through pair merging, many at a time.

Defined results: a null or empty text has no tokens; special tokens do not exist, their strings are
ordinary text; a text of any length is encoded whole; further columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import textarrays as ta
from tidemark.llm.cluster import ship
from tidemark.llm.tables import HashTable

LETTER, NUMBER, OTHER, APOS1, APOS2, SPACES, JOINING, SINGLE = range(8)
START, IN_L, IN_N, IN_O, JOINED, IN_W, AFTER_X, NEED1, NEED2, DONE = range(10)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The automaton of the split pattern: next state, and whether a slice begins at this character."""
    if symbol == LETTER:
        if state in (NEED2, NEED1):
            return state - 1 if state == NEED2 else DONE, False
        return IN_L, state not in (IN_L, JOINED)
    if symbol == NUMBER:
        return IN_N, state not in (IN_N, JOINED)
    if symbol in (OTHER, APOS1, APOS2):
        if state in (IN_O, JOINED):
            return IN_O, False
        return {OTHER: IN_O, APOS1: NEED1, APOS2: NEED2}[symbol], True
    if symbol == SPACES:
        return IN_W, state != IN_W
    return (JOINED if symbol == JOINING else AFTER_X), True


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol (8 plain, then 8 that first reset to START), product table, effect on states, borders."""
    plain = [tuple(_step(s, y)[0] for s in range(10)) for y in range(8)]
    gens = plain + [(g[START],) * 10 for g in plain]
    elements = {tuple(range(10)): 0}
    queue = [tuple(range(10))]
    for f in queue:
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    assert len(queue) < 256
    effect = np.array(queue, np.uint8)
    product = np.array([[elements[tuple(g[x] for x in f)] for g in queue] for f in queue], np.uint8)
    border = np.array([[_step(s, y)[1] for y in range(8)] + [True] * 8 for s in range(10)])
    return np.array([elements[g] for g in gens], np.uint8), product, effect, border


def _scan(elements: np.ndarray, product: np.ndarray, effect: np.ndarray) -> np.ndarray:
    """State before each position, from START, by a blocked associative scan."""
    n, width = len(elements), 256
    if n <= 64:
        out, s = np.zeros(n, np.uint8), START
        for i, e in enumerate(elements.tolist()):
            out[i] = s
            s = effect[e, s]
        return out
    m = len(product)
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint8)
    padded[:n] = elements
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    upto = np.zeros((width, blocks), np.uint8)
    table = product.ravel()
    acc = np.zeros(blocks, np.uint8)
    for j in range(width):
        upto[j] = acc
        acc = table[acc.astype(np.intp) * m + columns[j]]
    before = _scan(acc, product, effect)
    states = effect.ravel()[upto.astype(np.intp) * effect.shape[1] + before]
    return states.T.reshape(-1)[:n]


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACES for every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACES
    return out


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of all documents in order, and per document the index of its first one."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    first = np.zeros(n, bool)
    at = np.searchsorted(starts, offsets[:-1][np.diff(offsets) > 0])
    first[at] = True
    ends_text = np.ones(n, bool)
    ends_text[:-1] = first[1:]
    symbol = _classes()[points]
    white = symbol == SPACES
    before_text = white.copy()
    before_text[:-1] &= ~white[1:]
    before_text[-1] = False
    before_text &= ~ends_text
    symbol[before_text] = SINGLE
    symbol[before_text & (points == 32)] = JOINING
    for i in np.flatnonzero(points == 39).tolist():
        tail = points[i + 1 : i + 3].tolist() if not ends_text[i] else []
        if tail[:1] and tail[0] in (115, 116, 109, 100):
            symbol[i] = APOS1
        elif tail in ([114, 101], [118, 101], [108, 108]) and not ends_text[i + 1]:
            symbol[i] = APOS2
    symbol[first] += 8
    element, product, effect, border = _monoid()
    begins = starts[border[_scan(element[symbol], product, effect), symbol]]
    return begins, np.searchsorted(begins, offsets)


class Vocabulary:
    """Merge ranks of a public tokenizer, with array tables and a bounded cache of merged slices."""

    NONE = np.int64(1) << 40

    def __init__(self, rank_file: bytes, cache_words: int = 1 << 20):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.token_len = np.array([len(t) for t in self.tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        prefix = ta.prefix_hashes(self.token_bytes)
        some = np.flatnonzero(self.token_len)
        self.whole = HashTable(len(some))
        self.whole.insert(ta.slice_hashes(prefix, self.token_at[some], self.token_at[some + 1]), some)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pair = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = HashTable(len(pair))
        self.pairs.insert(np.fromiter(pair.keys(), np.uint64, len(pair)) + np.uint64(1), np.fromiter(pair.values(), np.int64, len(pair)))
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.cache = HashTable(min(1 << 12, self.cache_words))
        self.pool, self.used, self.count = np.zeros(1 << 16, np.int32), 0, 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.lookup(((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) + np.uint64(1))
        return np.where(found < 0, self.NONE, found)

    def _merge_long(self, word: bytes) -> list[int]:
        """Merging with a heap, for slices so long that rounds over the whole slice would cost too much."""
        ids = [int(self.byte_id[b]) for b in word]
        n = len(ids)
        nxt, prev, ranks, tokens = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks, self.tokens
        heap = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (r := ranks.get(tokens[ids[i]] + tokens[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            if prev[i] >= 0:
                push(prev[i])
            push(i)
        return [x for x in ids if x >= 0]

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many slices at once, one after another, and how many each has.

        Each round applies to every slice its leftmost pair of lowest rank; slices without a pair leave.
        """
        length = end - start
        counts = np.zeros(len(start), np.int64)
        done_ids, done_word = [], []
        for w in np.flatnonzero(length > 2000).tolist():
            ids = self._merge_long(data[start[w] : end[w]].tobytes())
            done_ids.append(np.array(ids, np.int64))
            done_word.append(np.full(len(ids), w))
        some = np.flatnonzero(length <= 2000)
        word = np.repeat(some, length[some])
        sym = self.byte_id[data[ta.ragged(start[some], length[some])]]
        rank = self._pair_ranks(sym, word)
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(heads, len(word)))
            low = np.minimum.reduceat(rank, heads)
            live = np.repeat(low < self.NONE, sizes)
            if not live.all():
                done_ids.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank = sym[live], word[live], rank[live]
                keep = low < self.NONE
                sizes, low = sizes[keep], low[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
            sym[hit] = rank[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            shift = hit - np.arange(len(hit))
            sym, word, rank = sym[stay], word[stay], rank[stay]
            for at in (shift, shift[shift > 0] - 1):
                right = np.minimum(at + 1, len(sym) - 1)
                rank[at] = np.where((at + 1 < len(sym)) & (word[right] == word[at]), self._rank(sym[at], sym[right]), self.NONE)
        if not done_ids:
            return np.zeros(0, np.int32), counts
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(start))

    def _pair_ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), self.NONE)
        if len(sym) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self._rank(sym[same], sym[same + 1])
        return rank

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        whole = self.whole.lookup(hashes)
        rest = np.flatnonzero(whole < 0)
        ids, counts = self.merge(data, start[rest], end[rest])
        size = np.ones(len(start), np.int64)
        size[rest] = counts
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(at[-1], np.int32)
        flat[at[:-1][whole >= 0]] = whole[whole >= 0]
        flat[ta.ragged(at[:-1][rest], counts)] = ids
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + len(start) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : self.used + len(flat)] = flat
        self.at[self.count : self.count + len(start)] = self.used + at[:-1]
        self.size[self.count : self.count + len(start)] = size
        self.cache.insert(hashes, np.arange(self.count, self.count + len(start)))
        self.used += len(flat)
        self.count += len(start)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all documents and per document the index of its first one (n + 1 values)."""
        start, first = slices(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        hashes = ta.slice_hashes(ta.prefix_hashes(data), start, end)
        index = self.cache.lookup(hashes)
        if (index < 0).any():
            new, where = np.unique(hashes[index < 0], return_index=True)
            at = np.flatnonzero(index < 0)[where]
            if self.count + len(new) > self.cache_words:
                self._reset()
                new, at = np.unique(hashes, return_index=True)
            if (size := self.count + len(new)) > self.cache.capacity:
                self.cache = self.cache.grown(2 * size)
            self._learn(data, start[at], end[at], new)
            index = self.cache.lookup(hashes)
        size = self.size[index].astype(np.int64)
        ids = self.pool[ta.ragged(self.at[index], size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the id sequences between the bounds, and their byte offsets."""
        size = self.token_len[ids]
        data = self.token_bytes[ta.ragged(self.token_at[ids], size)]
        return data, np.concatenate([[0], np.cumsum(size)])[bounds]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(rank_file: bytes) -> Vocabulary:
    """The vocabulary of a rank file, kept for the life of the worker."""
    key = hashlib.sha256(rank_file).hexdigest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(rank_file)
    return _vocabularies[key]


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file on the driver; they go to the executors as a broadcast of this fixed size."""
    with open(path, "rb") as f:
        return f.read()


def _others(df: DataFrame, text_col: str, new: list[str]) -> list[str]:
    return [c for c in df.columns if c != text_col and c not in new]


def encode(df: DataFrame, rank_path: str, text_col: str = "text") -> DataFrame:
    """df without its text, plus ids array<int> and token_starts array<int> (byte offsets of the tokens in the text)."""
    ship(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    keep = _others(df, text_col, ["ids", "token_starts"])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "token_starts")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks.value)
        for batch in batches:
            for piece in ta.pieces(batch, text_col, limit=1 << 20):
                ids, bounds = vocab.encode(*ta.flat(piece.column(text_col)))
                size = vocab.token_len[ids]
                start = np.concatenate([[0], np.cumsum(size)])
                rel = start[:-1] - np.repeat(start[bounds[:-1]], np.diff(bounds))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (ids, rel)]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + lists, names=[*keep, "ids", "token_starts"])

    return df.select(*keep, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, rank_path: str) -> DataFrame:
    """df without ids and token_starts, plus decoded binary: the bytes that the ids stand for."""
    ship(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    keep = [c for c in df.columns if c not in ("ids", "token_starts", "decoded")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks.value)
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])
            data, at = vocab.decode(np.asarray(lists.flatten()), bounds)
            out = pa.array(ta.strings(data, at), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [out], names=[*keep, "decoded"])

    return df.select(*keep, "ids").mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; id, n_tokens long, and SHA-256 of the ids (little-endian) and of the decoded bytes."""
    ship(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks.value)
        for batch in batches:
            for piece in ta.pieces(batch, text_col, limit=1 << 20):
                ids, bounds = vocab.encode(*ta.flat(piece.column(text_col)))
                data, at = vocab.decode(ids, bounds)
                code = ids.astype("<u4").view(np.uint8)
                digests = [pa.array([hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)], pa.string()) for x, o in ((code, bounds * 4), (data, at))]
                yield pa.RecordBatch.from_arrays([piece.column(id_col), pa.array(np.diff(bounds), pa.int64()), *digests], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
