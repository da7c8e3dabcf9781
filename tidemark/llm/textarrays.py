"""Texts of an Arrow batch as flat numpy arrays: bytes, document offsets, words, slice hashes and shingles.

Every function works on a whole piece of a batch at once, so the cost per document is a few array
passes. Hashes are 64-bit: a random-table polynomial in an odd base modulo 2^64, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240611)
_TAB = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, U64)
_ipow = np.ones(1, U64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about `limit` bytes of text (one text at least) and `rows` rows."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at, n = 0, len(lengths)
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; a null text is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher, elementwise."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, 1 << 16)
        p = np.full(size, _BASE, U64)
        q = np.full(size, _INV, U64)
        p[0] = q[0] = 1
        _pow, _ipow = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _pow, _ipow


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over the bytes, one longer than data."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TAB[data] * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte slices [start, end); equal bytes give equal hashes wherever they stand."""
    h = (prefix[end] - prefix[start]) * _powers(len(prefix))[1][start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values that do not cross a document's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per document the index of its first word (n + 1 values)."""
    start, end = runs(~separators[data], offsets)
    return start, end, np.searchsorted(start, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... (lengths[i] of them) for each i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return out + np.arange(total)


_CHAIN = U64(0xA0761D6478BD642F)


def shingles(word_hash: np.ndarray, first_word: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words, and per document the index of its first one (n + 1 values).

    A document with 1 to k - 1 words has its whole sequence as its only shingle; one without words has none.
    """
    n_words = np.diff(first_word)
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = ragged(first_word[:-1], count)
    acc = np.zeros(len(at), U64)
    size = np.repeat(np.minimum(n_words, k), count)
    for j in range(k):
        live = size > j
        step = np.where(live, word_hash[np.minimum(at + j, max(len(word_hash) - 1, 0))], U64(0)) if len(at) else acc
        acc = acc * _CHAIN + step
    return mix(acc + size.astype(U64)), bounds


SET_BITS = 54


def distinct_per_document(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, cut to 54 bits, and their bounds; up to 1023 documents at once."""
    n = len(bounds) - 1
    assert n < 1 << (64 - SET_BITS)
    key = (np.repeat(np.arange(n, dtype=U64), np.diff(bounds)) << U64(SET_BITS)) | (values >> U64(64 - SET_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> U64(SET_BITS)).astype(np.int64)
    return key & U64((1 << SET_BITS) - 1), np.searchsorted(owner, np.arange(n + 1))


def per_document(op, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """op.reduceat over each document's values; `empty` for a document without any."""
    out = np.full((len(bounds) - 1,) + values.shape[1:], empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = op.reduceat(values, bounds[full], axis=0)
    return out


def strings(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The byte strings between the offsets."""
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
