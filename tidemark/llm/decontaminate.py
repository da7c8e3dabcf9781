"""Benchmark decontamination by SimHash of item-sized windows and exact weighted verification.

Every benchmark item has a SimHash fingerprint of its five-word shingles, weighted by their rarity in
the benchmark. For each item length the same fingerprint is taken of a text's windows of that many
words. Fingerprints are cut into eight blocks of eight bits; the index holds every block value within
two bits of an item's, so by the pigeonhole principle all pairs within RADIUS bits meet. Those are
verified by weighted Jaccard similarity of their full shingle sets. A text with fewer words than an item
has one window for it, the whole text.

Windows that hold no shingle of any item have similarity 0 to all and are passed over before they are
fingerprinted; this loses nothing. In how many items a shingle stands is counted over the whole benchmark
by Spark, in SLOTS hashed slots (shingles that share a slot share its count), so weights and similarities
do not depend on how the benchmark is cut. The driver and every task hold one part of it at a time, of at
most PART_BYTES of text (one item at least): each further part is one more pass over the table, whose
result is written to the shared folder.

Defined results: words are split at ASCII white space after lower-casing A-Z; null or empty texts and
items match nothing; items under five words are matched as whole sequences; repeated items match alike,
each with its own id; of equal similarities the earliest window counts; whole texts are read; an empty
table or benchmark gives no matches; further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textarrays as ta
from tidemark.llm.cluster import Scratch, ship
from tidemark.llm.tables import HashTable

K = 5
RADIUS = 23
BLOCKS = 8
SIMILARITY = 0.8
PART_BYTES = 16 << 20
PAIRS = 1 << 22
SLOTS = 1 << 20

_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_NEAR = np.flatnonzero(np.bitwise_count(np.arange(256)) <= 2)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = ta.flat(column)
    data = ta.LOWER[data]
    start, end, first = ta.words(data, offsets)
    return ta.slice_hashes(ta.prefix_hashes(data), start, end), first


def _fingerprints(hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of the shingles [begin, begin + count): sign of the weighted sum of each bit's +1 and -1."""
    out = np.zeros(len(begin), np.uint64)
    for bit in _BIT:
        sums = np.concatenate([[0.0], np.cumsum(np.where(hashes & bit, weights, -weights))])
        out |= np.where(sums[begin + count] - sums[begin] > 1e-9, bit, np.uint64(0))
    return out


def _weights(shingles: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """log(1 + n / df): the rarer a shingle is in the benchmark, the more it weighs."""
    return np.log1p(n / np.maximum(slots[(shingles & np.uint64(SLOTS - 1)).astype(np.int64)], 1))


def _block_values(prints: np.ndarray) -> np.ndarray:
    """Blocks x fingerprints, each value tagged with its block."""
    return np.stack([((prints >> np.uint64(8 * b)) & np.uint64(255)) | np.uint64(b << 8) for b in range(BLOCKS)]).astype(np.int64)


def _meetings(lo: np.ndarray, hi: np.ndarray, owner: np.ndarray, n: int, prints: np.ndarray, theirs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs that share a block value and are within radius bits; about PAIRS candidates are held at once."""
    found = []
    ends = np.cumsum((hi - lo).sum(0)) // PAIRS
    cuts = np.concatenate([[0], np.flatnonzero(ends[1:] > ends[:-1]) + 1, [len(prints)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        size = (hi[:, a:b] - lo[:, a:b]).ravel()
        pair = np.unique(np.repeat(np.tile(np.arange(a, b), BLOCKS), size) * n + owner[ta.ragged(lo[:, a:b].ravel(), size)])
        found.append(pair[np.bitwise_count(prints[pair // n] ^ theirs[pair % n]) <= radius])
    pair = np.concatenate(found)
    return pair // n, pair % n


@dataclass
class Part:
    """One part of the benchmark, ready to search."""

    item_ids: list[int]
    sets: list[dict[int, float]]
    totals: np.ndarray
    known: HashTable
    slots: np.ndarray
    n: int
    lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # words: items, fingerprints, sorted keys, their items

    @staticmethod
    def build(ids: list[int], texts: list[str], slots: np.ndarray, n: int) -> Part:
        """slots: in how many of the benchmark's n items the shingles of each slot stand."""
        word, first = _words(pa.array(texts, pa.string()))
        n_words = np.diff(first)
        shingle, bounds = ta.shingles(word, first, K)
        keys = np.unique(shingle)
        known = HashTable(max(len(keys), 1))
        known.insert(keys, np.arange(len(keys)))
        of = _weights(shingle, slots, n)
        prints = _fingerprints(shingle, of, bounds[:-1], np.diff(bounds))
        sets = [dict(zip(shingle[a:b].tolist(), of[a:b].tolist(), strict=True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lengths = {}
        for size in np.unique(n_words[n_words > 0]).tolist():
            items = np.flatnonzero(n_words == size)
            values = _block_values(prints[items])
            near = values[..., None] ^ _NEAR
            owner = np.broadcast_to(np.arange(len(items))[None, :, None], near.shape)
            order = np.argsort(near.ravel(), kind="stable")
            lengths[size] = (items, prints[items], near.ravel()[order], owner.ravel()[order])
        return Part(list(ids), sets, np.array([sum(s.values()) for s in sets]), known, slots, n, lengths)

    def matches(self, word: np.ndarray, first: np.ndarray, least: float, radius: int) -> list[tuple[int, int, int, int, float]]:
        """(document, item, first word, words, similarity) of each document's best window for each item it holds."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        n_words = np.diff(first)
        short = [s for s in self.lengths if s < K]
        for k in [K, *short]:
            count = np.maximum(n_words - k + 1, 0)
            place = ta.ragged(first[:-1], count)
            if not len(place):
                continue
            acc = np.zeros(len(place), np.uint64)
            for j in range(k):
                acc = acc * ta._CHAIN + word[place + j]
            for _ in range(k, K):  # as ta.shingles() does for a text under five words
                acc = acc * ta._CHAIN
            shingle = ta.mix(acc + np.uint64(k))
            row = self.known.lookup(shingle)
            hits = np.flatnonzero(row >= 0)
            if not len(hits):
                continue
            bounds = np.concatenate([[0], np.cumsum(count)])
            doc_of_hit = np.searchsorted(bounds, hits, "right") - 1
            longest = max(s for s in self.lengths if s >= K) if k == K and any(s >= K for s in self.lengths) else k
            if k == K and longest < K:
                continue
            span = longest - k + 1
            # Only shingles within a window's reach of a hit are looked at again; their runs stay together.
            near = np.zeros(len(shingle) + 1, np.int32)
            np.add.at(near, np.maximum(hits - span + 1, bounds[doc_of_hit]), 1)
            np.add.at(near, np.minimum(hits + span, bounds[doc_of_hit + 1]), -1)
            held = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            h, r = shingle[held], row[held]
            w = _weights(h, self.slots, self.n)
            doc = np.searchsorted(bounds, held, "right") - 1
            seen = np.concatenate([[0], np.cumsum(r >= 0)])
            inside, opens = np.unique(doc, return_index=True)  # a text shorter than the longest item is held whole
            sums = None
            for size in [s for s in self.lengths if (s >= K if k == K else s == k)]:
                need = size - k + 1
                begin = np.arange(max(len(held) - need + 1, 0))
                last = begin + need - 1
                whole = (held[last] - held[begin] == need - 1) & (doc[last] == doc[begin]) & (seen[last + 1] > seen[begin])
                begin = begin[whole]
                brief = n_words[inside] < size
                need = np.concatenate([np.full(len(begin), need), count[inside[brief]]])
                begin = np.concatenate([begin, opens[brief]])
                if not len(begin):
                    continue
                if sums is None:
                    signs = np.where(h[:, None] & _BIT[None, :], w[:, None], -w[:, None]).astype(np.float64)
                    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(signs, axis=0)])
                bits = sums[begin + need] - sums[begin] > 1e-9
                prints = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
                items, theirs, keys, owner = self.lengths[size]
                values = _block_values(prints)
                lo, hi = np.searchsorted(keys, values), np.searchsorted(keys, values, "right")
                win, own = _meetings(lo, hi, owner, len(items), prints, theirs, radius)
                for i, o in zip(win.tolist(), own.tolist(), strict=True):
                    item, at, n = int(items[o]), int(begin[i]), int(need[i])
                    mine = dict(zip(h[at : at + n].tolist(), w[at : at + n].tolist(), strict=True))
                    theirs_set = self.sets[item]
                    common = sum(v for s, v in mine.items() if s in theirs_set)
                    sim = common / (sum(mine.values()) + float(self.totals[item]) - common)
                    if sim >= least:
                        d = int(doc[at])
                        new = (-sim, int(place[held[at]] - first[d]), n + k - 1)
                        if new < best.get((d, item), (1.0, 0, 0)):
                            best[d, item] = new
        return [(d, self.item_ids[i], at, size, -sim) for (d, i), (sim, at, size) in sorted(best.items())]


def count_shingles(items: DataFrame) -> np.ndarray:
    """For each slot, in how many items (row, text) a shingle of it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                shingle, bounds = ta.shingles(*_words(piece.column("text")), K)
                slot = (shingle & np.uint64(SLOTS - 1)).astype(np.int64)
                pair = np.unique(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * SLOTS + slot)
                slot, count = np.unique(pair % SLOTS, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(count.astype(np.int64))], names=["slot", "n"])

    got = items.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots = np.zeros(SLOTS, np.uint32)
    slots[np.asarray(got["slot"])] = np.asarray(got["n"])
    return slots


def load_parts(items: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of the items in parts of at most part_bytes of text each (one item at least), one at a time."""
    ids, texts, room = [], [], part_bytes
    for r in items.orderBy("item", "text").toLocalIterator():
        if ids and room < len(r["text"]):
            yield ids, texts
            ids, texts, room = [], [], part_bytes
        ids.append(r["item"])
        texts.append(r["text"])
        room -= len(r["text"])
    if ids:
        yield ids, texts


MATCHES = "array<struct<item_id: bigint, first_word: int, words: int, similarity: double>>"


def find_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = SIMILARITY, radius: int = RADIUS, part_bytes: int = PART_BYTES) -> DataFrame:
    """df with contamination: the benchmark items that each text holds, with the best window's place and similarity."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "decontaminate")
    keep = [c for c in df.columns if c != "contamination"]
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item"), "text")
    n, slots = items.count(), spark.sparkContext.broadcast(count_shingles(items))
    found = df.select(*keep).withColumn("contamination", F.array().cast(MATCHES))
    before = None
    for k, part in enumerate(load_parts(items, part_bytes)):
        if before is not None:  # the last part's pass ends here, so that no task holds two parts
            found = scratch.save(found, f"pass-{k}")
            before.destroy()
        before = spark.sparkContext.broadcast(part)
        found = _search(found, before, slots, n, keep, text_col, least, radius)
    return found


def _search(df: DataFrame, part: Broadcast, slots: Broadcast, n: int, keep: list[str], text_col: str, least: float, radius: int) -> DataFrame:
    """df with the matches of one part added to its column contamination."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("words", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Part.build(*part.value, slots.value, n)
        for batch in batches:
            for piece in ta.pieces(batch, text_col, limit=1 << 20):
                word, first = _words(piece.column(text_col))
                found = piece.column("contamination").to_pylist()
                for d, item, at, size, sim in built.matches(word, first, least, radius):
                    found[d].append({"item_id": item, "first_word": at, "words": size, "similarity": sim})
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + [pa.array(found, kind)], names=[*keep, "contamination"])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in [*keep, "contamination"]]))


def contamination_report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text and benchmark item it holds: (id, item_id, first_word, words, similarity)."""
    found = find_contamination(df.select(id_col, text_col), benchmark, text_col)
    return found.select(id_col, F.explode("contamination").alias("m")).select(id_col, "m.item_id", "m.first_word", "m.words", "m.similarity")
