"""Removal of byte strings that occur more than once in a corpus, by bounded Burrows-Wheeler intervals.

1. Every 400-byte window is routed by its minimiser: the least hash among its 32-byte grams. Equal
   windows have equal minimisers, so consecutive windows with the same minimiser make one segment (its
   windows' bytes) and all copies of a window meet in the group of one minimiser. Groups with a single
   segment and copy cannot repeat and leave; groups of several equal segments repeat whole and are done.
2. Equal segments of the other groups are kept once with their number. Groups with many different segments (a
   passage in very many contexts) are split in halves of window offsets, keyed by the bytes all windows
   of the half must share, and equal halves are collapsed again; at one offset a group is one string.
3. Blocks of whole groups are sorted by their first 512 bytes (prefix doubling) and their Burrows-Wheeler
   transform is taken. Breadth-first backward extension of intervals then sets common-prefix values in
   increasing order and stops at the least length: borders left open part suffixes that share 400 bytes.
4. Repeated window starts go back to all documents that hold the segment; covered bytes are removed.

Defined results: a null or empty text has no bytes and loses none; texts shorter than the least length
lose nothing; repeated rows remove each other (every copy counts as another place); matches never cross
texts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textarrays as ta
from tidemark.llm.cluster import Scratch, ship, with_ids, without_ids

LENGTH = 400
GRAM = 32
HOT_SEGMENTS = 1500
BLOCK_BYTES = 1 << 20
#: Keys that may hold this share of all rows or more are at most its inverse, however large the input is.
HOT_SHARE = 1 / 1000
_POSITION = np.uint64((1 << 28) - 1)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by block-wise running minima from either side."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each segment: document, start in it, number of windows, offset of its minimiser, minimiser hash, content hash."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    prefix = ta.prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = ta.slice_hashes(prefix, at, at + gram)
    least = (_sliding_min((grams & ~_POSITION) | at.astype(np.uint64), length - gram + 1) & _POSITION).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    valid = ta.ragged(offsets[:-1], counts)
    if not len(valid):
        return segments(data[:0], offsets, length, gram)
    low = least[valid]
    head = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    start, size = valid[head], np.diff(np.append(head, len(valid)))
    doc = np.searchsorted(offsets, start, "right") - 1
    content = ta.slice_hashes(prefix, start, start + size - 1 + length)
    return doc, start - offsets[doc], size, low[head] - start, grams[low[head]], content


def _cut(df: DataFrame, length: int, gram: int) -> DataFrame:
    schema = "mh long, ch long, id long, start int, size int, anchor int"
    names = ["mh", "ch", "id", "start", "size", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                doc, start, size, anchor, mh, ch = segments(*ta.flat(piece.column("text")), length, gram)
                cols = [pa.array(mh.view(np.int64)), pa.array(ch.view(np.int64)), piece.column("id").take(pa.array(doc))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(x, pa.int32()) for x in (start, size, anchor)], names=names)

    return df.mapInArrow(run, schema)


def _fetch(df: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments (mh, ch, size, anchor, copies, at.id, at.start)."""
    schema = "mh long, ch long, size int, anchor int, copies long, body binary"
    lists = wanted.select(F.col("at.id").alias("id"), F.struct("mh", "ch", "size", "anchor", "copies", F.col("at.start").alias("start")).alias("w")).groupBy("id").agg(F.collect_list("w").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                data, offsets = ta.flat(piece.column("text"))
                lists = piece.column("w")
                flat = lists.flatten()
                count = np.diff(np.asarray(lists.offsets))
                cols = {c: flat.field(c) for c in ("mh", "ch", "size", "anchor", "copies", "start")}
                begin = np.repeat(offsets[:-1], count) + np.asarray(cols["start"])
                size = np.asarray(cols["size"]).astype(np.int64) + length - 1
                body = ta.strings(data[ta.ragged(begin, size)], np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([cols[c] for c in ("mh", "ch", "size", "anchor", "copies")] + [pa.array(body, pa.binary())], names=["mh", "ch", "size", "anchor", "copies", "body"])

    return df.join(lists.hint("shuffle_hash"), "id").select("text", "w").mapInArrow(run, schema)


def _after(at: np.ndarray, h: int, n: int) -> np.ndarray:
    """The positions h bytes further on, around the end."""
    to = at + np.int32(h)
    to[to >= n] -= n
    return to


def _sorted_suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotations of text sorted by their first 512 bytes, and which neighbours differ within 16 and 32 bytes.

    Values: order; eight-byte words at every position; true where a rotation differs from the one before
    it within 16 bytes, and within 32.
    """
    n = len(text)
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | np.roll(text, -j)
    order = np.argsort(words).astype(np.int32)
    in_order = words[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    rank = np.zeros(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    borders = {}
    h = 8
    while h < 512:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied).astype(np.int32)
        if len(slots):
            at = order[slots]
            key = rank[at].astype(np.int64) << 32 | rank[_after(at, h, n)]
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[slots] = at
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            new[slots] = fresh
            rank[at] = np.maximum.accumulate(np.where(fresh, slots, np.int32(0)))
        h *= 2
        if h <= 32:
            borders[h] = new.copy()
    return order, words, borders[16], borders[32]


def common_prefix_borders(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rotations of text, and true where a rotation shares less than `length` bytes with the one before.

    Starts from the intervals of all 32-byte strings and extends backwards, value by value.
    """
    n = len(text)
    order, words, border16, border = _sorted_suffixes(text)
    bwt = text[order - 1]
    lf = np.zeros(n, np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    known = np.append(border, True)
    # Intervals of 32-byte strings whose right border has the common-prefix value 31 exactly.
    exact = np.flatnonzero(border & ~border16)
    left, right = order[exact - 1], order[exact]
    last = words[_after(left, 24, n)] ^ words[_after(right, 24, n)]
    exact = exact[(words[_after(left, 16, n)] == words[_after(right, 16, n)]) & (last != 0) & (last < 256)]
    heads = np.flatnonzero(border)
    lb, rb = heads[np.searchsorted(heads, exact - 1, "right") - 1], exact
    for _ in range(32, length):
        if not len(lb):
            break
        # Intervals of different strings of one length are disjoint and ascend, so within a character the order stays.
        size = rb - lb
        at = ta.ragged(lb, size)
        by = np.argsort(bwt[at], kind="stable")
        at, parent = at[by], np.repeat(np.arange(len(lb)), size)[by]
        to, char = lf[at], bwt[at]
        new = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])])
        begin = np.flatnonzero(new)
        lb, rb = to[begin], to[np.append(begin[1:], len(to)) - 1] + 1
        open_ = ~known[rb]
        lb, rb = lb[open_], rb[open_]
        rb, keep = np.unique(rb, return_index=True)
        lb = lb[keep]
        known[rb] = True
    return order, known[:n]


def repeated_starts(bodies: list[bytes], copies: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(segment, first start, end of starts) of the runs of window starts whose window occurs elsewhere."""
    size = np.array([len(b) for b in bodies], np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    text = np.concatenate([np.frombuffer(b"".join(bodies), np.uint8), np.zeros(512, np.uint8)])
    count = np.maximum(size - length + 1, 0)
    weight = np.zeros(len(text), np.int64)
    weight[ta.ragged(base[:-1], count)] = np.repeat(copies, count)
    order, border = common_prefix_borders(text, length)
    head = np.flatnonzero(border)
    total = np.add.reduceat(weight[order], head)
    hit = np.zeros(len(text), bool)
    hit[order] = np.repeat(total > 1, np.diff(np.append(head, len(text))))
    hit &= weight > 0
    start, end = ta.runs(hit[: base[-1]], base[:-1]) if len(bodies) else (base[:0], base[:0])
    seg = np.searchsorted(base, start, "right") - 1
    return list(zip(seg.tolist(), (start - base[seg]).tolist(), (end - base[seg]).tolist(), strict=True))


def _matches(rows: DataFrame, other: DataFrame, key: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of rows with other on key; rows of the hot keys (a bounded number) stay where they are.

    Only the other side's rows of hot keys are broadcast, so no task gathers a hot key.
    """
    hot = F.broadcast(hot)
    few = F.broadcast(other.join(hot, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(hot, key, "left_anti").join(other.join(hot, key, "left_anti"), key))


def _repeats(segs: DataFrame, length: int, tasks: int) -> DataFrame:
    """(mh, ch, s, e): runs of repeated window starts of the segments; groups stay whole within a task."""
    schema = "mh long, ch long, s int, e int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        bytes_held = 0

        def solve() -> pa.RecordBatch:
            found = repeated_starts([h[3] for h in held], np.array([h[2] for h in held], np.int64), length)
            cols = [[held[i][0] for i, _, _ in found], [held[i][1] for i, _, _ in found], [s for _, s, _ in found], [e for _, _, e in found]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["mh", "ch", "s", "e"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("mh", "ch", "copies", "body")), strict=True):
                if bytes_held > BLOCK_BYTES and row[0] != held[-1][0]:
                    yield solve()
                    held, bytes_held = [], 0
                held.append(row)
                bytes_held += len(row[3])
        if held:
            yield solve()

    # Dealt by a hash of mh: Spark drops a repartition by the key of a join below, and the adaptive plan may then read
    # that join's shuffle by its mappers, which takes groups apart.
    return segs.select("mh", "ch", "copies", "body").repartition(tasks, F.xxhash64("mh")).sortWithinPartitions("mh").mapInArrow(run, schema)


def _halves(hot: DataFrame, length: int) -> DataFrame:
    """Both halves of the hot groups' window offsets: parent (pm, pc), shift, and the new segment with its key."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    part = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi"))))
    cut = hot.select("*", part.alias("part")).select("mh", "ch", "size", "anchor", "copies", "body", "part.lo", "part.hi")
    # Window j stands `anchor - j` bytes before the minimiser; this row has offsets anchor - size + 1 to anchor.
    most, least = F.least("hi", "anchor"), F.greatest(F.col("lo"), F.col("anchor") - F.col("size") + 1)
    cut = cut.withColumns({"most": most, "least": least}).where("most >= least").withColumn("shift", F.col("anchor") - F.col("most"))
    body = F.substring(F.col("body"), F.col("shift") + 1, F.col("most") - F.col("least") + length)
    core = F.substring(F.col("body"), F.col("anchor") - F.col("lo") + 1, F.lit(length) - F.col("hi") + F.col("lo"))
    return cut.select(
        F.col("mh").alias("pm"), F.col("ch").alias("pc"), "shift", "copies", "lo", "hi",
        F.xxhash64("mh", "lo", "hi", core).alias("mh"), body.alias("body"),
        (F.col("most") - F.col("least") + 1).alias("size"), F.col("most").alias("anchor"),
    ).withColumn("ch", F.xxhash64("body", "anchor"))


def repeated_spans(df: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, begin, end): byte spans of df (id, text) covered by strings of `length` bytes that start elsewhere too.

    Spans of one text may touch or overlap.
    """
    spark = df.sparkSession
    places = scratch.save(_cut(df, length, gram), "places")
    hot_rows = max(int(places.count() * HOT_SHARE), 1)
    equal = reduce(Column.__and__, (F.min(c) == F.max(c) for c in ("ch", "size", "anchor")))
    often = scratch.save(places.groupBy("mh").agg(F.count("*").alias("all"), equal.alias("equal")).where("all > 1"), "often")
    shared = scratch.save(_matches(places, often.select("mh", "equal"), ["mh"], often.where(F.col("all") > hot_rows).select("mh")), "shared")
    scratch.drop("places", "often")
    whole = shared.where("equal").select("id", F.col("start").alias("begin"), (F.col("start") + F.col("size") + (length - 1)).alias("end"))
    places = shared.where("not equal").drop("equal")
    wanted = scratch.save(places.groupBy("mh", "ch", "size", "anchor").agg(F.count("*").alias("copies"), F.min(F.struct("id", "start")).alias("at")), "wanted")
    segs = scratch.save(_fetch(df, wanted, length).withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)}), "segments-0")
    levels, level = [], 0
    while True:
        hot = scratch.save(segs.groupBy("mh").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT_SEGMENTS).select("mh"), f"hot-{level}")
        sums = segs.agg(F.sum(F.length("body")).alias("b")).first()
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sums["b"] or 0) // (16 * BLOCK_BYTES) + 1)
        some_hot = bool(hot.head(1))
        calm = without_ids(segs, hot, "mh") if some_hot else segs
        found = scratch.save(_repeats(calm, length, tasks), f"found-{level}")
        levels.append((found, None))
        if not some_hot:
            break
        level += 1
        halves = scratch.save(_halves(with_ids(segs, hot, "mh"), length), f"halves-{level}")
        levels[-1] = (found, halves.select("pm", "pc", "shift", "mh", "ch"))
        kept = halves.groupBy("mh", "ch", "lo", "hi", "size", "anchor").agg(F.sum("copies").alias("copies"), F.first("body").alias("body"))
        alone = kept.groupBy("mh").agg(F.sum("copies").alias("all")).where("all > 1").select("mh")
        segs = scratch.save(kept.join(alone, "mh", "left_semi"), f"segments-{level}")
    result = levels[-1][0]
    for found, halves in levels[-2::-1]:
        up = result.join(halves, ["mh", "ch"]).select(F.col("pm").alias("mh"), F.col("pc").alias("ch"), (F.col("s") + F.col("shift")).alias("s"), (F.col("e") + F.col("shift")).alias("e"))
        result = found.unionByName(up)
    # A segment's runs are disjoint, fewer than its windows (at most length - gram + 1), so hot ones are few too.
    hot = wanted.groupBy("mh", "ch").agg(F.sum("copies").alias("all")).where(F.col("all") > hot_rows).select("mh", "ch")
    parts = _matches(places, result.distinct(), ["mh", "ch"], hot).select("id", (F.col("start") + F.col("s")).alias("begin"), (F.col("start") + F.col("e") + (length - 1)).alias("end"))
    return whole.unionByName(parts)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digests: bool = False) -> DataFrame:
    """One row per row of df: id, n_bytes, n_removed, n_spans (maximal runs), and kept: the remaining bytes.

    With digests, kept_sha256 stands in place of kept.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "substring-dedup")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, scratch, length).distinct().groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    last = ("kept_sha256", T.StringType(), pa.string()) if digests else ("kept", T.BinaryType(), pa.binary())
    schema = T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField(last[0], last[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                data, offsets = ta.flat(piece.column("text"))
                lists = piece.column("spans")
                flat = lists.flatten()
                count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                base = np.repeat(offsets[:-1], count)
                step = np.zeros(len(data) + 1, np.int32)
                if len(flat):
                    np.add.at(step, base + np.asarray(flat.field("begin")), 1)
                    np.add.at(step, base + np.asarray(flat.field("end")), -1)
                gone = np.cumsum(step[:-1]) > 0
                start, _ = ta.runs(gone, offsets)
                left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                kept = ta.strings(data[~gone], left)
                if digests:
                    kept = [hashlib.sha256(x).hexdigest() for x in kept]
                n = np.diff(offsets)
                cols = [piece.column("id"), *(pa.array(x, pa.int64()) for x in (n, n - np.diff(left), np.diff(np.searchsorted(start, offsets)))), pa.array(kept, last[2])]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.join(spans.hint("shuffle_hash"), "id", "left").mapInArrow(run, schema)
