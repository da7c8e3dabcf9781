"""MinHash near-duplicate linking with tensored banding and exact verification.

Two collections of M small groups of T minhashes each are computed; a table key combines one group of
either collection, so M x M tables of 2T rows cost 2MT minhashes instead of 2T x M x M. Equal shingle
sets are collapsed to one class first. Within a bucket no pairs are listed: members are compared with
its pivot (star edges), verified on full shingle sets, and merged. Classes whose buckets are still split
into several components then go through an exact prefix filter: the rarest shingles of their sets are
the new buckets, again first as stars, then pair by pair between components that are still apart, where
sizes, places and parity bits leave the pair possible. So
every pair that shares a table is compared, already joined, or ruled out exactly.

Defined results: words are split at ASCII white space after lower-casing A-Z; a null, empty or
white-space text has an empty set and is linked with nothing; fewer than five words make one shingle;
repeated rows link by equality; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textarrays as ta
from tidemark.llm.cluster import Scratch, ship, with_ids
from tidemark.llm.components import components

M, ROWS = 8, 3
PERCENT = 85
BITS = 1024
#: Edges of one pivot that one key of a join holds at most, about.
SPREAD = 256
_A = [f"a{i}" for i in range(M)]
_B = [f"b{i}" for i in range(M)]
_seeds = np.random.default_rng(7919).integers(1, 1 << 63, (2 * M * ROWS, 2), dtype=np.int64).astype(np.uint64)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (54-bit hashes) of each text, and their bounds."""
    data, offsets = ta.flat(column)
    data = ta.LOWER[data]
    start, end, first = ta.words(data, offsets)
    word = ta.slice_hashes(ta.prefix_hashes(data), start, end)
    return ta.distinct_per_document(*ta.shingles(word, first, k))


def _signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit sums that name the set, and the 2M group hashes (one row per group)."""
    spread = ta.mix(values + np.uint64(0x1234567))
    names = [ta.per_document(np.add, x, bounds, np.uint64(0)) for x in (spread, ta.mix(spread + np.uint64(99)))]
    groups = np.zeros((2 * M, len(bounds) - 1), np.uint64)
    for g in range(2 * M):
        for a, b in _seeds[g * ROWS : (g + 1) * ROWS]:
            low = ta.per_document(np.minimum, (spread * (a | np.uint64(1)) + b) >> np.uint64(8), bounds, np.uint64(0))
            groups[g] = ta.mix(groups[g] + low)
    return names[0], names[1], groups


def _sign(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "n", "s1", "s2", *_A, *_B)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, text_col, limit=1 << 20):
                values, bounds = shingle_sets(piece.column(text_col), k)
                s1, s2, groups = _signatures(values, bounds)
                cols = [piece.column("id"), pa.array(np.diff(bounds), pa.int64())]
                cols += [pa.array(x.view(np.int64)) for x in (s1, s2, *groups)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, schema)


def _parities(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set BITS bits: the parity of the number of shingles that hash to each."""
    n = len(bounds) - 1
    slot = np.repeat(np.arange(n), np.diff(bounds)) * BITS + (ta.mix(values) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(slot, minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _sets(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """(id, shingles, bits): the full set, and its parities as longs."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", longs), T.StructField("bits", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, text_col, limit=1 << 20):
                values, bounds = shingle_sets(piece.column(text_col), k)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                ends = np.arange(len(bounds)) * (BITS // 64)
                bits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_parities(values, bounds)))
                yield pa.RecordBatch.from_arrays([piece.column("id"), lists, bits], names=schema.names)

    return df.mapInArrow(run, schema)


def _similar(percent: int) -> Column:
    inter = F.size(F.array_intersect("x", "y")).cast("long")
    return inter * 100 >= (F.size("x") + F.size("y") - inter) * percent


def _parities_allow(percent: int) -> Column:
    """Sets of n and m shingles differ in at least as many shingles as parity bits (bits, mbits)."""
    differ = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("mbits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return differ * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)


def _beside(edges: DataFrame, rows: DataFrame, node: str, other: str, stored: DataFrame) -> DataFrame:
    """edges (u, v, fan) with the columns of rows, which has one row per `node`; stored holds these edges as a table.

    A node's row is copied fan times and its edges are dealt over the copies, so one node's edges never
    land in one task. The copies are counted on the table: a plan that made the edges would be in the plan twice.
    """
    copies = rows.join(stored.groupBy(node).agg(F.max("fan").alias("copies")), node)
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.col("fan")).cast("int")).join(copies, [node, "salt"]).drop("salt")


def _verified(edges: DataFrame, sets: DataFrame, percent: int, stars: bool, scratch: Scratch, name: str) -> DataFrame:
    """The edges (u, v, fan) whose full sets are similar enough, as (u, v). In stars only u can have many edges.

    Sizes and parity bits rule out most false candidates exactly; only the rest carry full sets through
    a shuffle. Either kind is stored, since the joins read it several times.
    """
    edges = scratch.save(edges.select("u", "v", "fan"), f"{name}-met")
    mine = sets.select(F.col("id").alias("u"), F.size("shingles").alias("n"), "bits")
    hers = sets.select(F.col("id").alias("v"), F.size("shingles").alias("m"), F.col("bits").alias("mbits"))
    join_v = (lambda e, rows, stored: e.join(rows, "v")) if stars else (lambda e, rows, stored: _beside(e, rows, "v", "u", stored))
    close = join_v(_beside(edges, mine, "u", "v", edges), hers, edges).where(_fits(percent) & _parities_allow(percent))
    close = scratch.save(close.select("u", "v", "fan"), f"{name}-close")
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("y"))
    return join_v(_beside(close, left, "u", "v", close), right, close).where(_similar(percent)).select("u", "v")


def _fits(percent: int) -> Column:
    """Sizes n and m do not rule out the similarity."""
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def _stars(groups: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v, fan) between each bucket's pivot and its members (key, rep, n, c) of other components, if the sizes allow a link.

    buckets: (key, pivot struct<rep, n, c>, members). fan is the number of parts in which a pivot's edges are dealt.
    """
    met = groups.join(buckets, "key").where((F.col("c") != F.col("pivot.c")) & _fits_pivot(percent))
    return met.groupBy(F.col("pivot.rep").alias("u"), F.col("rep").alias("v")).agg(F.max(_fan("members")).alias("fan"))


def _fits_pivot(percent: int) -> Column:
    return F.least("n", "pivot.n") * 100 >= F.greatest("n", "pivot.n") * percent


def _fan(members: str) -> Column:
    return F.ceil(F.col(members) / SPREAD).cast("int")


def _place(rows: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the component of `node`, itself where it has no link."""
    known = comp.select(F.col("node").alias(node), F.col("component").alias("found"))
    return rows.join(known, node, "left").withColumn(name, F.coalesce("found", node)).drop("found")


def _joined(comp: DataFrame) -> DataFrame:
    """The components as edges (u, v): they stand for all links that made them."""
    return comp.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _prefix_groups(sets: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n, at): the shingles in each set's prefix, rarest first among these sets.

    Two sets of the wanted similarity share a shingle within their first n - ceil(percent * n / 100) + 1
    in any common order. With rare ones first, passages that many texts share stay out of the prefix.
    """
    each = sets.select(F.col("id").alias("rep"), F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(often, "key")
    by = Window.partitionBy("rep")
    ranked = shared.withColumn("alone", F.col("n") - F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy("df", "key")))
    at = F.col("alone") + F.col("place")
    return ranked.withColumn("at", at).where(at <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("key", "rep", "n", "at")


def _apart(groups: DataFrame) -> DataFrame:
    """(key, pivot struct<rep, n, c>, members) of the keys whose members lie in several components c."""
    per = groups.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n", "c")).alias("pivot"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return per.where("lo < hi").select("key", "pivot", "members")


def _may_link(percent: int) -> Column:
    """Exact bounds for two sets (n, at, bits) and (m, mat, mbits) that share the key at these places.

    Sizes; the places, if this is their first common shingle; and the parities, which differ in at most
    as many bits as the sets have shingles of their own.
    """
    places = (1 + F.least(F.col("n") - F.col("at"), F.col("m") - F.col("mat"))) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    return _fits(percent) & places & _parities_allow(percent)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = 5) -> DataFrame:
    """(id_col, n_shingles long, component_id long, kept boolean), one row per row of df.

    Links are pairs with 100 * |intersection| >= percent * |union| of distinct k-word shingles. For a
    pair of similarity s one of the tables holds both with probability (1 - (1 - s^3)^8)^2: 0.999 at
    0.85 and 0.9999 at 0.9.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near-dedup")
    signed = scratch.save(_sign(df, id_col, text_col, k), "signed")
    classes = scratch.save(signed.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.count("*").alias("copies"), *(F.min(c).alias(c) for c in (*_A, *_B))), "classes")
    tables = F.array(*(F.xxhash64(F.lit(i * M + j), F.col(a), F.col(b)) for i, a in enumerate(_A) for j, b in enumerate(_B)))
    keys = classes.select("rep", F.explode(tables).alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("pivot")).where("members > 1")
    # Which pivots a class meets in its buckets; the buckets themselves are not kept.
    met = scratch.save(keys.join(buckets, "key").groupBy("rep", "pivot").agg(F.max(_fan("members")).alias("fan")), "met")
    stars = met.where("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v"), "fan")
    # Full sets are the bulk of what is moved: they are laid out by id once.
    texts = df.select(F.col(id_col).cast("long").alias("id"), text_col)
    sets = scratch.save_bucketed(_sets(with_ids(texts, met.select(F.col("rep").alias("id")).distinct(), "id"), text_col, k), "sets", "id")
    comp = scratch.save(components(_verified(stars, sets, percent, True, scratch, "stars"), scratch, "cc-0"), "comp-0")

    # Classes in buckets that are still split go on with an exact prefix filter. Every pivot meets itself.
    placed = _place(met, comp, "rep", "c")
    split = placed.groupBy("pivot").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("pivot")
    open_ = scratch.save(met.join(split, "pivot", "left_semi").select("rep").distinct(), "open")
    groups = _prefix_groups(sets.join(open_, F.col("id") == F.col("rep"), "left_semi"), percent)
    groups = scratch.save(_place(groups, comp, "rep", "c"), "groups")
    starred = _stars(groups, _apart(groups), percent)
    comp = scratch.save(components(_joined(comp).unionByName(_verified(starred, sets, percent, True, scratch, "starred")), scratch, "cc-1"), "comp-1")
    left = _place(groups.drop("c"), comp, "rep", "c")
    apart = _apart(left).select("key", _fan("members").alias("fan"))
    left = scratch.save(left.join(apart, "key").join(sets.select(F.col("id").alias("rep"), "bits"), "rep"), "apart")
    right = left.select("key", F.col("rep").alias("pivot"), F.col("n").alias("m"), F.col("at").alias("mat"), F.col("bits").alias("mbits"), F.col("c").alias("d"))
    pairs = left.join(right, "key").where((F.col("rep") > F.col("pivot")) & (F.col("c") != F.col("d")) & _may_link(percent))
    pairs = pairs.groupBy(F.col("pivot").alias("u"), F.col("rep").alias("v")).agg(F.max("fan").alias("fan"))
    comp = scratch.save(components(_joined(comp).unionByName(_verified(pairs, sets, percent, False, scratch, "pairs")), scratch, "cc-2"), "comp-2")

    # A class's component is named by its least document; only classes with copies or links need the join back.
    named = classes.select("s1", "s2", "rep", "copies").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = scratch.save(named.where("copies > 1 or component is not null").select("s1", "s2", F.coalesce("component", "rep").alias("component")), "named")
    scratch.keep("signed", "named")
    out = signed.select("id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
