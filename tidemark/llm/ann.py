"""Nearest neighbours by cosine with randomly rotated one-bit codes in an inverted file.

A bounded sample gives the cells' centroids. Every vector is assigned to its nearest cell and its unit
residual there is rotated at random and kept as packed sign bits with two correction scalars: its
length and its inner product with its own code. A query visits the `probes` nearest cells, and further
ones until those it visits hold k vectors besides itself or no cell is left; packed bits
and scalars give an unbiased estimate of each inner product with an error bound, and only vectors whose
bound can still reach the query's best six are compared exactly, in double precision.

Equal vectors are collapsed before the search (the six smallest ids of each suffice for five
neighbours), so hot vectors cost no more than others. Large cells are dealt out in blocks by id hash,
and queries in blocks too, so no task holds an unbounded group.

Defined results: vectors that are null, zero, or hold null or non-finite components, or whose length
differs from the sample's, take no part; ties go to the smaller id; fewer candidates than k give fewer
rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import Scratch, ship

SAMPLE = 16384
MAX_CELLS = SAMPLE // 4
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
SLICE, CHUNK = 64, 1 << 15
SURE = 3.0  # standard deviations in the error bound


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # unit vectors, cells x dims
    rotation: np.ndarray
    probes: int

    @staticmethod
    def fit(vectors: np.ndarray, rows: int, k: int, recall: float) -> Index:
        """Spherical k-means on the sample, about sqrt(rows) / 4 cells, and the fewest probes that reach
        `recall` of the true k nearest for 256 vectors of the sample: few for clustered data, most cells
        where the data have no clusters."""
        rng = np.random.default_rng(13)
        cells = int(np.clip(np.sqrt(rows) / 4, 1, min(MAX_CELLS, len(vectors))))
        centroids = vectors[rng.permutation(len(vectors))[:cells]]
        for _ in range(8):
            own = (vectors @ centroids.T).argmax(1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, own, vectors)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids)
        rotation, _ = np.linalg.qr(rng.standard_normal((vectors.shape[1],) * 2))
        asked = vectors[rng.permutation(len(vectors))[:256]]
        near = np.argsort(-(asked @ vectors.T), axis=1)[:, 1 : k + 1]
        visit = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
        place = np.empty_like(visit)
        np.put_along_axis(place, visit, np.arange(cells)[None, :].repeat(len(visit), 0), 1)
        needed = np.take_along_axis(place, (vectors @ centroids.T).argmax(1)[near], 1)
        return Index(centroids, rotation, int(np.quantile(needed, recall, method="higher")) + 1 if needed.size else cells)

    def cell(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.centroids.T).argmax(1)

    def cells_of_queries(self, unit: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the `probes` nearest cells, and of the next ones as long as those before hold under `least` vectors."""
        near = np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")
        before = np.cumsum(sizes[near], axis=1) - sizes[near]
        query, place = np.nonzero((np.arange(near.shape[1]) < self.probes) | (before < least))
        return query, near[query, place]

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed sign bits, residual lengths, and inner products of the residual directions with their codes."""
        residual = unit - self.centroids[cell]
        length = np.linalg.norm(residual, axis=1)
        turned = (residual / np.maximum(length, 1e-12)[:, None]) @ self.rotation
        return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def search_block(index: Index, cell: int, codes: np.ndarray, length: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine) of the best `keep` candidates of one cell's block for each query.

    Queries go in slices and exact cosines in chunks, so memory does not follow the size of the groups.
    """
    dims = vectors.shape[1]
    bits = (np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1).T
    exactly = unit(vectors)
    inverse = 1 / np.maximum(own, 1e-6)
    spread = SURE * np.sqrt(np.maximum(1 - own**2, 0)) * inverse / np.sqrt(max(dims - 1, 1))
    gain, reach_of, square = ((2 * length * inverse / np.sqrt(dims)).astype(np.float32), (2 * length * spread).astype(np.float32), (length**2).astype(np.float32))
    k = min(keep, len(ids))
    parts = []
    for a in range(0, len(query_ids), SLICE):
        q = unit(queries[a : a + SLICE])
        diff = q - index.centroids[cell]
        far = np.linalg.norm(diff, axis=1).astype(np.float32)[:, None]
        turned = (diff @ index.rotation).astype(np.float32)  # |diff| times the unit direction
        middle = square - (turned @ bits) * gain
        slack = far * reach_of
        reach = np.partition(middle + slack, k - 1, axis=1)[:, k - 1 : k]
        may = middle - slack <= reach + 1e-5
        # Reranking: inner products of the vectors that any of these queries still needs, then exact ones of the best.
        some = np.flatnonzero(may.any(0))
        score = np.where(may[:, some], q @ exactly[some].T, -2.0)
        least = np.partition(score, len(some) - k, axis=1)[:, len(some) - k : len(some) - k + 1]
        row, col = np.nonzero(score >= np.maximum(least - 1e-9, -1.5))
        col = some[col]
        exact = np.concatenate([_cosines(vectors[col[i : i + CHUNK]], queries[a + row[i : i + CHUNK]]) for i in range(0, len(row), CHUNK)])
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < keep
        parts.append((query_ids[a + row[best]], ids[col[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _valid(column: str, dims: int | None = None) -> Column:
    e = F.col(column)
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return e.isNotNull() & (F.size(e) > 0) & fine & (F.lit(True) if dims is None else F.size(e) == dims)


def neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, recall: float = 0.98) -> DataFrame:
    """(query_id, rank int from 1, id, score double): the k nearest found for each row whose id is divisible by `every`.

    The index is fitted on at most SAMPLE vectors (least id hash first) and holds every row.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ann")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _valid("v"))
    sampled = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if not sampled:
        return empty
    lengths = [len(v) for v in sampled]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n))
    rows = rows.where(F.size("v") == dims)
    index = Index.fit(unit(np.array([v for v in sampled if len(v) == dims])), rows.count(), k, recall)

    # Equal vectors: their k + 1 smallest ids stand for all; Spark drops the others before the shuffle.
    key = F.xxhash64("v")
    first = Window.partitionBy("h", "v").orderBy("id")
    kept = rows.withColumn("h", key).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).select("id", "v")
    asked = rows.where(F.col("id") % every == 0).withColumn("h", key)
    asked = scratch.save(asked, "asked")
    distinct = asked.groupBy("h", "v").agg(F.min("id").alias("qid"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = unit(_matrix(batch.column("v")))
            cell = index.cell(v)
            code, length, own = index.encode(v, cell)
            cols = [batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(own)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "v", "cell", "code", "length", "own"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, cell = index.cells_of_queries(unit(_matrix(batch.column("v"))), sizes, k + 1)
            at = pa.array(query)
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(at), batch.column("v").take(at), pa.array(cell, pa.int32())], names=["qid", "v", "cell"])

    coded = scratch.save(kept.mapInArrow(assign, "id long, v array<double>, cell int, code binary, length double, own double"), "coded")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in coded.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    routed = scratch.save(distinct.select("qid", "v").mapInArrow(route, "qid long, v array<double>, cell int"), "routed")
    # At most MAX_CELLS rows either: how many blocks each cell's vectors and queries need.
    blocks = coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    parts = routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    plan = F.broadcast(scratch.save(blocks.join(parts, "cell"), "plan"))
    dealt = coded.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")
    sent = routed.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("qid"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts")

    def meet(cands: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(cands) or not len(asks):
            cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        else:
            cands, asks = cands.combine_chunks(), asks.combine_chunks()
            codes = np.frombuffer(b"".join(cands["code"].to_pylist()), np.uint8).reshape(len(cands), -1)
            get = lambda t, c: np.asarray(t[c])
            v, q = _matrix(cands["v"].combine_chunks()), _matrix(asks["v"].combine_chunks())
            cols = search_block(index, int(get(cands, "cell")[0]), codes, get(cands, "length"), get(cands, "own"), get(cands, "id"), v, get(asks, "qid"), q, k + 1)
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["qid", "id", "score"])

    by = ["cell", "block", "part"]
    found = dealt.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(meet, "qid long, id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    top = scratch.save(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1), "top")
    named = asked.select(F.col("id").alias("query_id"), "h", "v").join(distinct.select("h", "v", "qid"), ["h", "v"]).select("query_id", "qid")
    mine = top.join(named, "qid").where("id <> query_id")
    last = Window.partitionBy("query_id").orderBy("place")
    return mine.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
