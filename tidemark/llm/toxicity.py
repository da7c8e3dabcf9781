"""Toxic passages: maximum-scoring segments over token log-odds with extreme-value calibration.

Token scores are log-odds of toxic against clean text under an informative Dirichlet prior (the pooled
counts, scaled), taken for whole words and for their prefixes. A word's evidence is the largest of its
features' log-odds that are significant by z-score; without one it keeps its own log-odds where these
speak for clean text, and 0 where they are unknown or not significant. COST is taken off every word, so
that passages stay local. One linear scan finds all maximal scoring segments. A segment's score becomes
a surprise, lambda * S - log(K * n), by the extreme-value law of maximal segments: lambda solves
E[exp(lambda * score)] = 1 over the words of the clean sample, and K has its greatest likelihood given
the clean texts' largest segments. The surprises of the significant segments are aggregated per document
and mapped to a probability by a logistic curve fitted on the training sample.

Fitting uses a bounded sample: at most SAMPLE_PER_CLASS labelled documents of either class.

Defined results: a null or empty text has no passage and the score of one without evidence; equal texts
get equal scores; whole texts are read; without both classes all scores are 0; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textarrays as ta
from tidemark.llm.cluster import ship
from tidemark.llm.labelled import held_out, sample
from tidemark.llm.tables import HashTable

SAMPLE_PER_CLASS = 8000
PREFIXES = (4, 5, 6)
PRIOR_SHARE = 0.1  # of the pooled counts
MIN_Z = 2.5
MIN_DOCS = 4
COST = 0.4

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = False
SEPARATORS[0x80:] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of every word (the word, then its prefixes; 0 where the word is shorter), starts, ends, first words."""
    data = ta.LOWER[data]
    start, end, first = ta.words(data, offsets, SEPARATORS)
    prefix = ta.prefix_hashes(data)
    rows = [ta.slice_hashes(prefix, start, end)]
    for k in PREFIXES:
        h = ta.slice_hashes(prefix, start, np.minimum(start + k, end)) ^ np.uint64(k)
        rows.append(np.where(end - start > k, h, np.uint64(0)))
    return np.stack(rows), start, end, first


@dataclass(frozen=True)
class Lexicon:
    """Features with their log-odds (significant ones for toxic text, all for clean text) and the constants of the calibration."""

    keys: np.ndarray
    scores: np.ndarray
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    offset: float = 0.0

    def table(self) -> HashTable:
        t = HashTable(max(len(self.keys), 1))
        t.insert(self.keys, np.arange(len(self.keys)))
        return t

    def token_scores(self, table: HashTable, rows: np.ndarray) -> np.ndarray:
        """Each word's evidence less COST; rows holds the features of the words, whole words first."""
        best = np.zeros(rows.shape[1])
        for i, r in enumerate(rows):
            at = table.lookup(r)
            own = np.where((at >= 0) & (r != 0), self.scores[at] if len(self.scores) else 0.0, 0.0)
            best = own if i == 0 else np.where(own > 0, np.maximum(best, own), best)
        return best - COST


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in one pass over its positive scores."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    stack: list[tuple[float, float, int, int]] = []  # total before and after, first, last
    for left, right, p in zip(sums[at].tolist(), sums[at + 1].tolist(), at.tolist(), strict=True):
        seg = (left, right, p, p)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= seg[0]:
                j -= 1
            if j < 0 or stack[j][1] >= seg[1]:
                stack.append(seg)
                break
            seg = (stack[j][0], seg[1], stack[j][2], seg[3])
            del stack[j:]
    return [(a, b, right - left) for left, right, a, b in stack]


def _passages(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, table: HashTable) -> list[tuple[float, list[tuple[int, int, float]]]]:
    """Per document: evidence, and significant passages (byte begin, byte end, surprise)."""
    rows, start, end, first = tokens(data, offsets)
    score = lexicon.token_scores(table, rows)
    odd = np.concatenate([[0], np.cumsum(score > 0)])[first]
    out = []
    for d in range(len(offsets) - 1):
        found, evidence, n = [], 0.0, max(int(first[d + 1] - first[d]), 1)
        if odd[d + 1] > odd[d]:
            for a, b, s in maximal_segments(score[first[d] : first[d + 1]]):
                surprise = lexicon.lam * s - float(np.log(lexicon.k * n))
                if surprise > 0:
                    evidence += surprise
                    found.append((int(start[first[d] + a] - offsets[d]), int(end[first[d] + b] - offsets[d]), surprise))
        out.append((evidence, found))
    return out


def _counts(df: DataFrame) -> DataFrame:
    """(feature, pos, neg): in how many texts of either class a feature stands; the totals have feature 0.

    A text counts once for a feature, so that a word repeated as filler has no more weight than another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                rows, _, _, first = tokens(*ta.flat(piece.column("text")))
                doc = np.tile(np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first)), len(rows))
                h = rows.ravel()
                h, doc = h[h != 0], doc[h != 0]
                u, inv = np.unique(h, return_inverse=True)
                pair = np.unique(inv.astype(np.uint64) << np.uint64(20) | doc)
                toxic = np.asarray(piece.column("y"))[(pair & np.uint64((1 << 20) - 1)).astype(np.int64)] > 0
                word = (pair >> np.uint64(20)).astype(np.int64)
                pos, total = np.bincount(word, weights=toxic, minlength=len(u)), np.bincount(word, minlength=len(u))
                u, pos, total = np.append(u, np.uint64(0)), np.append(pos, toxic.sum()), np.append(total, len(pair))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in (pos, total - pos))], names=["feature", "pos", "neg"])

    return df.mapInArrow(run, "feature long, pos long, neg long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("pos", "neg")))


def _tail_law(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum(weights * exp(lambda * scores)) = 1, for a negative mean and some positive scores."""
    if not (scores > 0).any() or (weights[scores > 0].sum() == 0):
        return 1.0
    low, high = 1e-6, 1.0
    moment = lambda x: float((weights * np.exp(np.clip(x * scores, -60, 60))).sum())
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 1 else (low, mid)
    return min(max(high, 0.05), 8.0)


def extreme_values(lexicon: Lexicon, clean: DataFrame) -> Lexicon:
    """lexicon with lambda and K of the clean texts: exact words' scores, and P(S >= x) = 1 - exp(-K n exp(-lambda x))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lexicon.table()
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                rows, _, _, first = tokens(*ta.flat(piece.column("text")))
                score = lexicon.token_scores(table, rows)
                best = [max((s for _, _, s in maximal_segments(score[a:b])), default=0.0) for a, b in zip(first[:-1], first[1:], strict=True)]
                value, count = np.unique(np.round(score, 2), return_counts=True)
                cols = [np.concatenate(x) for x in ((np.zeros(len(value), np.int32), np.ones(len(best), np.int32)), (value, np.array(best, np.float64)), (count, np.diff(first)))]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int64))], names=["kind", "x", "n"])

    found = clean.select("text").mapInArrow(run, "kind int, x double, n long").groupBy("kind", "x").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    got = found.toArrow().sort_by([("kind", "ascending"), ("x", "ascending")])
    kind, x, n = (np.asarray(got[c]) for c in ("kind", "x", "n"))
    words, texts = kind == 0, kind == 1
    lam = _tail_law(x[words], n[words] / max(n[words].sum(), 1))
    mass = float((n[texts] * np.exp(-lam * x[texts])).sum())
    count = float(np.asarray(got["rows"])[texts].sum())
    return replace(lexicon, lam=lam, k=min(max(count / mass, 1e-9), 1.0) if mass else 0.1)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Lexicon | None:
    """Fit lexicon and calibration on a bounded sample of the given labels; None without both classes."""
    ship(docs.sparkSession)
    chosen = sample(docs, labels, label, per_class, id_col, text_col)
    counts = _counts(chosen.select("text", "y")).persist()
    totals = counts.where("feature = 0").first()
    if totals is None or not totals["pos"] or not totals["neg"]:
        counts.unpersist()
        return None
    n1, n0 = float(totals["pos"]), float(totals["neg"])
    prior = (F.col("pos") + F.col("neg")) * PRIOR_SHARE
    y1, y0 = F.col("pos") + prior, F.col("neg") + prior
    mass = (n1 + n0) * PRIOR_SHARE
    delta = F.log(y1 / (n1 + mass - y1)) - F.log(y0 / (n0 + mass - y0))
    scored = counts.where((F.col("feature") != 0) & (F.col("pos") + F.col("neg") >= MIN_DOCS)).withColumns({"score": delta, "z": delta / F.sqrt(1 / y1 + 1 / y0)})
    # The features of a bounded sample are bounded by its size.
    got = scored.where((F.col("z") >= MIN_Z) | (F.col("score") < 0)).select("feature", "score").toArrow().sort_by("feature")
    counts.unpersist()
    keys, scores = np.asarray(got["feature"]).view(np.uint64), np.asarray(got["score"], dtype=np.float64)
    lexicon = extreme_values(Lexicon(keys, scores), chosen.where("y <= 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lexicon.table()
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                got = _passages(*ta.flat(piece.column("text")), lexicon, table)
                yield pa.RecordBatch.from_arrays([piece.column("y"), pa.array([e for e, _ in got], pa.float64())], names=["y", "x"])

    pairs = chosen.select("text", "y").mapInArrow(run, "y int, x double").toArrow()
    y, x = np.asarray(pairs["y"]) > 0, np.log1p(np.asarray(pairs["x"]))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps of a one-variable logistic regression with a small penalty
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-9
        g = np.array([((q - y) * x).sum() + 1e-2 * a, (q - y).sum() + 1e-2 * b])
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, g), -1, 1)
    return replace(lexicon, slope=float(a), offset=float(b))


def find_toxic(df: DataFrame, lexicon: Lexicon | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double 0 to 1, predicted int, passages array<struct<begin, end, surprise>>) in bytes of the text."""
    ship(df.sparkSession)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))
    schema = "array<struct<begin: int, end: int, surprise: double>>"
    if lexicon is None:
        return df.select(id_col, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(schema).alias("passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lexicon.table()
        for batch in batches:
            for piece in ta.pieces(batch, text_col):
                got = _passages(*ta.flat(piece.column(text_col)), lexicon, table)
                x = np.log1p(np.array([e for e, _ in got], np.float64))
                score = 1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.offset, -30, 30)))
                spans = pa.array([[{"begin": a, "end": b, "surprise": s} for a, b, s in f] for _, f in got], kind)
                yield pa.RecordBatch.from_arrays([piece.column(id_col), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), spans], names=[id_col, "score", "predicted", "passages"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double, predicted int, passages {schema}")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Train on the labels outside the held-out fold (crc32 modulo 5 is 0), then score every document."""
    lexicon = train(docs, labels.where(~held_out(id_col, 5, 0)), id_col=id_col)
    found = find_toxic(docs, lexicon, id_col)
    return found.select(id_col, held_out(id_col, 5, 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
