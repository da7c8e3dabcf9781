"""Quality classifier: ordinal cumulative-link regression on hashed text features.

Grades (any integers) share one weight vector over hashed byte trigrams and word shapes; one ordered
threshold between each two neighbouring grades cuts the latent score: P(grade <= k) = sigmoid(threshold_k - score). The model gives the expected grade
and the tail probability P(grade >= wanted) by which documents are kept.

Fitting uses a bounded sample: at most SAMPLE_PER_GRADE labelled documents of each grade.

Defined results: a null or empty text has all features zero and is never kept (no content to grade);
equal texts get equal scores; whole texts are read; without labels everything has probability 1 and is
kept; further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textarrays as ta
from tidemark.llm.cluster import ship
from tidemark.llm.labelled import sample

SAMPLE_PER_GRADE = 2500
BLOCK_ROWS = 256
GRAM_BUCKETS = 1024
SHAPE_BUCKETS = 512
DIMS = GRAM_BUCKETS + SHAPE_BUCKETS

_UPPER = np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_KIND = np.full(256, 0, np.int64)  # of a word's last byte: letter, digit, sentence mark, other mark
_KIND[[*b"0123456789"]] = 1
_KIND[[*b".,;:?"]] = 2
_KIND[[*b"!\"#$%&'()*+-/<=>@[\\]^_`{|}~"]] = 3


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the hashed feature frequencies, one row per document."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, DIMS), np.float32)
    if len(data) >= 3:
        code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
        bucket = (code * np.uint32(2654435761)) >> np.uint32(22)
        inside = doc[:-2] == doc[2:]
        grams = np.bincount(doc[:-2][inside] * GRAM_BUCKETS + bucket[inside], minlength=n * GRAM_BUCKETS).reshape(n, -1)
        out[:, :GRAM_BUCKETS] = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1))
    start, end, first = ta.words(data, offsets)
    if len(start):
        owner = np.repeat(np.arange(n), np.diff(first))
        h = ta.slice_hashes(ta.prefix_hashes(data), start, end)
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        ups = upper[end] - upper[start]
        size = end - start
        shape = np.minimum(size, 15) // 2 * 4 + np.minimum(ups, 2) + (ups * 2 > size)
        shape = shape * 4 + _KIND[data[end - 1]]
        again = np.zeros(len(h), np.int64)
        again[1:] |= (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        bucket = (shape * 2 + again) % SHAPE_BUCKETS
        shapes = np.bincount(owner * SHAPE_BUCKETS + bucket, minlength=n * SHAPE_BUCKETS).reshape(n, -1)
        out[:, GRAM_BUCKETS:] = np.sqrt(shapes / np.maximum(shapes.sum(1, keepdims=True), 1))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray  # the grades met in training, ascending; they may have gaps and be negative

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1..K-1, one row per document."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, steps: int = 250) -> Model:
    """Accelerated gradient descent on the penalised negative log-likelihood, every grade weighing the same."""
    names, y = np.unique(y, return_inverse=True)
    n, grades = len(y), len(names)
    share = np.bincount(y, minlength=grades)
    weight = (n / (np.maximum(share, 1) * max((share > 0).sum(), 1)))[y] / n
    mean = x.mean(0)
    w, cut = np.zeros(x.shape[1]), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1)
    vw, vc = w.copy(), cut.copy()
    rate = 4.0
    # Centred and widened block by block: the driver never holds a second copy of x.
    blocks = [slice(i, i + BLOCK_ROWS) for i in range(0, n, BLOCK_ROWS)]
    for step in range(steps):
        momentum = step / (step + 3)
        pw, pc = w + momentum * vw, cut + momentum * vc
        z = np.concatenate([(x[b] - mean) @ pw for b in blocks])
        edges = np.concatenate([[-np.inf], pc, [np.inf]])
        up, low = (1 / (1 + np.exp(-np.clip(e - z, -40, 40))) for e in (edges[y + 1], edges[y]))
        p = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up), low * (1 - low)
        gz = weight * (du - dl) / p  # of the loss, by the score
        gw = sum((x[b] - mean).T @ gz[b] for b in blocks) + penalty * pw
        gc = np.zeros(grades - 1)
        np.add.at(gc, np.minimum(y, grades - 2), np.where(y < grades - 1, -weight * du / p, 0))
        np.add.at(gc, np.maximum(y - 1, 0), np.where(y > 0, weight * dl / p, 0))
        vw, vc = momentum * vw - rate * gw, momentum * vc - rate * gc
        w, cut = w + vw, np.sort(cut + vc)
    return Model(w.astype(np.float64), cut + float(mean @ w), names)


def matrix(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Grades and features (id, y, x binary) by id, copied once and straight into place."""
    order = np.argsort(np.asarray(got["id"], dtype=np.int64), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    x, done = np.empty((len(order), DIMS), np.float32), 0
    for chunk in got["x"].chunks:
        for row in chunk:
            x[place[done]] = np.frombuffer(row.as_buffer(), np.float32)
            done += 1
    return np.asarray(got["y"], dtype=np.int64)[order], x


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_grade: int = SAMPLE_PER_GRADE) -> Model | None:
    """Fit on the bounded sample; None without labelled documents of two grades. Features are made on the executors."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text", limit=1 << 20):
                rows = [r.tobytes() for r in features(*ta.flat(piece.column("text")))]
                yield pa.RecordBatch.from_arrays([piece.column("id").cast(pa.int64()), piece.column("y"), pa.array(rows, pa.binary())], names=["id", "y", "x"])

    y, x = matrix(sample(docs, labels, label, per_grade, id_col, text_col).mapInArrow(run, "id long, y int, x binary").toArrow())
    return fit(x, y) if len(np.unique(y)) > 1 else None


def grade(df: DataFrame, model: Model | None, text_col: str = "text", wanted: int = 1, least: float = 0.25) -> DataFrame:
    """df with expected_grade double, tail_probability double and quality_kept boolean (columns of those names are replaced)."""
    ship(df.sparkSession)
    new = ["expected_grade", "tail_probability", "quality_kept"]
    keep = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in new[:2]] + [T.StructField(new[2], T.BooleanType())])
    if model is None:
        return df.select(*keep).withColumns({"expected_grade": F.lit(1.0), "tail_probability": F.lit(1.0), "quality_kept": F.coalesce(F.length(text_col) > 0, F.lit(False))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, text_col, limit=1 << 20):
                data, offsets = ta.flat(piece.column(text_col))
                tails = model.tails(features(data, offsets))
                full = np.diff(offsets) > 0
                tails[~full] = 0
                # P(grade >= wanted): the first grade that is wanted; certain if even the least one is, 0 if none.
                at = int(np.searchsorted(model.grades, wanted))
                tail = full.astype(float) if at == 0 else tails[:, at - 1] if at < len(model.grades) else np.zeros(len(full))
                expected = np.where(full, model.grades[0] + tails @ np.diff(model.grades), model.grades[0])
                cols = [pa.array(expected.astype(np.float64)), pa.array(tail), pa.array((tail >= least) & full)]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + cols, names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)
