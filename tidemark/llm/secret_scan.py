"""Secret scanning: fixed patterns plus a token-efficiency test on long unbroken strings.

A random string costs many tokens under a byte-level BPE vocabulary: few characters per token. Runs of
MIN_RUN key-like characters or more that hold a letter are encoded and reported (kind `random`) when
their characters per token stay within what random strings reach; that threshold is found by simulation
under the vocabulary in use. Known identifiers are excluded: UUIDs, digests of the standard lengths
(alone or behind a digest's name), and names, paths and versions, whose parts between separators are
words, numbers or words with a number. Their letters must encode as words: each segment of LONG_SEGMENT
letters or more passes the threshold, and the shorter ones do together or are single tokens.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; equal
texts give equal rows; texts of any length are scanned whole; further columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textarrays as ta
from tidemark.llm.bpe import Vocabulary, read_ranks, vocabulary
from tidemark.llm.cluster import ship

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|sha(1|224|256|384|512)[-=][A-Za-z0-9+/=]+|md5[-=][A-Za-z0-9+/=]+")
PART = re.compile(r"[A-Za-z]*[0-9]{0,4}[A-Za-z]{0,2}|[0-9]{1,8}")
BREAK, LETTERS = re.compile(r"[_/=+-]+"), re.compile(r"[A-Za-z]+")
MIN_RUN = 16
LONG_SEGMENT = 8
#: Share of random strings of MIN_RUN letters and digits, or letters alone, that the threshold lets through.
LET_THROUGH = 0.001

_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, leftmost and non-overlapping within each kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 16]


def calibrated_ratio(vocab: Vocabulary, length: int = MIN_RUN, strings: int = 4000) -> float:
    """The most characters per token that random strings of this length reach but for LET_THROUGH of them, by simulation."""
    if (known := getattr(vocab, "random_ratio", None)) is not None:
        return known
    rng = np.random.default_rng(17)
    letters = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    ratios = []
    for size in (52, 62):
        _, bounds = vocab.encode(letters[rng.integers(0, size, strings * length)], np.arange(strings + 1) * length)
        ratios.append(np.quantile(length / np.diff(bounds), 1 - LET_THROUGH))
    vocab.random_ratio = float(max(ratios))
    return vocab.random_ratio


def _long_runs(mask: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    start, end = ta.runs(mask[data], offsets)
    keep = end - start >= least
    return start[keep], end[keep]


def random_runs(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary, min_run: int = MIN_RUN, max_ratio: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the unbroken runs that encode badly and are not known identifiers."""
    max_ratio = calibrated_ratio(vocab) if max_ratio is None else max_ratio
    start, end = _long_runs(_RUN, data, offsets, min_run)
    letters = np.concatenate([[0], np.cumsum(_ALPHA[data])])
    keep = letters[end] > letters[start]
    start, end = start[keep], end[keep]
    if not len(start):
        return start, end
    size = end - start
    _, bounds = vocab.encode(data[ta.ragged(start, size)], np.concatenate([[0], np.cumsum(size)]))
    low = size / np.maximum(np.diff(bounds), 1) <= max_ratio
    start, end = start[low], end[low]
    runs = [data[a:b].tobytes().decode("ascii") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    words = _plain_words(runs, vocab, max_ratio)
    keep = np.array([not (w or UUID.fullmatch(r) or DIGEST.fullmatch(r)) for r, w in zip(runs, words, strict=True)], bool)
    return start[keep], end[keep]


def _plain_words(runs: list[str], vocab: Vocabulary, max_ratio: float) -> list[bool]:
    """Whether a run is a name (its parts between separators are words, numbers or words with a number) whose letters encode as words.

    Capitals encode badly, so segments of one case are lower-cased. Long ones are judged each, short ones together.
    """
    named = [all(PART.fullmatch(p) for p in BREAK.split(r)) for r in runs]
    parts = [LETTERS.findall(r) if n else [] for r, n in zip(runs, named, strict=True)]
    flat = [p for ps in parts for p in ps]
    if not flat:
        return named
    size = np.array([len(p) for p in flat])
    _, bounds = vocab.encode(np.frombuffer("".join(p.lower() if p.isupper() or p.istitle() else p for p in flat).encode(), np.uint8), np.concatenate([[0], np.cumsum(size)]))
    tokens = np.diff(bounds)
    owner = np.repeat(np.arange(len(runs)), [len(ps) for ps in parts])
    total = lambda x: np.bincount(owner, x, len(runs))
    bad = total((size >= LONG_SEGMENT) & (size <= max_ratio * tokens)) > 0
    short = size < LONG_SEGMENT
    bad |= (total(short * size) <= max_ratio * total(short * tokens)) & (total(short & (tokens > 1)) > 0)
    return [n and not b for n, b in zip(named, bad.tolist(), strict=True)]


def scan(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> list[list[tuple[int, int, str]]]:
    """For each document its spans (start, end, kind) by start, then kind as listed in KINDS.

    Whole-array passes find the documents that can hold a match; only those go through the patterns.
    """
    n = len(offsets) - 1
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
    hex_start, _ = _long_runs(_HEX, data, offsets, 16)
    start, end = random_runs(data, offsets, vocab)
    lower = ta.LOWER[data].tobytes()
    marks = [*hex_start.tolist(), *start.tolist()]
    for word, raw in [*((k, lower) for k in KEYWORDS), (b"AKIA", data.tobytes())]:
        at = raw.find(word)
        while at >= 0:
            marks.append(at)
            at = raw.find(word, at + 1)
    owner = np.searchsorted(offsets, start, "right") - 1
    for d in np.unique(np.searchsorted(offsets, np.array(marks, np.int64), "right") - 1).tolist():
        body = data[offsets[d] : offsets[d + 1]]
        points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        spans = base_spans(body.tobytes().decode("utf-8"))
        for a, b in zip((start[owner == d] - offsets[d]).tolist(), (end[owner == d] - offsets[d]).tolist(), strict=True):
            spans.append((int(points[a]), int(points[b]), "random"))
        out[d] = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def find_secrets(df: DataFrame, rank_path: str, text_col: str = "text") -> DataFrame:
    """df with secrets array<struct<start, end, kind>> added (a column of that name is replaced)."""
    ship(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    keep = [c for c in df.columns if c != "secrets"]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("secrets", SPANS)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks.value)
        for batch in batches:
            for piece in ta.pieces(batch, text_col, limit=1 << 20):
                spans = scan(*ta.flat(piece.column(text_col)), vocab)
                found = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + [found], names=[*keep, "secrets"])

    return df.select(*keep).mapInArrow(run, schema)


def mask_secrets(df: DataFrame, rank_path: str, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """df with every secret's characters in the text replaced by `mark`; overlapping spans are joined first."""
    found = find_secrets(df.withColumn("secrets", F.lit(None).cast(SPANS)), rank_path, text_col)
    joined = F.aggregate(
        F.col("secrets"),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] < acc["at"], acc["done"]).otherwise(F.concat(acc["done"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    return found.withColumn(text_col, F.when(F.size("secrets") > 0, joined).otherwise(F.col(text_col))).drop("secrets")


def secret_report(df: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the fixed kinds, digest of their spans, and all spans as text."""
    found = find_secrets(df.select(id_col, text_col), rank_path, text_col)
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count("random").alias("n_random"),
    )
