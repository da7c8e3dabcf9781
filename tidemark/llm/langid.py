"""Language identification by interpolated Kneser-Ney character models in sorted arrays.

Texts become lower-case letters with one space between words. A character four-gram is packed into 64
bits; each language's counts of it, over all training documents, are summed by Spark. On the driver
they become an interpolated Kneser-Ney model (absolute discount, continuation counts below order
four), stored as arrays sorted by key. All languages' log-probabilities of the four-grams that occur
are merged into one sorted array, so scoring needs one binary search a character; four-grams unseen
everywhere go through the models' own back-off. The language of least length-normalised cross-entropy
wins; a posterior and a rejection flag are calibrated on a bounded sample of training texts, under models
that leave these texts out.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the language
first in order; without training documents everything is `und`; equal texts get equal results; whole
texts are read; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textarrays as ta
from tidemark.llm.cluster import Scratch, ship
from tidemark.llm.labelled import held_out

ORDER = 4
UND = "und"
CALIBRATION_DOCS = 2000
_CHARS = 65536


@cache
def _letters() -> np.ndarray:
    """For each code point the 16-bit code of its lower-case letter, or a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint16)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = ord(chr(c).lower()[0])
            out[c] = low if low < _CHARS else 0xE000 + low % 0x1900
    return out


def fourgrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed four-grams of all texts in order, bounds by text, and whether a text has a letter."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    code = _letters()[points]
    owner = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    head = np.zeros(len(code) + 1, bool)
    head[owner] = True
    letter = code != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~head[1:-1]  # the first character after a letter closes the word
    at = np.flatnonzero(keep)
    bounds = np.searchsorted(at, owner)
    c = code[at].astype(np.uint64)
    place = np.arange(len(c)) - np.repeat(bounds[:-1], np.diff(bounds))
    key = c.copy()
    for k in range(1, ORDER):
        before = np.full(len(c), 32, np.uint64)
        if len(c) > k:
            before[k:] = np.where(place[k:] >= k, c[:-k], np.uint64(32))
        key |= before << np.uint64(16 * k)
    words = np.concatenate([[0], np.cumsum(letter)])[owner]
    return key, bounds, np.diff(words) > 0


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)


@dataclass(frozen=True)
class CharModel:
    """One language: for orders 4 to 1 the sorted keys, discounted shares, and per context the back-off weight."""

    keys: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    alphabet: int = 1

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> CharModel:
        levels: tuple[list, list, list, list] = ([], [], [], [])
        counts = counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.9)
            context, head = np.unique(keys >> np.uint64(16), return_index=True)
            total, kinds = np.add.reduceat(counts, head), np.diff(np.append(head, len(keys)))
            row = np.repeat(np.arange(len(context)), kinds)
            for out, x in zip(levels, (keys, np.maximum(counts - discount, 0) / total[row], context, discount * kinds / total), strict=True):
                out.append(x)
            # One step down, a key counts once for each different character before it.
            keys, counts = _sum_by_key(keys & np.uint64((1 << 16 * (order - 1)) - 1), np.ones(len(keys)))
        return CharModel(*levels, alphabet=len(levels[0][-1]) + 1)

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / self.alphabet)
        for order in range(1, ORDER + 1):
            level = ORDER - order
            part = keys & np.uint64((1 << 16 * order) - 1) if order < 4 else keys
            at, there = _find(self.keys[level], part)
            share = np.where(there, self.shares[level][at], 0)
            at, there = _find(self.contexts[level], part >> np.uint64(16))
            p = np.where(there, share + self.backoff[level][at] * p, p)
        return np.log(np.maximum(p, 1e-12))


@dataclass(frozen=True)
class Identifier:
    languages: list[str]
    models: list[CharModel]
    keys: np.ndarray
    table: np.ndarray
    sharpness: float = 8.0
    limits: np.ndarray | None = None

    @staticmethod
    def build(models: dict[str, CharModel]) -> Identifier:
        names = sorted(models)
        keys = np.unique(np.concatenate([models[x].keys[0] for x in names]))
        return Identifier(names, [models[x] for x in names], keys, np.stack([models[x].log_probability(keys) for x in names], 1).astype(np.float32))

    def cross_entropy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log-probability a character, by text and language, and whether a text has a letter."""
        key, bounds, letters = fourgrams(data, offsets)
        at, there = _find(self.keys, key)
        logp = self.table[at] if len(key) else np.zeros((0, len(self.languages)), np.float32)
        if not there.all():
            rare, back = np.unique(key[~there], return_inverse=True)
            logp[~there] = np.stack([m.log_probability(rare) for m in self.models], 1)[back]
        sums = ta.per_document(np.add, logp.astype(np.float64), bounds, 0.0)
        return -sums / np.maximum(np.diff(bounds), 1)[:, None], letters

    def posterior(self, entropy: np.ndarray) -> np.ndarray:
        e = np.exp(-self.sharpness * (entropy - entropy.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def _count(df: DataFrame, text_col: str, lang_col: str, held: set[int]) -> DataFrame:
    """(lang, key, n, held): four-gram counts, and those of the calibration texts; each task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def total(name: tuple[str, bool]) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*sums[name], strict=True))
            return _sum_by_key(keys, counts)

        for batch in batches:
            for piece in ta.pieces(batch, text_col):
                key, bounds, _ = fourgrams(*ta.flat(piece.column(text_col)))
                apart = np.array([h in held for h in piece.column("h").to_pylist()], bool)
                names, code = np.unique(np.array(piece.column(lang_col).to_pylist(), dtype=object).astype(str), return_inverse=True)
                owner = np.repeat(code * 2 + apart, np.diff(bounds))
                for i in np.unique(owner).tolist():
                    name = (names[i // 2], bool(i % 2))
                    sums.setdefault(name, []).append(np.unique(key[owner == i], return_counts=True))
                    if sum(len(k) for k, _ in sums[name]) > 1 << 20 and len(sums[name]) > 1:
                        sums[name] = [total(name)]
        for lang, apart in sums:
            keys, counts = total((lang, apart))
            for at in range(0, len(keys), 1 << 16):
                k = keys[at : at + (1 << 16)]
                n = pa.array(counts[at : at + len(k)].astype(np.int64))
                none = pa.array(np.zeros(len(k), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), n, n if apart else none], names=["lang", "key", "n", "held"])

    return df.mapInArrow(run, "lang string, key long, n long, held long").groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", calibration: int = CALIBRATION_DOCS) -> Identifier | None:
    """Count over all rows with text and language, then build the models; None without such rows.

    All counts are kept, whatever their number; the driver gathers one language at a time. The models are
    held by the driver and every worker and grow with the number of different four-grams. Sharpness and
    limits of rejection are fitted on at most `calibration` different texts (least hash first) under
    models that have not counted them; the models returned have counted all.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col, F.xxhash64(text_col, lang_col).alias("h"))
    held = {r["h"] for r in rows.select("h").distinct().orderBy("h").limit(calibration).collect()}
    counts = Scratch(spark, "langid").save(_count(rows, text_col, lang_col, held), "counts")
    every, known = {}, {}
    for lang in sorted(r["lang"] for r in counts.select("lang").distinct().collect()):
        got = counts.where(F.col("lang") == lang).select("key", "n", "held").toArrow()
        keys, n, apart = np.asarray(got["key"]).view(np.uint64), np.asarray(got["n"]), np.asarray(got["held"])
        order = np.argsort(keys)
        keys, n, apart = keys[order], n[order], apart[order]
        every[lang] = CharModel.build(keys, n)
        if (n > apart).any():
            known[lang] = CharModel.build(keys[n > apart], (n - apart)[n > apart])
    if not every:
        return None
    model = Identifier.build(every)
    return _with(model, *calibrated(Identifier.build(known), rows, text_col, lang_col, held, model.languages)) if known else model


def calibrated(model: Identifier, rows: DataFrame, text_col: str, lang_col: str, held: set[int], languages: list[str]) -> tuple[float, np.ndarray | None]:
    """Sharpness of the posterior by likelihood, and per language the entropy beyond which a text is rejected."""
    chosen = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in held], "h long"))
    one = rows.join(chosen, "h", "left_semi").dropDuplicates(["h"]).select(text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, text_col):
                entropy, letters = model.cross_entropy(*ta.flat(piece.column(text_col)))
                lists = pa.array([e.tolist() if ok else None for e, ok in zip(entropy, letters, strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([piece.column(lang_col), lists], names=["lang", "e"])

    got = one.mapInArrow(run, "lang string, e array<double>").where(F.col("e").isNotNull() & F.col("lang").isin(model.languages)).toArrow()
    limits = np.full(len(languages), np.inf)
    if not len(got):
        return 8.0, None
    entropy = np.array(got["e"].to_pylist())
    true = np.array([model.languages.index(x) for x in got["lang"].to_pylist()])
    best = max(2.0 ** np.arange(0, 8), key=lambda s: float(np.log(np.maximum(_with(model, s).posterior(entropy)[np.arange(len(true)), true], 1e-9)).sum() - 0.01 * s))
    for i, name in enumerate(model.languages):
        if (own := entropy[true == i, i]).size >= 20:
            limits[languages.index(name)] = np.quantile(own, 0.999) + 2 * own.std()
    return best, limits


def _with(model: Identifier, sharpness: float, limits: np.ndarray | None = None) -> Identifier:
    return Identifier(model.languages, model.models, model.keys, model.table, sharpness, limits)


def identify(df: DataFrame, model: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score: posterior of it, cross_entropy, rejected: unlike all training text)."""
    ship(df.sparkSession)
    if model is None:
        return df.select(id_col, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UND], dtype=object)
        limits = m.limits if m.limits is not None else np.full(len(m.languages), np.inf)
        for batch in batches:
            for piece in ta.pieces(batch, text_col):
                entropy, letters = m.cross_entropy(*ta.flat(piece.column(text_col)))
                pick = entropy.argmin(1)
                row = np.arange(len(pick))
                score = np.where(letters, m.posterior(entropy)[row, pick], 0.0)
                least = entropy[row, pick]
                label = names[np.where(letters, pick, len(m.languages))].tolist()
                cols = [pa.array(label, pa.string()), pa.array(score), pa.array(least, mask=~letters), pa.array(~letters | (least > limits[pick]))]
                yield pa.RecordBatch.from_arrays([piece.column(id_col), *cols], names=[id_col, "lang_pred", "score", "cross_entropy", "rejected"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents whose crc32 modulo 4 is not 2, predict all."""
    model = train(docs.where(~held_out(id_col, 4, 2)), text_col, lang_col)
    found = identify(docs, model, id_col, text_col)
    return found.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
