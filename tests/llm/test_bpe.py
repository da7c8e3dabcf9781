"""Byte-level BPE against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from tidemark.llm import bpe, queries
from tidemark.llm import textarrays as ta

PATH = P.path("byte_bpe_multi_50k.tiktoken")
EDGE = [None, "", " ", "  ", "\n\n a", "I'll we've 're''s 'ss 'll's", "a" * 5000 + " " * 3000 + "x", "<|endoftext|>", "中文 é😀", "\x85\xa0 x", "a'", "'re", "'r"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids(library):
    rng = random.Random(1)
    letters = " '  \n\t\x85\xa0　abstremvdl's1٣²!.,<|中é😀ñ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for t in EDGE]
    vocab = bpe.Vocabulary(bpe.read_ranks(PATH), cache_words=500)  # the cache overflows many times
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        ids, bounds = vocab.encode(*ta.flat(pa.array(part, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in part]
        data, offsets = vocab.decode(ids, bounds)
        assert [x.decode() for x in ta.strings(data, offsets)] == part


def test_cache_grows_with_the_slices_it_has_met(library):
    """A worker keeps its cache for life, so a few words take no room for a million; growing loses none."""
    vocab = bpe.Vocabulary(bpe.read_ranks(PATH))
    encode = lambda t: vocab.encode(*ta.flat(pa.array([t])))[0].tolist()
    assert encode("a few words") == library.encode_ordinary("a few words")
    assert vocab.cache.keys.nbytes + vocab.cache.values.nbytes < 1 << 20
    many = [" ".join(f"w{i} x{i * 7919 % 100003}" for i in range(k, k + 3000)) for k in range(0, 12000, 3000)]
    assert [encode(t) for t in many + many[:1]] == [library.encode_ordinary(t) for t in many + many[:1]]
    assert vocab.cache.capacity >= vocab.count == (vocab.cache.keys != 0).sum()


def test_long_and_short_merging_agree():
    vocab = bpe.Vocabulary(bpe.read_ranks(PATH))
    word = ("theandofing" * 40).encode()
    ids, _ = vocab.merge(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
    assert ids.tolist() == vocab._merge_long(word)


def test_operator(spark, library):
    rows = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(EDGE + EDGE[:3])], "doc_id long, text string, extra string, ids long")
    got = {r["doc_id"]: r for r in bpe.encode(rows, PATH).collect()}
    for i, t in enumerate(EDGE):
        want = library.encode_ordinary(t or "")
        assert got[i]["ids"] == want and got[i]["extra"] == "kept"
        sizes = [len(library.decode_single_token_bytes(x)) for x in want]
        assert got[i]["token_starts"] == [sum(sizes[:k]) for k in range(len(sizes))]
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(bpe.encode(rows, PATH), PATH).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    assert bpe.encode(rows.limit(0), PATH).count() == 0


def test_query(spark, tiny, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in queries.op5_bpe(spark, tiny).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
