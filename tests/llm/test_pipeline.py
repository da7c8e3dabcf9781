"""The pipeline against a brute-force version of its stages after the classifier."""

import base64

import corpus_pipeline as cp
import public_tokenizers as P
import tiktoken
from test_documents import brute_components, brute_contamination, brute_spans

from tidemark.llm import secret_scan


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = cp.keep_quality(spark, docs, tiny).cache()
    assert kept.columns == cp.COLUMNS
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    comp = brute_components([t for _, t in rows], [i for i, _ in rows])
    rows = [(i, t) for i, t in rows if comp[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    dirty = {d for d, _ in brute_contamination([t for _, t in rows], items)}
    rows = [r for d, r in enumerate(rows) if d not in dirty]
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in cp.run(spark, tiny).collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        if not brute_spans(t) and not secret_scan.UUID.search(t):
            assert got[i] == enc.encode_ordinary(t)
        else:
            text = enc.decode(got[i])
            assert "<secret>" in text and not brute_spans(text)
    assert len(rows) < docs.count() and len(cp.STAGES) == 5


def test_odd_rows(spark, tiny):
    """Nulls, empty and long texts, repeated rows and ids, further columns: each stage has a defined result."""
    text = "A calm plain sentence about rivers and hills in the north. " * 4
    rows = [(1, text, None, None, None), (1, text, "en", "a", 5), (2, text, "en", "a", 5), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, "other words entirely here now " * 4, "en", None, 9), (5, text, "en", "b", 1), (6, "many different words " + " ".join(f"w{i}" for i in range(20000)), "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, contamination string")
    near = cp.drop_near_duplicates(spark, docs, tiny)
    got = sorted((r["doc_id"], r["text"]) for r in near.collect() if r["text"])
    assert near.columns == cp.COLUMNS and [i for i, _ in got] == [1, 5, 6] and got[1][1] == text
    assert sorted(r["doc_id"] for r in near.collect() if not r["text"]) == [3, 4]
    for name, stage in cp.STAGES:
        out = stage(spark, docs.limit(0), tiny)
        assert out.count() == 0 and (name == "bpe" or out.columns == cp.COLUMNS)
    for name, stage in cp.STAGES[2:]:
        assert stage(spark, docs, tiny).count() == len(rows)
    assert {r["doc_id"] for r in cp.keep_quality(spark, docs, tiny).collect()} <= {1, 2, 5, 6}
