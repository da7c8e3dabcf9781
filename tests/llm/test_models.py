"""Held-out accuracy of the fitted operators, and recall of the vector search."""

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ann, labelled, langid, quality, queries, toxicity
from tidemark.llm import textarrays as ta


def test_quality_query(spark, tiny):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    got = {r["doc_id"]: r["quality_kept"] for r in queries.op1_quality(spark, tiny).collect()}
    assert np.mean([got[d] == bool(y) for d, y in labels.items() if d in got]) > 0.9


def test_quality_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 5)).astype(np.float32)
    y = np.digitize(x[:, 0] * 2 + rng.standard_normal(900) * 0.3, [-1, 1])
    model = quality.fit(x, y)
    assert np.all(np.diff(model.thresholds) >= 0)
    assert np.mean(np.round(model.tails(x).sum(1)) == y) > 0.85


def test_quality_against_plain_gradient_descent():
    """The fit's penalised likelihood is at least that of a slow, plain descent with numeric gradients."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 3))
    y = np.digitize(x @ [1.0, -0.5, 0.2] + rng.logistic(size=200) * 0.5, [-0.7, 0.9])
    weight = (200 / (3 * np.bincount(y)))[y] / 200

    def loss(w, cut):
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        up, low = (1 / (1 + np.exp(-(e - x @ w))) for e in (edge[y + 1], edge[y]))
        return -(weight * np.log(np.maximum(up - low, 1e-12))).sum() + 1e-4 * (w @ w)

    theta = np.array([0.0, 0, 0, -1, 1])
    for _ in range(3000):
        grad = np.array([(loss((theta + h)[:3], (theta + h)[3:]) - loss((theta - h)[:3], (theta - h)[3:])) / 2e-5 for h in np.eye(5) * 1e-5])
        theta = theta - 1.0 * grad
    model = quality.fit(x.astype(np.float32), y, steps=2000)
    assert loss(model.weights, model.thresholds) <= loss(theta[:3], theta[3:]) + 1e-3
    assert np.allclose(model.weights, theta[:3], atol=0.05) and np.allclose(model.thresholds, theta[3:], atol=0.05)


def test_quality_of_any_grades(spark):
    """Grades with gaps, below 0, repeated rows, a column of a clashing name and a very long text."""
    texts = [("good plain sentence about things. " * 5, 7), ("w0rd!!! ### $$ 99 %% " * 6, -3), ("mixed words ## and 12 numbers. " * 5, 2)]
    rows = spark.createDataFrame([(i, texts[i % 3][0] + str(i), "x") for i in range(90)] + [(90, texts[0][0] * 20000, "x"), (0, texts[0][0] + "0", "x")], "doc_id long, text string, expected_grade string")
    labels = spark.createDataFrame([(i, texts[i % 3][1]) for i in range(90)] + [(999, 2)], "doc_id long, quality int")
    model = quality.train(rows, labels)
    assert model.grades.tolist() == [-3, 2, 7] and np.all(np.diff(model.thresholds) >= 0)
    got = quality.grade(rows, model, wanted=3).collect()
    assert len(got) == 92 and len({r["tail_probability"] for r in got if r["doc_id"] == 0}) == 1
    assert all(-3 <= r["expected_grade"] <= 7 for r in got)
    assert np.mean([(r["tail_probability"] > 0.5) == (r["doc_id"] % 3 == 0) for r in got]) > 0.95
    with pytest.raises(ValueError):
        labelled.sample(rows, spark.createDataFrame([(i, i) for i in range(70)], "doc_id long, quality int"), "quality", 5)


def test_quality_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "good text here")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality.train(rows, labels)
    assert model is None
    assert {r["doc_id"]: r["quality_kept"] for r in quality.grade(rows, model).collect()} == {1: False, 2: False, 3: True}
    assert quality.grade(rows.limit(0), model).count() == 0


def test_language_query(spark, tiny):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, tiny).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_kneser_ney_sums_to_one():
    keys = np.unique(np.random.default_rng(1).integers(97, 101, (400, 4)).astype(np.uint64) @ np.array([1 << 48, 1 << 32, 1 << 16, 1], np.uint64))
    model = langid.CharModel.build(keys, np.arange(len(keys)) % 5 + 1)
    context = np.uint64(keys[0] >> np.uint64(16)) << np.uint64(16)
    p = np.exp(model.log_probability(context + np.arange(97, 101, dtype=np.uint64)))
    assert abs(p.sum() + 1 / model.alphabet * math.prod(model.backoff[4 - o][np.searchsorted(model.contexts[4 - o], (keys[0] >> np.uint64(16)) & np.uint64((1 << 16 * (o - 1)) - 1))] for o in range(1, 5)) - 1) < 1e-9


def brute_kneser_ney(texts):
    """Interpolated Kneser-Ney of order 4 with dictionaries: probability of a character after three others."""
    grams = Counter()
    for t in texts:
        c = "   " + " ".join("".join(x if x.isalpha() else " " for x in t.lower()).split())
        grams.update(c[i : i + 4] for i in range(len(c) - 3))
    counts = {4: grams}
    for o in (3, 2, 1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    discount = {}
    for o, c in counts.items():
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        discount[o] = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.9)
    total, kinds = defaultdict(int), defaultdict(int)
    for o, c in counts.items():
        for g, v in c.items():
            total[o, g[:-1]] += v
            kinds[o, g[:-1]] += 1

    def p(gram, o=4):
        if o == 0:
            return 1 / (len(counts[1]) + 1)
        g = gram[4 - o :]
        if not total[o, g[:-1]]:
            return p(gram, o - 1)
        return max(counts[o][g] - discount[o], 0) / total[o, g[:-1]] + discount[o] * kinds[o, g[:-1]] / total[o, g[:-1]] * p(gram, o - 1)

    return p


def test_language_against_brute_force(spark):
    """Cross-entropies of held-out texts equal those of a dictionary model; ties, repeated rows, long texts, clashing columns."""
    train = [("the cat sat on the mat and the dog", "en"), ("a dog and a cat", "en"), ("el gato y el perro en la casa", "es"), ("la casa del perro", "es")] * 2
    asked = ["the dog sat", "el perro", "casa and cat", "zzz", "the " * 30000]
    rows = spark.createDataFrame([(i, t, x, 0.5) for i, (t, x) in enumerate(train)], "doc_id long, text string, lang string, score double")
    model = langid.train(rows, calibration=0)
    brute = {x: brute_kneser_ney([t for t, y in train if y == x]) for x in ("en", "es")}
    entropy, _ = model.cross_entropy(*ta.flat(pa.array(asked)))
    for i, t in enumerate(asked[:4]):
        c = "   " + t
        for j, x in enumerate(model.languages):
            want = -np.mean([math.log(brute[x](c[k : k + 4])) for k in range(len(c) - 3)])
            assert math.isclose(entropy[i, j], want, rel_tol=1e-5)
    got = langid.identify(spark.createDataFrame([(i, t, "x") for i, t in enumerate(asked + asked)], "doc_id long, text string, lang_pred string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:5]] == [r["lang_pred"] for r in got[5:]] and got[0]["lang_pred"] == got[4]["lang_pred"] == "en" and got[1]["lang_pred"] == "es"
    both = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(both, langid.train(both)).collect()} == {"a"}


def test_language_edges(spark):
    rows = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "hello there friend", "en"), (4, "hola amigo que tal", "es"), (5, "é", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(rows, langid.train(rows)).collect()}
    assert got[1] == ("und", 0.0) == got[2] and got[3][0] == "en" and got[4][0] == "es" and got[5][0] in ("en", "es")
    assert langid.predict_languages(rows.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(rows, None).collect()} == {"und"}


def test_language_keeps_all_counts(spark, monkeypatch):
    """Over four million different four-grams, nearly all of them met once."""
    letters = np.random.default_rng(8).integers(0x4E00, 0x9FA5, (40, 110000)).astype(np.uint16)
    texts = [row.tobytes().decode("utf-16-le") for row in letters]
    monkeypatch.setattr(langid.Identifier, "build", staticmethod(lambda models: SimpleNamespace(languages=sorted(models), models=models)))
    monkeypatch.setattr(langid, "calibrated", lambda *_: (8.0, None))
    monkeypatch.setattr(langid, "_with", lambda model, *_: model)
    rows = spark.createDataFrame([(t, ("a", "b")[i % 2]) for i, t in enumerate(texts)], "text string, lang string")
    models = langid.train(rows, calibration=1).models
    for at, lang in enumerate("ab"):
        raw = [np.frombuffer(t.encode(), np.uint8) for t in texts[at::2]]
        want = np.unique(np.concatenate([langid.fourgrams(r, np.array([0, len(r)]))[0] for r in raw]))
        assert np.array_equal(models[lang].keys[0], want) and len(want) > 2_100_000


def test_toxicity_query(spark, tiny):
    rows = queries.op10_toxicity(spark, tiny.replace("0.001", "0.01")).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{tiny.replace('0.001', '0.01')}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    hits = [(toxic[r["doc_id"]], r["score"]) for r in rows if r["doc_id"] in toxic and r["held_out"]]
    pos, neg = [s for y, s in hits if y], [s for y, s in hits if not y]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.75


def test_toxicity_of_odd_rows(spark):
    """Repeated rows and ties score alike, a long text is read to its end, clashing columns are ignored; K and lambda by brute force."""
    texts = [(i, ("lovely green meadow calm water " * 3) + (f"vile scum garbage {i}" if i % 4 == 0 else "under the vile sky" if i % 20 == 1 else "under the sky")) for i in range(120)]
    rows = spark.createDataFrame([(i, t, 0.5) for i, t in [*texts, (0, texts[0][1]), (500, "calm water " * 60000 + "vile scum garbage " * 9), (501, None)]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    lexicon = toxicity.train(rows, labels)
    got = toxicity.find_toxic(rows, lexicon).collect()
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert len(got) == 123 and all(by[i] == (i % 4 == 0) for i in range(120)) and by[501] == 0
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    long = next(r for r in got if r["doc_id"] == 500)
    assert [(p["begin"], p["end"]) for p in long["passages"]] == [(660000, 660161)]
    table, words, best = lexicon.table(), [], []
    for i, t in texts:
        if i % 4:
            score = lexicon.token_scores(table, toxicity.tokens(*ta.flat(pa.array([t])))[0])
            words += score.tolist()
            best.append((len(score), max((s for _, _, s in toxicity.maximal_segments(score)), default=0.0)))
    assert lexicon.lam == 8.0 or abs(np.mean(np.exp(lexicon.lam * np.array(words))) - 1) < 0.05
    assert math.isclose(lexicon.k, min(len(best) / sum(n * math.exp(-lexicon.lam * x) for n, x in best), 1.0), rel_tol=1e-6)


def test_maximal_segments():
    def best(scores):
        return max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))

    rng = np.random.default_rng(2)
    for _ in range(50):
        at = np.sort(rng.choice(40, 8, replace=False))
        full = np.full(40, -0.4)
        full[at] = rng.uniform(-1, 3, 8)
        full[rng.integers(0, 40)] -= 1
        segs = toxicity.maximal_segments(full)
        assert math.isclose(max(s for _, _, s in segs), best(full.tolist()), abs_tol=1e-9)
        assert all(math.isclose(full[a : b + 1].sum(), s, abs_tol=1e-9) for a, b, s in segs)
        assert all(x[1] < y[0] for x, y in zip(segs, segs[1:]))


def test_toxicity_edges(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "plain words", "you idiot"])], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(rows, labels).collect()} == {0.0}
    assert toxicity.score_documents(rows.limit(0), labels).count() == 0


def brute(vectors, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in good if j != i)
            out[i] = [j for _, j in near[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16)).astype(np.float32)
    vectors = [(i, base[i % 40].tolist() if i % 3 else (base[i % 40] + rng.standard_normal(16) * 0.3).astype(np.float32).tolist()) for i in range(300)]
    vectors[7], vectors[8], vectors[9], vectors[50] = (7, None), (8, [0.0] * 16), (9, [float("nan")] * 16), (50, [None] + [1.0] * 15)
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.neighbours(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(vectors)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert ann.neighbours(rows.limit(0)).count() == 0
    few = ann.neighbours(rows.where("vec_id in (0, 1, 2)")).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_every_query_has_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = [(0, [-1.0] + [0.0] * 7)] + [(i, [1.0, *(rng.standard_normal(7) * 0.1).tolist()]) for i in range(1, 120)]
    ends = np.eye(8)[[0, 0, 0]] * [[-1], [1], [1]] + [[0] * 8, [0] * 8, [0, 1e-3] + [0] * 6]
    monkeypatch.setattr(ann.Index, "fit", staticmethod(lambda *_: ann.Index(ann.unit(ends), np.eye(8), 1)))
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = Counter(r["query_id"] for r in ann.neighbours(rows).collect())
    assert got == {0: 5, 50: 5, 100: 5}
    few = Counter(r["query_id"] for r in ann.neighbours(rows.where("vec_id < 4")).collect())
    assert few == {0: 3}


def test_nearest_ties_and_odd_lengths(spark):
    """Equal cosines go to the smaller id; another length takes no part; clashing columns are ignored."""
    vectors = [(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2), 0.0], 1, 2.0) for i in range(60)] + [(100, [1.0, 0.0], 1, 2.0)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank int, score double")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.neighbours(rows).collect()}
    assert [got[0, k] for k in range(1, 6)] == [(3 * k, 1.0) for k in range(1, 6)]
    assert [got[50, k][0] for k in range(1, 6)] == [2, 5, 8, 11, 14] and len(got) == 10


def test_recall_of_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([tuple(r) for r in rows])
    got: dict = {}
    for r in queries.op9_nearest(spark, tiny).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_quality_fit_holds_one_copy_of_its_features():
    draw = np.random.default_rng(2)
    x = draw.random((2000, quality.DIMS), dtype=np.float32)
    ids, y = draw.permutation(2000), (x[:, :9].sum(1) > 4.5).astype(int)
    rows = pa.table({"id": ids, "y": pa.array(y, pa.int32()), "x": pa.array([r.tobytes() for r in x], pa.binary())})
    grades, sorted_ = quality.matrix(rows)
    assert np.array_equal(sorted_, x[np.argsort(ids)]) and np.array_equal(grades, y[np.argsort(ids)])
    tracemalloc.start()
    quality.fit(x, y, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 2
