"""Secrets, near-duplicates, repeated substrings, licenses and contamination against brute-force versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, license_scan, near_dedup, queries, secret_scan, substring_dedup
from tidemark.llm.cluster import BATCH_BYTES, Scratch, ship
from tidemark.llm.components import components

PATH = queries.rank_path()


def docs(spark, texts):
    """Texts with ids, a row twice, and columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, id string, n long")


def words_of(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(t):
    w = words_of(t)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(texts, ids):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(texts))}


def near_copies(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    texts = [None, "", "  \n", "Two words", "two WORDS", "two  words", "one"]
    common = [word() for _ in range(120)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(80, 200))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts + texts[5:15]


def test_near_duplicates(spark):
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    want = brute_components(texts, list(range(len(texts))))
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want


def test_hot_group_and_threshold(spark, monkeypatch):
    """One group of near copies with a third of all rows, dealt over many copies of its pivot; a pair at exactly 85 %."""
    monkeypatch.setattr(near_dedup, "SPREAD", 3)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = [" ".join([*base[:i], word(), *base[i + 1 :]]) for i in range(5, 65)]
    texts += [" ".join(word() for _ in range(50)) for _ in range(60)]
    one = [word() for _ in range(41)]  # 37 shingles each, of which 34 are shared: 34 / 40
    texts += [" ".join(one), " ".join([*one[:38], word(), word(), word()]), " ".join(base * 300)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    want = brute_components(texts, list(range(len(texts))))
    assert got == want and want[121][1] == 120 and len({want[i][1] for i in range(60)}) == 1


def test_near_duplicates_plan_few_exchanges_at_once(spark, monkeypatch):
    """What the joins read several times is stored: the driver keeps a thread and a plan for every exchange of a job."""
    planned, save = {}, Scratch.save
    def kept(self, df, name):
        planned[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        return save(self, df, name)
    monkeypatch.setattr(Scratch, "save", kept)
    near_dedup.near_duplicates(docs(spark, ["a b c d e f g", "a b c d e f g h", "a b c d e f g"]))
    assert max(planned.values()) <= 16, planned


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0


def test_near_dedup_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([r["text"] for r in rows], [r["doc_id"] for r in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_near_dedup(spark, tiny).collect()}
    assert got == want


def brute_spans(t):
    out = []
    for kind, pattern, least in (("assign", secret_scan.ASSIGN, 12), ("access", secret_scan.ACCESS, 18), ("hex", secret_scan.HEX, 16)):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(t or "") if len(m[2] if kind == "assign" else m[0]) >= least]
    return sorted(out, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


SECRETS = [None, "", "é Password: 'abcdefghijkl'", "API_KEY=short", "x AKIA" + "A" * 14 + " AKIAAKIA", "deadbeef" * 2 + " " + "g" * 20, "ſecret=abcdefghijklmnop secret = zzzzzzzzzzzz", "key q8Zr2LxV0mT4cK9pW1sN7bY3 end", "550e8400-e29b-41d4-a716-446655440000", "pass" * 9 + "word=" + "a1" * 9, "a" * 300000 + " token=" + "Zq9" * 8]


def test_secrets(spark):
    rows = docs(spark, SECRETS)
    found = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["secrets"]] for r in secret_scan.find_secrets(rows, PATH).collect()}
    for i, t in enumerate(SECRETS):
        assert [s for s in found[i] if s[2] != "random"] == brute_spans(t)
    assert [s[2] for s in found[7]] == ["random"] and found[8] == []
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(rows, PATH).collect()}
    assert masked[7] == "key <secret> end" and masked[0] is None and masked[3] == SECRETS[3] and masked[2] == "é <secret>'"


RANDOM_LETTERS = ["Zq8xK2vTnWmR4bLp", "QwZrTkPxVbNmLsDf", "xKqZvTnWmRbLpHjGdFsQ", "xKqZvTnWmRbLpHjGdFsQ-12", "2024/xKqZvTnWmRbLpHjGdFsQ/report"]
PLAIN = ["internationalization", "configuration_settings_default_values", "getElementByIdFromTheDocument", "report-2024-01-31-final-12", "/usr/local/share/documentation", "a-b-c-d-e-f-g-h-i-j-k-l", "/usr/lib/python3/dist-packages/numpy/core/x86_64-linux", "build-2024-x86_64-release-v1-2-3-rc4", "--yaml-roundtrip-files"]


def test_random_letters(spark):
    texts = [f"see {x} here" for x in RANDOM_LETTERS + PLAIN]
    masked = [r["text"] for r in secret_scan.mask_secrets(docs(spark, texts), PATH).orderBy("doc_id").collect()]
    assert masked == ["see <secret> here"] * len(RANDOM_LETTERS) + texts[len(RANDOM_LETTERS) :]


def test_secrets_of_nothing(spark):
    rows = docs(spark, SECRETS).withColumn("secrets", F.lit("clash"))
    assert secret_scan.find_secrets(rows.limit(0), PATH).count() == 0
    assert dict(secret_scan.find_secrets(rows, PATH).dtypes)["secrets"].startswith("array")


def test_random_strings_are_found():
    """Of random strings of any mixed alphabet and length from 16 on, nearly all are found; of words none."""
    vocab = secret_scan.vocabulary(secret_scan.read_ranks(PATH))
    rng = random.Random(4)
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        for n in (16, 20, 33):
            raw = "\n".join("".join(rng.choice(alphabet) for _ in range(n)) for _ in range(500)).encode()
            start, _ = secret_scan.random_runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), vocab)
            assert len(start) >= 490


def test_secret_query(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in queries.op3_secret_scan(spark, tiny).collect():
        want = brute_spans(texts[r["doc_id"]])
        kinds = Counter(k for _, _, k in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = {}
    for d, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [1500, 3])
def test_repeated_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", hot / 100)
    rng = random.Random(hot)
    rand = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [rand(n) for n in (390, 400, 401, 700)]
    texts = [None, "", "short", "la " * 400] + [rand(rng.randint(0, 500)) + rng.choice(passages) + rand(rng.randint(0, 60)) for _ in range(30)]
    texts += texts[6:9]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert got == brute_repeats(texts, 400)


def test_equal_segments_are_not_sorted(spark, monkeypatch):
    """Groups that hold one segment in several copies are done; only groups of different segments get their bytes."""
    fetched, fetch = [], substring_dedup._fetch
    monkeypatch.setattr(substring_dedup, "_fetch", lambda df, wanted, length: fetched.extend(wanted.collect()) or fetch(df, wanted, length))
    rng = random.Random(8)
    rand = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    copied, passage = rand(2500), rand(900)
    texts = [copied, copied, copied, rand(300) + passage + rand(70), passage + rand(500), rand(800)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert got == brute_repeats(texts, 400)
    kinds = Counter(r["mh"] for r in fetched)
    assert fetched and min(kinds.values()) > 1 and {r["at"]["id"] for r in fetched} == {3, 4}


def test_groups_stay_whole_after_a_join_on_their_key(spark):
    """A join planned by shuffle and then broadcast has its shuffle read by mappers, here a group's segments in two of them."""
    rng = random.Random(21)
    body = lambda: "".join(rng.choice("abcdefgh ") for _ in range(450)).encode()
    passages = [body() for _ in range(40)]
    segs = spark.createDataFrame([(g, ch, 1, b"%d" % ch + p) for ch in (0, 1) for g, p in enumerate(passages)], "mh long, ch long, copies long, body binary")
    hot = spark.range(3_000_000).where("id % 1000000 = 999999").select(F.col("id").alias("mh"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = substring_dedup._repeats(segs.join(hot, "mh", "left_anti"), 400, int(spark.conf.get("spark.sql.shuffle.partitions"))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found)) == [(g, ch, 1, 52) for g in range(40) for ch in (0, 1)]


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(docs(spark, ["x"]).limit(0)).count() == 0


def test_repeat_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute_repeats([r["text"] for r in rows], 400)
    want = {rows[i]["doc_id"]: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in want.items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op6_substring_dedup(spark, tiny).collect()} == want


def brute_license(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LICENSES = [None, "", "...", "CC BY", "cc by cc-by x CC  BY", "All Rights reserved; GENERAL public license", "Licensed under the Apache License, Version 2.0.", "Licensed under the old Apache License, Version 2.0!", "licensed under the", "É cc by é", "all rights"]


def test_licenses(spark):
    got = {r["doc_id"]: r for r in license_scan.license_report(docs(spark, LICENSES)).collect()}
    for i, t in enumerate(LICENSES):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(t)
    assert got[6]["labels"] == "apache-2.0" and got[6]["score"] == 1.0 and got[7]["labels"] == "apache-2.0" and got[8]["labels"] == "" and got[3]["labels"] == "cc-by"
    assert license_scan.license_report(docs(spark, LICENSES).limit(0)).count() == 0


def test_license_query(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in queries.op7_license_scan(spark, tiny).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(texts[r["doc_id"]])


def brute_contamination(texts, items):
    sets = {i: (shingle_set(t), len(words_of(t))) for i, t in items}
    df = Counter(s for v, _ in sets.values() for s in v)
    weight = lambda s: float(np.log1p(len(items) / df[s])) if s in df else float(np.log1p(len(items)))
    out = {}
    for d, t in enumerate(texts):
        w, here = words_of(t), shingle_set(t)
        for i, (own, size) in sets.items():
            if size >= 5 and not own & here:
                continue
            for at in range(len(w) - size + 1 if own else 0):
                win = shingle_set(" ".join(w[at : at + size]))
                if win & own:
                    sim = sum(map(weight, win & own)) / sum(map(weight, win | own))
                    if sim >= 0.8 and sim > out.get((d, i), (0, 0))[0] + 1e-12:
                        out[d, i] = (sim, at)
    return out


def test_contamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(20)] + [(20, "tiny one"), (21, None), (22, "")]
    texts = [None, "", items[0][1]]
    for _ in range(25):
        text = [word() for _ in range(50)] + rng.choice(items[:20])[1].upper().split() + [word() for _ in range(30)]
        if rng.random() < 0.5:
            text[rng.choice([50, len(text) - 31])] = word()
        texts.append(" ".join(text))
    texts.append("a tiny one b")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in decontaminate.contamination_report(docs(spark, texts), bench).collect()}
    want = brute_contamination(texts, [(i, t) for i, t in items if t])
    assert got.keys() == want.keys() and len(got) > 15
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)
    assert decontaminate.contamination_report(docs(spark, texts), bench.limit(0)).count() == 0


def test_contamination_does_not_depend_on_parts(spark):
    """Weights come from the whole benchmark: one part and one part per item give the same rows."""
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(30)]
    items = [(i, " ".join(words[i : i + 20])) for i in range(8)] + [(3, " ".join(words[3:23]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(["x", "y", *words[a:b]]) for a, b in ((0, 20), (2, 25), (5, 30))] + [" ".join(words * 3000), ""]
    rows = docs(spark, texts + texts[:1]).withColumn("contamination", F.lit("clash"))
    key = lambda r: (r["doc_id"], r["item_id"], r["first_word"], r["words"], round(r["similarity"], 12))
    out = []
    for size in (1, 16 << 20):
        found = decontaminate.find_contamination(rows, bench, part_bytes=size).select("doc_id", F.explode("contamination").alias("m")).select("doc_id", "m.*")
        out.append(Counter(key(r) for r in found.collect()))
    assert out[0] == out[1] and sum(out[0].values()) > 20
    assert Counter(k[1:] for k in out[0].elements() if k[0] == 0) == Counter(k[1:] for k in out[0].elements() if k[0] == 5)


def test_contamination_of_texts_shorter_than_the_item(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(words[:57]), " ".join(words[3:]), " ".join(words[:20]), " ".join(words[:4]), "x " + " ".join(words)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:57]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["words"], r["similarity"]) for r in decontaminate.contamination_report(docs(spark, texts), bench).collect()}
    weight = lambda s: float(np.log1p(2 / sum(s in shingle_set(" ".join(words[:n])) for n in (60, 57))))

    def similarity(a, b):
        a, b = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        return pytest.approx(sum(map(weight, a & b)) / sum(map(weight, a | b)))

    assert got == {
        (0, 1): (0, 57, similarity(words[:57], words)), (0, 2): (0, 57, 1.0),
        (1, 1): (0, 57, similarity(words[3:], words)), (1, 2): (0, 57, similarity(words[3:], words[:57])),
        (4, 1): (1, 60, 1.0), (4, 2): (1, 57, 1.0),
    }


def test_contamination_at_the_threshold():
    """Items with words replaced so that the similarity is just over 0.8: none of the pairs is lost."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(60)] for _ in range(600)]
    bodies = [" ".join(t) for t in items]
    shingles = decontaminate.ta.shingles(*decontaminate._words(pa.array(bodies)), decontaminate.K)[0]
    slots = np.bincount((shingles % np.uint64(decontaminate.SLOTS)).astype(np.int64), minlength=decontaminate.SLOTS)
    part = decontaminate.Part.build(list(range(600)), bodies, slots, 600)
    texts = [" ".join([*t[:30], word(), *t[31:59], word()]) for t in items]
    hits = part.matches(*decontaminate._words(pa.array(texts)), 0.8, decontaminate.RADIUS)
    assert [(d, i) for d, i, *_ in hits] == [(d, d) for d in range(600)]
    assert all(0.8 <= sim < 0.81 for *_, sim in hits)


def test_batches_for_python_are_bounded_in_bytes(spark):
    ship(spark)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text")).mapInArrow(sizes, "n long").collect()
    assert sum(r["n"] for r in rows) >= 40_000_000 and max(r["n"] for r in rows) < 2 * BATCH_BYTES


def least_of(edges):
    """The least node that each node of the edges reaches, by plain merging."""
    of = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in of:
        for u, v in edges:
            if u != v:
                of[u] = of[v] = min(of[u], of[v])
    return of


@pytest.mark.parametrize("part", [None, 7])
def test_components_of_one_part_need_no_exchange(spark, part):
    """Chains, stars, loops, repeated edges and negative ids; in one part no round of stars, in many the same result."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(-5, 2**62), (7, 7), (300, 300), (1, 0)]
    edges += [(a, b) for a, b in ((rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(45))]
    rng.shuffle(edges)
    scratch = Scratch(spark, "components-test")
    given = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = components(given, scratch, "cc", part)
    assert {r["node"]: r["component"] for r in got.collect()} == least_of(edges) and got.count() == len(least_of(edges))
    assert part or "cc-0" not in scratch.paths and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert components(given.limit(0), scratch, "none", part).count() == 0
