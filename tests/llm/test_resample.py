import hashlib
import math
import random
import re
import zlib

import numpy as np

from logloom.llm import resample as R

DOC = "doc_id long, text string, rank long, score long, b string"


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def features(t, run, buckets):
    w = words(t)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=10, run=1, buckets=10_000, min_words=20):
    rows = [(d, features(t, run, buckets), len(words(t))) for d, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, f, _ in rows:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x, run, buckets):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for d, f, n in rows:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def test_planes_give_exact_sums():
    rnd = np.random.default_rng(4)
    for buckets, high in ((64, 1), (100, 40_000), (10_000, 1 << 40)):
        gain = rnd.integers(-high, high, buckets)
        docs = [rnd.integers(0, buckets, n).astype(np.uint16) for n in (0, 1, 5, 300, 20_000)] + [np.full(70_000, 3, np.uint16)]
        want = [sum(int(gain[b]) for b in d) for d in docs]
        assert R.GainPlanes(gain).sums(docs).tolist() == want
    assert R.GainPlanes(np.zeros(10, np.int64)).sums([np.zeros(4, np.uint16)]).tolist() == [0]


def test_pieces_do_not_change_the_features():
    rnd = random.Random(6)
    text = "".join(rnd.choice(["ab", "Zé", " ", "--", "7", "東"]) for _ in range(4000)) + "x" * 90 + " end"
    want = {run: sorted(features(text, run, 999)) for run in (1, 2, 4)}
    old = R.PIECE_BYTES
    try:
        for size in (1, 2, 7, 64, 1 << 20):
            R.PIECE_BYTES = size
            for run in (1, 2, 4):
                got, n = R.feature_buckets(text.encode(), run, 999)
                assert sorted(got.tolist()) == want[run] and n == len(words(text))
    finally:
        R.PIECE_BYTES = old


def data():
    rnd = random.Random(9)
    vocab = ["alpha", "Beta", "x1", "Größe", "東京", "tail", "of", "the"]
    docs = [(i, " ".join(rnd.choice(vocab[:3 + i % 6]) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    docs += [(5, docs[7][1]), (None, docs[30][1]), (1000, None), (1001, ""), (1002, "..."), (1003, "the " * 9000)]
    docs += [(50, docs[50][1])] * 100  # one row again and again
    return docs, ["the x1 of alpha", None, "", "Beta " * 30]


def test_resampling_equals_brute_force(spark):
    docs, target = data()
    df = spark.createDataFrame([(d, t, 0, 0, "b") for d, t in docs], DOC).repartition(6)
    bm = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, run in ((10, 1), (100, 2), (0, 1)):
        got = R.resample(df, bm, percent, run)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, percent, run)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b", 0, 0, "")], DOC)
    bm = spark.createDataFrame([], "text string")
    assert R.resample(none, bm).count() == 0
    assert [tuple(r)[:4] for r in R.resample(one, bm).collect()] == [tuple(r)[:4] for r in brute([(1, "a b")], [])]
    assert R.resample(none, one).count() == 0
