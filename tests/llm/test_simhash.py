import random

import numpy as np
from pyspark.sql import functions as F

from logloom.llm import simhash as S

A = "doc_id long, text string, root string, fp string, key long"


def brute(rows):
    fps = {}
    for i, t in rows:
        fps.setdefault(S.fingerprint_of(t), []).append(i)
    nodes = list(fps)
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= 4:
                parent[find(a)] = find(b)
    low = {}
    for n in nodes:
        for i in fps[n]:
            r = find(n)
            low[r] = i if r not in low else min(low[r], i)
    return sorted((i, f"{n:016x}", low[find(n)]) for n in nodes for i in fps[n])


def test_index_sets_share_within_two_bits():
    bits = 1 << np.arange(23, dtype=np.int64)
    errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])]
    leaders = S.ERRORS[:, 0]
    own = S.indices(leaders)
    assert (np.bitwise_count(S.ERRORS[:, 1:]) <= 4).all()
    assert (S._remainder(S.ERRORS) == np.arange(2048)[:, None]).all()
    for e in errors:
        other = S.indices(leaders ^ e)
        assert (own[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_keys_lose_no_link_and_one_key_reports_it():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64) * 2 + 1
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
    own = S._own_key(x, y)
    assert (own >= 0).all()
    for part in (x, y):
        rows, keys = S.fuzzy_keys(part.view(np.int64))
        assert len(set(zip(rows.tolist(), keys.tolist()))) == len(rows)
        have = set(zip(rows.tolist(), keys.tolist()))
        assert all((i, k) in have for i, k in enumerate(own.tolist()))


def test_fingerprint_matches_spark_hash(spark):
    t = "Ab cD\tef\x0bgh  ij\n"
    sh = ["ab cd ef gh", "cd ef gh ij"]
    h = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in sh], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 2)
    assert S.fingerprint_of(t) == want
    assert S.fingerprint_of("") == S.fingerprint_of(None) == S.fingerprint_of(" \n") == 0


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (3, "one two"), (4, "é x")]
    i = 10
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 400))]
        for _ in range(rnd.randint(1, 8)):
            t = list(base)
            for _ in range(rnd.randint(0, 2)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((i, " ".join(t)))
            i += 1
    rows.append((i, " ".join(words) * 40))
    return rows + rows[7:9]


def test_near_dedup_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], A)
    got = sorted((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in S.near_dedup(df).collect())
    assert got == brute(rows)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_long_runs_are_split(spark):
    rng = np.random.default_rng(1)
    base = np.uint64(0x123456789ABCDEF1)
    fps = {int(base)}
    for _ in range(900):
        f = base
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            f ^= np.uint64(1) << np.uint64(b)
        fps.add(int(f))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    from logloom.llm.components import components
    for limit in (S.RUN_LIMIT, 60):
        comp = components(S.links(df, run_limit=limit))
        assert comp.select("root").distinct().count() == 1 and comp.count() == len(fps)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], A)
    assert S.near_dedup(empty).count() == 0 and S.keep_one(empty).count() == 0
    df = spark.createDataFrame([(None, "a b", None, None, None), (None, "a b", None, None, None), (5, "A B", None, None, None)], A)
    assert {r.component_id for r in S.near_dedup(df).collect()} == {5}
    assert [r.doc_id for r in S.keep_one(df).collect()] == [5]


def test_distinct_fingerprints_are_dealt_out_anew(spark):
    fps = spark.range(500).select((F.col("id") % 90).alias("fp")).distinct()
    assert S.spread(fps).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_blocks_of_a_split_run_are_never_given_up(spark):
    fp = np.concatenate([np.uint64(i) ^ np.r_[np.uint64(0), np.uint64(1) << np.arange(22, 64, dtype=np.uint64)] for i in (0, 1 << 8)])
    df = spark.createDataFrame([(int(f),) for f in np.unique(fp).view(np.int64)], "fp long")
    for limit in (6, 1000):  # runs split into blocks, and none
        edges = S.links(df, run_limit=limit).collect()
        seen = {int(f): int(f) for f in np.unique(fp).view(np.int64)}

        def root(x):
            while seen[x] != x:
                x = seen[x]
            return x
        for u, v in edges:
            seen[root(u)] = root(v)
        assert len({root(x) for x in seen}) == 1
