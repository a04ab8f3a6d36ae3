import hashlib

import numpy as np
import pytest

from logloom.llm import centroids as C

VEC = "vec_id long, embedding array<float>, label int, cluster int, v string"


def brute(rows, dim, scale, k, rounds):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *near(v)) for i, v in kept]
    total = {j: sum(d for _, d, o in got if o == j) for j in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, total[j], sum(total.values()), sha[j]) for i, d, j in got), key=repr)


@pytest.mark.parametrize("dim,values,k", [(1, 3, 9), (2, 4, 16), (8, 2, 30), (64, 500, 40)])
def test_tree_equals_full_search_with_ties(dim, values, k):
    rnd = np.random.default_rng(dim)
    x, c = rnd.integers(-values, values, (500, dim)), rnd.integers(-values, values, (k, dim))
    full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for leaf in (1, 2, 5, k):
        number, best = C.VantageTree(c, leaf).nearest(x)
        assert (number == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


def test_tree_prunes_and_is_exact_at_the_limit():
    rnd = np.random.default_rng(3)
    c = np.concatenate([rnd.integers(-9, 9, (20, 64)) + m for m in (-C.LIMIT + 9, 0, C.LIMIT - 9)])
    x = np.repeat(c, 3, axis=0)
    x[::3, 0] += 1
    x = np.clip(x, -C.LIMIT, C.LIMIT)
    full = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x[:30]], dtype=object)
    number, best = C.VantageTree(c).nearest(x[:30])
    assert number.tolist() == [int(np.argmin(r)) for r in full] and best.tolist() == [int(min(r)) for r in full]
    seen = []
    old, C.squared = C.squared, lambda a, b: seen.append(len(a)) or old(a, b)
    try:
        C.VantageTree(c).nearest(x)
    finally:
        C.squared = old
    assert sum(seen) < len(x) * len(c)


def data():
    rnd = np.random.default_rng(8)
    rows = [(i, (rnd.integers(-40, 40, 6) / 16).astype(np.float32).tolist()) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (500, rows[4][1]), (501, rows[4][1])]
    bad = [(601, None), (602, []), (603, rows[0][1][:5]), (604, rows[0][1][:5] + [None]), (605, rows[0][1][:5] + [float("nan")]),
           (606, rows[0][1][:5] + [float("-inf")]), (607, rows[0][1] * 2)]
    return rows + bad


def test_clusters_equal_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(i, v, 0, 5, "x") for i, v in rows], VEC).repartition(4)
    for k, rounds in ((16, 3), (5, 0), (500, 2)):
        got = sorted((tuple(r) for r in C.cluster(df, dim=6, scale=16, k=k, rounds=rounds).collect()), key=repr)
        assert got == brute(rows, 6, 16, k, rounds)


def test_empty_and_too_wide(spark):
    none = spark.createDataFrame([], VEC)
    assert C.cluster(none).count() == 0
    assert C.cluster(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large for 64 bits"):
        C.cluster(spark.createDataFrame([(1, [1e30] * 64, 0, 0, "")], VEC)).collect()
