import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.operators import align as A
from logloom.operators import forests as G


def table_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(cur[j], prev[j + 1]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=150), st.lists(st.sampled_from("abcde"), max_size=150))
def test_lcs_by_bits_equals_the_table(a, b):
    assert A.lcs_length(A.token_masks(a), len(a), b) == table_lcs(a, b)


def least(n):
    return 1 - math.log(n) / math.log(2) / n


def similar(a, b, measure, sim_th):
    (_, ta, amin, amax), (_, tb, bmin, bmax) = a, b
    sa, sb = " ".join(ta), " ".join(tb)
    short, long = sorted((sa, sb), key=len)
    if measure == "jaccard":
        s = len(set(ta) & set(tb)) / len(set(ta) | set(tb))
    elif short in long:
        s = 1.0
    elif abs(len(ta) - len(tb)) > min(len(ta), len(tb)):
        s = 0.0
    else:
        s = table_lcs(ta, tb) / min(len(ta), len(tb))
    if sim_th:
        return s >= sim_th
    return (amin < bmax and s >= least(len(ta))) or (bmin < amax and s >= least(len(tb)))


def labels(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def contents():
    rnd = random.Random(11)
    vocab = ["open", "close", "ab", "abc", "x", "<*>", "user", "disk", "é1", "failed"]
    texts = {tuple(rnd.choice(vocab[:3 + i % 8]) for _ in range(rnd.randint(1, 7))) for i in range(160)}
    texts |= {("b",), ("c", "o"), ("n", "clo"), ("zz",), ("q" * 5, "w" * 4), ("qw",), ("q w",), tuple(f"t{i}" for i in range(90)),
              tuple(f"t{i}" for i in range(0, 90, 2)), ("alone", "here")}
    rows = [(i, list(t), rnd.randint(0, 400)) for i, t in enumerate(sorted(texts))]
    return [(i, t, first, first + rnd.choice([0, 0, 50])) for i, t, first in rows]


def test_forests_have_the_components_of_all_pairs(spark):
    rows = contents()
    df = spark.createDataFrame(rows, "id long, tokens array<string>, min_line long, max_line long")
    for measure, sim_th, block in (("lcs", 0.0, G.BLOCK_ROWS), ("lcs", 0.7, 9), ("jaccard", 0.0, G.BLOCK_ROWS), ("jaccard", 0.6, 9)):
        pairs = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1:] if similar(a, b, measure, sim_th)}
        links = {tuple(sorted((r.src, r.dst))) for r in G.similar_links(df, measure, sim_th, block).collect()}
        assert links <= pairs
        assert labels([r[0] for r in rows], links) == labels([r[0] for r in rows], pairs)


def test_a_dense_bucket_gives_a_tree(spark):
    rows = [(i, ["job", "started", "by", f"u{i}", "on", "host"], i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, min_line long, max_line long")
    links = G.similar_links(df).collect()
    assert len(links) <= 5 * len(rows)  # all pairs: 79,800
    assert {r.component for r in G.linked_components(df).collect()} == {0}


def test_empty_and_wordless_contents(spark):
    schema = "id long, tokens array<string>, min_line long, max_line long"
    assert G.similar_links(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, [], 0, 0), (2, ["a"], 1, 1), (3, None, 2, 2)], schema)
    assert sorted(map(tuple, G.linked_components(df).collect())) == [(1, 1), (2, 2), (3, 3)]
