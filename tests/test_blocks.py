import random

import pytest

from logloom.operators import similarity
from logloom.operators.blocks import block_pairs
from pyspark.sql import functions as F

KIND = "id long, tokens array<string>, min_line long, max_line long"


def contents(seed=3):
    """Near copies, copies, short texts and texts of frequent words; two rows share an id, one has none."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(160):
        base = [words[min(399, int(rnd.expovariate(1 / 60)))] for _ in range(rnd.randint(1, 90))]
        out.append((i, base))
        if i % 4 == 0:
            out.append((1000 + i, [w for w in base if rnd.random() > 0.1] or base))
        if i % 10 == 0:
            out.append((2000 + i, base))
    return [(i, t, i % 50, i % 50 + rnd.randint(0, 9)) for i, t in out] + [(5, out[5][1], 5, 5), (None, out[6][1], 6, 6), (9999, [], 1, 1), (9998, None, 1, 1)]


def brute(spark, rows, measure, sim_th):
    df = spark.createDataFrame(rows, KIND).where("size(tokens) > 0")
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    scored = similarity.score_pairs(a.join(b, F.col("a_id") < F.col("b_id")), measure)
    near = F.col("score") >= sim_th if sim_th else (
        (F.col("a_min_line") < F.col("b_max_line")) & (F.col("score") >= similarity.dynamic_threshold(F.size("a_tokens")))
        | (F.col("b_min_line") < F.col("a_max_line")) & (F.col("score") >= similarity.dynamic_threshold(F.size("b_tokens"))))
    return sorted((r.a_id, r.b_id, round(r.score, 9)) for r in scored.where(near).collect())


@pytest.mark.parametrize("measure,sim_th", [("jaccard", 0.2), ("jaccard", 0.3), ("jaccard", 0.0), ("cosine", 0.97), ("cosine", 0.6)])
def test_pairs_equal_brute_force(spark, measure, sim_th):
    rows = contents()
    df = spark.createDataFrame(rows, KIND).repartition(4)
    want = brute(spark, rows, measure, sim_th)
    got = similarity.similar_pairs(df, measure, sim_th)
    assert sorted((r.a_id, r.b_id, round(r.score, 9)) for r in got.collect()) == want and want
    small = block_pairs(df, measure, (lambda n: F.lit(sim_th)) if sim_th else similarity.dynamic_threshold, not sim_th, block_tokens=1000)
    assert sorted((r.a_id, r.b_id, round(r.score, 9)) for r in small.collect()) == want


def test_ids_of_strings(spark):
    rows = [(f"t{i}", t, lo, hi) for i, t, lo, hi in contents(8) if i is not None and t]
    df = spark.createDataFrame(rows, KIND.replace("id long", "id string"))
    assert {(r.a_id, r.b_id) for r in similarity.similar_pairs(df, "jaccard", 0.5).collect()} == {
        (a, b) for a, b, _ in brute_strings(rows, 0.5)}


def brute_strings(rows, least):
    sets = [(i, set(t)) for i, t, _, _ in rows if t]
    return [(a, b, 0) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) >= least]


def test_no_candidate_is_shuffled(spark):
    """Only the blocks and the tokens' frequencies are exchanged, not pairs (before: a shuffle of every candidate)."""
    df = spark.createDataFrame(contents(), KIND)
    plan = similarity.similar_pairs(df, "jaccard", 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Distinct" not in plan and "Aggregate" not in plan


def test_blocks_of_other_sizes_do_not_meet(spark):
    """Two blocks whose contents' sizes are too far apart for the threshold are left out (before: every two met)."""
    df = spark.createDataFrame(contents(), KIND)
    plan = similarity.similar_pairs(df, "jaccard", 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "a_large" in plan and "b_small" in plan and "RepartitionByExpression" in plan


def test_few_pairs_are_compared_in_full():
    """Short vectors leave the near pairs of two blocks, and some others (before: prefixes of a third of the tokens)."""
    import pickle

    import numpy as np
    from logloom.operators import blocks

    rnd = np.random.default_rng(5)
    hashes = rnd.integers(-1 << 62, 1 << 62, 3000)
    packer = blocks._Packer(hashes[:blocks.FREQUENT], True)
    rows = [hashes[np.minimum(2999, rnd.exponential(400, 120)).astype(int)] for _ in range(200)]
    rows += rows[:20]
    packer.add([(i, i, i, 0.97) for i in range(len(rows))], np.concatenate(rows), np.array([len(x) for x in rows]))
    block = pickle.loads(packer.packed()["content"])
    asked = sum(len(js) for _, js, _ in blocks._met_cosine(block, block))
    assert {(i, j) for i, js, _ in blocks._similar(block, block, True, True, False) for j in js.tolist()} == {(i, 200 + i) for i in range(20)}
    assert asked < 0.05 * len(rows) ** 2


def test_dynamic_threshold_does_not_compare_every_two_blocks(spark):
    """What is compared shares a rare token: no product of all blocks (before: one)."""
    df = spark.createDataFrame(contents(4), KIND)
    found = similarity.similar_pairs(df, "jaccard", 0.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "a_block" not in plan
    assert sorted((r.a_id, r.b_id, round(r.score, 9)) for r in found.collect()) == brute(spark, contents(4), "jaccard", 0.0)


def test_a_task_leaves_out_edges_that_link_nothing(spark):
    """Edges of a clique are as many as its nodes before any is sent (before: every edge was)."""
    import pyarrow as pa

    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60)] + [(100, 101), (101, 102), (100, 102)]
    batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs[k::3]], "b": [b for _, b in pairs[k::3]]}) for k in range(3)]
    assert sum(x.num_rows for x in similarity._linking(iter(batches))) == 61
    edges = spark.createDataFrame([*pairs, (None, 5), (7, 7)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(60), 100, 101, 102, 103]], "id long")
    assert {(r.id, r.component) for r in similarity.components(nodes, edges).collect()} == {
        (i, 0) for i in range(60)} | {(100, 100), (101, 100), (102, 100), (103, 103)}
