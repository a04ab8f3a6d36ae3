"""Alias order, balanced answers, long chains, null lines, named parameters, cosine candidates, streaming replay."""

import math
from collections import Counter

from pyspark.sql import functions as F

from logloom.operators import induction, params, similarity
from logloom.plans.mine import mine_templates
from logloom.streaming.incremental import replay_stream, resolve_alias


def test_alias_order_and_cycles(spark):
    alias = spark.createDataFrame([(1, "A", "B"), (2, "A", "C"), (3, "B", "A"), (3, "C", "B")], "batch long, old_key string, new_key string")
    rows = [(i, k, b) for i, (k, b) in enumerate([("A", 1), ("A", 2), ("A", 3), ("B", 1), ("B", 4), ("C", 2), ("Z", 1)])]
    got = {r.line_id: r.template_key for r in resolve_alias(spark.createDataFrame(rows, "line_id long, template_key string, batch long"), alias).collect()}
    assert got == {0: "A", 1: "B", 2: "A", 3: "A", 4: "B", 5: "B", 6: "Z"}


def test_balanced_answers(spark):
    rows = [("a", 'x {"template": "set {<*>} done"} y'), ("b", '{"a":{"b":1},"template":"t <*>"}'), ("c", '{"template": "one"} {"template": "two"}'),
            ("d", "} no {"), ("e", '{"template": "kept"} {open'), ("f", "{broken}"), ("g", "")]
    got = {r.cluster_key: r.template for r in induction.read_decisions(spark.createDataFrame(rows, "cluster_key string, answer string")).collect()}
    assert got == {"a": "set {<*>} done", "b": "t <*>", "c": "two", "d": "", "e": "kept", "f": "", "g": ""}


def test_long_chain_is_one_component(spark):
    n = 300
    nodes = spark.range(n)
    edges = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1)], "src long, dst long")
    assert similarity.components(nodes, edges).select("component").distinct().collect()[0][0] == 0


def test_null_lines_keep_a_template(spark):
    df = spark.createDataFrame([(0, "User a1 logged in"), (1, None), (2, "User b2 logged in"), (3, "")], "line_id long, line string")
    got = {r.line_id: r.template for r in mine_templates(df).assignments.collect()}
    assert len(got) == 4 and got[1] == got[3] == ""


def test_named_and_exact_parameters(spark):
    rules = [(r"(?P<a>\d+)x\1?", "NUM"), (r"([a-z])\1", "PAIR")]
    df = spark.createDataFrame([(1, "port <NUM> open <PAIR> <*>", "port 12x open  zz  any thing"), (2, "port <NUM>", "port y")],
                               "line_id long, template string, text string")
    plain = {(r.line_id, r.position, r.mask_name, r.value) for r in params.extract_params(df, rules=rules).collect()}
    assert plain == {(1, 0, "NUM", "12x"), (1, 1, "PAIR", "zz"), (1, 2, "*", "any thing"), (2, 0, "NUM", "y")}
    exact = {(r.line_id, r.position, r.value) for r in params.extract_params(df, exact=True, rules=rules).collect()}
    assert {v for v in exact if v[0] == 1} == {(1, 0, "12x"), (1, 1, "zz"), (1, 2, "any thing")}
    assert not [v for v in exact if v[0] == 2]


def test_cosine_pairs_equal_brute_force(spark):
    import random
    rnd = random.Random(1)
    rows = [(i, [rnd.choice("abcdefg") for _ in range(rnd.randint(1, 12))], i, i) for i in range(60)] + [(99, ["a"] * 100 + ["b"], 99, 99), (100, ["a"] * 9 + ["c"], 100, 100)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, min_line long, max_line long")

    def cos(x, y):
        a, b = Counter(x), Counter(y)
        return sum(a[k] * b[k] for k in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    for t in (0.5031, 0.9007):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and cos(a[1], b[1]) >= t}
        assert {(r.a_id, r.b_id) for r in similarity.similar_pairs(df, "cosine", t).collect()} == want


def test_streamed_batches_equal_one_batch(spark):
    lines = spark.range(60).select(F.col("id").alias("line_id"), F.expr(
        "CASE WHEN id % 2 = 0 THEN concat('User ', id + 100, ' logged in') ELSE concat('Disk ', id + 100, ' is full') END").alias("line"))
    one = {(r.template, r.n_lines) for r in mine_templates(lines).catalog.collect()}
    for chunks in (1, 3):
        assert {(r.template, r.n_lines) for r in replay_stream(spark, lines, chunks).collect()} == one
    shuffled = {(r.template, r.n_lines) for r in mine_templates(lines.repartition(7)).catalog.collect()}
    assert shuffled == one


def test_replayed_chunks_are_many_files(spark, monkeypatch):
    from logloom.streaming import incremental
    lines = spark.createDataFrame([(i, f"user {i % 7} logged in from host h{i % 3}") for i in range(400)], "line_id bigint, line string")
    one = {(r.template, r.n_lines) for r in replay_stream(spark, lines, 2).collect()}
    sizes, process = [], incremental.process_batch
    monkeypatch.setattr(incremental, "FILE_ROWS", 50)
    monkeypatch.setattr(incremental, "process_batch", lambda df, *a: sizes.append((df.count(), df.select(F.input_file_name()).distinct().count())) or process(df, *a))
    assert {(r.template, r.n_lines) for r in replay_stream(spark, lines, 2).collect()} == one
    assert [n for _, n in sizes] == [4, 4] and sum(n for n, _ in sizes) == 400
