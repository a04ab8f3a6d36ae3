"""Static key, entropy, match guard, mergeability, alignment, header, metrics."""

from pyspark.sql import functions as F

from logloom.operators import induction, matching, merging
from logloom.operators.align import align_pair, positional_merge
from logloom.operators.metrics import score
from logloom.operators.tokens import static_keys, vocabulary_from_list
from logloom.sources.raw_logs import compile_header, parse_headers


def _contents(spark, texts):
    rows = [(t, t.split(), 1, i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "canon string, tokens array<string>, n long, min_line long, max_line long")


def test_static_key(spark):
    cc = _contents(spark, ["User logged in id = <*>"])
    k = static_keys(cc, vocabulary_from_list(spark, ["User", "logged", "in"])).first().static_key
    assert k == "0User1logged2in4="


def test_entropy_values(spark):
    rows = [("k", "a x", 2, 0), ("k", "a y", 1, 5), ("k", "a z", 1, 6)]
    c = spark.createDataFrame([(k, t, t.split(), n, m, m) for k, t, n, m in rows],
                              "cluster_key string, canon string, tokens array<string>, n long, min_line long, max_line long")
    ps = induction.position_entropy(c, vocabulary_from_list(spark, ["a"])).where("pos = 1").first()
    assert round(ps.entropy, 6) == 1.5


def test_match_guard(spark):
    v = vocabulary_from_list(spark, ["password"])
    pairs = spark.createDataFrame([("Accepted password from <*>", "Accepted <*> from <*>"),
                                   ("Accepted x9 from <*>", "Accepted <*> from <*>")], "content string, template string")
    got = {r.content for r in matching.template_match(pairs, v).collect()}
    assert got == {"Accepted x9 from <*>"}


def test_mergeable(spark):
    cat = spark.createDataFrame([("a <*> c",), ("a b c",), ("x y",), ("x z",), ("q",), ("q r s t",)], "template string") \
        .withColumn("template_key", F.md5("template"))
    pairs = merging.mergeable_pairs(cat, vocabulary_from_list(spark, []))
    names = {r.template_key: r.template for r in cat.collect()}
    got = {frozenset((names[r.a_key], names[r.b_key])) for r in pairs.collect()}
    assert got == {frozenset(("a <*> c", "a b c"))}


def test_align_and_positional():
    assert align_pair("a b c".split(), "a x y c".split()) == ["a", "<*>", "c"]
    assert positional_merge("a <*> c".split(), "a b c".split()) == ["a", "<*>", "c"]
    assert positional_merge("a b".split(), "a c".split()) is None


def test_header_linux(spark):
    hf = compile_header("<Month> <Date> <Time> <Level> <Component>(\\[<PID>\\])?: <Content>")
    df = spark.createDataFrame([("Jun 14 15:16:01 combo sshd(pam_unix)[19939]: check pass",),
                                ("Jun 14 15:16:01 combo su: hi",), ("garbage",)], "line string")
    rows = parse_headers(df, hf).collect()
    assert len(rows) == 2
    pids = sorted((r.PID or "") for r in rows)
    assert pids == ["", "19939"]


def test_metrics_fixture(spark):
    pred = spark.createDataFrame([(1, "A", "t1"), (2, "A", "t1"), (3, "B", "t2"), (4, "C", "t2")],
                                 "line_id long, event_id string, template string")
    truth = spark.createDataFrame([(1, "e1", "t1"), (2, "e1", "t1"), (3, "e2", "t2"), (4, "e2", "t2")],
                                  "line_id long, event_id string, template string")
    s = score(pred, truth).first()
    assert (s.ga, s.pga, s.rga, s.fga) == (0.5, 0.3333, 0.5, 0.4)
    assert (s.pa, s.fta) == (1.0, 0.4)


def test_leaderboard_and_summary(spark, tmp_path):
    from logloom.operators import runs
    line = ("Evaluation on Dataset: {d}, Group Accuracy: {g}, PA Accuracy: 0.5000, FGA: 0.5000, FTA: 0.5000, "
            "Duration: 1.00 sec, Total of 2000 lines, rate 2000.0 lines/sec, 3 templates, "
            "Total LLM Call count: 0, Total LLM Call Tokens: 0")
    rows = [(1, line.format(d="A", g="0.9000")), (2, line.format(d="A", g="0.9000")), (3, line.format(d="B", g="0.7000")),
            (4, "noise")]
    r = runs.read_runs(spark.createDataFrame(rows, "seq long, line string"))
    best = {x.dataset: x.seq for x in runs.best_run(r).collect()}
    assert best == {"A": 1, "B": 3}
    lb = {x.dataset: x.ga for x in runs.leaderboard(r).collect()}
    assert lb["Average"] == 0.8
    runs.write_summary(runs.leaderboard(r), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
