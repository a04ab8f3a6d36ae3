"""Rules table, line numbers, top values and sketches."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import params, runs
from logloom.sources import layouts, raw_logs

LINES = "dataset string, line string, content2 string"


def test_rules_table_parses_each_dataset_by_its_own_rules(spark):
    rules = spark.createDataFrame([("a", "<T> <Content>", [r"\d+"], ["secret "]), ("b", r"\[<T>\](\(<P>\))? <Content>", None, None), ("c", None, [], [])], layouts.RULES_SCHEMA)
    lines = spark.createDataFrame([("a", "t1 secret x 12  ", "k"), ("a", "alone", "k"), ("b", "[t2](p) x 12", "k"), ("b", " [t3] y", "k"),
                                   ("b", "t4 y", "k"), ("c", " whole 1 ", "k"), ("d", "t5 x", "k"), ("a", None, "k"), (None, "t x", "k"), ("a", "", "k")], LINES)
    got = layouts.for_datasets(lines, rules, fields=("T", "P", "Z"))
    assert got.columns == ["dataset", "content2", "T", "P", "Z", "content"]
    assert sorted((r.dataset, r.T, r.P, r.Z, r.content) for r in got.collect() if r.T) == [
        ("a", "t1", None, None, "x <*>"), ("b", "t2", "p", None, "x 12"), ("b", "t3", None, None, "y")]
    assert [r.content for r in got.where("dataset = 'c'").collect()] == ["whole 1"]
    assert layouts.for_datasets(lines, rules.where("false"), fields=("T",)).collect() == []
    assert layouts.for_datasets(lines.where("false"), rules).count() == 0
    with pytest.raises(ValueError):
        layouts.for_datasets(lines, rules.union(rules))


def test_known_layouts_compile(spark):
    table = layouts.layouts(spark)
    assert table.count() == len({r[0] for r in layouts.LAYOUTS}) == 18
    line = spark.createDataFrame([("Mac", "Jul  1 09:00:55 host kernel[0] (x): hello a.b.c.d", ""), ("Proxifier", "[10.30 16:49:06] chrome.exe - proxy:80 close, 0 bytes (1.5 KB) sent", "")], LINES)
    got = {r.dataset: (r.PID, r.content) for r in layouts.for_datasets(line, table, fields=("PID",)).collect()}
    assert got["Mac"] == ("0", "hello <*>")
    assert got["Proxifier"] == (None, "proxy:80 close, 0 bytes sent")


@pytest.mark.parametrize("buckets", [1, 3, 200])
def test_line_numbers_by_group(spark, buckets):
    rows = [(("hot" if i % 3 else None) if i % 5 else "x", (i * 7919) % 5003) for i in range(3000)]
    got = raw_logs.number_rows(spark.createDataFrame(rows, "g string, k long"), "k", by=("g",), buckets=buckets).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.k, r.LineId) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert len(got) == len(rows)
    assert raw_logs.number_rows(spark.createDataFrame([], "g string, k long"), "k", buckets=buckets).count() == 0


def test_sums_before(spark):
    df = spark.createDataFrame([(i // 7, i % 7, i + 1) for i in range(100)], "a long, b long, v long")
    got = {(r.a, r.b): r.off for r in raw_logs.sum_before(df, ["a", "b"], "v", "off").collect()}
    assert got == {(i // 7, i % 7): i * (i + 1) // 2 for i in range(100)}


def test_run_files_are_numbered_in_order(spark, tmp_path):
    line = ("x Evaluation on Dataset: {d}, Group Accuracy: 0.5, PA Accuracy: 0.5, FGA: 0.5, FTA: 0.5, Duration: {n}.0 sec, Total of 9 lines, "
            "rate 1.5 lines/sec, 3 templates, Total LLM Call count: 1, Total LLM Call Tokens: 2")
    for f in range(3):
        (tmp_path / f"log{f}.txt").write_text("\n".join(["other"] + [line.format(d="d", n=10 * f + i) for i in range(4)]) + "\n")
    got = runs.read_run_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 13)) and [r.duration for r in got] == [10.0 * f + i for f in range(3) for i in range(4)]
    assert runs.best_run(runs.read_run_files(spark, str(tmp_path))).first().seq == 1


def _values(spark):
    rows = spark.range(60000).select(F.lit("t").alias("template"), F.col("id").alias("line"), F.lit(0).alias("position"), F.concat(F.lit("v"), F.col("id") % 30000).alias("value"))
    few = spark.range(5000).select(F.lit("t").alias("template"), F.col("id").alias("line"), F.lit(1).alias("position"),
                                   F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), F.col("id") % 9)).alias("value"))
    return rows.unionByName(few)


def test_sketches_add_up_over_batches(spark):
    p = _values(spark).withColumn("batch", F.col("line") % 5)
    parts = params.param_sketches(p, by=("batch",))
    one = {r.position: r for r in params.sketch_profile(params.merge_sketches(parts)).collect()}
    assert one[0].n_values == 60000 and abs(one[0].n_distinct - 30000) < 0.08 * 30000
    assert one[1].n_values == 5000 and one[1].n_distinct == 4
    assert [(t["item"], t["count"]) for t in one[1].top][0] == ("hot", 3333)
    again = params.merge_sketches(params.merge_sketches(parts.where("batch < 2")).unionByName(params.merge_sketches(parts.where("batch >= 2"))))
    assert {r.position: (r.n_values, r.n_distinct) for r in params.sketch_profile(again).collect()} == {k: (v.n_values, v.n_distinct) for k, v in one.items()}


def test_top_values(spark):
    got = params.top_values(_values(spark), 2)
    assert sorted((r.position, r.rank, r.value, r.n) for r in got.collect()) == [(0, 1, "v0", 2), (0, 2, "v1", 2), (1, 1, "hot", 3333), (1, 2, "w0", 556)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    prof = {r.position: r for r in params.param_profile(_values(spark)).collect()}
    assert (prof[1].n_values, prof[1].n_distinct, prof[1].top_value, prof[1].top_count) == (5000, 4, "hot", 3333)
