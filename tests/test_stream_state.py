"""Catalog changes, snapshots, questions and answers of the stream; batches replayed after a failure."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from logloom.operators import merging
from logloom.operators.tokens import vocabulary_from_list
from logloom.plans.mine import mine_templates
from logloom.streaming import incremental as I

from .test_matching import templates_to_merge

WORDS = ["Job", "state", "moved", "to", "disk", "is", "full", "user", "left"]


def _batch(spark, start, texts):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "line_id bigint, line string")


def _state():
    return tempfile.mkdtemp(prefix="state-", dir="/tmp")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _stream(spark, state, batches, vocab):
    for i, b in enumerate(batches):
        I.process_batch(b, i, state, vocab, rules=[])


def _batches(spark):
    return [_batch(spark, 0, ["user a1 left", "disk <*> is full", "user b2 left"]),
            _batch(spark, 10, ["user c3 left", "disk x is <*>", "user a1 left"]),
            _batch(spark, 20, ["disk y is full", "user d4 left d5", "<*> <*> <*> left"])]


def test_only_changes_are_written_and_add_up(spark, monkeypatch):
    vocab, (full, cut) = vocabulary_from_list(spark, WORDS).checkpoint(), (_state(), _state())
    _stream(spark, full, _batches(spark), vocab)
    want = I.load_catalog(spark, full)
    assert want.agg(F.sum("n_lines")).first()[0] == 9
    changed = I._read_batches(spark, full, "catalog")
    assert changed.where("batch = 1").count() < I.load_catalog(spark, full, 2).count() + changed.where("batch = 1 AND gone").count()
    done = I.final_assignments(spark, full)
    assert done.count() == 9 and done.join(want, "template_key", "left_anti").count() == 0
    monkeypatch.setattr(I, "COMPACT_EVERY", 2)  # a snapshot after batch 1
    _stream(spark, cut, _batches(spark), vocab)
    assert I._read_batches(spark, cut, "snapshot").select("batch").distinct().count() == 1
    assert _rows(I.load_catalog(spark, cut)) == _rows(want)


def test_a_batch_replayed_after_a_failure(spark, monkeypatch):
    vocab, state, clean = vocabulary_from_list(spark, WORDS).checkpoint(), _state(), _state()
    batches = _batches(spark)[:2]
    _stream(spark, clean, batches, vocab)
    I.process_batch(batches[0], 0, state, vocab, rules=[])
    write = I._write_batch

    def failing(df, state_dir, name, batch_id):
        if name == "catalog":
            raise RuntimeError("lost")
        write(df, state_dir, name, batch_id)
    monkeypatch.setattr(I, "_write_batch", failing)
    with pytest.raises(RuntimeError):
        I.process_batch(batches[1], 1, state, vocab, rules=[])
    assert I.last_batch(spark, state) == 0 and I.final_assignments(spark, state).count() == 3  # its assignments do not count yet
    monkeypatch.setattr(I, "_write_batch", write)
    I.process_batch(batches[1], 1, state, vocab, rules=[])
    assert _rows(I.load_catalog(spark, state)) == _rows(I.load_catalog(spark, clean))
    assert _rows(I.final_assignments(spark, state)) == _rows(I.final_assignments(spark, clean))


def test_answers_change_later_batches(spark):
    vocab, state = vocabulary_from_list(spark, WORDS).checkpoint(), _state()
    first = ["Job state moved to k1", "Job state moved to k2"]
    I.process_batch(_batch(spark, 0, first), 0, state, vocab, rules=[])
    asked = I.read_queue(spark, state)
    assert {r["sample"] for r in asked.collect()} == set(first)
    assert {r.template for r in I.load_catalog(spark, state).collect()} == set(first)  # no answer yet: I11
    I.write_decisions(asked.select("cluster_key", F.lit("wrong").alias("template")).distinct(), state)
    I.write_decisions(asked.select("cluster_key", F.lit("Job state moved to <*>").alias("template")).distinct(), state)
    I.process_batch(_batch(spark, 10, ["Job state moved to k3", "Job state moved to k4"]), 1, state, vocab, rules=[])
    assert I.read_queue(spark, state).where("batch = 1").count() == 0
    cat = {r.template: (r.n_lines, r.first_line) for r in I.load_catalog(spark, state).collect()}
    assert cat == {"Job state moved to <*>": (4, 0)}  # the templates of batch 0 merged into the answer
    assert I.final_assignments(spark, state).select("template_key").distinct().count() == 1


def test_the_miner_returns_its_questions(spark):
    lines = _batch(spark, 0, ["Job state moved to k1", "Job state moved to k2", "disk x is full"])
    vocab = vocabulary_from_list(spark, WORDS)
    got = mine_templates(lines, vocab, rules=[]).queue.collect()
    assert [(r["mode"], r["rank"], r["sample"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, 1, "Job state moved to k1"), (1, 2, "Job state moved to k2")]
    answers = spark.createDataFrame([(got[0]["cluster_key"], "")], "cluster_key string, template string")
    assert mine_templates(lines, vocab, rules=[], decisions=answers).queue.count() == 0


def test_merging_into_a_settled_catalog_equals_merging_all(spark):
    rnd, vocab = random.Random(12), vocabulary_from_list(spark, ["user"]).checkpoint()
    rows = [(t, rnd.randint(1, 9), i) for i, t in enumerate(templates_to_merge(rnd, 16))]
    schema = "template string, n_lines long, first_line long"
    old = spark.createDataFrame(rows[::2], schema)
    alias = merging.merge_templates(old, vocab)
    settled = merging.apply_alias(old, alias).groupBy("template").agg(F.sum("n_lines").alias("n_lines"), F.min("first_line").alias("first_line"))
    both = (settled.withColumn("settled", F.lit(True)).unionByName(spark.createDataFrame(rows[1::2], schema).withColumn("settled", F.lit(False)))
            .groupBy("template").agg(F.sum("n_lines").alias("n_lines"), F.min("first_line").alias("first_line"), F.max("settled").alias("settled"))).checkpoint()
    want = {tuple(r) for r in merging.merge_templates(both.drop("settled"), vocab).collect()}
    assert want and {tuple(r) for r in merging.merge_templates(both, vocab).collect()} == want
