import numpy as np
from pyspark.sql import functions as F

from logloom.llm import quality as Q
from logloom.llm.common import table

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, score string, y string, quality string"


def test_partial_sums_equal_brute_force():
    import pyarrow as pa
    texts = ["a b a, c", None, "", "x " * 50, "Ünï 12 12ab ###"]
    index = Q.index_vectors().astype(np.int64)
    want = np.zeros((Q.BUCKETS, Q.DIM), np.int64)
    for t in texts:
        ids = [int(i) for p in Q.bucket_pieces(t) for i in p]
        for i, w in enumerate(ids):
            for j in range(max(0, i - Q.CONTEXT), min(len(ids), i + Q.CONTEXT + 1)):
                if j != i:
                    want[w] += index[ids[j]]
    out = next(Q._partial_sums([pa.RecordBatch.from_pydict({"text": texts})]))
    got = np.concatenate([np.frombuffer(v, np.int64) for v in out.column("v").to_pylist()]).reshape(want.shape)
    got = got.copy()
    got[0] = 0
    assert (got == want).all()


def test_pieces_join_to_the_whole(monkeypatch):
    text = "one two, three### four five " * 40
    whole = np.concatenate(list(Q.bucket_pieces(text)))
    monkeypatch.setattr(Q, "PIECE_BYTES", 37)
    assert (np.concatenate(list(Q.bucket_pieces(text))) == whole).all()


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = Q.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc"),
                F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept"),
                F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted"))).alias("caught"),
                F.avg((F.col("score") - F.col("quality")) ** 2).alias("brier")).first()
    print(r)
    assert r.acc > 0.95 and r.kept > 0.97 and r.caught > 0.8


def test_odd_rows_and_labels(spark):
    rows = [(1, None, "", "", ""), (2, "", "", "", ""), (None, "a b", "", "", ""), (1, None, "", "", ""), (4, "z " * 300_000, "", "", "")]
    df = spark.createDataFrame(rows, DOC)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.score_documents(df, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0), (4, 0), (4, 0)], "doc_id long, quality int")
    got = Q.score_documents(df, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert Q.score_documents(spark.createDataFrame([], DOC), labels).count() == 0
    assert Q.keep_good(df, none).columns == df.columns
