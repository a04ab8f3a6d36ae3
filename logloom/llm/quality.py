"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network (operator 5).

1. Random indexing over every document: a token falls into one of ``BUCKETS``
   buckets, each bucket has a fixed sparse ternary index vector, and a bucket's
   word vector is the sum of the index vectors seen within ``CONTEXT`` tokens of
   it.  Tasks add up integer matrices of fixed size, which are summed in two
   shuffled steps, so the corpus never meets in one task.
2. A document is pooled to the mean and the spread of its word vectors plus
   its length and its shares of distinct tokens and token pairs.
3. A network with one hidden layer is fitted with numpy on at most
   ``TRAIN_ROWS`` labelled rows (smallest hash of doc_id first); a quarter of
   them is kept back to choose the temperature of its probabilities.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import SLICE, packed, sliced, table

BUCKETS = 1 << 14  # bucket 0 is the gap between documents
DIM = 32
CONTEXT = 2
NONZERO = 8
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
HIDDEN = 32
PIECE_BYTES = 1 << 20
BLOCK = 256  # buckets in one row of a summed matrix

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
SPACE = re.compile(rb"\s")


def index_vectors() -> np.ndarray:
    """(BUCKETS, DIM) int8: NONZERO entries of +1 / -1 in each row but row 0."""
    rng = np.random.default_rng(20240501)
    out = np.zeros((BUCKETS, DIM), np.int8)
    place = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.int8), place.shape), axis=1)
    out[0] = 0
    return out


def bucket_pieces(text: str | None):
    """Bucket numbers of a text's tokens, in pieces of bounded size cut at white space."""
    data, at = (text or "").encode(), 0
    while at < len(data):
        gap = SPACE.search(data, at + PIECE_BYTES) if at + PIECE_BYTES < len(data) else None
        end = gap.start() if gap else len(data)
        tokens = TOKEN.findall(data, at, end)
        if tokens:
            crc = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
            yield (crc % (BUCKETS - 1) + 1).astype(np.uint16)
        at = end + 1


def _partial_sums(batches):
    """One task's word-vector sums, as rows (block, values)."""
    index = index_vectors().astype(np.int16)
    total = np.zeros((BUCKETS, DIM), np.int64)
    gap = np.zeros(CONTEXT, np.uint16)

    def add(ids: np.ndarray):
        near = index[ids]
        ctx = np.zeros((len(ids), DIM), np.int16)
        for s in range(1, CONTEXT + 1):
            ctx[s:] += near[:-s]
            ctx[:-s] += near[s:]
        order = np.argsort(ids, kind="stable")
        own = ids[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total[own[first]] += np.add.reduceat(ctx[order], first, axis=0, dtype=np.int64)

    for batch in sliced(batches):
        held, n = [], 0
        for text in batch.column(0).to_pylist():
            for piece in bucket_pieces(text):
                held += [piece, gap]
                n += len(piece)
                if n > 200_000:
                    add(np.concatenate(held))
                    held, n = [], 0
        if held:
            add(np.concatenate(held))
    yield _matrix_rows(total)


def _matrix_rows(total: np.ndarray) -> pa.RecordBatch:
    blocks = total.reshape(-1, BLOCK * DIM)
    return pa.RecordBatch.from_pydict({"block": np.arange(len(blocks), dtype=np.int32), "v": [b.tobytes() for b in blocks]})


def _sum_rows(batches):
    got: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, v in zip(batch.column("block").to_pylist(), batch.column("v").to_pylist()):
            v = np.frombuffer(v, np.int64)
            got[block] = got[block] + v if block in got else v
    if got:
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(got), pa.int32()), "v": [v.tobytes() for v in got.values()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) float32 unit word vectors of all texts of ``docs``; zero rows for unseen buckets."""
    kind = "block int, v binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_partial_sums, kind)
    # a fixed number of partitions: merged ones would bring many tasks' matrices into one
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = parts.repartition(spread, "block", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(_sum_rows, kind)
    full = some.repartition("block").mapInArrow(_sum_rows, kind)
    total = np.zeros((BUCKETS // BLOCK, BLOCK * DIM), np.float64)
    for r in full.collect():  # BUCKETS / BLOCK rows of fixed size
        total[r.block] += np.frombuffer(bytes(r.v), np.int64)
    total = total.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


N_FEATURES = 2 * DIM + 4


def pool(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Feature row of one text; zeros without tokens."""
    out = np.zeros(N_FEATURES)
    n, seen = 0, []
    s1, s2 = np.zeros(DIM), np.zeros(DIM)
    for ids in bucket_pieces(text):
        for i in range(0, len(ids), 1 << 16):
            v = vectors[ids[i:i + (1 << 16)]]
            s1 += v.sum(axis=0, dtype=np.float64)
            s2 += np.einsum("ij,ij->j", v, v)
        n += len(ids)
        seen.append(ids)
    if n:
        ids = np.concatenate(seen).astype(np.uint32)
        mean = s1 / n
        out[:DIM] = mean
        out[DIM:2 * DIM] = np.sqrt(np.maximum(s2 / n - mean * mean, 0))
        pairs = ids[1:] * np.uint32(BUCKETS) + ids[:-1]
        out[2 * DIM:] = (np.log1p(n), len(np.unique(ids)) / n,
                         len(np.unique(pairs)) / max(1, len(pairs)), np.linalg.norm(mean))
    return out


class Network:
    """Standardised input, one hidden tanh layer, one logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 7):
        self.mu, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.default_rng(seed)
        held = np.arange(len(y)) % 4 == 3
        z = (x - self.mu) / self.sd
        self.w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        train = np.flatnonzero(~held)
        for _ in range(epochs):
            rng.shuffle(train)
            for i in range(0, len(train), 256):
                step += 1
                part = train[i:i + 256]
                h = np.tanh(z[part] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-(h @ self.w[2] + self.w[3])))
                d = (p - y[part, None]) / len(part)
                dh = (d @ self.w[2].T) * (1 - h * h)
                grads = [z[part].T @ dh + 1e-4 * self.w[0], dh.sum(axis=0), h.T @ d + 1e-4 * self.w[2], d.sum(axis=0)]
                for a, g, mm, vv in zip(self.w, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= 0.005 * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.999 ** step)) + 1e-8)
        self.t = 1.0
        logit, target = self.logit(x[held]), y[held]
        if len(target):
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
            loss = [np.mean(np.logaddexp(0, np.where(target > 0, -1, 1) * logit / t)) for t in grid]
            self.t = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.mu) / self.sd @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.t, -60, 60)))


class Prior:
    """Used where the labels hold fewer than two classes: the smoothed share of label 1."""

    def __init__(self, y: np.ndarray):
        self.p = (float(y.sum()) + 1) / (len(y) + 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def held_out(doc_id="doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, h (of the text), text, y of the documents with one of the first ``limit`` labels that may be learned from."""
    ids = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
           .select("doc_id", (F.col("quality") > 0).cast("int").alias("y")).orderBy(*_order()).limit(limit))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(ids), "doc_id")


def _order() -> list:
    return [F.xxhash64("doc_id", F.lit(5)), "doc_id", "y"]


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[np.ndarray, Network | Prior]:
    """Word vectors of all ``docs`` and the network fitted on the labelled sample.

    Texts are pooled where they are; only feature rows of fixed size, at most ``limit``, come together.
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = labelled_rows(docs, labels, limit)

    def features(batch):
        x = [pool(t, shared.value).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "h", "y")} | {"x": pa.array(x, pa.binary())})

    pooled = rows.mapInArrow(lambda it: map(features, sliced(it)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, y int, x binary")
    found = pooled.orderBy(*_order(), "h").limit(limit).select("x", "y").toArrow()
    y = found["y"].to_numpy().astype(np.float64)
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    return vectors, Network(x, y) if 0 < y.sum() < len(y) else Prior(y)


def scorer(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS):
    """A column function text -> score, fitted on ``docs`` and ``labels``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        vectors, net = shared.value
        out = [net.score(np.stack([pool(t, vectors) for t in text.slice(i, SLICE).to_pylist()])) for i in range(0, len(text), SLICE)]
        return pa.array(np.concatenate(out or [np.zeros(0)]))

    return lambda text: score(F.col(text).cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts get the score of an empty text.  Null labels and
    labels of held-out rows are not read; without two classes of labels the
    score is the smoothed share of label 1.  Empty table: no rows.
    """
    score = scorer(docs, labels, limit)
    return docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score")).select(
        "*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    score = scorer(docs, labels, limit)
    return packed(docs).withColumn("score", score("row.text")).where(F.col("score") >= THRESHOLD).select("row.*")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every row of documents."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
