"""Importance resampling towards a target distribution by bit-sliced sums (operator 13).

A feature (a run of words) falls into one of ``buckets`` buckets.  The gain of a
bucket compares its share of the target's features with that of the source's.  A
document's counts become planes, one bit a bucket: plane j holds bit j of every
count.  The gains become planes too, by sign and bit.  AND-ing plane j with gain
plane k and counting the ones gives a whole number of 2^(j+k), so the sum over
all pairs of planes is the exact sum of the gains over the document's features.

Documents with enough words are drawn by the highest weight plus Gumbel noise.
The distinct scores are few (both parts are whole numbers of bounded size), so
their counts tell the least score that is drawn; ranks are given in sorted
ranges of the rows from there on.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import durable, numbered, sliced, table
from logloom.llm.decontaminate import _KEEP
from logloom.session import written

BUCKETS, RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
PIECE_BYTES = 1 << 20
GROUP = 32  # documents whose planes are held at once


def word_pieces(text: bytes):
    """Lists of the words of a UTF-8 text, A-Z folded, in pieces of bounded size."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE_BYTES)
        folded = text[at:end].translate(_KEEP)
        if end < len(text):  # a word that reaches the end goes with the next piece
            cut = folded.rfind(b" ")
            while cut < 0 and end < len(text):
                end = min(len(text), end + PIECE_BYTES)
                folded = text[at:end].translate(_KEEP)
                cut = folded.rfind(b" ") if end < len(text) else len(folded)
            folded = folded[:cut] if end < len(text) else folded
        words = folded.split()
        if words:
            yield words
        at += max(1, len(folded))


def feature_buckets(text: bytes, run: int, buckets: int) -> tuple[np.ndarray, int]:
    """Buckets of all runs of 1 to ``run`` words, repeats included, and the number of words."""
    out, n, tail = [], 0, []
    for words in word_pieces(text):
        n += len(words)
        row = tail + words
        for k in range(1, run + 1):
            # runs that end in this piece
            first = max(0, len(tail) - k + 1)
            runs = row[first:] if k == 1 else [b" ".join(row[i:i + k]) for i in range(first, len(row) - k + 1)]
            out.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % np.uint32(buckets))
        tail = row[max(0, len(row) - run + 1):] if run > 1 else []
    return np.concatenate(out) if out else np.zeros(0, np.uint32), n


def bucketed(docs: DataFrame, id_col: str | None = "doc_id", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``id_col``, n_words and ``b``, the bucket numbers of its features (16 or 32 bits each), of every row of ``docs``."""
    ids = [id_col] if id_col else []
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def task(batches):
        for batch in sliced(batches):
            got = [feature_buckets(t, run, buckets) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ids} | {
                "n_words": pa.array([n for _, n in got], pa.int64()), "b": pa.array([b.astype(kind).tobytes() for b, _ in got], pa.binary())})

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ids) + "n_words long, b binary"
    return docs.select(*[F.col(f"`{c}`") for c in ids], text).mapInArrow(task, schema)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all ``rows(b)``, summed in tasks first."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def task(batches):
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column("b").to_pylist()), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    out = np.zeros(buckets, np.int64)
    for r in rows.select("b").mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n  # at most ``buckets`` rows
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share of the target / share of the source)) per bucket, both smoothed by one."""
    n = len(source)
    s_all, t_all = float(int(source.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


class GainPlanes:
    """Gains as bit planes: one bit a bucket, one plane for each sign and bit."""

    def __init__(self, gain: np.ndarray):
        self.width = -(-len(gain) // 64) * 64
        bits = max(1, int(np.abs(gain).max(initial=0)).bit_length())
        planes, factor = [], []
        for sign in (1, -1):
            size = np.where(np.sign(gain) == sign, np.abs(gain), 0)
            for k in range(bits):
                plane = (size >> k & 1).astype(np.uint8)
                if plane.any():
                    planes.append(self._packed(np.r_[plane, np.zeros(self.width - len(gain), np.uint8)][None])[0])
                    factor.append(sign << k if sign > 0 else -(1 << k))
        self.planes = np.array(planes, np.uint64).reshape(-1, self.width // 64)
        self.factor = np.array(factor, np.int64)

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits.reshape(-1, self.width), axis=1, bitorder="little").view(np.uint64)

    def sums(self, documents: list[np.ndarray]) -> np.ndarray:
        """Exact sum of the gains over each document's buckets."""
        out = np.zeros(len(documents), np.int64)
        sizes = np.array([len(d) for d in documents], np.int64)
        if not sizes.sum() or not len(self.planes):
            return out
        own = np.repeat(np.arange(len(documents)) * self.width, sizes) + np.concatenate(documents).astype(np.int64)
        place, count = np.unique(own, return_counts=True)
        bits = np.zeros(len(documents) * self.width, np.uint8)
        for j in range(int(count.max()).bit_length()):
            on = place[(count >> j & 1).astype(bool)]
            bits[on] = 1
            plane = self._packed(bits)
            bits[on] = 0
            ones = np.bitwise_count(plane[:, None, :] & self.planes[None]).sum(axis=2, dtype=np.int64)
            out += (ones @ self.factor) << j
        return out


def weights(rows: DataFrame, gain: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_words, n_features and weight (floored mean gain; 0 without features) of ``rows``, see ``bucketed``."""
    shared = rows.sparkSession.sparkContext.broadcast(GainPlanes(gain))
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def task(batches):
        planes = shared.value
        for batch in sliced(batches):
            docs = [np.frombuffer(b, kind) for b in batch.column("b").to_pylist()]
            total = np.concatenate([planes.sums(docs[i:i + GROUP]) for i in range(0, len(docs), GROUP)])
            n = np.array([len(d) for d in docs], np.int64)
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "n_words": batch.column("n_words"), "n_features": pa.array(n),
                                              "weight": pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))})

    return rows.mapInArrow(task, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, run: int = RUN, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs(doc_id, text, ...)``.

    rank (1, 2, 3, ... by falling score, ties by rising doc_id, null last) is
    null for rows that are not among the highest floor(percent N / 100) scores
    of the N rows with ``min_words`` words or more.  Null text has no words.  A null
    doc_id is hashed as the empty string; rows alike in doc_id have the same
    noise and follow one another in any order.  Empty tables: no rows, or a
    target without features.  Only doc_id and text are read.
    """
    rows = written(bucketed(docs, "doc_id", run, buckets))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(bucketed(target, None, run, buckets), buckets))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = written(weights(rows, gain).withColumn("score", (F.col("weight") + noise).cast("long")))
    enough = scored.where(F.col("n_words") >= min_words)
    # weights and noise lie within +-1000 ln(2^128) and -3,200 to 23,000, so there are fewer than 210,000 scores
    held = sorted(((r.score, r.n) for r in enough.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in held) // 100
    least, seen = None, 0
    for score, n in held:
        if seen >= drawn:
            break
        least, seen = score, seen + n
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    top = numbered(durable(scored.where(high)), [F.desc("score"), F.asc_nulls_last("doc_id")], "at")
    rank = F.when(F.col("at") < drawn, F.col("at") + 1).cast("long")
    return top.withColumn("rank", rank).drop("at").unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of every row of documents, drawn towards benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
src AS MATERIALIZED (SELECT r, unnest(w) AS w FROM d),
tgt AS MATERIALIZED (SELECT unnest({_WORDS}) AS w FROM benchmark),
crc AS MATERIALIZED (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(1, CAST(length(x) / 2 + 1 AS BIGINT)),
    lambda i: CAST(concat('0x', x[2 * i - 1:2 * i]) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) % {BUCKETS} AS b
  FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM src UNION SELECT w FROM tgt)), step),
s AS (SELECT b, count(*) AS s FROM src JOIN crc USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM tgt JOIN crc USING (w) GROUP BY b),
g AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM src) + {BUCKETS})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tgt) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
w AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM src JOIN crc USING (w) JOIN g USING (b) GROUP BY r),
f AS MATERIALIZED (SELECT r, doc_id, coalesce(n, 0) AS n_features,
  coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST(concat('0x', left(sha256(concat('{SEED}:', doc_id)), 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST) AS rank FROM f WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM k) // 100 THEN rank END AS rank
FROM f LEFT JOIN k USING (r)
"""
