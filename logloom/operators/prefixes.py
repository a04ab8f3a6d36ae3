"""L7 for Jaccard and the dynamic threshold: pairs from rare tokens.

The threshold is high but for the shortest contents, so a similar pair shares one
of the few rarest tokens of each side.  Tokens have one order for all contents,
by counts of groups of tokens (an array of a fixed length) and then by hash; a
content is sent to its rarest tokens with 256 bits of all its tokens.  What meets
there and can be similar by sizes and bits is compared in full.  No token or
content is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .blocks import hashed_rows, least_jaccard

GROUPS = 1 << 20
WORDS = 4  # of bits that stand for a content's tokens
KEYS = "key long, id {kind}, least double, size int, else_ int, " + ", ".join(f"bits{w} long" for w in range(WORDS))


def _counted(batches):
    """Task over contents: how many hold a token of each group."""
    counts = np.zeros(GROUPS, np.int64)
    for batch in batches:
        hashes = batch.column("hashes").flatten().to_numpy(zero_copy_only=False)
        counts += np.bincount(hashes & (GROUPS - 1), minlength=GROUPS)
    held = np.flatnonzero(counts)
    for at in range(0, len(held), 100_000):
        some = held[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["g", "n"])


def _scored(batches):
    """Task over pairs with both sides' hashes: the pairs without them, but with a score."""
    for batch in batches:
        sides = []
        for c in ("a_hashes", "b_hashes"):
            column = batch.column(c)
            ends = np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)))
            sides.append((column.flatten().to_numpy(zero_copy_only=False), ends.tolist()))
        (a, a_at), (b, b_at) = sides
        scores = []
        for k in range(batch.num_rows):
            x, y = a_at[k], b_at[k]
            both = np.concatenate((a[x:a_at[k + 1]], b[y:b_at[k + 1]]))
            both.sort()
            shared = np.count_nonzero(both[1:] == both[:-1])
            scores.append(shared / (len(both) - shared))
        rest = batch.drop_columns(["a_hashes", "b_hashes"])
        yield rest.append_column("score", pa.array(scores, pa.float64()))


def _keys(counts):
    """Task over contents: a row for each of their rarest tokens, as many as any similar pair must share one of."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                some = some.filter(pc.greater(pc.fill_null(pc.list_value_length(some.column("hashes")), 0), 0))
                if not some.num_rows:
                    continue
                hashes = some.column("hashes").flatten().to_numpy(zero_copy_only=False)
                sizes = pc.list_value_length(some.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64)
                row, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
                order = np.lexsort((hashes, counts.value[hashes & (GROUPS - 1)], row))
                size, which = np.unique(sizes, return_inverse=True)
                length = np.array([n - max(1, int(np.ceil(least_jaccard(int(n)) * n - 1e-9))) + 1 for n in size])[which]
                bits = np.zeros((len(sizes), 64 * WORDS), bool)
                bits[row, (hashes >> 20) & (64 * WORDS - 1)] = True
                held = bits.sum(axis=1)
                packed = np.packbits(bits, axis=1).view(np.int64)
                sent = np.repeat(np.arange(len(sizes)), length)
                place = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
                take = pa.array(sent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[order[place]]), some.column("id").take(take), some.column("least").take(take), pa.array(sizes[sent].astype(np.int32)),
                     pa.array((sizes - held)[sent].astype(np.int32)), *(pa.array(packed[sent, w]) for w in range(WORDS))],
                    ["key", "id", "least", "size", "else_", *(f"bits{w}" for w in range(WORDS))])

    return run


def prefix_pairs(contents: DataFrame, least) -> DataFrame:
    """(a_id, b_id, score) of the similar pairs of ``contents(id, tokens, min_line, max_line)`` by jaccard.

    ``least`` is the dynamic threshold (L5) of a number of tokens; a side's counts
    if its first line is before the other's last.  Rows without an id or a token
    have no pair.  The contents are computed three or four times.
    """
    spark = contents.sparkSession
    kind = contents.schema["id"].dataType.simpleString()
    rows = hashed_rows(contents, least).withColumn("hashes", F.array_distinct("hashes"))
    found = rows.select("hashes").mapInArrow(_counted, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # a bounded table
    counts = np.zeros(GROUPS, np.int64)
    counts[found["g"].to_numpy()] = found["n"].to_numpy()
    out = "string" if kind == "string" else "long"
    keys = rows.select("id", "least", "hashes").mapInArrow(_keys(spark.sparkContext.broadcast(counts)), KEYS.format(kind=out))
    a, b = (keys.select("key", *(F.col(c).alias(f"{x}_{c}") for c in keys.columns[1:])) for x in "ab")
    m = F.least("a_least", "b_least")
    need = m / (m + 1) * (F.col("a_size") + F.col("b_size")) - F.lit(1e-6)
    both = F.least("a_else_", "b_else_")
    for w in range(WORDS):
        both = both + F.bit_count(F.col(f"a_bits{w}").bitwiseAND(F.col(f"b_bits{w}")))
    near = (F.col("a_id") < F.col("b_id")) & (F.least("a_size", "b_size") >= need) & (both >= need)
    pairs = written(a.join(b, "key").where(near).select("a_id", "b_id").distinct())

    def side(x: str) -> DataFrame:
        return rows.select(*(F.col(c).alias(f"{x}_{c}") for c in rows.columns))

    def passes(x: str, y: str) -> Column:
        return (F.col("score") >= F.col(f"{x}_least")) & (F.col(f"{x}_min_line") < F.col(f"{y}_max_line"))

    met = side("b").join(side("a").join(pairs, "a_id"), "b_id")
    plain = [c for c in met.columns if not c.endswith("_hashes")]
    scored = met.select(*plain, "a_hashes", "b_hashes").mapInArrow(_scored, ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in plain) + ", score double")
    return (scored.where(passes("a", "b") | passes("b", "a"))
            .select(F.col("a_id").cast(kind).alias("a_id"), F.col("b_id").cast(kind).alias("b_id"), "score"))
