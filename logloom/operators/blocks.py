"""L3-L7 for set and count measures: similar pairs from pairs of blocks of contents.

Contents are packed into blocks of about ``BLOCK_TOKENS`` tokens, and every two
blocks meet in a task of their own (Spark's cartesian product), so no candidate
pair is ever written or shuffled: only the blocks are, once.  No token, content
or pair is left out.

Blocks are made in the order of the contents' sizes.

Jaccard: two blocks whose sizes are too far apart do not meet.  Of two that do,
one has an index of its tokens.  A row of the other counts what it shares with all of them, but for
the most frequent tokens; those are bits of which only the pairs are asked that
they could still make similar.  How many tokens are bits is tried on a few rows.

Cosine: a content has a short vector, the weights of the most frequent tokens
and the norms of groups of the others.  The product of two vectors is never
below the cosine, so a product of matrices leaves the pairs that are compared in
full.  How long the vectors are is tried on a few rows.

Tokens are 64-bit hashes.
"""

from __future__ import annotations

import math
import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

BLOCK_TOKENS = 6_000_000  # some 40 MB
BLOCK_ROWS = 1 << 14
LEAST_TOKENS = 20_000  # smaller blocks are not made for the sake of more tasks
FREQUENT = 512  # tokens that a content's bits stand for
TRIED = (0, 64, 128, 256, 512)  # numbers of tokens that are bits
LONG = 256  # holders of a token from which they are a run of their own
WIDTHS, OWN = (128, 256, 512), 64  # lengths of a content's vector, and the tokens with a place of their own
CELLS = 1 << 23  # products of vectors at once


@lru_cache(1 << 16)
def least_jaccard(d: int) -> float:
    """Smallest dynamic threshold (L5) that a pair can pass one side of which has ``d`` distinct tokens.

    The threshold is that of n tokens of one side, which has at most n distinct
    ones, so n >= threshold * d; n^2 / (n - log2 n) grows from n = 3 on.
    """
    def threshold(n: int) -> float:
        return 1 - math.log2(n) / n

    low, high = 3, max(3, d)
    while low < high:
        n = (low + high) // 2
        low, high = (low, n) if n >= threshold(n) * d - 1e-6 else (n + 1, high)
    return threshold(low) - 1e-9


class _Packer:
    """Contents of one block."""

    def __init__(self, common: np.ndarray, cosine: bool):
        self.by_hash = np.argsort(common)
        self.common, self.cosine = common[self.by_hash], cosine
        self.clear()

    def clear(self) -> None:
        self.n_tokens, self.n_rows, self.rows, self.hashes, self.lengths = 0, 0, [], [], []

    def add(self, rows: list, hashes: np.ndarray, lengths: np.ndarray) -> None:
        """``rows`` of (id, first line, last line, threshold) with their tokens one after the other."""
        self.rows += rows
        self.hashes.append(hashes)
        self.lengths.append(lengths)
        self.n_rows, self.n_tokens = self.n_rows + len(rows), self.n_tokens + len(hashes)

    def packed(self) -> dict:
        """Columns of the block's row: its contents, and the least and greatest size and threshold."""
        ids, first, last, least = zip(*self.rows)
        n = len(ids)
        keys, local = np.unique(np.concatenate(self.hashes), return_inverse=True)
        held = np.repeat(np.arange(n), np.concatenate(self.lengths)) * len(keys) + local
        held, counts = np.unique(held, return_counts=True)
        row, local = np.divmod(held, len(keys))
        rank = np.full(len(keys), FREQUENT)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, keys), len(self.common) - 1)
            rank = np.where(self.common[at] == keys, self.by_hash[at], FREQUENT)
        least = np.array(least)
        sizes = np.bincount(row, minlength=n)
        out = {"ids": list(ids), "first": np.array(first), "last": np.array(last), "least": least, "keys": keys,
               "at": np.append(0, np.cumsum(sizes)), "local": local.astype(np.int32), "rank": rank.astype(np.int16)}
        if self.cosine:
            counts = counts.astype(np.float64)
            out["size"] = np.sqrt(np.bincount(row, counts * counts, minlength=n))
            out["counts"] = counts.astype(np.min_scalar_type(int(counts.max())))
        else:
            bits = np.zeros((n, FREQUENT), bool)
            often = rank[local] < FREQUENT
            bits[row[often], rank[local[often]]] = True
            holder = np.sort(local * n + row) % n
            out |= {"size": sizes, "bits": np.packbits(bits, axis=1).view(np.uint64).T.copy(),
                    "start": np.append(0, np.cumsum(np.bincount(local, minlength=len(keys)))).astype(np.int32), "holder": holder.astype(np.uint16)}
        self.clear()
        return {"small": float(out["size"].min()), "large": float(out["size"].max()), "least": float(least.min()),
                "content": pickle.dumps(out, protocol=5)}


BLOCK = "block long, small double, large double, least double, content binary"


def _pack(common, cosine: bool, block_tokens: int, block_rows: int):
    """Task over contents: blocks, each with a number of its own."""
    def run(batches):
        packer, part, n = _Packer(common.value, cosine), TaskContext.get().partitionId(), 0

        def block():
            nonlocal n
            n += 1
            made = packer.packed()
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), *(pa.array([made[c]], pa.float64()) for c in ("small", "large", "least")),
                                               pa.array([made["content"]], pa.binary())], ["block", "small", "large", "least", "content"])

        for batch in batches:
            column = batch.column("hashes")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
            rows, some = list(zip(*(batch.column(c).to_pylist() for c in ("id", "min_line", "max_line", "least")))), np.flatnonzero(sizes)
            k = 0
            while k < len(some):
                # as many as the block has room for, one at least
                room = ends[some[k]] + max(1, block_tokens - packer.n_tokens)
                end = min(max(k + 1, int(np.searchsorted(ends[some + 1], room, "right"))), k + block_rows - packer.n_rows, len(some))
                packer.add([rows[i] for i in some[k:end].tolist()], flat[ends[some[k]]:ends[some[end - 1] + 1]], sizes[some[k:end]])
                if packer.n_tokens >= block_tokens or packer.n_rows >= block_rows or (end < len(some) and end > k):
                    yield block()
                k = end
        if packer.rows:
            yield block()

    return run


def _known(a: dict, b: dict) -> np.ndarray:
    """Place of each of a's tokens among b's, or -1."""
    at = np.searchsorted(b["keys"], a["keys"])
    at[at == len(b["keys"])] = 0
    return np.where(b["keys"][at] == a["keys"], at, -1)


class _Shared:
    """Rows of block ``a`` against all of ``b``: what they share, the ``frequent`` most frequent tokens as bits."""

    def __init__(self, a: dict, b: dict, frequent: int, rows: np.ndarray):
        self.a, self.b, self.words = a, b, frequent // 64
        sizes = a["at"][rows + 1] - a["at"][rows]
        place = np.repeat(a["at"][rows] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        local = a["local"][place] if len(rows) < len(a["ids"]) else a["local"]
        known = a["known"][local]
        keep = (known >= 0) & (a["rank"][local] >= frequent)
        self.tokens, self.rows = known[keep], rows
        self.at = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(sizes))]
        self.own_a, self.own_b = (np.bitwise_count(x["bits"][:self.words]).sum(axis=0, dtype=np.int32) for x in (a, b))
        self.needs: tuple = (None, None)

    def _need(self, i: int) -> tuple[int, int, np.ndarray]:
        """The part of b whose sizes can make a pair, and the tokens that must be shared."""
        a, b, key = self.a, self.b, (self.a["size"][i], self.a["least"][i])
        if self.needs[0] != key:
            size, least = key
            low = min(least, b["lowest"])
            lo, hi = (np.searchsorted(b["size"], size * low - 1e-6), np.searchsorted(b["size"], size / low + 1e-6, "right")) if b["sorted"] else (0, len(b["ids"]))
            m = np.minimum(least, b["least"][lo:hi])
            self.needs = (key, (lo, hi, np.ceil(m / (1 + m) * (size + b["size"][lo:hi]) - 1e-6).astype(np.int32)))
        return self.needs[1]

    def __iter__(self):
        """(i, js, what i shares with each of js), for the js that can be similar; counts the work in ``cost``."""
        a, b, n, holder = self.a, self.b, len(self.b["ids"]), self.b["holder"]
        self.cost = 0.0
        for at in range(0, len(self.rows), 64):
            rows = self.rows[at:at + 64].tolist()
            base = self.at[at]
            tokens = self.tokens[base:self.at[at + len(rows)]]
            begin, number = b["start"][tokens], b["number"][tokens]
            ends = self.at[at:at + len(rows) + 1] - base
            few = number < LONG  # those holders are read at once, the others' runs one by one
            ahead, many = (np.append(0, np.cumsum(x)) for x in (np.where(few, number, 0), ~few))
            short, long = number[few], np.flatnonzero(~few)
            met_few = holder[np.repeat(begin[few] - ahead[:-1][few], short) + np.arange(ahead[-1])]
            runs = list(map(holder.__getitem__, map(slice, begin[long].tolist(), (begin + number)[long].tolist())))
            ahead, many = ahead[ends].tolist(), many[ends].tolist()
            for k, i in enumerate(rows):
                lo, hi, need = self._need(i)
                if lo >= hi:
                    continue
                met = [met_few[ahead[k]:ahead[k + 1]], *runs[many[k]:many[k + 1]]]
                met = met[0] if len(met) == 1 else np.concatenate(met)
                shared = np.bincount(met, minlength=n)[lo:hi].astype(np.int32)
                bits = np.minimum(self.own_b[lo:hi], self.own_a[i])  # that can be shared
                js = (shared >= np.subtract(need, bits, out=bits)).nonzero()[0]
                self.cost += len(met) * 4 + (many[k + 1] - many[k]) * 700 + (hi - lo) * 2 + len(js) * (20 + 10 * self.words)
                if len(js):
                    found, need, js = shared[js], need[js], js + lo
                    for w in range(self.words):
                        found += np.bitwise_count(b["bits"][w][js] & a["bits"][w][i])
                    some = found >= need
                    if some.any():
                        yield i, js[some], found[some]


def _met_jaccard(a: dict, b: dict):
    """(i, js, tokens shared) of two blocks' rows, those that can be similar at least."""
    a["known"] = _known(a, b)
    b["lowest"], b["sorted"] = b["least"].min(), bool((np.diff(b["size"]) >= 0).all())
    b["holder"], b["number"] = b["holder"].astype(np.int64), np.diff(b["start"])
    n = len(a["ids"])
    frequent, every = TRIED[-2], np.arange(n)
    if n > 256:
        costs = []
        for frequent in TRIED:
            tried = _Shared(a, b, frequent, every[n // 24:: n // 12])
            for _ in tried:
                pass
            costs.append(tried.cost)
        frequent = TRIED[int(np.argmin(costs))]
    yield from _Shared(a, b, frequent, every)


def _vectors(x: dict, width: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors of ``rows`` (all): the weights of the most frequent tokens, and the norms of groups of the others."""
    if rows is None:
        rows, span = np.arange(len(x["ids"])), slice(None)
        sizes = np.diff(x["at"])
    else:
        sizes = x["at"][rows + 1] - x["at"][rows]
        span = np.repeat(x["at"][rows] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    place = np.where(x["rank"] < OWN, x["rank"], OWN + (x["keys"].view(np.uint64) % np.uint64(width - OWN)).astype(np.int64))
    cell = np.repeat(np.arange(len(rows)) * width, sizes) + place[x["local"][span]]
    squares = np.bincount(cell, x["counts"][span].astype(np.float64) ** 2, minlength=len(rows) * width)
    return (np.sqrt(squares.reshape(len(rows), width)) / x["size"][rows, None]).astype(np.float32)


def _width(a: dict, b: dict, low: float) -> int:
    """The length of vectors that is cheapest for two blocks, by some of their rows."""
    some_a, some_b = (np.unique(np.linspace(0, len(x["ids"]) - 1, n).astype(np.int64)) for x, n in ((a, 64), (b, 512)))
    sizes, costs = b["at"][some_b + 1] - b["at"][some_b], []
    for width in WIDTHS:
        near = _vectors(a, width, some_a) @ _vectors(b, width, some_b).T >= low
        costs.append(width / 28 + (near.sum(axis=0) * (sizes * 5 + 1500)).sum() / near.size)
    return WIDTHS[int(np.argmin(costs))]


def _met_cosine(a: dict, b: dict):
    """(i, js, product of counts) of two blocks' rows, those that can be similar at least."""
    known, n = _known(b, a), len(b["ids"])
    place_of = np.empty(len(a["keys"]) + 1, np.int64)  # the tokens of most contents lie together
    place_of[np.argsort(-np.bincount(a["local"], minlength=len(a["keys"])), kind="stable")] = np.arange(len(a["keys"]))
    place_of[-1] = -1
    weight, ours, theirs = np.zeros(len(a["keys"])), place_of[a["local"]], place_of[known][b["local"]]
    keep = theirs >= 0
    theirs, counts, at = theirs[keep], b["counts"][keep].astype(np.float64), np.append(0, np.cumsum(keep))[b["at"]]
    low = min(a["least"].min(), b["least"].min()) - 1e-4
    width = _width(a, b, low)
    left, right = _vectors(a, width), _vectors(b, width).T
    step = max(1, CELLS // n)
    for r in range(0, len(left), step):
        rows, others = np.divmod(np.flatnonzero(left[r:r + step] @ right >= low), n)
        some = at[others + 1] > at[others]
        rows, others = rows[some], others[some]
        found, first = np.unique(rows, return_index=True)
        for i, x, y in zip(found.tolist(), first.tolist(), np.append(first[1:], len(rows)).tolist()):
            span = slice(a["at"][r + i], a["at"][r + i + 1])
            weight[ours[span]] = a["counts"][span]
            for k in range(x, y, 64):
                js = others[k:min(k + 64, y)]
                begin, sizes = at[js], at[js + 1] - at[js]
                spans = list(map(slice, begin.tolist(), (begin + sizes).tolist()))
                products = weight.take(np.concatenate(list(map(theirs.__getitem__, spans))))
                products *= np.concatenate(list(map(counts.__getitem__, spans)))
                yield r + i, js, np.add.reduceat(products, np.cumsum(sizes) - sizes)
            weight[ours[span]] = 0


def _similar(a: dict, b: dict, same: bool, cosine: bool, dynamic: bool):
    """(a's row, b's rows, scores) of the similar pairs of two blocks."""
    for i, js, shared in (_met_cosine if cosine else _met_jaccard)(a, b):
        if same:
            later = js > i
            js, shared = js[later], shared[later]
        score = shared / (a["size"][i] * b["size"][js]) if cosine else shared / (a["size"][i] + b["size"][js] - shared)
        near_a, near_b = score >= a["least"][i], score >= b["least"][js]
        if dynamic:
            near_a &= a["first"][i] < b["last"][js]
            near_b &= b["first"][js] < a["last"][i]
        near = near_a | near_b
        if near.any():
            yield i, js[near], score[near]


def _compare(cosine: bool, dynamic: bool, kind: str):
    """Task over pairs of blocks: their similar pairs."""
    def ids(x: dict) -> np.ndarray:
        return np.array(x["ids"], object if kind == "string" else np.int64)

    def batch_of(found: list) -> pa.RecordBatch:
        a, b, score = (np.concatenate(x) for x in zip(*found))
        other = np.flatnonzero(a != b)
        a, b, score = a[other], b[other], score[other]
        type_ = pa.string() if kind == "string" else pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), type_), pa.array(np.maximum(a, b), type_), pa.array(score, pa.float64())], ["a_id", "b_id", "score"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("a_block")[k].as_py() == batch.column("b_block")[k].as_py()
                a = pickle.loads(batch.column("a_content")[k].as_buffer())
                b = a if same else pickle.loads(batch.column("b_content")[k].as_buffer())
                a_ids, b_ids, found, n = ids(a), ids(b), [], 0
                for i, js, scores in _similar(a, b, same, cosine, dynamic):
                    found.append((np.repeat(a_ids[i:i + 1], len(js)), b_ids[js], scores))
                    n += len(js)
                    if n >= 100_000:
                        yield batch_of(found)
                        found, n = [], 0
                if found:
                    yield batch_of(found)

    return run


def hashed_rows(contents: DataFrame, least) -> DataFrame:
    """(id, min_line, max_line, hashes, least) of the contents with an id; ids are longs or strings."""
    kind = contents.schema["id"].dataType.simpleString()
    lowest, highest = -(1 << 62), 1 << 62  # a missing line is before and after none
    rows = contents.where("id IS NOT NULL").select(
        F.col("id") if kind == "string" else F.col("id").cast("long").alias("id"),
        F.coalesce(F.col("min_line").cast("long"), F.lit(highest)).alias("min_line"), F.coalesce(F.col("max_line").cast("long"), F.lit(lowest)).alias("max_line"),
        F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    return rows.withColumn("least", F.lit(least(F.size("hashes"))).cast("double"))


def block_pairs(contents: DataFrame, measure: str, least, dynamic: bool, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(a_id, b_id, score) of the similar pairs of ``contents(id, tokens, min_line, max_line)`` by jaccard or cosine.

    ``least`` gives the threshold of a content from its number of tokens; a pair
    passes by either side's.  With ``dynamic`` a side counts only if its first
    line is before the other's last.  id is an integer or a string; rows without
    an id or a token have no pair.  The contents are computed three times.
    """
    spark, cosine = contents.sparkSession, measure == "cosine"
    kind = contents.schema["id"].dataType.simpleString()
    rows = hashed_rows(contents, least)
    seen = Observation()
    frequency = rows.select("hashes").observe(seen, F.sum(F.greatest(F.size("hashes"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("rows")).select(F.explode("hashes").alias("h"))
    frequency = frequency.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = frequency.where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()  # a bounded list
    common = spark.sparkContext.broadcast(np.array([r.h for r in top], np.int64))
    total, n_rows = seen.get["n"] or 0, seen.get["rows"]
    tasks = max(1, math.isqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    per_block = min(block_tokens, max(LEAST_TOKENS, total // tasks))
    rows_a_block = min(BLOCK_ROWS, max(256, -(-n_rows // tasks)))
    parts = max(1, -(-total // per_block))
    meet = F.col("a_block") <= F.col("b_block")
    if not cosine:
        rows = rows.withColumn("hashes", F.array_distinct("hashes"))
    rows = rows.withColumn("n", F.size("hashes")).repartitionByRange(parts, "n", F.xxhash64("hashes")).sortWithinPartitions("n").drop("n")
    if not cosine:
        low = F.least("a_least", "b_least") - F.lit(1e-9)
        meet &= (F.col("a_large") >= low * F.col("b_small")) & (F.col("b_large") >= low * F.col("a_small"))
    blocks = rows.mapInArrow(_pack(common, cosine, per_block, rows_a_block), BLOCK).repartition(parts, "block")
    a, b = (blocks.select(*(F.col(c).alias(f"{x}_{c}") for c in blocks.columns)) for x in "ab")
    pairs = a.hint("shuffle_replicate_nl").join(b, meet).select("a_block", "b_block", "a_content", "b_content")
    out = "string" if kind == "string" else "long"
    found = pairs.mapInArrow(_compare(cosine, dynamic, out), f"a_id {out}, b_id {out}, score double")
    return found.select(F.col("a_id").cast(kind).alias("a_id"), F.col("b_id").cast(kind).alias("b_id"), "score")
