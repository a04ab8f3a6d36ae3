"""SimHash near-duplicates found by Golay-code fuzzy keys (operator 2).

A fingerprint's 64 bits are cut into three segments (22 + 21 + 21 bits, each
read as a 23-bit word).  The binary Golay code (23, 12) is perfect: each word
has one code word within 3 bits.  ``S(x)`` is that code word, and for a word
at distance exactly 3 also the five code words at distance 4.  Two words that
differ in at most 2 bits always share an element of ``S`` (tests check it over
all cosets).  Pigeonhole on at most 4 differing bits over three segments:

* every segment differs in at most 2 bits -> the triple of code-word indices is shared;
* one segment differs in 3 or 4 bits -> the other two differ in at most 1 bit
  together, so one of them is equal and the other shares an index.

So the keys (index, index, index) and (equal segment, index of another) lose
no link.  Candidates that meet under a key are verified on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import durable, map_batches, packed, table
from logloom.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (shift, width)
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
RUN_LIMIT = 32768  # members of one key compared in one piece; longer runs are split in block pairs
SHORT_RUN = 12
NO_LIMIT = 1 << 62


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes (11 bits) of 23-bit words."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


def _error_table() -> np.ndarray:
    """(2048, 6) error patterns per syndrome; unused places repeat the first."""
    bits = 1 << np.arange(23, dtype=np.int64)
    patterns = [np.zeros(1, np.int64), bits]
    for _ in range(3):  # weights 2, 3, 4: add a bit above the highest one set
        last = patterns[-1]
        top = np.floor(np.log2(last)).astype(np.int64)
        patterns.append(np.concatenate([last[top < b] | (1 << b) for b in range(1, 23)]))
    near = np.concatenate(patterns[:4])
    leaders = np.zeros(2048, np.int64)
    leaders[_remainder(near)] = near
    out = np.repeat(leaders[:, None], 6, axis=1)
    far = patterns[4]
    syn = _remainder(far)
    deep = np.bitwise_count(leaders[syn]) == 3
    order = np.argsort(syn[deep], kind="stable")
    out[np.unique(syn[deep]), 1:] = far[deep][order].reshape(-1, 5)
    return out


ERRORS = _error_table()


def indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) Golay code-word indices of 23-bit words (places may repeat)."""
    return (words[:, None] ^ ERRORS[_remainder(words)]) >> 11


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.astype(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]


_PAIRS = [(i, j) for i in range(3) for j in range(3) if i != j]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, key) of the fingerprints; the top bits of a key name its kind."""
    seg = _segments(fp)
    idx = [indices(s) for s in seg]
    # repeated places are masked, so a (row, key) pair occurs once
    use = [np.concatenate([np.ones((len(fp), 1), bool), i[:, 1:] != i[:, :1]], axis=1) for i in idx]
    rows, keys = [], []

    def add(mask, key):
        r = np.nonzero(mask)
        rows.append(r[0])
        keys.append(key[r])

    a, b, c = (i[:, [x for x in range(6)]] for i in idx)
    add(use[0][:, :, None, None] & use[1][:, None, :, None] & use[2][:, None, None, :],
        (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :])
    for kind, (i, j) in enumerate(_PAIRS, 1):
        add(use[j], (kind << 36) | (seg[i][:, None] << 12) | idx[j])
    return np.concatenate(rows), np.concatenate(keys)


def _own_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The one key that reports the link x - y: the smallest key that both have."""
    seg_x, seg_y = _segments(x), _segments(y)
    none = np.int64(1 << 40)
    low = []
    for s, t in zip(seg_x, seg_y):
        i, j = indices(s), indices(t)
        both = (i[:, :, None] == j[:, None, :]).any(axis=2)
        low.append(np.where(both, i, none).min(axis=1))
    out = np.where((low[0] < none) & (low[1] < none) & (low[2] < none),
                   (low[0] << 24) | (low[1] << 12) | low[2], np.int64(-1))
    for kind, (i, j) in enumerate(_PAIRS, 1):
        hit = (out < 0) & (seg_x[i] == seg_y[i]) & (low[j] < none)
        out = np.where(hit, (kind << 36) | (seg_x[i] << 12) | low[j], out)
    return out


def _links_of_run(key: int, f: np.ndarray, max_bits: int) -> tuple[list, list]:
    """A spanning forest of the links that ``key`` reports within one long run."""
    left, out_a, out_b = f, [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.flatnonzero(np.bitwise_count(left ^ x) <= max_bits)
            if len(near):
                near = near[_own_key(np.full(len(near), x), left[near]) == key]
            if len(near):
                got = left[near]
                out_a += [x] * len(got)
                out_b += got.tolist()
                stack.extend(got)
                left = np.delete(left, near)
    return out_a, out_b


def _links(k: np.ndarray, sub: np.ndarray, f: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal (k, sub) of sorted arrays."""
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (sub[1:] != sub[:-1])])
    size = np.diff(np.r_[new, len(k)])
    run = np.repeat(np.arange(len(new)), size)
    short = size[run] <= SHORT_RUN
    out_a, out_b = [], []
    for lag in range(1, min(SHORT_RUN, int(size.max(initial=1)))):
        i = np.flatnonzero((run[lag:] == run[:-lag]) & short[lag:])
        i = i[np.bitwise_count(f[i] ^ f[i + lag]) <= max_bits]
        if len(i):
            i = i[_own_key(f[i], f[i + lag]) == k[i]]
            out_a.append(f[i])
            out_b.append(f[i + lag])
    for r in np.flatnonzero(size > SHORT_RUN):
        a, b = _links_of_run(k[new[r]], f[new[r]:new[r] + size[r]], max_bits)
        out_a.append(np.array(a, dtype=np.uint64))
        out_b.append(np.array(b, dtype=np.uint64))
    return (np.concatenate(out_a) if out_a else f[:0]), (np.concatenate(out_b) if out_b else f[:0])


def _verify(max_bits: int, limit: int):
    """Task over rows sorted by (key, sub): emits links (key null) and the rows of over-long runs (key set)."""

    def run(batches):
        k = np.empty(0, np.int64)
        sub, f, over = k, k.view(np.uint64), None

        def emit(a, b, key=None):
            n = len(a)
            return pa.RecordBatch.from_pydict({
                "u": pa.array(a.view(np.int64)), "v": pa.array(b.view(np.int64)),
                "key": pa.nulls(n, pa.int64()) if key is None else pa.array(np.full(n, key, np.int64))})

        for batch in batches:
            k = np.r_[k, batch.column("key").to_numpy()]
            sub = np.r_[sub, batch.column("sub").to_numpy()]
            f = np.r_[f, batch.column("fp").to_numpy().view(np.uint64)]
            if not len(k):
                continue
            if over is not None:  # the run that was given up goes on
                n = int(np.searchsorted((k != over).astype(np.int8), 1))
                if n:
                    yield emit(f[:n], f[:n], over)
                k, sub, f = k[n:], sub[n:], f[n:]
                over = over if not len(k) else None
                if not len(k):
                    continue
            last = int(np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (sub[1:] != sub[:-1])])[-1])
            if last:
                a, b = _links(k[:last], sub[:last], f[:last], max_bits)
                if len(a):
                    yield emit(a, b)
            k, sub, f = k[last:], sub[last:], f[last:]
            if len(k) > limit:
                over = k[0]
                yield emit(f, f, over)
                k, sub, f = k[:0], sub[:0], f[:0]
        if len(k):
            a, b = _links(k, sub, f, max_bits)
            if len(a):
                yield emit(a, b)

    return run


_OUT = "u long, v long, key long"


def spread(fps: DataFrame) -> DataFrame:
    """``fps(fp)`` over all shuffle partitions: each row becomes some 180, which merged partitions would gather in few tasks.

    Dealt by a hash of fp: by fp itself, an input that is distinct already would not be dealt anew.
    """
    return fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fps(fp)`` that connect all pairs within ``max_bits``.

    A key's members are compared in one task up to ``run_limit``; a longer run
    is split into blocks and every pair of blocks is compared in its own task.
    Within a run only a spanning forest of its links is returned.
    """
    if max_bits > 4:
        raise ValueError("the keys cover at most 4 differing bits")

    def expand(batch):
        fp = batch.column("fp").to_numpy()
        out = []
        for i in range(0, len(fp), 1000):
            part = fp[i:i + 1000]
            rows, keys = fuzzy_keys(part)
            out.append((keys, part[rows]))
        key = np.concatenate([k for k, _ in out])
        return {"key": key, "sub": np.zeros(len(key), np.int64), "fp": np.concatenate([f for _, f in out])}

    keys = map_batches(spread(fps), expand, "key long, sub long, fp long")
    found = durable(keys.repartition("key").sortWithinPartitions("key")
                    .mapInArrow(_verify(max_bits, run_limit), _OUT))
    plain = found.where("key IS NULL").select("u", "v")
    over = found.where("key IS NOT NULL").select("key", F.col("u").alias("fp"))
    if over.isEmpty():
        return plain
    sized = over.groupBy("key").agg(F.ceil(F.count("*") * 4 / F.lit(run_limit)).alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = over.join(sized, "key").select("key", "fp", F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.least(block, o) * F.col("blocks") + F.greatest(block, o))).alias("sub"))
    rest = (pairs.repartition("key", "sub").sortWithinPartitions("key", "sub")
            .mapInArrow(_verify(max_bits, NO_LIMIT), _OUT))  # blocks of about run_limit / 4: none is given up
    return plain.union(durable(rest).select("u", "v"))


def fingerprint_of(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as an unsigned integer; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: folds A-Z, splits at \x09-\x0D and \x20
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    total, ones = len(words) - k + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, total, 4096):
        j = min(total, i + 4096)
        h = np.array([digest(line[s:e], 42) for s, e in zip(starts[i:j].tolist(), ends[i + k - 1:j + k - 1].tolist())],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_cols: tuple = ("doc_id",),
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``id_cols`` and ``fp`` (signed 64-bit) per row; null or wordless text gives 0."""
    fields = [docs.schema[c] for c in id_cols]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fp long"

    def run(batch):
        fp = np.fromiter((fingerprint_of(t, shingle) for t in batch.column("__text").to_pylist()),
                         dtype=np.uint64, count=batch.num_rows)
        return {c: batch.column(c) for c in id_cols} | {"fp": fp.view(np.int64)}

    return map_batches(docs.select(*id_cols, F.col(text_col).cast("string").alias("__text")), run, schema)


def clusters(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp`` and ``root`` (a fingerprint naming the component) for every distinct fingerprint of ``fps``."""
    nodes = fps.select("fp").distinct()
    labels = components(links(nodes, max_bits)).select(F.col("node").alias("fp"), "root")
    return nodes.join(labels, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits.  Equal fingerprints are one node, so copies
    are never paired.  Null text counts as no words (fingerprint 0, linked
    like any other); null doc_ids take part but never name a component unless
    all its ids are null; an empty table gives no rows.
    """
    fps = durable(fingerprints(docs, shingle=shingle))
    named = durable(clusters(fps, max_bits))
    lowest = fps.groupBy("fp").agg(F.min("doc_id").alias("d")).join(named, "fp")
    roots = lowest.groupBy("root").agg(F.min("d").alias("component_id"))
    comp = named.join(roots, "root").select("fp", "component_id")
    return fps.join(comp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id.

    Rows that agree in doc_id and text are one document and stay once.  Null
    doc_ids come last.  Columns of ``docs`` are returned unchanged.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    fps = durable(fingerprints(keyed, id_cols=("doc_id", "h"), shingle=shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("k")
    kept = (fps.groupBy("fp").agg(first).join(clusters(fps, max_bits), "fp")
            .groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("d"), F.col("k.h").alias("g")))
    rows = packed(docs).withColumn("doc_id", F.col("row.doc_id")).withColumn("h", F.xxhash64("row.text"))
    on = F.col("h").eqNullSafe(F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d"))
    return rows.join(kept, on, "left_semi").dropDuplicates(["doc_id", "h"]).select("row.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of documents."""
    return near_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
