"""Benchmark decontamination by a broadcast set of normalised n-grams (operator 10).

Words are runs of digits, a-z and non-ASCII characters after folding A-Z.  A
window is ``size`` consecutive words of an item; an item of fewer words (but
not none) is one window.  Document windows are looked up by a 64-bit hash of
word numbers, each hit is verified word by word, and every word inside a
verified occurrence is marked.

The set is broadcast only if the benchmark has at most ``BROADCAST_WORDS``
words (counted first).  A larger benchmark takes a bitmap of fixed size as
pre-filter and an equi-join of window texts, with equal results.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import durable, map_batches, packed, sha_join, table

WINDOW_WORDS = 10
BROADCAST_WORDS = 500_000  # about 60 MB in a worker
BITMAP_BITS = 1 << 26  # 8 MB, whatever the size of the benchmark

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words, before folding


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


def _hash_windows(ids: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(ids) - size + 1, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + len(h)].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h


class GramSet:
    """Windows of a bounded list of (item, words joined by spaces)."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        found: dict[int, list] = {}
        for name, line in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in line.split()], np.int64)
            if len(ids):
                found.setdefault(min(size, len(ids)), []).append((number[name], ids))
        self.by_size = {}
        for k, group in found.items():
            hashes = np.concatenate([_hash_windows(ids, k) for _, ids in group])
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, k) for _, ids in group])
            item = np.concatenate([np.full(len(ids) - k + 1, i) for i, ids in group])
            order = np.argsort(hashes, kind="stable")
            self.by_size[k] = hashes[order], rows[order], item[order]

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Marks of the hit words, and the numbers of the items with an occurring window."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        marks, items = np.zeros(len(words) + 1, np.int64), set()
        gaps = np.r_[0, np.cumsum(ids == 0)]
        for k, (hashes, rows, item) in self.by_size.items():
            at = np.flatnonzero(gaps[k:] == gaps[:-k]) if len(ids) >= k else ids[:0]  # windows of known words only
            if not len(at):
                continue
            windows = np.lib.stride_tricks.sliding_window_view(ids, k)
            h = _hash_windows(ids, k)[at]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            seen = set()
            for i in np.flatnonzero(hi > lo):
                same = (rows[lo[i]:hi[i]] == windows[at[i]]).all(axis=1)
                if same.any():
                    marks[at[i]] += 1
                    marks[at[i] + k] -= 1
                    if h[i] not in seen:
                        seen.add(h[i])
                        items.update(item[lo[i]:hi[i]][same].tolist())
        return np.cumsum(marks[:-1]) > 0, items


def _runs(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_CACHE: dict = {}


def _items(benchmark: DataFrame) -> DataFrame:
    """item (string, '' for null) and its normalised words joined by spaces; items without words are left out."""

    def run(batch):
        lines = [b" ".join(words_of(t)) for t in batch.column("t").to_pylist()]
        return {"item": batch.column("item"), "line": pa.array(lines, pa.binary()),
                "n": np.array([len(x.split()) for x in lines], np.int64)}

    return map_batches(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                                        F.col("text").cast("string").alias("t")),
                       run, "item string, line binary, n long").where("n > 0")


def _scan_broadcast(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    grams = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.line)) for r in items.select("item", "line").collect()])
    key = hashlib.sha1(repr(sorted(grams.value)).encode()).hexdigest(), size

    def run(batch):
        if key not in _CACHE:
            _CACHE.clear()
            _CACHE[key] = GramSet(grams.value, size)
        found = _CACHE[key]
        n, spans, names = [], [], []
        for text in batch.column("__text").to_pylist():
            words = words_of(text)
            hit, items = found.find(words) if words else (np.zeros(0, bool), ())
            n.append(len(words))
            spans.append(_runs(hit))
            names.append([found.names[i] for i in sorted(items)])
        return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "n_words": pa.array(n, pa.int64()),
                "spans": pa.array(spans, _SPANS), "items": pa.array(names, pa.list_(pa.string()))}

    return map_batches(docs, run, _schema(docs))


def _schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, h long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _windows(words: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


def _scan_join(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Any benchmark size: bitmap pre-filter of fixed size, then an equi-join on the window's text."""
    spark = docs.sparkSession

    def cut(batch):
        out = {"item": [], "window": [], "k": []}
        for item, line in zip(batch.column("item").to_pylist(), batch.column("line").to_pylist()):
            words = line.split()
            got = _windows(words, min(size, len(words)))
            out["item"] += [item] * len(got)
            out["window"] += got
            out["k"] += [min(size, len(words))] * len(got)
        return {"item": pa.array(out["item"], pa.string()), "window": pa.array(out["window"], pa.binary()),
                "k": pa.array(out["k"], pa.int32())}

    grams = durable(map_batches(items, cut, "item string, window binary, k int").distinct())
    sizes = [r.k for r in grams.select("k").distinct().collect()]  # at most ``size`` values
    width = BITMAP_BITS // 64

    def bits(batches):
        used = np.zeros(width, np.uint64)
        for batch in batches:
            at = np.array([zlib.crc32(w) % BITMAP_BITS for w in batch.column("window").to_pylist()], np.int64)
            np.bitwise_or.at(used, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_pydict({"i": at, "v": used[at].view(np.int64)})

    words = grams.mapInArrow(bits, "i long, v long").groupBy("i").agg(F.bit_or("v").alias("v"))
    used = np.zeros(width, np.uint64)
    for batch in words.toArrow().to_batches():  # at most BITMAP_BITS / 64 rows
        used[batch.column("i").to_numpy()] = batch.column("v").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(used)

    def propose(batch):
        test, crc = shared.value, zlib.crc32
        out = {"doc_id": [], "h": [], "pos": [], "window": []}
        for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "__text"))):
            words = words_of(text)
            for k in sizes:
                for pos, w in enumerate(_windows(words, k)):
                    c = crc(w) % BITMAP_BITS
                    if int(test[c >> 6]) >> (c & 63) & 1:
                        for col, v in zip(out, (doc, h, pos, w)):
                            out[col].append(v)
        return {"doc_id": pa.array(out["doc_id"], batch.schema.field("doc_id").type), "h": pa.array(out["h"], pa.int64()),
                "pos": pa.array(out["pos"], pa.int64()), "window": pa.array(out["window"], pa.binary())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = (map_batches(docs, propose, f"doc_id {kind}, h long, pos long, window binary")
             .join(grams, "window").groupBy("doc_id", "h")
             .agg(F.collect_set(F.struct("pos", "k")).alias("at"), F.sort_array(F.collect_set("item")).alias("items")))

    def merge(batch):
        spans = []
        for at in batch.column("at").to_pylist():
            marks = np.zeros(max(x["pos"] + x["k"] for x in at) + 1, np.int64)
            for x in at:
                marks[x["pos"]] += 1
                marks[x["pos"] + x["k"]] -= 1
            spans.append(_runs(np.cumsum(marks[:-1]) > 0))
        return {"d": batch.column("doc_id"), "g": batch.column("h"), "spans": pa.array(spans, _SPANS), "items": batch.column("items")}

    found = map_batches(found, merge, f"d {kind}, g long, spans array<struct<start:long,end:long>>, items array<string>")

    def count(batch):
        return {"doc_id": batch.column("doc_id"), "h": batch.column("h"),
                "n_words": np.array([len(words_of(t)) for t in batch.column("__text").to_pylist()], np.int64)}

    counted = map_batches(docs, count, f"doc_id {kind}, h long, n_words long")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return (counted.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g")), "left")
            .select("doc_id", "h", "n_words", F.coalesce("spans", none).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def _hits(docs: DataFrame, benchmark: DataFrame, size: int, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    items = durable(_items(benchmark))
    total = items.agg(F.sum("n")).first()[0] or 0
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("__text"))
    return (_scan_broadcast if total <= broadcast_words else _scan_join)(rows, items, size)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS,
                  broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: doc_id, n_words, spans (word intervals hit, end exclusive), items.

    Null or wordless text has no words and no hits; null item text is no item,
    a null item_id reads as ''.  Repeated rows are reported once each; empty
    tables give no rows or no hits.  Other columns are not read.
    """
    return _hits(docs, benchmark, size, broadcast_words).drop("h")


def _cut(text: str | None, spans: list[dict] | None) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if not spans:
        return text
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, end = [], 0
    for s in spans:
        out.append(text[end:at[s["start"]][0]])
        end = at[s["end"] - 1][1]
    return "".join(out) + text[end:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without contaminated documents (mode "documents") or without the hit spans (mode "spans").

    All columns are kept; in mode "spans" only ``text`` (and ``n_chars``, if
    there is one) changes.  Rows with the same doc_id and text share a verdict.
    """
    hits = _hits(docs, benchmark, size).where("size(spans) > 0").select(
        F.col("doc_id").alias("d"), F.col("h"), "spans").dropDuplicates(["d", "h"])
    on = F.col("row.doc_id").eqNullSafe(F.col("d")) & F.xxhash64("row.text").eqNullSafe(F.col("h"))
    if mode == "documents":
        return packed(docs).join(hits, on, "left_anti").select("row.*")
    cut = F.udf(_cut, "string", useArrow=True)
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNotNull(), F.char_length("cut").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    out = packed(docs).join(hits, on, "left").withColumn("cut", cut(F.col("row.text").cast("string"), "spans"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every row of documents."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(sha_join("items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
          FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
wins AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
         FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM grams))),
hits AS MATERIALIZED (SELECT r, i, wins.k, item FROM wins JOIN grams ON wins.g = grams.g AND wins.k = grams.k),
marks AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marks USING (r) LEFT JOIN names USING (r)
"""
