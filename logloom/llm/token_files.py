"""Token ids in binary files of patched frame-of-reference blocks (operator 11).

A document's ids are those of a tokenizers model, with an end id behind them.
Documents are ordered by doc_id (null first, then by a hash of the text) and cut
into shards, one file each, that follow one another in that order:

    blocks | index | footer, the blocks in chunks that end with a line feed

A block holds ``BLOCK`` ids (the last one of a shard is filled up): its minimum
(4 bytes), a bit width (1), a zero byte, the number of exceptions (2), the low
``width`` bits of all differences to the minimum, then the places (1 byte each)
and the high parts (4 bytes each) of the exceptions.  The width is the smallest
one that ``PERCENT`` of the block's differences fit.  The index has the byte
where each block starts and, per document, its id, whether that is null, and
where its ids end.  Numbers are little-endian.

Spark's text writer puts the bytes of each value out unchanged, so shards go to
any store that Spark writes to, and its committer keeps the files of lost or
repeated tasks out.  They are read back by the ``binaryFile`` source.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import durable, offsets, sliced, table
from logloom.session import shared_path, written

MODEL = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 1
BLOCK = 256
PERCENT = 90
SHARD_BYTES = 40_000_000  # text in a shard, about; a file of some 30 MB
LEAST_BYTES = 2_000_000  # smaller shards are not made for the sake of more tasks
FLUSH = 1 << 20  # ids packed at once
GROUP = 256  # new words encoded as one text
CACHE_WORDS = 600_000  # words kept by a worker (about 110 MB); then it starts anew
CACHE_LENGTH = 48  # longer ones are not kept
HEAD = np.dtype([("base", "<u4"), ("width", "u1"), ("zero", "u1"), ("n_exc", "<u2")])
FOOTER = "<8sIIQQQQQ"  # magic, block size, crc32 of the index, shard, ids, blocks, documents, index start
MAGIC = b"PFORIDS1"


# ---- blocks -------------------------------------------------------------------------

def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """(m, 64) values of w bits -> (m, 8 w) bytes."""
    cols, out = np.ascontiguousarray(v.T), np.zeros((w, len(v)), np.uint64)
    for i in range(64):
        k, s = divmod(i * w, 64)
        out[k] |= cols[i] << np.uint64(s)
        if s + w > 64:
            out[k + 1] |= cols[i] >> np.uint64(64 - s)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8)


def _unpack(data: np.ndarray, w: int) -> np.ndarray:
    """(m, 8 w) bytes -> (m, 64) values of w bits."""
    words = np.ascontiguousarray(data.view("<u8").astype(np.uint64).T)
    out, mask = np.empty((64, words.shape[1]), np.uint64), np.uint64((1 << w) - 1)
    for i in range(64):
        k, s = divmod(i * w, 64)
        v = words[k] >> np.uint64(s)
        if s + w > 64:
            v |= words[k + 1] << np.uint64(64 - s)
        out[i] = v & mask
    return np.ascontiguousarray(out.T)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each of ``counts``."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Ids below 2^32, a multiple of BLOCK of them -> the bytes of their blocks, and where each starts."""
    rows = ids.reshape(-1, BLOCK).astype(np.uint64)
    base = rows.min(axis=1)
    diff = rows - base[:, None]
    place = -(-BLOCK * PERCENT // 100) - 1
    width = _bit_length(np.partition(diff, place, axis=1)[:, place])
    high = diff >> width.astype(np.uint64)[:, None]
    row, col = np.nonzero(high)
    n_exc = np.bincount(row, minlength=len(rows))
    size = HEAD.itemsize + width * (BLOCK // 8) + 5 * n_exc
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros(len(rows), HEAD)
    head["base"], head["width"], head["n_exc"] = base, width, n_exc
    out[start[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(len(rows), -1)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        if w:
            low = diff[at] & np.uint64((1 << w) - 1)
            out[start[at][:, None] + HEAD.itemsize + np.arange(w * BLOCK // 8)] = _pack(low.reshape(-1, 64), w).reshape(len(at), -1)
    tail, rank = (start + HEAD.itemsize + width * (BLOCK // 8))[row], _within(n_exc)
    out[tail + rank] = col
    out[(tail + n_exc[row] + 4 * rank)[:, None] + np.arange(4)] = high[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), start


def unpack_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``start`` in the bytes ``data``."""
    start = start.astype(np.int64)
    head = data[start[:, None] + np.arange(HEAD.itemsize)].view(HEAD)[:, 0]
    width, n_exc = head["width"].astype(np.int64), head["n_exc"].astype(np.int64)
    out = np.zeros((len(start), BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        if w:
            bits = data[start[at][:, None] + HEAD.itemsize + np.arange(w * BLOCK // 8)]
            out[at] = _unpack(bits.reshape(-1, 8 * w), w).reshape(len(at), BLOCK)
    row, rank = np.repeat(np.arange(len(start)), n_exc), _within(n_exc)
    tail = (start + HEAD.itemsize + width * (BLOCK // 8))[row]
    high = data[(tail + n_exc[row] + 4 * rank)[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.uint64)
    out[row, data[tail + rank]] |= high << width[row].astype(np.uint64)
    return (out + head["base"].astype(np.uint64)[:, None]).astype("<u4").reshape(-1)


# ---- ids ----------------------------------------------------------------------------

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# ASCII and the letters from U+00C0 to U+017F: composed already, and letters in every version of Unicode
LATIN = re.compile(rb"(?:[\x00-\x7f]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])*")
#: the words that SPLIT finds in such a text, folded
WORD = re.compile(rb"[a-z\xc3-\xc5\x80-\xbf]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9\x80-\xff]+")


def cuts_into_words(model: dict) -> bool:
    """True if a text's ids are those of its words, one after another, and a word ends with a token that says so.

    So it is where the normaliser only composes, folds case and replaces white
    space, SPLIT finds the words, nothing is added around a text, and added
    tokens take no white space with them.
    """
    def steps(part, name):
        return [] if not part else part[name] if part["type"] == "Sequence" else [part]

    norm, pre = steps(model["normalizer"], "normalizers"), steps(model["pre_tokenizer"], "pretokenizers")
    plain = [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"} and norm[1]["content"] == " "
    split = len(pre) == 2 and (pre[0]["type"], pre[0]["behavior"], pre[0]["invert"], pre[0]["pattern"]) == ("Split", "Removed", True, {"Regex": SPLIT})
    level = split and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
    bpe = model["model"]["type"] == "BPE" and bool(model["model"]["end_of_word_suffix"]) and not model["model"]["dropout"]
    return plain and level and bpe and not model["truncation"] and not model["padding"] and all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|")
        and not any(c.isspace() for c in t["content"]) for t in model["added_tokens"])


class Encoder:
    """Ids of texts in one worker; equal to those of the library for whole texts.

    Words recur, so each is encoded once and kept; new ones go to the library
    many at a time.  Parts between white space with other characters, or with
    what may be an added token, are such words as they stand.
    """

    def __init__(self, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        spec = json.loads(model)
        self.tok, self.by_word = Tokenizer.from_str(model.decode()), cuts_into_words(spec)
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)  # tokens that end a word
        if self.by_word:
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}

    def _library(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in got]

    def _learn(self, words: list[bytes], alone: list[bytes]) -> None:
        groups = [words[i:i + GROUP] for i in range(0, len(words), GROUP)]
        size = self.dtype.itemsize
        for group, ids in zip(groups, self._library([b" ".join(g) for g in groups])):
            stops = (np.flatnonzero(self.ends[ids]) + 1) * size
            if len(stops) != len(group) or stops[-1] != len(ids) * size:
                alone += group
                continue
            data, stops = ids.tobytes(), stops.tolist()
            self.known.update(zip(group, [data[i:j] for i, j in zip([0, *stops], stops)]))
        self.known.update(zip(alone, (a.tobytes() for a in self._library(alone))))

    @staticmethod
    def _cut(text: bytes, odd: set[bytes]) -> list[bytes]:
        """Words of a text; those that only the library can cut further are added to ``odd``."""
        if b"<|" not in text and LATIN.fullmatch(text):
            return WORD.findall(text.lower())
        out = []
        for part in text.split():
            if b"<|" not in part and LATIN.fullmatch(part):
                out += WORD.findall(part.lower())
            else:
                odd.add(part)
                out.append(part)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as bytes of ``dtype``."""
        if not self.by_word:
            return [a.tobytes() for a in self._library(texts)]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        odd: set[bytes] = set()
        cut = [self._cut(t, odd) for t in texts]
        new = set().union(*cut).difference(self.known)
        self._learn(list(new - odd), list(new & odd))
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for w in new:
            if len(w) > CACHE_LENGTH:
                del self.known[w]
        return out


_ENCODERS: dict = {}


def _encoder(shared, key: int) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


# ---- files --------------------------------------------------------------------------

def _shard_writer(shared, key: int, end: bytes):
    """Task over the sorted documents of one shard: the values that make up its file."""
    size = len(end)

    def run(batches):
        held, n_held, at, starts = [], 0, 0, []
        doc_id, null, n_ids = [], [], []

        def flush(last: bool):
            nonlocal held, n_held, at
            ids = np.frombuffer(b"".join(held), f"<u{size}")
            if last:
                ids = np.r_[ids, np.repeat(ids[-1:], -len(ids) % BLOCK)]
            full = len(ids) // BLOCK * BLOCK
            for i in range(0, full, FLUSH):
                data, start = pack_blocks(ids[i:min(i + FLUSH, full)])
                starts.append(start + at)
                at += len(data) + 1  # and the line feed
                yield pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})
            held, n_held = [ids[full:].tobytes()], len(ids) - full

        for batch in sliced(batches, 512):
            ids = [i + end for i in _encoder(shared, key).encode(batch.column("text").to_pylist())]
            held += ids
            n_ids.append(np.array([len(x) // size for x in ids], np.int64))
            n_held += int(n_ids[-1].sum())
            null.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            doc_id.append(batch.column("doc_id").fill_null(0).to_numpy())
            if n_held >= FLUSH:
                yield from flush(False)
        if not n_ids:
            return
        ends = np.cumsum(np.concatenate(n_ids))
        if n_held:
            yield from flush(True)
        starts = np.concatenate(starts)
        index = b"".join([starts.astype("<u8").tobytes(), np.concatenate(doc_id).astype("<i8").tobytes(),
                          ends.astype("<u8").tobytes(), np.concatenate(null).astype("u1").tobytes()])
        foot = struct.pack(FOOTER, MAGIC, BLOCK, zlib.crc32(index), TaskContext.get().partitionId(), int(ends[-1]), len(starts), len(ends), at)
        yield pa.RecordBatch.from_pydict({"data": pa.array([index + foot], pa.binary())})

    return run


def write_tokens(docs: DataFrame, path: str, model_path: str = MODEL, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of every row of ``docs(doc_id, text, ...)`` to files under ``path``.

    doc_id is an integer or null (null first); null text is empty, its ids are
    the end id alone.  Rows with the same doc_id follow one another, by a hash
    of their texts; other columns are not read.  An empty table gives no shard.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:  # on the driver only
        model = f.read()
    dtype = Encoder(model).dtype
    if not 0 <= end_id < 1 << 8 * dtype.itemsize:
        raise ValueError(f"the end id {end_id} does not fit {dtype.itemsize} bytes")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"),
                       F.monotonically_increasing_id().alias("place"), text.cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-total // shard_bytes), min(spread, total // LEAST_BYTES))
    order = ["doc_id", "h", "place"]  # equal rows are told apart by their place, so they can fill several shards
    sorted_ = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    task = _shard_writer(spark.sparkContext.broadcast(model), zlib.crc32(model), np.array([end_id], dtype).tobytes())
    sorted_.mapInArrow(task, "data binary").select(F.col("data").cast("string")).write.text(path)


class Shard:
    """Reader of one file's bytes."""

    def __init__(self, content: bytes):
        body = len(content) - 1 - struct.calcsize(FOOTER)
        magic, block, crc, self.number, self.n_ids, n_blocks, n_docs, at = struct.unpack_from(FOOTER, content, body)
        if magic != MAGIC or block != BLOCK or zlib.crc32(content[at:body]) != crc:
            raise ValueError("not a file of token ids, or a damaged one")
        self.data = np.frombuffer(content, np.uint8)
        self.starts = np.frombuffer(content, "<u8", n_blocks, at)
        self.doc_ids = np.frombuffer(content, "<i8", n_docs, at + 8 * n_blocks)
        self.ends = np.frombuffer(content, "<u8", n_docs, at + 8 * (n_blocks + n_docs)).astype(np.int64)
        self.null = np.frombuffer(content, "u1", n_docs, at + 8 * (n_blocks + 2 * n_docs)).astype(bool)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end``; only the blocks that hold them are decoded."""
        end = min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, -(-end // BLOCK)
        return unpack_blocks(self.data, self.starts[first:last])[start - first * BLOCK:end - first * BLOCK]

    def documents(self):
        """(number, ids) of every document; an over-long one is decoded alone, others many at a time."""
        first = 0
        while first < len(self.ends):
            begin = int(self.ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(self.ends, begin + FLUSH, "right")))
            ids = self.ids(begin, int(self.ends[last - 1]))
            at = begin
            for i in range(first, last):
                yield i, ids[at - begin:int(self.ends[i]) - begin]
                at = int(self.ends[i])
            first = last


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def _with_start(rows: DataFrame) -> DataFrame:
    """``rows`` (shard, at, n_tokens, ...) with ``start`` over all shards."""
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return rows.join(offsets(sizes, "shard", "n"), "shard").withColumn("start", F.col("offset") + F.col("at")).drop("shard", "at", "offset")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, on request, ``ids`` of every document in the files under ``path``.

    start counts the ids of all documents before it; ids_crc32 is that of the
    ids as little-endian 32-bit integers.
    """
    def run(batches):
        for batch in sliced(batches, 1):
            shard = Shard(batch.column("content")[0].as_py())
            for part in _groups(shard.documents(), FLUSH):
                at = [i for i, _ in part]
                n = np.array([len(x) for _, x in part], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(len(at), shard.number, np.int64)), "at": pa.array(shard.ends[at] - n),
                    "doc_id": pa.array(shard.doc_ids[at].astype(np.int64), mask=shard.null[at]), "n_tokens": pa.array(n),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for _, x in part], pa.int64()),
                    **({"ids": pa.array([x.astype(np.int64) for _, x in part], pa.list_(pa.int64()))} if with_ids else {})})

    kind = "shard long, at long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    rows = _files(spark, path).mapInArrow(run, kind)
    rows = _with_start(written(rows) if with_ids else durable(rows))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _groups(documents, limit: int):
    """Lists of documents of about ``limit`` ids."""
    held, n = [], 0
    for i, ids in documents:
        held.append((i, ids))
        n += len(ids) + 16
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ``ids`` of the named documents: by the index, only their blocks are decoded."""
    want = np.array(sorted(set(doc_ids)), np.int64)

    def run(batches):
        for batch in sliced(batches, 1):
            shard = Shard(batch.column("content")[0].as_py())
            at = np.flatnonzero(np.isin(shard.doc_ids, want) & ~shard.null)
            for i in at.tolist():
                ids = shard.ids(int(shard.ends[i - 1]) if i else 0, int(shard.ends[i]))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([int(shard.doc_ids[i])], pa.int64()),
                                                  "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})

    return _files(spark, path).mapInArrow(run, "doc_id long, ids array<long>")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of the ids of every row of documents, read back from the files."""
    path = shared_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, with_ids=False)
