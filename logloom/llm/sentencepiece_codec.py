"""SentencePiece encoding and decoding on the tokenizers library (operator 6).

The model file (a protobuf) is parsed on the driver and rebuilt: normaliser
(character map, white-space rules, dummy prefix), the metaspace marker, unigram
scores or BPE merges ranked by score, and byte fallback.  Tasks encode batches
with the library's threads; every result is compared with the sentencepiece
library; a row whose ids differ from it is flagged.

If no piece goes on after a non-marker character with the marker, a text's
tokens are those of its pieces "markers + word", one after another.  Then each
distinct piece of a batch is encoded, and verified, once.  Other models take
whole texts.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import map_batches, packed, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
CACHE_PIECES = 250_000  # pieces kept by a worker (about 55 MB); then it starts anew
CACHE_LENGTH = 64  # longer pieces are not kept
GROUP = 64  # new pieces encoded as one text
MARK = "▁"
PIECE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

UNIGRAM, BPE = 1, 2  # model types, and below piece types, of the protobuf
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def parse(model: bytes):
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return proto


def is_local(proto) -> bool:
    """True if texts may be encoded piece by piece."""
    spec = proto.normalizer_spec
    plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
    words = [p for p in proto.pieces if p.type in (NORMAL, USER, UNUSED)]
    return (plain and not proto.trainer_spec.treat_whitespace_as_suffix and all(p.type != USER for p in words)
            and any(p.piece == MARK for p in words) and all(re.fullmatch(f"{MARK}*[^{MARK}]*", p.piece) for p in words))


def build(proto):
    """A tokenizers.Tokenizer equal to the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    kind, spec = proto.trainer_spec.model_type, proto.normalizer_spec
    unk = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), 0)
    fallback = any(p.type == BYTE for p in proto.pieces)
    words = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER, UNUSED)}
    if kind == BPE:
        # a pair may merge if the result is a piece; the order is that of the result's score
        found = [(-proto.pieces[i].score, i, c, (s[:c], s[c:])) for s, i in words.items() for c in range(1, len(s))
                 if s[:c] in words and s[c:] in words]
        model = models.BPE({p.piece: i for i, p in enumerate(proto.pieces)}, [m[-1] for m in sorted(found)],
                           unk_token=proto.pieces[unk].piece, fuse_unk=True, byte_fallback=fallback)
    elif kind == UNIGRAM:
        low = min((p.score for p in proto.pieces if p.type == NORMAL), default=0.0)
        # what a text must not match by its spelling gets the least score; controls get a spelling of their own
        rows = [(f"{p.piece}" if p.type == CONTROL else p.piece,
                 p.score if p.type in (NORMAL, USER) else low) for p in proto.pieces]
        model = models.Unigram(rows, unk_id=unk, byte_fallback=fallback)
    else:
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    tok = Tokenizer(model)
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
        if spec.remove_extra_whitespaces:  # markers that the text spells itself go at its end, too
            steps.append(normalizers.Replace(Regex(f"{MARK}+\\z"), ""))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    tok.add_tokens([AddedToken(p.piece, normalized=False) for p in proto.pieces if p.type == USER])
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                     *([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else [])])
    return tok


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, model: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece
        proto = parse(model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tok, self.local, self.threads = build(proto), is_local(proto), threads
        self.bytes = np.array([p.type == BYTE for p in proto.pieces])
        self.bare = build(proto)  # without normaliser: its input is normalised already
        from tokenizers import normalizers
        self.bare.normalizer = normalizers.Sequence([])
        # bytes of a piece, markers included; the unknown piece spells nothing that can be counted
        self.size = np.array([1 if p.type == BYTE else len(p.piece.encode()) if p.type != UNKNOWN else -(1 << 40) for p in proto.pieces])
        self.known: dict[str, bytes] = {}  # piece -> its ids as 32-bit integers
        self.odd: set[str] = set()

    def _whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        mine = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.reference.encode(texts, num_threads=self.threads)
        return mine, [a == b for a, b in zip(mine, theirs)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces, verified; many at a time, and cut apart by the bytes that the ids spell."""
        words = [p for p in pieces if p.strip(MARK)]  # markers alone would join with what follows
        out = self._learn_each([p for p in pieces if not p.strip(MARK)])
        groups = [words[i:i + GROUP] for i in range(0, len(words), GROUP)]
        joined = ["".join(g)[1:].replace(MARK, " ") for g in groups]
        mine = [e.ids for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)]
        theirs = self.reference.encode(joined, num_threads=self.threads)
        for group, a, b in zip(groups, mine, theirs):
            ids = np.array(a, np.int32)
            spelled, wanted = np.cumsum(self.size[ids]), np.cumsum([len(p.encode()) for p in group])
            stop = np.searchsorted(spelled, wanted)
            if a != b or stop[-1] != len(ids) - 1 or (spelled[stop] != wanted).any():
                out |= self._learn_each(group)
                continue
            data, at = ids.tobytes(), 0
            for p, end in zip(group, (4 * (stop + 1)).tolist()):
                out[p] = data[at:end]
                at = end
        return out

    def _learn_each(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces (each starts with the marker), verified one by one."""
        texts = [p[1:].replace(MARK, " ") for p in pieces]
        mine = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.reference.encode(texts, num_threads=self.threads)
        out = {}
        for p, a, b in zip(pieces, mine, theirs):
            if p == MARK:  # both read this as an empty text, but in a text it is a piece
                a = b = self.bare.encode(p, add_special_tokens=False).ids
            out[p] = array("i", a).tobytes()
            if a != b:
                self.odd.add(p)
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids and parity per text."""
        if not self.local:
            ids, same = self._whole(texts)
            return [np.array(i, np.int32) for i in ids], same
        if len(self.known) > CACHE_PIECES:
            self.known, self.odd = {}, set()
        cut = [PIECE.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        found = [list(map(self.known.get, c)) for c in cut]
        new = list(dict.fromkeys(p for c, f in zip(cut, found) if None in f for p, x in zip(c, f) if x is None))
        extra = self._learn(new) if new else {}
        ids = [np.frombuffer(b"".join([extra[p] if x is None else x for p, x in zip(c, f)] if None in f else f), np.int32)
               for c, f in zip(cut, found)]
        same = [not self.odd or self.odd.isdisjoint(c) for c in cut]
        self.known.update((p, x) for p, x in extra.items() if len(p) <= CACHE_LENGTH)
        self.odd -= {p for p in self.odd if len(p) > CACHE_LENGTH}
        return ids, same

    def decode(self, ids: list) -> list[str]:
        return self.tok.decode_batch([i.tolist() if isinstance(i, np.ndarray) else list(i) for i in ids], skip_special_tokens=False)


_CODECS: dict = {}


def _codec(shared, key: str, threads: int) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, threads)
    return _CODECS[key]


def _share(spark: SparkSession, model_path: str):
    import hashlib
    with open(model_path, "rb") as f:  # on the driver only
        model = f.read()
    parse(model)
    return spark.sparkContext.broadcast(model), hashlib.sha1(model).hexdigest()


def _list(ids: list[np.ndarray]) -> pa.Array:
    sizes = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _columns(codec: Codec, texts: list[str]) -> dict[str, pa.Array]:
    """The new columns for texts, which are encoded and decoded again."""
    ids, same = codec.encode(texts)
    back = codec.decode(ids)
    return {"token_ids": _list(ids), "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
            "n_byte_tokens": pa.array([int(codec.bytes[i].sum()) for i in ids], pa.int64()),
            "parity": pa.array(same, pa.bool_()), "round_trip": pa.array([b == t for b, t in zip(back, texts)], pa.bool_())}


TEXTS = 512  # texts encoded at once


def encode(docs: DataFrame, model_path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``docs`` plus token_ids, n_tokens, n_byte_tokens, parity and round_trip.

    Null and empty texts have no tokens.  The ids are those of the rebuilt
    tokenizer.  parity: the sentencepiece library gives the same ids for every
    piece of the text (for models that take whole texts: for the text); round_trip: the rebuilt
    tokenizer's decoder gives the text back from its ids.  Columns of ``docs``
    that clash with the new ones are replaced.
    """
    shared, key = _share(docs.sparkSession, model_path)
    new = "token_ids array<int>, n_tokens long, n_byte_tokens long, parity boolean, round_trip boolean"
    names = ["token_ids", "n_tokens", "n_byte_tokens", "parity", "round_trip"]
    rows = packed(docs).withColumn("text", F.col("row.text").cast("string"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {new}"

    def run(batches):
        codec = _codec(shared, key, threads)
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), **_columns(codec, texts)})

    return rows.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in names], *names)


def decode(tokens: DataFrame, model_path: str = MODEL, threads: int = THREADS, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` plus ``text`` decoded from ``ids_col``; null ids give null text."""
    shared, key = _share(tokens.sparkSession, model_path)
    keep = [f for f in tokens.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", text string"

    def run(batch):
        ids = batch.column(ids_col).to_pylist()
        text = _codec(shared, key, threads).decode([i or [] for i in ids])
        return {f.name: batch.column(f.name) for f in keep} | {
            "text": pa.array([None if i is None else t for i, t in zip(ids, text)], pa.string())}

    return map_batches(tokens.select(*[F.col(f"`{f.name}`") for f in keep]), run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every row of documents, with parity and round trip."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
