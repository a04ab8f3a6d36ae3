import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import token_files as T
from logloom.session import shared_path

DOC = "doc_id long, text string, ids string, start long, h string"


def library(texts):
    return [e.ids + [T.END_ID] for e in Tokenizer.from_file(T.MODEL).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("high", [0, 1, 255, 40_000, (1 << 32) - 1])
def test_blocks_round_trip(high):
    rnd = np.random.default_rng(high % 97)
    ids = rnd.integers(0, high, 7 * T.BLOCK, endpoint=True).astype(np.uint32)
    ids[T.BLOCK:2 * T.BLOCK] = 9  # no width
    ids[3 * T.BLOCK + 5] = (1 << 32) - 1  # one exception, of the greatest size
    ids[4 * T.BLOCK:4 * T.BLOCK + 25] = 1 << 31  # as many exceptions as the percentile lets through
    data, start = T.pack_blocks(ids)
    assert (T.unpack_blocks(np.frombuffer(data, np.uint8), start) == ids).all()
    some = [5, 2, 3]
    assert (T.unpack_blocks(np.frombuffer(data, np.uint8), start[some]) == ids.reshape(-1, T.BLOCK)[some].reshape(-1)).all()


def test_width_is_the_percentile():
    ids = np.zeros(T.BLOCK, np.uint32)
    ids[:26] = 1 << 20  # more than a tenth: they decide the width
    wide, _ = T.pack_blocks(ids)
    ids[25] = 0
    narrow, _ = T.pack_blocks(ids)
    assert len(wide) == 8 + 21 * T.BLOCK // 8 and len(narrow) == 8 + 5 * 25


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40) | st.lists(st.sampled_from(
    ["It's", "'SAVE", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", " ", " ", " ", "\x1c", "\n\n", "H̱", "̱", "İ", "Ω", "12a3", "ﬁ", "É", "×", "ŉ", "!\x01?", "ab'llc", "\u00a0", "ª", "ſ", "東京", "🙂!"]),
    max_size=8).map("".join), max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    with open(T.MODEL, "rb") as f:
        enc = ENCODERS.setdefault("e", T.Encoder(f.read()))
    assert enc.by_word
    got = [np.frombuffer(b, enc.dtype).tolist() + [T.END_ID] for b in enc.encode([t.encode() for t in texts])]
    assert got == library(texts)


ENCODERS: dict = {}


def documents():
    rnd = random.Random(5)
    words = ["Alpha", "beta's", "x9", "Größe", "...", "zzqxj", "東京"]
    rows = [(9, None), (3, ""), (None, "null id"), (3, "tie one"), (3, "tie two"), (3, "tie two"), (7, "w " * 700_000), (-4, "minus")]
    return rows + [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(300)]


def test_files_hold_the_ids_in_order(spark):
    docs = documents()
    df = spark.createDataFrame([(d, t, "i", 0, "h") for d, t in docs], DOC).repartition(5)
    path = shared_path(spark)
    T.write_tokens(df, path, shard_bytes=200_000)
    got = sorted(T.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert len(spark.read.format("binaryFile").load(path).where("length > 0").collect()) > 3
    assert [r.doc_id for r in got] == sorted([d for d, _ in docs], key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = sorted(((d is not None, d or 0), ids) for (d, _), ids in zip(docs, library([t for _, t in docs])))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), list(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    again = T.read_tokens(spark, path, with_ids=False).collect()
    assert sorted(map(tuple, again), key=lambda r: r[1]) == [tuple(r)[:4] for r in got]
    few = {r.doc_id: list(r.ids) for r in T.read_documents(spark, path, [7, 120, 5, 9]).collect()}
    assert few == {d: ids for (_, d), ids in want if d in (7, 120, 9)}


def test_shards_follow_one_another(spark):
    df = spark.createDataFrame([(1, "one two " * 5000) for _ in range(60)], "doc_id long, text string").repartition(4)
    path = shared_path(spark)
    T.write_tokens(df, path, shard_bytes=120_000)  # copies of one document fill several shards
    rows = T.read_tokens(spark, path, with_ids=False).orderBy("start").collect()
    assert [r.start for r in rows] == [10_001 * i for i in range(60)]
    assert len({r.ids_crc32 for r in rows}) == 1
    assert spark.read.format("binaryFile").load(path).where("length > 0").count() > 3


def test_empty_table_and_damaged_file(spark):
    path = shared_path(spark)
    T.write_tokens(spark.createDataFrame([], DOC), path)
    assert T.read_tokens(spark, path).count() == 0 and T.read_documents(spark, path, [1]).count() == 0
    with pytest.raises(ValueError):
        T.Shard(b"x" * 200)


def test_query(spark):
    from tests.conftest import SF
    rows = T.op11_token_files(spark, SF).orderBy("start").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    ids = library([d.text for d in docs])
    starts = [0, *np.cumsum([len(i) for i in ids]).tolist()]
    assert [tuple(r) for r in rows] == [(d.doc_id, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in zip(docs, starts, ids)]
    assert T.op11_token_files(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
