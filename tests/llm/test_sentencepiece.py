import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from logloom.llm import sentencepiece_codec as C

DOC = "doc_id long, text string, token_ids string, parity string"


def unigram(tmp_path, extra=False):
    """A small unigram model written by hand (tokenizers are never trained)."""
    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = True
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, 1, 2, -1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.escape_whitespaces = True
    m.normalizer_spec.remove_extra_whitespaces = extra
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    words = ["▁", "▁the", "▁th", "the", "th", "he", "re", "▁r", "ing", "▁on", "on", "nt", "é", "▁▁"] + list("abcdefghinorst,.")
    rows += [(w, -2.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    for p, s, t in rows:
        m.pieces.add(piece=p, score=s, type=t)
    path = tmp_path / "small.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def texts(n=120):
    rnd = random.Random(6)
    bits = ["the", "there", "on", " ", "  ", "   ", "\n", "\t", "é", "漢", "😀", "aaaa", "aaaaa", "!!!!", "###", "<s>", "a▁b", "1234567", " ", "Ing.", "ßä"]
    return ["", " ", "  a", "a  ", "\n", "▁", "the " * 3000, "x" * 20_000] + ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["bpe", "unigram", "unigram_spaces"])
def test_parity_with_the_reference(tmp_path, kind):
    path = C.MODEL if kind == "bpe" else unigram(tmp_path, kind.endswith("spaces"))
    model = open(path, "rb").read()
    codec, ref = C.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    assert codec.local == (kind != "unigram_spaces")
    rows = texts()
    ids, same = codec.encode(rows)
    assert [i.tolist() for i in ids] == ref.encode(rows)
    assert sum(same) >= 0.9 * len(rows), [t[:60] for t, s in zip(rows, same) if not s]
    ordinary = [k for k, t in enumerate(rows) if "▁" not in t and (kind != "unigram_spaces" or t == " ".join(t.split(" ")).strip(" ") and "  " not in t)]
    back = codec.decode([ids[k].tolist() for k in ordinary])
    assert back == [rows[k] for k in ordinary]


def test_encode_decode_tables(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts(30))] + [(None, None, None, None), (1, " ", "x", "y")]
    df = spark.createDataFrame(rows, DOC)
    out = C.encode(df)
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_tokens == len(r.token_ids) for r in got)
    assert all(r.round_trip for r in got if "▁" not in (r.text or ""))
    ref = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    assert all(list(r.token_ids) == ref.encode(r.text or "") for r in got)
    back = C.decode(out.drop("text")).collect()
    assert sorted(r.text for r in back) == sorted((t or "").replace("▁", " ") for _, t, *_ in rows)
    assert C.encode(spark.createDataFrame([], DOC)).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "CACHE_PIECES", 50)
    codec = C.Codec(open(C.MODEL, "rb").read())
    rows = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    one = np.concatenate([codec.encode([t])[0][0] for t in rows])
    assert len(codec.known) <= 50 + 40 and (one == np.concatenate(codec.encode(rows)[0])).all()


def test_round_trip_runs_the_decoder():
    from tokenizers import decoders
    codec = C.Codec(open(C.MODEL, "rb").read())
    rows = ["the words", "漢字 and é", "a\tb\n  c", "x" * 5000, "😀 <s>", ""]
    assert C._columns(codec, rows)["round_trip"].to_pylist() == [True] * 6
    # a decoder that leaves the dummy prefix: only the empty text comes back
    codec.tok.decoder = decoders.Sequence([decoders.Replace(C.MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    assert C._columns(codec, rows)["round_trip"].to_pylist() == [False] * 5 + [True]
