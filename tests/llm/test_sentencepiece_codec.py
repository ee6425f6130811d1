import hashlib
import os
import random
import struct

import pyarrow as pa
import pytest

from ledgerlark.llm import sentencepiece_codec as S

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no model file")

TEXTS = ["", " ", "a", "  two  spaces  ", "tab\tand\nnewline", "Straße über ñandú", "日本語 текст 🙂", "<s> </s> <unk> <0x41>", "▁already ▁marked", "x" * 3000, "a" + " " * 40 + "b", " nbsp", "é combining", "\x00\x01", "ﬁ ligature", "don't stop!!! 12,345.67"]


def message(*parts):
    """A protobuf message from (number, value)."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("▁the", -1.5, 1), ("▁th", -2.5, 1), ("e", -2.2, 1), ("he", -2.4, 1), ("r", -2.9, 1), ("er", -2.0, 1), ("t", -3.1, 1), ("h", -3.2, 1), ("▁t", -2.6, 1)]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return body + message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2)))) + message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


@pytest.mark.parametrize("raw", [S.load() if os.path.exists(S.MODEL) else b"", unigram_model()], ids=["bpe", "unigram"])
def test_parity_and_round_trip(raw):
    codec = S.Codec(raw)
    original = sentencepiece.SentencePieceProcessor(model_proto=raw)
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("the rté\n ") for _ in range(r.randrange(1, 200))) for _ in range(200)]
    ids = codec.encode(texts)
    assert ids == [original.encode(t) for t in texts]
    assert [codec.decode(x) for x in ids] == [original.decode(x) for x in ids] == [codec.normal(t) for t in texts]
    assert codec.tokenizer.decode_batch(ids) == [original.decode(x) for x in ids]


def test_trimming_normaliser():
    raw = unigram_model()
    cut = raw[: raw.rindex(message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1)))))] + message((3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    codec, original = S.Codec(cut), sentencepiece.SentencePieceProcessor(model_proto=cut)
    for t in ["  the  her ", "the", "   ", "", "the her"]:
        assert codec.encode([t])[0] == original.encode(t), t


def test_queries(spark):
    rows = [(k, t, [k]) for k, t in enumerate(TEXTS)] + [(None, "the end", [1]), (99, None, [2]), (98, "word " * 30_000, [3]), (98, "word " * 30_000, [4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens array<int>")
    original = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    out = S.digests(docs, parity_share=1).collect()
    assert len(out) == len(rows) and all(x.parity or x.doc_id is None for x in out)
    by = {x.doc_id: x for x in out}
    for d, t, _ in rows:
        ids = original.encode(t or "")
        assert by[d].n_tokens == len(ids) and by[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert all(x.round_trip for x in out)  # to the normalised text: a marker in it reads as a space
    encoded = S.encode(docs)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "token_ids"]
    back = S.decode(encoded.drop("text")).collect()
    assert sorted((x.doc_id or -1, x.text or "") for x in back) == sorted((d or -1, (t or "").replace("▁", " ")) for d, t, _ in rows)
    assert [x.text for x in back if x.doc_id == 99] == [None]
    assert S.digests(docs.limit(0)).collect() == []


def test_parity_is_checked_on_every_row(spark):
    rows = [(k, f"text {k}") for k in range(50)] + [(None, "no id"), (60, None)]
    assert all(x.parity for x in S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_a_word_is_encoded_once(monkeypatch):
    """Words are looked up, also when there are more than are remembered, and give what texts encoded as a whole do."""
    codec = S.Codec(S.load())
    r = random.Random(5)
    words = ["".join(r.choices("abcdeäß.,\n▂日🙂<0x41>", k=r.randrange(1, 9))) for _ in range(400)]
    texts = TEXTS + [" ".join(r.choices(words, k=r.randrange(1, 80))) + r.choice(["", "", " ", "  x"]) for _ in range(200)]
    want = sentencepiece.SentencePieceProcessor(model_file=S.MODEL).encode(texts)
    assert codec.encode(texts) == want == codec._whole(texts)
    asked = []
    learn = codec._learn
    monkeypatch.setattr(codec, "_learn", lambda texts: (asked.append(len(codec.words)), learn(texts), asked.append(len(codec.words))))
    assert codec.encode(texts[::-1]) == want[::-1]
    assert asked[0] == asked[1] > 300
    monkeypatch.setattr(S, "WORDS", 50)
    for k in range(0, len(texts), 10):
        assert codec.encode(texts[k : k + 10]) == want[k : k + 10]
        assert len(codec.words) <= 50
    monkeypatch.setattr(S, "WORD_CHARS", 100)
    long = " ".join(["y" * 500, "b", "y" * 500])
    assert codec.encode([long, "b c"]) == sentencepiece.SentencePieceProcessor(model_file=S.MODEL).encode([long, "b c"])
    assert not codec.words and not codec.words_before


@pytest.mark.parametrize("call, columns", [(S.encode, {"text": TEXTS}), (S.digests, {"doc_id": list(range(len(TEXTS))), "text": TEXTS, "check": [True] * len(TEXTS)})], ids=["encode", "digests"])
def test_a_task_leaves_no_words_in_its_process(spark, monkeypatch, call, columns):
    df = spark.createDataFrame([], "doc_id long, text string")
    df = df if call is S.digests else df.select("text")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, work, schema: work)
    work, codec = call(df), S._codec(S.load(), S.THREADS)
    learned = []
    monkeypatch.setattr(codec, "_learn", lambda texts, f=codec._learn: (f(texts), learned.append(len(codec.words))))
    assert sum(len(b) for b in work(iter([pa.RecordBatch.from_pydict(columns)]))) == len(TEXTS) and learned[0]
    assert not codec.words and not codec.words_before and not codec.known and not codec.word_chars
