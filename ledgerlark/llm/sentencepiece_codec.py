"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here: pieces with scores and types, and the specifications
of trainer and normaliser. From them a tokenizer is rebuilt: the normaliser (character map,
white space rules, dummy prefix), the metaspace marker, then for a unigram model its scores, or for a
BPE model its merges in the order of the merged pieces' scores, and byte fallback. The text is
cut in front of runs of the marker, where no piece of the model has a marker after
another character, as nothing can merge across such a place.

The library ranks pairs, where the original ranks the merged piece and then takes the
leftmost. This matters where one piece can be made of different pairs side by side, which is what
runs of white space do. So a BPE word with two markers or more is merged here by the
original's rule, and kept for the next time it occurs. So are words of a unigram text that
spell out a control or byte piece, which the library would take for that piece.

Of a BPE model's texts without runs of white space, words are cut at the blanks. The library's model encodes a word that
a task doesn't know yet, and the task remembers the ids of up to 2 * WORDS words. All other texts are encoded in batches by several threads. Decoding looks up each piece's bytes in
numpy; the round trip and parity with the original library are checked on every row
(parity_share can lower the latter to a share of the rows, chosen by doc_id's hash).

The path is a parameter; the driver reads the file and sends its bytes along, so executors need no copy.

Cases: null and empty texts have no tokens (null ids stay null in encode()). Very long texts are encoded
as a whole. Repeated rows and null doc_ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from ledgerlark.llm import _words as W
from ledgerlark.llm._shared import bound_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
PARITY_SHARE = 1  #: one row in so many is also encoded by the original library
SLICE = 1 << 18  #: bytes of text encoded at once; the library needs some hundred bytes for each token of them
KEPT = 50_000  #: words with runs of markers that a task remembers
WORDS, WORD_CHARS = 200_000, 2_000_000  #: other words that it remembers before it forgets those that it knew before the last so many, and the characters in them

# Fixed values of the format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def fields(raw: bytes):
    """(number, value) of a protobuf message; numbers and floats as int or bytes of 4 or 8."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass(frozen=True)
class Proto:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim: bool
    suffix: bool


def parse(raw: bytes) -> Proto:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in fields(raw):
        if number == 1:
            one = dict(fields(value))
            pieces.append((one.get(1, b"").decode(), struct.unpack("<f", one[2])[0] if 2 in one else 0.0, one.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    return Proto(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(trainer.get(24, 0)))


def merges(proto: Proto) -> list[tuple[str, str]]:
    """Pairs that make a piece, best piece first."""
    index = {p: k for k, (p, _, kind) in enumerate(proto.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for p, score, kind in proto.pieces:
        if kind == NORMAL:
            found += [(-score, index[p[:k]], index[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in index and p[k:] in index]
    found.sort()
    return [x[3:] for x in found]


def build(proto: Proto) -> Tokenizer:
    if proto.suffix:
        raise ValueError("models that mark white space as a suffix aren't supported")
    unknown = next(k for k, x in enumerate(proto.pieces) if x[2] == UNKNOWN)
    if proto.kind == UNIGRAM:
        model = models.Unigram([(p, score) for p, score, _ in proto.pieces], unknown, proto.byte_fallback)
    elif proto.kind == BPE:
        vocabulary = {p: k for k, (p, _, _) in enumerate(proto.pieces)}
        model = models.BPE(vocabulary, merges(proto), unk_token=proto.pieces[unknown][0], fuse_unk=True, byte_fallback=proto.byte_fallback)
    else:
        raise ValueError(f"model type {proto.kind} isn't supported")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(proto.charsmap)] if proto.charsmap else []
    if proto.trim:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if proto.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p, _, kind in proto.pieces if kind in (NORMAL, USER_DEFINED)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    end = [decoders.Strip(" ", 1, 0)] if proto.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return tokenizer


class Codec:
    """Encodes and decodes with the model in `raw`, a .model file's bytes."""

    def __init__(self, raw: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.proto = parse(raw)
        self.tokenizer = build(self.proto)
        texts = []
        for p, _, kind in self.proto.pieces:
            texts.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode())
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.proto.pieces) if kind == BYTE}
        self.unknown = next(k for k, x in enumerate(self.proto.pieces) if x[2] == UNKNOWN)
        self.size = np.array([len(t) for t in texts])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

        self.exact = None
        if self.tokenizer.pre_tokenizer is not None:
            spelled = "|".join(re.escape(p) for p, _, kind in self.proto.pieces if kind not in (NORMAL, USER_DEFINED))
            self.exact = re.compile(f"({MARK}{{2,}}[^{MARK}]*)" if self.proto.kind == BPE else f"({MARK}*[^{MARK}]*(?:{spelled})[^{MARK}]*)")
        self.least = min((score for p, score, kind in self.proto.pieces if kind == NORMAL), default=0.0)
        self.scores = {p: (score, k) for k, (p, score, kind) in enumerate(self.proto.pieces) if kind in (NORMAL, USER_DEFINED)}
        self.known: dict[str, list[int]] = {}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        self.word_chars = 0
        #: whether texts may be put together from words, each with a marker in front and normal as it is
        self.by_word = self.exact is not None and self.proto.kind == BPE and self.proto.dummy_prefix and not self.proto.charsmap and not self.proto.trim
        if self.exact:
            # the same model, for texts that are normalised already
            self.inner = Tokenizer(self.tokenizer.model)
            self.inner.pre_tokenizer = self.tokenizer.pre_tokenizer
            self.inner.normalizer = normalizers.Sequence([])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.arrays(texts)]

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, as int32."""
        words = {k: t.split(" ") for k, t in enumerate(texts) if self.by_word and t and "  " not in t and MARK not in t and t[0] != " " != t[-1]}
        other = iter(self._whole([t for k, t in enumerate(texts) if k not in words]))
        self._learn(words.values())
        found = [np.frombuffer(b"".join(map(self.words.__getitem__, words[k])), np.int32) if k in words else np.array(next(other), np.int32) for k in range(len(texts))]
        if len(self.words) > WORDS or self.word_chars > WORD_CHARS:
            self.words_before, self.words, self.word_chars = self.words if self.word_chars <= 2 * WORD_CHARS else {}, {}, 0
        return found

    def forget(self) -> None:
        """Lets go of all words. Tasks end with it: Python workers live on, and other operators work in them."""
        self.known, self.words, self.words_before, self.word_chars = {}, {}, {}, 0

    def _learn(self, texts) -> None:
        """Adds the words that aren't known yet."""
        for word in set().union(*texts).difference(self.words):
            self.words[word] = self.words_before.get(word) or array("i", [x.id for x in self.tokenizer.model.tokenize(MARK + word)]).tobytes()
            self.word_chars += len(word)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that are encoded as a whole."""
        if not texts:
            return []
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.exact:
            for k, text in enumerate(texts):
                if "  " in text or MARK in text or text[:1] == " " or self.proto.kind == UNIGRAM:
                    if self.exact.search(text := self.tokenizer.normalizer.normalize_str(text)):
                        found[k] = self._with_exact(text)
        return found

    def _with_exact(self, text: str) -> list[int]:
        """Ids of a normalised text with words that follow the original's rule here."""
        parts = self.exact.split(text)
        plain = [e.ids for e in self.inner.encode_batch_fast(parts[::2], add_special_tokens=False)]
        out = list(plain[0])
        for word, rest in zip(parts[1::2], plain[1:]):
            if word not in self.known:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[word] = self._merge(word) if self.proto.kind == BPE else self._best_path(word)
            out += self.known[word]
            out += rest
        return out

    def _merge(self, word: str) -> list[int]:
        """The best piece first, the leftmost of equal ones."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

        def offer(i: int):
            j = after[i] if i >= 0 else len(parts)
            if j < len(parts) and (joint := parts[i] + parts[j]) in self.scores:
                return -self.scores[joint][0], i, joint
            return None

        heap = [x for x in map(offer, range(len(parts))) if x]
        heapify(heap)
        while heap:
            _, i, joint = heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != joint:
                continue
            parts[i], parts[j] = joint, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (more := offer(x)):
                    heappush(heap, more)
        return self._ids(p for p in parts if p is not None)

    def _best_path(self, word: str) -> list[int]:
        """The pieces with the highest sum of scores."""
        widest = max(map(len, self.scores), default=1)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), 0)] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + widest) + 1):
                p = word[i:j]
                score = self.scores[p][0] if p in self.scores else self.least - 10 if j == i + 1 else float("-inf")
                if best[i][0] + score > best[j][0]:
                    best[j] = (best[i][0] + score, i)
        cuts = [len(word)]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        return self._ids(word[a:b] for b, a in zip(cuts[-2::-1], cuts[:0:-1]))

    def _ids(self, parts) -> list[int]:
        out: list[int] = []
        for p in parts:
            if p in self.scores:
                out.append(self.scores[p][1])
            elif self.proto.byte_fallback:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def surface(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, the dummy prefix with them."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        return self.bytes[np.repeat(self.start[ids] - ends + size, size) + np.arange(total)].tobytes()

    def decode(self, ids) -> str:
        raw = self.surface(np.asarray(ids, np.int64))
        return (raw[1:] if self.proto.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def normal(self, text: str) -> str:
        """What decode(encode(text)) gives where every character has a piece or bytes."""
        text = self.tokenizer.normalizer.normalize_str(text).replace(MARK, " ")
        return text[1:] if self.proto.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def _codec(raw: bytes, threads: int) -> Codec:
    codec = Codec(raw, threads)
    W.give_back()  # building it takes more than keeping it
    return codec


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = MODEL, threads: int = THREADS, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with a further column of token ids (array<int>); null where the text is null."""
    bound_batches(docs.sparkSession)
    raw = load(path)
    schema = docs.withColumn(ids, F.lit(None).cast("array<int>")).schema
    names = schema.names

    def work(stream):
        codec = _codec(raw, threads)
        for batch in stream:
            for i, j, _, _ in W.slices(batch.column(text), SLICE):
                part = batch.slice(i, j - i)
                texts = part.column(text).to_pylist()
                found = codec.arrays([t or "" for t in texts])
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                missing = pa.array([t is None for t in texts])
                column = pa.ListArray.from_arrays(pa.array(at), pa.array(flat), mask=missing) if part.column(text).null_count else pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names)
            del batch
        codec.forget()
        W.give_back()

    return docs.mapInArrow(work, schema)


def decode(tokens: DataFrame, path: str = MODEL, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """tokens with a further column: the text that the ids stand for; null where they are null."""
    bound_batches(tokens.sparkSession)
    raw = load(path)
    schema = tokens.withColumn(text, F.lit(None).cast("string")).schema

    def work(stream):
        codec = _codec(raw, THREADS)
        for batch in stream:
            texts = [None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return tokens.mapInArrow(work, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean"


def digests(docs: DataFrame, path: str = MODEL, threads: int = THREADS, parity_share: int = PARITY_SHARE) -> DataFrame:
    """doc_id, number and SHA-256 of the ids (4 bytes each, little-endian), whether they decode to the normalised text, and whether the original library gives the same ids (null where not checked)."""
    bound_batches(docs.sparkSession)
    raw = load(path)

    def work(stream):
        import sentencepiece

        codec = _codec(raw, threads)
        original = sentencepiece.SentencePieceProcessor(model_proto=raw)
        plain = not codec.proto.charsmap and not codec.proto.trim
        for batch in stream:
            picked = batch.column("check").to_numpy(zero_copy_only=False)
            for i, j, _, _ in W.slices(batch.column("text"), SLICE):
                texts = [t or "" for t in batch.column("text").slice(i, j - i).to_pylist()]
                n, sha, trip, parity = [], [], [], [None] * len(texts)
                for k, (text, ids) in enumerate(zip(texts, codec.arrays(texts))):
                    n.append(len(ids))
                    sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    want = text.replace(MARK, " ") if plain else codec.normal(text)
                    trip.append(codec.surface(ids) == ((" " if codec.proto.dummy_prefix and want else "") + want).encode())
                    if picked[i + k]:
                        parity[k] = original.encode(text) == ids.tolist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(trip, pa.bool_()), pa.array(parity, pa.bool_())], [x.split()[0] for x in DIGEST.split(", ")])
            del batch
        codec.forget()
        W.give_back()

    check = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(parity_share)) == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(check, F.lit(False)).alias("check")).mapInArrow(work, DIGEST)
