"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of byte n-grams (n in GRAMS, ASCII letters in
lower case) that both have, whatever their frequency, over the geometric mean of what
each has. N-grams are hashed to CELLS cells. LANDMARKS texts stand for all
others (Nyström): a text is described by its kernel with each landmark, and kernel
ridge regression in that space separates each language from the rest. Texts
are scored in batches: presence matrix x landmark matrix x coefficients.

Fitted on the driver on at most PER_LANGUAGE texts of each language, those with the smallest hash of doc_id. Only
their presence bits travel, CELLS / 8 bytes each.

Cases: a null text or one without a letter is `und`, with score 0. A null lang is
not learned from. Without any training text every text is `und`. Repeated rows get
equal predictions. Of different texts under one doc_id and language the one with the smallest hash is learned from. Extra columns
are ignored. Rows with a null doc_id are predicted, not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlark.llm import _features, _words as W
from ledgerlark.llm._shared import bound_batches
from ledgerlark.llm.quality_gam import held_out

GRAMS = (1, 2, 3)
CELLS = 1 << 14
PER_LANGUAGE = 300
LANDMARKS = 96
RIDGE = 1e-2
BATCH = 128
UNKNOWN = "und"


def presence(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """0/1 matrix: which cells each text's n-grams fall into."""
    rows = len(at) - 1
    out = np.zeros((rows, CELLS), np.float32)
    flat = out.ravel()
    low = W.LOWER[raw].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64) * CELLS, np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(raw))
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + low[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            cell = (code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(18)
            flat[row[:m] + np.where(left[:m] >= n, cell, 0)] = 1
    out[:, 0] = 0  # where n-grams that cross into the next text are sent
    return out


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a @ b.T) / sizes


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits
    weights: np.ndarray

    def matrix(self) -> np.ndarray:
        return np.unpackbits(self.landmarks, axis=1).astype(np.float32)


def fit(bits: np.ndarray, languages: list[str]) -> Model:
    """bits: packed presence rows in a fixed order; languages: of each."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, CELLS // 8), np.uint8), np.zeros((0, 0)))
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in languages])
    each = max(1, LANDMARKS // len(names))
    chosen = np.concatenate([np.flatnonzero(y[:, k] > 0)[:each] for k in range(len(names))])
    z = x[chosen]
    knm, kmm = _kernel(x, z).astype(np.float64), _kernel(z, z).astype(np.float64)
    balance = 1.0 / np.array([languages.count(lang) for lang in languages])
    left = knm.T @ (knm * balance[:, None]) + RIDGE * kmm + 1e-6 * np.eye(len(chosen))
    return Model(names, bits[chosen], np.linalg.solve(left, knm.T @ (y * balance[:, None])))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    keys = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    share = {r.lang: min(1.0, 4.0 * per_language / r.n) for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return fit(np.zeros((0, CELLS // 8), np.uint8), [])
    limit = F.create_map(*(x for lang, s in sorted(share.items()) for x in (F.lit(lang), F.lit(int(s * (1 << 30))))))[F.col("lang")]
    some = keys.filter(F.pmod("h", F.lit(1 << 30)) <= limit)
    picked: dict[str, list[tuple[int, int]]] = {}
    # about 4 * per_language rows of a language at most
    for r in some.distinct().collect():
        picked.setdefault(r.lang, []).append((r.h, r.doc_id))
    ids = [(d, lang) for lang, rows in picked.items() for _, d in sorted(rows)[:per_language]]
    chosen = spark.createDataFrame(ids, "doc_id long, lang string")

    def bits(stream):
        for rows, raw, at in W.batches("text")(stream):
            for lo in range(0, len(rows), BATCH):
                part = rows.slice(lo, BATCH)
                a = at[lo : lo + len(part) + 1]
                packed = np.packbits(presence(raw[a[0] : a[-1]], a - a[0]).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("print"), pa.array([x.tobytes() for x in packed], pa.binary())], ["doc_id", "lang", "print", "bits"])

    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text", F.xxhash64("text").alias("print")).mapInArrow(bits, "doc_id long, lang string, print long, bits binary")
    # one row of a repeated doc_id, so at most per_language rows of a language come to the driver
    got = rows.groupBy("doc_id", "lang").agg(F.min_by("bits", "print").alias("bits")).toPandas().sort_values(["doc_id", "lang"])
    return fit(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), CELLS // 8), got["lang"].tolist())


def predict(model: Model, rows: pa.RecordBatch, raw: np.ndarray, at: np.ndarray, z: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. z: model.matrix()."""
    letters = W.sums(_features.LETTER[raw], at) > 0
    texts = rows.column("text")
    for k in np.flatnonzero(~letters):
        text = texts[int(k)].as_py()
        letters[k] = any(map(str.isalpha, text or ""))
    out, score = [UNKNOWN] * len(rows), np.zeros(len(rows))
    if not model.languages:
        return out, score
    for lo in range(0, len(rows), BATCH):
        a = at[lo : min(lo + BATCH, len(rows)) + 1]
        k = _kernel(presence(raw[a[0] : a[-1]], a - a[0]), z) @ model.weights
        best = np.argmax(k, axis=1)
        value = np.clip((k[np.arange(len(k)), best] + 1) / 2, 0, 1)
        for i in np.flatnonzero(letters[lo : lo + len(k)]):
            out[lo + i], score[lo + i] = model.languages[best[i]], value[i]
    return out, score


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    bound_batches(docs.sparkSession)
    model = learn(docs, per_language)

    def work(stream):
        z = model.matrix()
        for rows, raw, at in W.batches("text")(stream):
            lang, score = predict(model, rows, raw, at, z)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = base.mapInArrow(work, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
