import random
import zlib

import numpy as np

from ledgerlark.llm import language_id as L

PARTS = {"xx": ["the", "ing", "tion", "and"], "yy": ["der", "sch", "ung", "über"], "zz": ["que", "ción", "los", "ñar"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(0)
    langs = [r.choice(list(PARTS)) for _ in range(500)]
    rows = [(i, text(r, lang, r.randrange(3, 60)), lang if i % 10 else None, 1.0) for i, lang in enumerate(langs)]
    odd = [(600, None, "xx", 0.0), (601, "", "xx", 0.0), (602, "12 34 !?", "yy", 0.0), (None, "the tion and", "zz", 0.0), (603, "über " * 40_000, None, 0.0), (604, "Ω", None, 0.0)]
    out = {x.doc_id: x for x in L.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")).collect()}
    assert len(out) == 506
    held = [i for i in range(500) if out[i].held_out]
    assert held == [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].lang_pred == langs[i] for i in held]) > 0.97
    assert [(out[i].lang_pred, out[i].score) for i in (600, 601, 602)] == [("und", 0.0)] * 3
    assert out[603].lang_pred == "yy" and out[None].lang_pred == "xx" and out[604].lang_pred in PARTS
    assert all(0 <= x.score <= 1 for x in out.values())


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in L.identify(docs).collect()} == {"und"}
    assert L.identify(docs.limit(0)).collect() == []


def test_presence_counts_grams_of_one_text_only():
    a, b = "abc", "cab"
    both = L.presence(np.frombuffer(b"abccab", np.uint8), np.array([0, 3, 6]))
    for row, t in zip(both, (a, b)):
        assert (row == L.presence(np.frombuffer(t.encode(), np.uint8), np.array([0, 3]))[0]).all()
    assert both[0].sum() == 6


def cells_of(text):
    """Cells of the n-grams of a text, one n-gram after the other."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    out = set()
    for n in L.GRAMS:
        for i in range(len(low) - n + 1):
            code = 0
            for b in low[i : i + n]:
                code = (code * 257 + b + 1) % (1 << 32)
            out.add(((code + n) * 2654435761 % (1 << 32)) >> 18)
    return out - {0}


def test_kernel_and_fit_against_sets():
    texts = ["Der Hund und die Katze", "the dog and the cat", "", "a", "le chien et le chat", "Das Haus ist alt", "THE HOUSE IS OLD", "la maison est vieille", "é ü ñ"]
    raw = [t.encode() for t in texts]
    bits = L.presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]))
    sets = [cells_of(t) for t in texts]
    assert [set(np.flatnonzero(row).tolist()) for row in bits] == sets
    kernel = [[len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) for b in sets] for a in sets]
    assert np.allclose(L._kernel(bits, bits), kernel, atol=1e-6)
    # all texts are landmarks here, so the fit is kernel ridge regression with balanced classes
    languages = ["de", "en", "de", "en", "fr", "de", "en", "fr", "fr"]
    model = L.fit(np.packbits(bits.astype(bool), axis=1), languages)
    order = [k for name in model.languages for k, lang in enumerate(languages) if lang == name]
    assert model.languages == ["de", "en", "fr"] and len(model.landmarks) == len(texts)
    k = np.array(kernel)
    z = k[:, order]
    left, right = np.zeros((len(order), len(order))), np.zeros((len(order), 3))
    for i, lang in enumerate(languages):
        share = 1 / languages.count(lang)
        left += share * np.outer(z[i], z[i])
        for c, name in enumerate(model.languages):
            right[:, c] += share * z[i] * (1 if lang == name else -1)
    left += L.RIDGE * k[np.ix_(order, order)] + 1e-6 * np.eye(len(order))
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(left, right), atol=1e-4)
