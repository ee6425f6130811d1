import re
from collections import Counter


import corpus_pipeline as P
from ledgerlark.llm import quality_gam, sentencepiece_codec
from tests.llm.test_ngram_join import brute as components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"


def removed(rows, k=13):
    """doc_id -> text after substring dedup, by the definition."""
    first = {}
    words = {d: WORD.findall(t) for d, t in rows}
    for d, w in words.items():
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in rows:
        w = words[d]
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    return out


def test_stages_against_brute_force(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    score = {x.doc_id: x.score for x in quality_gam.scores(docs, labels).collect()}
    text = {x.doc_id: x.text for x in docs.collect()}
    source = {x.doc_id: x.source for x in docs.collect()}

    kept = P.quality(spark, docs, DIR)
    assert kept.schema == docs.schema
    left = {x.doc_id: x.text for x in kept.collect()}
    assert left == {d: t for d, t in text.items() if score[d] >= 0.3}

    one = P.near_duplicates(spark, kept, DIR)
    assert one.columns == docs.columns
    root = {d: c for d, _, c in components(sorted(left.items()))}
    left = {d: t for d, t in left.items() if root[d] == d}
    assert {x.doc_id: x.text for x in one.collect()} == left

    cut = P.repeats(spark, one, DIR)
    assert cut.columns == docs.columns
    left = {d: t for d, t in removed(sorted(left.items())).items() if t.strip()}
    got = cut.collect()
    assert {x.doc_id: x.text for x in got} == left and all(x.n_chars == len(x.text) for x in got)

    mixed = P.mix(spark, cut, DIR)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert {x.doc_id: x.text for x in rows} == left

    out = P.tokens(spark, mixed, DIR).collect()
    original = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    assert Counter(x.doc_id for x in out) == Counter(x.doc_id for x in rows)
    assert all(list(x.token_ids) == original.encode(left[x.doc_id]) and x.n_tokens == len(x.token_ids) and x.source == source[x.doc_id] for x in out)


def test_run_and_edges(spark, tmp_path):
    rows = [(1, "the cat sat on the mat", "en", "a", 22), (1, "the cat sat on the mat", "en", "a", 22), (None, "a dog", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out = P.run(spark, path).collect()
    assert {x.doc_id for x in out} == {1, None, 2, 3} and len({tuple(x.token_ids or []) for x in out if x.doc_id == 1}) == 1
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/none/labels.parquet")
    assert P.run(spark, f"{path}/none").collect() == []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], SCHEMA)
    return Counter((x.doc_id, x.text) for x in P.near_duplicates(spark, docs, DIR).collect())


def test_different_texts_under_one_doc_id_stay(spark):
    copy, clean, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, copy), (9, copy), (9, clean), (5, other), (5, other), (7, ""), (7, ""), (7, None), (None, copy)]
    for repeated in (rows, [x for x in rows if x[0] != 5]):
        want = Counter([(1, copy), (9, clean), (7, ""), (7, ""), (7, None), (None, copy)] + [(5, other)] * (repeated is rows))
        assert near(spark, repeated) == want
    assert near(spark, [(9, clean), (9, other), (9, other), (9, copy), (1, copy)]) == Counter([(9, clean), (9, other), (1, copy)])


def test_copies_from_four_fifths_on_go(spark):
    words = [f"w{k}" for k in range(500)]
    longer = [" ".join(words + [f"x{k}" for k in range(n)]) for n in (120, 130)]
    # 496 of 616 shingles, and of 626
    assert near(spark, [(1, " ".join(words)), (2, longer[0])]) == Counter([(1, " ".join(words))])
    assert near(spark, [(1, " ".join(words)), (2, longer[1])]) == Counter([(1, " ".join(words)), (2, longer[1])])
