"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import fill_middle, html_extract, language_id, license_scan, media_jpeg, mixing, nearest, ngram_join, quality_gam, quality_rules, sentencepiece_codec, substring_dedup, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": _table("documents", mixing.plan),
        "op2_quality_rules": _table("documents", quality_rules.verdicts),
        "op3_sentencepiece": _table("documents", sentencepiece_codec.digests),
        "op4_media_jpeg": _table("documents", media_jpeg.digests),
        "op5_quality_gam": _op5,
        "op6_substring_dedup": _table("documents", substring_dedup.digests),
        "op7_html_extract": _table("pages", html_extract.extract),
        "op8_language_id": _table("documents", language_id.identify),
        "op9_license_scan": _table("documents", license_scan.digests),
        "op10_ngram_jaccard_join": _table("documents", ngram_join.similar),
        "op11_fill_middle": _table("documents", fill_middle.digests),
        "op12_nearest": _table("embeddings", nearest.neighbours),
        "op13_vector_codes": _table("embeddings", vector_codes.digests),
    }


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS u(i)),
firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN firsts USING (k), range(13) AS r(j) WHERE m < doc_id),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS u(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM reach r JOIN edges e ON e.u = r.d)
SELECT d AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM reach LEFT JOIN sizes ON doc_id = d GROUP BY d"""


FILL_MIDDLE = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, sha256('42:' || doc_id) AS h FROM documents),
c AS (SELECT *, len(us) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:n], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Plain Lloyd: in each round an assignment by all distances (whole numbers, exact in doubles), and means rounded down."""
    dot = "list_inner_product({}, {})"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096::DOUBLE * x)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p))""",
        f"""c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT vec_id, label, cut.p, x, e, {dot.format('x', 'x')} - 2 * {dot.format('x', 'c')} + {dot.format('c', 'c')} AS d FROM cut JOIN c{k} ON cut.p = c{k}.p) GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, e, i, CAST(sum(CAST(x[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM a{k}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY p, e, i)""")
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS m FROM s{k} GROUP BY p, e) USING (p, e))""")
    return f"""WITH {", ".join(steps)},
digest AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c{rounds}, unnest(range(1, len(c) + 1)) AS u(i)),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": SUBSTRINGS, "op10_ngram_jaccard_join": JACCARD, "op11_fill_middle": FILL_MIDDLE, "op13_vector_codes": _codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS)}
