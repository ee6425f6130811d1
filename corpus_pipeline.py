"""Training-data pipeline over `documents`: classify, deduplicate, cut repeats, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
and reads it again as the next stage's docs. All stages but the last return the columns
of documents. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.llm import mixing, ngram_join, quality_gam, sentencepiece_codec, substring_dedup
from ledgerlark.llm._shared import Tables

#: Of near duplicates: words of a shingle, and the similarity from which texts count as such.
SHINGLE = 5
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality_gam.add_score(docs, model, name).filter(F.col(name) >= quality_gam.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the smallest doc_id. Rows with a null doc_id or without words stay."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    # rows that share a doc_id are told apart by their texts
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    tables = Tables(spark, "representatives")
    found = tables.keep(ngram_join.similar(keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE, PERCENT))
    ids = keyed.filter("doc_id is not null").groupBy("doc_id", F.col(key).alias("k_")).agg(F.count("*").alias("rows"))
    groups = found.filter("n_shingles > 0").select(F.col("doc_id").alias("k_"), "component_id")
    first = ids.join(groups, "k_").groupBy("component_id").agg(F.min(F.struct("doc_id", "k_", "rows")).alias("first"))
    wordless = found.filter("n_shingles = 0 and doc_id is not null").select(F.col("doc_id").alias("kept_key"), F.lit(1).cast("long").alias("kept_rows"))
    first = tables.keep(first.select(F.col("first.k_").alias("kept_key"), F.col("first.rows").alias("kept_rows")).unionByName(wordless))
    tables.drop(found)

    def kept(rows: str) -> DataFrame:
        return keyed.join(first.filter(rows), F.col(key) == F.col("kept_key"), "left_semi")

    out = kept("kept_rows = 1")
    if not first.filter("kept_rows > 1").isEmpty():
        # of equal rows one
        out = out.unionByName(kept("kept_rows > 1").dropDuplicates([key]))
    return out.drop(key).unionByName(docs.filter("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id has; documents of which nothing is left go."""
    cut = substring_dedup.remove_repeats(docs)
    left = cut.filter("text is null or length(trim(text)) > 0 or n_chars = 0")
    return left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; sources that begin again occur again."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids and n_tokens."""
    encoded = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"))
    return encoded.select("doc_id", "source", "token_ids", F.coalesce(F.array_size("token_ids"), F.lit(0)).alias("n_tokens"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeats),
    ("mixing to target weights", mix),
    ("SentencePiece encoding", tokens),
]

#: The classifier and the tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, tables.keep(stage(spark, docs, sf_dir))
        if k:
            tables.drop(before)
    return docs
