import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import _shared, _sketch, substring_dedup as S


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in dirs for p in Path(d.getPath()).rglob("shuffle_*")}


def left_behind(spark, before):
    """Files that are there beside those of before; Spark deletes in the background."""
    for _ in range(50):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_kept_tables_leave_no_shuffle_files(spark, adaptive):
    setting = "spark.sql.adaptive.enabled"
    old = spark.conf.get(setting)
    spark.conf.set(setting, adaptive)
    try:
        df = spark.range(20_000).withColumn("x", F.col("id") * 7 % 1009).repartition(3, "x").groupBy("x").count()
        assert df.count() == 1009
        cleanup, before = spark.conf.get(_shared.CLEANUP_SETTING), shuffle_files(spark)
        kept = _shared.Tables(spark, "freed").keep(df)
        assert not left_behind(spark, before)
        assert spark.conf.get(_shared.CLEANUP_SETTING) == cleanup
        assert kept.count() == df.count() == 1009
    finally:
        spark.conf.set(setting, old)


def test_sketches_and_ranges_leave_no_shuffle_files(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 97}" for j in range(60))) for k in range(200)], "doc_id long, text string").repartition(4)
    docs = _shared.Tables(spark, "docs").keep(docs)
    before = shuffle_files(spark)
    _sketch.gram_levels(docs, 2, lower=False)
    assert not left_behind(spark, before)
    S.repeated_ranges(docs)
    assert not left_behind(spark, before)
