"""Fill-in-the-middle: documents cut in three and put in another order, in Spark SQL functions alone.

A text is cut into units, words with the white space in front of them (white space at its end is a
unit of its own). Two cuts, an order and whether to rearrange at all come from a hash of the
seed and doc_id, so they are the same in every run and on every executor. The whole
transformation is a projection: nothing is shuffled, and each row is read once.

psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle. `restored` parses the sentinels
of an output and gives the text back.

Cases: a null text counts as empty, and empty texts stay plain, as do those that contain a sentinel,
so the sentinels of an output are always its own. A null doc_id is hashed as an empty
string. Parts may be empty. Repeated rows are transformed alike. Very long texts are cut like others. Other columns of
the input are kept by `transformed` (one that has a name of its results is replaced) and dropped by `digests`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50  #: of a hundred documents, how many are rearranged
SPM = 80  #: of a hundred rearranged ones, how many begin with the suffix


def _number(digest: str, k: int) -> Column:
    """The k-th group of eight hex digits."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _between(text: Column, left: str, right: str) -> Column:
    return F.substring_index(F.substring_index(text, right, 1), left, -1)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix, middle, suffix (null where plain) and output."""
    text = F.coalesce("text", F.lit(""))
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    # each step is a projection of its own, so that the units of a text are made once
    units = docs.withColumns({"units_": F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), "digest_": F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), "plain_": plain})
    cuts = units.withColumns({"n": F.size("units_").cast("long"), **{f"h{k}_": _number("digest_", k) for k in (1, 2, 3, 4)}})
    ends = [F.col(f"h{k}_") % (F.col("n") + 1) for k in (1, 2)]
    form = F.when(F.col("plain_") | (F.col("h3_") % 100 >= rate), "plain").when(F.col("h4_") % 100 < spm, "spm").otherwise("psm")
    cuts = cuts.withColumns({"a_": F.least(*ends).cast("int"), "b_": F.greatest(*ends).cast("int"), "form": form})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units_", start, length), ""))
    parts = cuts.withColumns({"prefix": part(F.lit(1), F.col("a_")), "middle": part(F.col("a_") + 1, F.col("b_") - F.col("a_")), "suffix": part(F.col("b_") + 1, F.col("n").cast("int") - F.col("b_"))})
    before, after, between = ((F.lit(s), F.col(c)) for s, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(*before, *after, *between)).otherwise(F.concat(*after, *before, *between))
    return parts.withColumn("output", output).drop("units_", "digest_", "plain_", "a_", "b_", *(f"h{k}_" for k in (1, 2, 3, 4)))


def restored(output: Column, form: Column) -> Column:
    """The text of an output, by its sentinels: each occurs once in an output that isn't plain."""
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(_between(output, PREFIX, SUFFIX), middle, _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), middle, _between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle, and digests of the output and of the text restored from it."""
    out = transformed(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
