"""Quality rules with thresholds that adapt to language and source.

Each document has a few measures, such as symbols for each character of its words. A measure
is a count over a base, and both have something added, as if a text of usual writing came with the document;
so short texts aren't extreme, and a text without the trait has a small value and not none. A
quantile sketch of every measure is kept for each language and source: counts of
logarithmic bins (each a factor of GAMMA wide), so quantiles have a bounded relative error and
sketches merge by adding counts, in any order and with the same result.

A document fails a rule if its measure is above the group's fence. In logarithms, a sketch's fence is its median + SPREAD *
(upper quartile - median). Where half of a group has one value, the higher quantiles of UPPER stand
in for the quartile, scaled as in a normal distribution. A fence lets LEEWAY occurrences more than the median has pass at least, as
a group without any spread can't tell what is unusual. A group of n documents
has its own fence by weight n / (n + SHRINK), and else its language's, from the merged sketches,
which in turn is drawn to that of all documents. There is no fixed cutoff and no least size.
The fences are then joined with the documents.

Base rules apply first: fewer than LEAST_WORDS words, or more than MOST_REPEATED per
cent of the words in repeated windows of eight.

Cases: null texts have no words and fail the base rules. A null language or source is a
group of its own. Repeated rows count each time and get equal verdicts. Rows with a null
doc_id are judged as well. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlark.llm import _features, _words as W
from ledgerlark.llm._shared import Tables, bound_batches

LEAST_WORDS = 20
MOST_REPEATED = 30
GAMMA = 1.02
SPREAD = 5.0
SHRINK = 50
LEEWAY = 2
#: quantiles above the median, and how much nearer the quartile is to it in a normal distribution
UPPER = ((0.75, 1.0), (0.9, 0.526), (0.95, 0.41))
ZERO = -(1 << 20)  #: the bin of measures that are 0

#: measure -> (count, added to it, base, added to it)
MEASURES = {
    "symbols": ("n_symbols", 1, "word_chars", 1000),
    "marks": ("n_marks", 4, "word_chars", 1000),
    "capitals": ("n_capitals", 10, "n_letters", 1000),
    "dup_lines": ("n_dup_lines", 4, "n_lines", 20),
    "repeats": ("n_repeat_words", 16, "n_words", 200),
    "again": ("n_again", 4, "n_words", 200),
    "word_length": ("word_chars", 0, "n_words", 20),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS and MEASURES of every row."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, lang string, source string, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{m} double" for m in MEASURES])

    def work(stream):
        for rows, raw, at in W.batches("text")(stream):
            s = _features.statistics(raw, at)
            measures = [pa.array((s[a] + one) / (s[b] + add)) for a, one, b, add in MEASURES.values()]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(s[c]) for c in COUNTS), *measures], ["doc_id", "lang", "source", *COUNTS, *MEASURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text").mapInArrow(work, schema)


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, k: the quantile sketches, one row for each bin that has something."""
    each = F.explode(F.create_map(*(x for m in MEASURES for x in (F.lit(m), F.col(m))))).alias("measure", "x")
    bin_of = F.when(F.col("x") > 0, F.ceil(F.log("x") / math.log(GAMMA))).otherwise(F.lit(ZERO)).cast("int")
    return measured.select("lang", "source", each).groupBy("lang", "source", "measure", bin_of.alias("bin")).agg(F.count("*").alias("k"))


def leeway(added: int) -> float:
    """What LEEWAY occurrences add to the logarithm of a measure that has none."""
    return math.log1p(LEEWAY / added) if added else 0.0


def _fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """n and the logarithm of the fence of each measure for each group, from sketches merged to `by`."""
    merged = sketches.groupBy(*by, "measure", "bin").agg(F.sum("k").alias("k"))
    # a measure's sketch has as many rows as bins, whatever the input
    bins = merged.groupBy(*by, "measure").agg(F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct("bin", "k"))).alias("bins"))

    def quantile(q: float):
        return F.expr(f"aggregate(bins, named_struct('seen', 0L, 'bin', cast(null as int)), (s, b) -> named_struct('seen', s.seen + b.k, 'bin', if(s.bin is null and s.seen + b.k >= {q} * n, b.bin, s.bin))).bin")

    found = bins.select(*by, "n", "measure", quantile(0.5).alias("mid"), *(quantile(q).alias(f"q{k}") for k, (q, _) in enumerate(UPPER)))
    spread = F.lit(0.0)
    for k, (_, scale) in reversed(list(enumerate(UPPER))):
        spread = F.when(F.col(f"q{k}") > F.col("mid"), (F.col(f"q{k}") - F.col("mid")) * scale).otherwise(spread)
    least = F.create_map(*(x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(leeway(v[1])))))[F.col("measure")]
    # the middle of a bin, in logarithms
    fence = F.col("mid") * math.log(GAMMA) + F.greatest(SPREAD * spread * math.log(GAMMA), least) + math.log(2 / (GAMMA + 1))
    fences = found.select(*by, "n", "measure", F.when(F.col("mid") > ZERO, fence).alias("fence"))
    return fences.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"max_{m}") for m in MEASURES))


def _drawn(own, n, towards):
    """own by the weight n / (n + SHRINK), else towards; the one that isn't null if one is."""
    w = n / (n + SHRINK)
    return F.coalesce(w * own + (1 - w) * towards, own, towards)


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and a fence for each measure (null if nothing is above it), from their own sketches, drawn to those of their language."""
    sketches = Tables(measured.sparkSession, "sketches").keep(sketch(measured))
    own, lang = _fences(sketches, ["lang", "source"]), _fences(sketches, ["lang"])
    everything = _fences(sketches, []).first()  # one number for each measure
    last = {m: F.lit(None if everything is None else everything[f"max_{m}"]).cast("double") for m in MEASURES}
    lang = lang.select(F.col("lang").alias("l"), *(_drawn(F.col(f"max_{m}"), F.col("n"), last[m]).alias(f"l_{m}") for m in MEASURES))
    both = own.join(lang, own.lang.eqNullSafe(lang.l))
    return both.select("lang", "source", *(F.exp(_drawn(F.col(f"max_{m}"), F.col("n"), F.col(f"l_{m}"))).alias(f"max_{m}") for m in MEASURES))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and failed_rule (null if none) of every row."""
    measured = Tables(docs.sparkSession, "rules").keep(measure(docs))
    fences = thresholds(measured).withColumnsRenamed({"lang": "group_lang", "source": "group_source"})
    joined = measured.join(fences, measured.lang.eqNullSafe(fences.group_lang) & measured.source.eqNullSafe(fences.group_source), "left")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rule = F.when(base, "base")
    for m in MEASURES:
        # a measure of the fence's own bin isn't above it
        rule = rule.when(F.col(m) > GAMMA * F.col(f"max_{m}"), m)
    return joined.select("doc_id", *COUNTS, base.alias("base_failed"), rule.alias("failed_rule")).select("doc_id", *COUNTS, "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule")
