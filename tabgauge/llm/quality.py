"""Quality rules: text statistics, and the log-likelihood ratio of hashed n-grams.

Counts of hashed n-grams (one and two words, in lower case, marks included) make two
multinomials: one over trusted documents (labelled quality 1), one over the whole corpus.
A document's score is the mean of log(p_trusted / p_corpus) over its n-grams, so length
does not count. It is kept if the score reaches ``THRESHOLD`` and the base rules hold.

All work is DataFrame expressions on the rows as they lie: counting shuffles one row per
bucket and task, and scoring shuffles nothing. The weights are one array of ``BUCKETS``
numbers. At most ``TRUSTED_ROWS`` labelled ids are broadcast, chosen by hash of the id;
the corpus counts cover every document. Weights are whole numbers (millionths), so sums
do not depend on order.

Defined results: a null text has no words; no words means score 0 and not kept. Rows are
kept one by one, repeated or not. Without trusted documents every weight is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BUCKETS = 32_768
#: Most labelled ids that the trusted counts are made from.
TRUSTED_ROWS = 20_000
#: Least mean log-likelihood ratio, in nats per n-gram, of a kept document.
THRESHOLD = -0.1
MIN_WORDS = 50
#: Largest share of words in repeated windows of three, in percent.
MAX_REPEAT_PERCENT = 50

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def grams(lower: Column, buckets: int) -> Column:
    """Buckets of all n-grams of one and two words."""
    hashed = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    one = F.transform(lower, lambda w: hashed(w))
    two = F.zip_with(F.slice(lower, 1, F.greatest(F.size(lower) - 1, F.lit(0))), F.slice(lower, 2, F.size(lower)), lambda a, b: hashed(a, b))
    return F.when(F.size(lower) > 1, F.concat(one, two)).otherwise(one)


def weights(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[int]:
    """Log-likelihood ratio of every bucket, in millionths."""
    own = documents.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    chosen = good.orderBy(F.xxhash64("__id"), "__id").limit(trusted_rows).withColumn("__trusted", F.lit(1))
    flagged = own.join(F.broadcast(chosen), "__id", "left").select(F.col("__trusted"), words_of(F.lower("__text")).alias("__lower"))
    counts = (
        flagged.select("__trusted", F.explode(grams(F.col("__lower"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.count("__trusted").alias("t"))
        .collect()
    )
    every, target = [0] * buckets, [0] * buckets
    for row in counts:
        every[row["bucket"]], target[row["bucket"]] = row["n"], row["t"]
    n, t = sum(every), sum(target)
    if not t:
        return [0] * buckets
    # One occurrence is added to each bucket of the corpus, and its trusted share to the other side:
    # n-grams that neither has seen say nothing.
    share = t / n
    return [round(1e6 * (math.log((b + share) / (t + share * buckets)) - math.log((a + 1) / (n + buckets)))) for a, b in zip(every, target, strict=True)]


def _repeated_words(words: Column, windows: Column) -> Column:
    """Words in windows that occur more than once; ``windows`` are hashes by first word."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))

    # A one-element array binds the sorted windows once for the inner look-ups.
    found = F.element_at(F.transform(F.array(placed), again), 1)
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.size(covered))


def rate(documents: DataFrame, weight: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """The documents with their statistics, ``score``, ``base_failed`` and ``kept``."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")
    # Own columns travel in a struct, so that no name of theirs meets one used here.
    names = [c for c in documents.columns if c not in made]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    first = documents.select(row.alias("__row"), text.alias("__text"))
    split = first.select(
        "__row",
        "__text",
        words_of(F.col("__text")).alias("__words"),
        words_of(F.lower("__text")).alias("__lower"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    words = F.col("__words")
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )
    # The weights as text of one literal: a bounded array, part of the plan.
    table = F.from_json(F.lit("[" + ",".join(map(str, weight)) + "]"), "array<bigint>")
    hashed = split.select(
        "__row",
        F.size("__words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__text", F.lit(_SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        "__words",
        windows.alias("__windows"),
        grams(F.col("__lower"), len(weight)).alias("__grams"),
    )
    total = F.aggregate("__grams", F.lit(0).cast("bigint"), lambda s, g: s + F.get(table, g))
    counted = hashed.select(
        *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeated_words(F.col("__words"), F.col("__windows")).cast("bigint").alias("n_repeat_words"),
        F.when(F.size("__grams") > 0, total / F.size("__grams") / 1e6).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, against all of them."""
    documents = shared.table(spark, sf_dir, "documents")
    weight = weights(documents, shared.table(spark, sf_dir, "labels"))
    return rate(documents.select("doc_id", "text"), weight).drop("text")
