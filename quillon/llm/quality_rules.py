"""Quality rules: plain counts that fail a document outright, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets.  Two multinomials over the buckets, one of trusted documents and one of the
whole corpus, give each bucket a log ratio; a document's score is the mean ratio of its n-grams, and every document with
a score below a fixed threshold goes.  Nothing is drawn at random.

The corpus costs one pass whose shuffle carries a row per bucket and task; scores need no shuffle at all, since the ratio
table (of a fixed number of buckets) is part of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_BYTES, bounded, let, stored, words_of

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class RatioSettings:
    buckets: int = 10_000
    prior: float = 5.0  # n-grams of the corpus' own distribution that each bucket's trusted count starts from
    threshold: float = -0.06  # mean log ratio, in nats, that a kept document has at least
    broadcast_bytes: int = BROADCAST_BYTES  # of trusted ids that are sent to all executors; beyond, documents are joined by a shuffle


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Buckets of all words, then of all pairs of neighbours."""

    def both(w: Column) -> Column:
        single = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        pairs = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(w, i), x), F.lit(buckets)).cast("int"))
        return F.concat(single, pairs)

    return let(words, both)


def log_ratios(docs: DataFrame, trusted: DataFrame, settings: RatioSettings = RatioSettings()) -> list[float]:
    """Log ratio of each bucket, from every document's words.  trusted: one column doc_id, of trusted documents.

    Both counts of a bucket are smoothed by as many n-grams of the corpus' distribution, so a bucket that is merely rare
    has a ratio near 0 and a document doesn't fall for words that it alone has.  Empty inputs give ratios of zero; a null doc_id is never trusted.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct()
    ids = bounded(stored(ids.withColumn("_trusted", F.lit(True)), "trusted"), settings.broadcast_bytes)
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left")
    counts = (
        marked.select(F.coalesce("_trusted", F.lit(False)).alias("t"), F.explode(ngram_buckets(words_of(F.col("text")), settings.buckets)).alias("b"))
        .groupBy("b").agg(F.count("*").alias("n"), F.count_if("t").alias("t"))
        .collect()  # a row per bucket at most
    )
    raw, target = [0] * settings.buckets, [0] * settings.buckets
    for row in counts:
        raw[row["b"]], target[row["b"]] = row["n"], row["t"]
    share, a = sum(target) / max(sum(raw), 1), settings.prior
    return [math.log((t + a) / (share * r + a)) for t, r in zip(target, raw, strict=True)]


def ratio_score(words: Column, ratios: list[float]) -> Column:
    """Mean log ratio of the n-grams; 0 where there are none."""
    held = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into one literal
    return let(
        ngram_buckets(words, len(ratios)),
        lambda g: F.when(F.size(g) == 0, 0.0).otherwise(F.aggregate(g, F.lit(0.0), lambda total, b: total + F.get(held, b)) / F.size(g)),
    )


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more.  Windows are told apart by a hash of 64 bits."""

    def marked(pairs: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, k: same(x, F.get(pairs, k - 1)) | same(x, F.get(pairs, k + 1)))
        starts = F.array_sort(F.transform(twice, lambda x: x["p"]))
        first = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
        step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + 3 - F.greatest(acc["end"] - p, F.lit(0))).alias("n"))
        return F.aggregate(F.sort_array(starts), first, step, lambda acc: acc["n"])

    def from_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(pairs, marked))

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))

    return let(words, lambda w: let(windows(w), from_hashes))


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
        "n_repeat_words": repeated_words(words),
    }


def judge_documents(docs: DataFrame, ratios: list[float], settings: RatioSettings = RatioSettings()) -> DataFrame:
    """A row per row of docs: doc_id, the base counts, base_failed, kept, score.

    Null and empty texts have no words and fail the base rules; repeated rows get the same result each.
    """
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    counted = t.select("doc_id", *[c.alias(k) for k, c in base_counts(F.col("text"), F.col("words")).items()], ratio_score(F.col("words"), ratios).alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("score") >= settings.threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    )
