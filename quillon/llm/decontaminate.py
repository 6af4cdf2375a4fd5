"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each part of the corpus holds the postings (term, doc_id, pos) of its documents,
sorted by term, so that a lookup of a term skips what lies outside its row groups.  Only terms of the test items are kept.

A window is a run of test words.  Its terms are ranked by their number of postings; the postings of the rarest give
candidate starts (position less offset), the second rarest's list is intersected with them, and what is left meets the
lists of all the other terms at once.  Joins are keyed by (document, position), so neither a frequent term nor a long
document gathers rows in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_BYTES, ascii_lower, bounded, stored

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class DecontaminationSettings:
    window: int = 10
    broadcast_bytes: int = BROADCAST_BYTES  # of terms, windows or documents that are sent to every executor; beyond, joined by a shuffle


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """(item_id, words) of each run of so many words; an item with fewer, but not none, is one window."""
    w = F.col("w")
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.slice(w, i + 1, F.lit(size)))
    made = F.when(F.size(w) >= size, runs).when(F.size(w) > 0, F.array(w))
    return items.select("item_id", tokens(F.col("text")).alias("w")).select("item_id", F.explode(made).alias("words"))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Postings (term_id, doc_id, pos), written to shared storage.  vocabulary: (term, term_id); without it every term is
    kept and term_id is the term itself.  Null texts have no postings."""
    rows = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    if vocabulary is None:
        rows = rows.withColumnRenamed("term", "term_id")
    else:
        rows = rows.join(bounded(vocabulary, most), "term")
    return stored(rows.select("term_id", "doc_id", "pos").sortWithinPartitions("term_id", "doc_id", "pos"), "postings")


def ranked_windows(words: DataFrame, index: DataFrame, vocabulary: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """(window_id, offset, term_id, rank, k): a window's terms from the rarest on; windows with an unseen term are gone."""
    seen = index.groupBy("term_id").agg(F.count("*").alias("n"))
    # a row per term of the vocabulary that the corpus has: sent to all, so that a frequent term's windows stay where they are
    seen = bounded(stored(vocabulary.join(seen, "term_id"), "seen"), most)
    placed = words.select("window_id", F.size("words").alias("k"), F.posexplode("words").alias("offset", "term"))
    known = placed.join(seen, "term")
    whole, order = Window.partitionBy("window_id"), Window.partitionBy("window_id").orderBy("n", "offset")
    return (
        known.withColumn("there", F.count("*").over(whole)).withColumn("rank", F.row_number().over(order) - 1)
        .filter("there = k").select("window_id", "offset", "term_id", "rank", "k")
    )


def phrase_matches(index: DataFrame, words: DataFrame, vocabulary: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, window_id, start, k) of each place where a window's words stand in a document in their order."""
    ranked = stored(ranked_windows(words, index, vocabulary, most), "ranked")

    def list_of(low: int, high: int) -> DataFrame:
        return ranked.filter((F.col("rank") >= low) & (F.col("rank") < high))

    rarest = bounded(list_of(0, 1), most)
    found = index.join(rarest, "term_id").select("doc_id", "window_id", (F.col("pos") - F.col("offset")).alias("start"), "k").filter("start >= 0")
    second = bounded(list_of(1, 2).select("window_id", "term_id", "offset"), most)
    # windows of one word are done
    met = intersect(found.filter("k > 1"), index, second)
    left = stored(met.drop("hits").unionByName(found.filter("k = 1")), "candidates")
    docs = bounded(stored(left.select("doc_id").distinct(), "candidate-ids"), most)
    others = bounded(list_of(2, 1 << 30).select("window_id", "term_id", "offset"), most)
    rest = index.join(docs, index["doc_id"].eqNullSafe(docs["doc_id"]), "left_semi")
    long = intersect(left.filter("k > 2"), rest, others).filter(F.col("hits") == F.col("k") - 2).drop("hits")
    return long.unionByName(left.filter("k <= 2"))


def intersect(found: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates that at least one posting of these terms of theirs confirms, with the number of those (hits)."""
    looked = found.join(terms, "window_id").select(F.col("doc_id").alias("d"), "window_id", "start", "k", (F.col("start") + F.col("offset")).alias("p"), F.col("term_id").alias("t"))
    met = looked.join(index, (F.col("t") == F.col("term_id")) & (F.col("p") == F.col("pos")) & F.col("d").eqNullSafe(F.col("doc_id")))
    # repeated rows of a document repeat its postings
    return met.groupBy(F.col("d").alias("doc_id"), "window_id", "start", "k").agg(F.count_distinct("p").alias("hits"))


def proximity_matches(index: DataFrame, words: DataFrame, vocabulary: DataFrame, slack: int = 5, most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, window_id, pos): places of a window's rarest term with all its other terms, in any order, no further away
    than the window is long plus slack.  A term that a window has twice need stand there but once."""
    ranked = stored(ranked_windows(words, index, vocabulary, most), "near")
    rarest = bounded(ranked.filter("rank = 0").select("window_id", F.col("term_id").alias("t"), "k"), most)
    anchors = index.join(rarest, F.col("term_id") == F.col("t")).select(F.col("doc_id").alias("d"), "window_id", F.col("pos").alias("at"), "k")
    terms = bounded(ranked.select("window_id", F.col("term_id").alias("t")).distinct(), most)
    need = bounded(ranked.groupBy("window_id").agg(F.count_distinct("term_id").alias("need")), most)
    asked = anchors.join(terms, "window_id")
    # both sides fall into blocks of positions, so a long document's postings are met only near the anchor
    reach, block = F.col("k") + slack, 64
    asked = asked.withColumn("b", F.explode(F.sequence(F.floor((F.col("at") - reach) / block), F.floor((F.col("at") + reach) / block))))
    met = asked.join(index.withColumn("c", F.floor(F.col("pos") / block)), (F.col("t") == F.col("term_id")) & F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("b") == F.col("c")))
    near = met.filter(F.abs(F.col("pos") - F.col("at")) < reach).groupBy(F.col("d").alias("doc_id"), "window_id", F.col("at").alias("pos")).agg(F.count_distinct("t").alias("got"))
    return near.join(need, "window_id").filter("got = need").select("doc_id", "window_id", "pos")


def covered(spans: Column) -> Column:
    """Positions inside any of the spans (start, k), sorted by start."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["k"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], s["start"])).alias("n"))

    return F.aggregate(spans, first, step, lambda acc: acc["n"])


def item_windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(window_id, words), (window_id, item_id) and the vocabulary (term, term_id)."""
    runs = stored(windows_of(items, size).distinct(), "runs")
    words = stored(runs.select("words").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    owners = runs.join(words, "words").select("window_id", "item_id")
    terms = words.select(F.explode("words").alias("term")).distinct()
    return words, owners, stored(terms.withColumn("term_id", F.monotonically_increasing_id()), "terms")


def matches(docs: DataFrame, items: DataFrame, settings: DecontaminationSettings) -> tuple[DataFrame, DataFrame]:
    """Places of the items' windows in docs, stored, and the windows' items."""
    words, owners, vocabulary = item_windows(items, settings.window)
    index = build_index(docs, vocabulary, settings.broadcast_bytes)
    return stored(phrase_matches(index, words, vocabulary, settings.broadcast_bytes), "matches"), owners


def contaminated_ids(docs: DataFrame, items: DataFrame, settings: DecontaminationSettings = DecontaminationSettings()) -> DataFrame:
    """The distinct doc_id of documents with a window of an item."""
    return matches(docs, items, settings)[0].select("doc_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, settings: DecontaminationSettings = DecontaminationSettings()) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, items (sorted array of item ids as strings).

    Null texts have no words.  Rows with one doc_id, or with none, count as one document: they share their hits.  Null
    item ids are left out of items.
    """
    found, owners = matches(docs, items, settings)
    hits = found.groupBy("doc_id").agg(covered(F.sort_array(F.collect_set(F.struct("start", "k")))).alias("n_hit"))
    whose = found.select("doc_id", "window_id").distinct().join(bounded(stored(owners, "owners"), settings.broadcast_bytes), "window_id")
    named = whose.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    stats = hits.join(named, hits["doc_id"].eqNullSafe(named["doc_id"])).select(hits["doc_id"].alias("d"), "n_hit", "items")
    counted = docs.select("doc_id", F.size(tokens(F.col("text"))).cast("bigint").alias("n_words"))
    return counted.join(stats, counted["doc_id"].eqNullSafe(stats["d"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
