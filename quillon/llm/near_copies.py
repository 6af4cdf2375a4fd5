"""Near copies by the Jaccard similarity of their texts' word runs: Golay keys, then MinHash candidates, each verified exactly.

A text is the set of its runs of five words; texts of one set are one node.  First the fingerprints of the runs are linked
by operator 4 (simhash: Golay keys, two differing bits at most), and each member of a class is compared with one node of it,
so that copies and the closest near copies are settled by a comparison each.  Two bits are too few for most pairs of
similarity 0.8 (their fingerprints differ in ten), so what that leaves apart is searched further.  Of 120 permutations of the runs' hashes the
least values are cut into 24 bands of five, and nodes that share a band are candidates: a pair of similarity 0.8 is one with
a probability of 1 - (1 - 0.8^5)^24, over 0.9999.  Every pair that is linked has been compared run by run.

Small buckets give each of their pairs.  In a large one all nodes are compared with four leaders.  The nodes of buckets that
still have several classes are then searched exactly: two sets of similarity t share a run among the rarest n - tn + 1 of
each (prefix filter), and of those that share one with room for enough others behind it, all pairs of different classes are
compared.  Pairs within a class can't change it, so the classes are those that all pairs of all buckets would give.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_BYTES, bounded, stored
from quillon.llm.simhash import SimHashSettings, components, first_rows, fold, linked_prints, shingle_hashes


@dataclass(frozen=True)
class CopySettings:
    shingle: int = 5
    least: float = 0.8
    bands: int = 24
    rows: int = 5
    pair_limit: int = 64  # nodes of a bucket up to which all its pairs are compared


def runs_of(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


@lru_cache(maxsize=4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of numbers to xor and odd ones to multiply with."""
    r = np.random.default_rng(42)
    return tuple(r.integers(0, 1 << 64, (n, 1), np.uint64) | np.uint64(odd) for odd in (0, 1))


def band_keys(runs: np.ndarray, settings: CopySettings) -> list[int]:
    """A key for each band, as signed 64-bit numbers; none for a text without words."""
    if not len(runs):
        return []
    flip, factor = permutations(settings.bands * settings.rows)
    blocks = (((runs[a : a + 512] ^ flip) * factor).min(axis=1) for a in range(0, len(runs), 512))
    least = np.minimum.reduce(list(blocks)).reshape(settings.bands, settings.rows)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], np.uint64).view(np.int64).tolist()


def mark_column(text: Column, settings: CopySettings) -> Column:
    """node: a 64-bit hash of the set of runs; n: its size; fp: operator 4's fingerprint of the set; keys."""

    @F.pandas_udf("node bigint, n int, fp bigint, keys array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            runs = runs_of(t, settings.shingle)
            node = xxhash.xxh64_intdigest(runs.tobytes(), 42)
            found.append((node - (1 << 64) if node >> 63 else node, len(runs), fold(runs), band_keys(runs, settings)))
        return pd.DataFrame(found, columns=["node", "n", "fp", "keys"])

    return run(text)


def alike_column(a: Column, b: Column, settings: CopySettings) -> Column:
    @F.pandas_udf("boolean")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        found, last, x = [], None, None
        for s, t in zip(left, right, strict=True):
            if x is None or s != last:
                last, x = s, runs_of(s, settings.shingle)
            y = runs_of(t, settings.shingle)
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both >= 1 and both / (len(x) + len(y) - both) >= settings.least)
        return pd.Series(found, dtype=bool)

    return run(a, b)


def pairs_of(left: DataFrame, right: DataFrame, where: str, settings: CopySettings) -> DataFrame:
    """Distinct pairs (a < b) of two tables of (key, node, n, ..) that share a key, of sizes that permit the similarity."""
    both = left.alias("l").join(right.alias("r"), "key").filter(where)
    fits = F.least("l.n", "r.n") / F.greatest("l.n", "r.n") >= settings.least
    return both.filter(fits).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def texts_of(wanted: DataFrame, rows: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """node and text of the wanted nodes."""
    firsts = bounded(stored(nodes.select("node", "row").join(wanted, "node"), "wanted"), most)
    return stored(rows.select("row", F.col("doc.text").alias("text")).join(firsts, "row").select("node", "text"), "texts")


def rarest_runs(members: DataFrame, texts: DataFrame, settings: CopySettings, most: int) -> DataFrame:
    """(key, node, n, root, place) for each of the rarest runs of the members (node, n, root) that another one has too; similar
    sets share one."""

    @F.pandas_udf("array<bigint>")
    def run(found: pd.Series) -> pd.Series:
        return pd.Series([runs_of(t, settings.shingle).view(np.int64) for t in found])

    runs = stored(texts.select("node", F.explode(run("text")).alias("key")), "runs")
    often = stored(runs.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    placed = runs.join(bounded(often, most), "key", "left").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "key")))
    first = placed.filter("often > 1").join(members, "node").filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * settings.least - 1e-6) + 1)
    return stored(first.select("key", "node", "n", "root", "place"), "prefixes")


def mixed_keys(held: DataFrame) -> DataFrame:
    """key and top, its largest root, of the keys of (key, node, n, root) that have several roots."""
    counts = held.groupBy("key", "root").agg(F.count("*").alias("size"))
    return stored(counts.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("key", "top"), "mixed")


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, settings: CopySettings, most: int) -> DataFrame:
    """The pairs of nodes whose texts are similar enough."""
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = texts_of(wanted, rows, nodes, most)
    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return stored(pairs.join(b, "b").join(a, "a").filter(alike_column(F.col("text_a"), F.col("text_b"), settings)).select("a", "b"), "alike")


def golay_links(rows: DataFrame, nodes: DataFrame, settings: CopySettings, most: int) -> DataFrame:
    """Links of the nodes of operator 4's classes of fingerprints to the least node of each, where their texts are similar
    enough."""
    prints = nodes.select("node", "n", "fp")
    classes = components(linked_prints(prints.select("fp").distinct(), SimHashSettings(settings.shingle)))
    placed = prints.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("class"))
    least = placed.groupBy("class").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("size")).filter("size > 1")
    met = placed.join(bounded(stored(least, "least"), most), "class").filter(F.col("node") != F.col("least.node"))
    fits = F.least("n", "least.n") / F.greatest("n", "least.n") >= settings.least
    return verified(met.filter(fits).select(F.col("least.node").alias("a"), F.col("node").alias("b")), rows, nodes, settings, most)


def linked_nodes(rows: DataFrame, nodes: DataFrame, settings: CopySettings, most: int) -> DataFrame:
    """Links (a, b), a < b, that connect the same nodes as all similar pairs of all buckets do."""
    first = golay_links(rows, nodes, settings, most)
    settled = components(first).withColumnRenamed("root", "found")
    return first.union(band_links(rows, nodes, settled, settings, most)).distinct()


def band_links(rows: DataFrame, nodes: DataFrame, settled: DataFrame, settings: CopySettings, most: int) -> DataFrame:
    """Links that, with those that gave the classes settled (node, found), connect all similar pairs of all buckets."""
    rooted = nodes.join(settled, "node", "left").withColumn("root", F.coalesce("found", "node"))
    keyed = stored(rooted.select("node", "n", "root", F.explode("keys").alias("key")), "bands")
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    shared = stored(keyed.join(bounded(sizes, most), "key"), "shared")
    small, large = (shared.filter(F.col("size") <= settings.pair_limit), shared.filter(F.col("size") > settings.pair_limit))
    pairs = pairs_of(small, small, "l.node < r.node and l.root <> r.root", settings)
    if large.isEmpty():
        return verified(pairs, rows, nodes, settings, most)
    other = F.xxhash64("node")
    chosen = large.groupBy("key").agg(F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", other), F.max_by("node", other))).alias("nodes"))
    leaders = large.join(bounded(stored(chosen.select("key", F.explode("nodes").alias("node")), "chosen"), most), ["key", "node"], "left_semi")
    pairs = pairs.union(pairs_of(large, bounded(stored(leaders, "leaders"), most), "l.root <> r.root", settings)).distinct()
    links = verified(pairs, rows, nodes, settings, most)
    # what the leaders leave apart
    tied = settled.filter("node <> found").select(F.col("found").alias("a"), F.col("node").alias("b"))
    roots = components(links.union(tied)).withColumnRenamed("root", "found")
    held = stored(large.drop("root").join(roots, "node", "left").select("key", "node", "n", F.coalesce("found", "node").alias("root")), "held")
    members = stored(held.join(bounded(mixed_keys(held), most), "key", "left_semi").select("node", "n", "root").distinct(), "members")
    if members.isEmpty():
        return links
    found = rarest_runs(members, texts_of(members.select("node"), rows, nodes, most), settings, most)
    mixed = found.join(bounded(mixed_keys(found), most), "key")
    others = stored(mixed.filter("root <> top"), "others")
    # a pair's first common run leaves room for all others (positional filter)
    room = f"least(l.n - l.place, r.n - r.place) + 1 >= (l.n + r.n) * {settings.least / (1 + settings.least)!r}D - 1e-6"
    return links.union(verified(pairs_of(mixed, bounded(others, most), f"l.root <> r.root and {room}", settings), rows, nodes, settings, most)).distinct()


def first_of_each_class(docs: DataFrame, settings: CopySettings = CopySettings(), most: int = BROADCAST_BYTES) -> DataFrame:
    """docs with one row of each class of near copies, that of the least doc_id.  Each row is judged by its own text, and
    goes only if another row of its class stays.  Rows without an id can't be told apart and all stay.

    Texts without words are one class.  Tables of up to `most` bytes are broadcast.
    """
    marked = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"), mark_column(F.col("text"), settings).alias("m"))
    rows = stored(marked.select("doc", "row", "m.*"), "rows")  # from here on a row's number is fixed
    nodes = stored(rows.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    return first_rows(rows, components(linked_nodes(rows, nodes, settings, most)), most)
