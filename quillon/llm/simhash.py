"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits.  They are cut into three segments of 22, 21 and 21 bits; with two differing bits at most, one
segment at least is free of errors (pigeonhole), and the next segment, round the circle, has two errors at most.  That
segment, filled up to 23 bits, is decoded by the perfect binary Golay code to the indices of all codewords within four
bits.  Two words that differ in two bits have a word between them one bit from each; its codeword is within three bits of
it, so within four of both: they share an index.  A word has one index or six.  So the keys of a fingerprint are, for each
segment, (its value, an index of the next segment): about 33 bits of selectivity, three to eighteen keys.

Equal fingerprints are one node; keys of nodes are joined and pairs verified by counting bits.  A bucket with many nodes
isn't paired: each of its nodes emits the 65 words within one bit of it.  Nodes that share such a word are linked, and two
linked nodes share one (the word between them); at most 65 nodes lie around a word, so nothing grows with the square of a
bucket.  Classes are found by alternating large-star and small-star steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_BYTES, bounded, remove_stored, stored

#: Generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
ALL_BITS = 64


@dataclass(frozen=True)
class SimHashSettings:
    shingle: int = 3
    distance: int = 2  # the key scheme is proven for 2 and less
    pair_limit: int = 64  # nodes of a bucket up to which all its pairs are compared


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64, seed 42, of each run of k words, A-Z lower-cased; of the whole sequence where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, 42)], np.uint64)
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, len(words) - k + 1)


def fold(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number; hashes are taken in blocks of bounded memory."""
    counts = np.zeros(ALL_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    on = 2 * counts > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, settings: SimHashSettings) -> Column:
    k = settings.shingle

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fold(shingle_hashes(t, k)) for t in texts], dtype="int64")

    return run(text)


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """leaders: for each of the 2048 syndromes the one error of weight three or less.  fours: for each syndrome whose
    leader has weight three, the five errors of weight four; else -1."""
    errors = [np.array([sum(1 << b for b in bits) for bits in combinations(range(23), k)], np.uint32) for k in range(5)]
    leaders, fours = np.zeros(2048, np.uint32), np.full((2048, 5), -1, np.int64)
    for light in errors[:4]:
        leaders[syndrome(light)] = light
    heavy = errors[4]
    heavy = heavy[np.bitwise_count(leaders[syndrome(heavy)]) == 3]
    heavy = heavy[np.argsort(syndrome(heavy), kind="stable")].reshape(-1, 5)
    fours[syndrome(heavy[:, 0])] = heavy
    return leaders, fours


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder, 11 bits, of division by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> np.uint32(bit) & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0)).astype(np.uint32)
    return rest


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Six columns: the indices (message bits) of the codewords within four bits of each 23-bit word, -1 where there are
    none left."""
    leaders, fours = golay_tables()
    s = syndrome(words.astype(np.uint32))
    near = ((words ^ leaders[s]) >> 11).astype(np.int64)
    far = fours[s]
    rest = np.where(far >= 0, (words[:, None].astype(np.int64) ^ far) >> 11, -1)
    return np.column_stack([near, rest])


def fuzzy_keys(prints: np.ndarray) -> list[list[int]]:
    """Keys of each fingerprint: segment number, that segment's value, a codeword index of the next segment."""
    parts = [(prints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    columns = []
    for i, part in enumerate(parts):
        index = codeword_indices(parts[(i + 1) % len(parts)].astype(np.uint32))
        columns.append(np.where(index >= 0, (np.int64(i) << 34) | (part[:, None] << 12) | index, -1))
    return [row[row >= 0].tolist() for row in np.hstack(columns)]


def key_column(fp: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(prints: pd.Series) -> pd.Series:
        return pd.Series(fuzzy_keys(prints.to_numpy(np.int64).view(np.uint64)))

    return run(fp)


def close(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def linked_prints(prints: DataFrame, settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """Links (a, b), a < b, that connect the same distinct fingerprints (column fp) as all pairs within the distance do.

    Small buckets give each of their pairs; of a large bucket, each word's nodes are linked to the least of them.
    """
    if settings.distance > 2:
        raise ValueError("the keys find pairs of two differing bits at most")
    keyed = stored(prints.select("fp", F.explode(key_column(F.col("fp"))).alias("key")), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(keyed.join(sizes, "key"), "buckets")
    small = shared.filter(F.col("n") <= settings.pair_limit).select("key", "fp")
    pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").filter(F.col("a") < F.col("b"))
    pairs = pairs.filter(close(F.col("a"), F.col("b"), settings.distance)).select("a", "b")
    crowded = shared.filter(F.col("n") > settings.pair_limit).select("fp").distinct()
    return pairs.unionByName(links_by_middle(crowded, settings.distance)).distinct()


def links_by_middle(prints: DataFrame, distance: int) -> DataFrame:
    """Links of prints by the words within one bit of each: no more than 65 nodes meet at a word."""
    masks = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(ALL_BITS if distance > 1 else 0)])
    if distance == 1:  # words of one bit less or more: each node reaches the other itself
        near = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(ALL_BITS)])
        spread = prints.select(F.col("fp").alias("a"), F.explode(F.transform(near, lambda m: F.col("fp").bitwiseXOR(m))).alias("b"))
        return spread.join(prints.select(F.col("fp").alias("b")), "b").filter("a < b").select("a", "b")
    spread = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    around = spread.groupBy("word").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    return around.select("a", F.explode("all").alias("b")).filter("a < b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a < b) the least one that it is connected to.

    Large-star: each node's larger neighbours are linked to its least one; small-star: so are the others.  Two rounds that
    leave the links as they were end it.  Each round is written to shared storage.
    """
    edges, last = stored(links, "links"), None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = stored(large, "large")
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(lower, "b")
        small = hung.select(F.col("m").alias("a"), "b").union(hung.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        before, edges = edges, stored(small, "small")
        remove_stored(large, before)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("s")).first()
        if now == last:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """A row per row of docs: doc_id, fp (bigint), component_id (the least doc_id of its class, nulls apart).

    Null, empty and blank texts have the fingerprint zero and are linked like any other; repeated rows are in one class.
    """
    marked = stored(docs.select("doc_id", fingerprint_column(F.col("text"), settings).alias("fp")), "prints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(linked_prints(nodes.select("fp"), settings))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stored(placed.select("fp", "root").join(classes, "root").select("fp", "component_id"), "classes")
    return marked.join(found, "fp", "left").select("doc_id", "fp", "component_id")


def first_of_each_class(docs: DataFrame, settings: SimHashSettings = SimHashSettings(), most: int = BROADCAST_BYTES) -> DataFrame:
    """docs with one row of each class, that of the least doc_id.  Each row is judged by its own fingerprint, and goes only if
    another row of its class stays.  Rows without an id can't be told apart and all stay."""
    marked = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"), fingerprint_column(F.col("text"), settings).alias("node"))
    rows = stored(marked, "rows")  # from here on a row's number is fixed
    roots = components(linked_prints(rows.select(F.col("node").alias("fp")).distinct(), settings))
    return first_rows(rows, roots, most)


def first_rows(rows: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """The documents of rows (doc, row, node) with one row, that of the least doc_id, of each class (node, root)."""
    own = F.when(F.col("doc.doc_id").isNotNull(), F.struct("doc.doc_id", "row"))
    nodes = rows.groupBy("node").agg(F.min(own).alias("first"), F.count(own).alias("size"))
    placed = nodes.join(roots.withColumnRenamed("root", "found"), "node", "left").select("node", "first", "size", F.coalesce("found", "node").alias("root"))
    placed = stored(placed, "placed")
    classes = placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("size").alias("size")).filter("size > 1")
    stays = stored(placed.select("node", "root").join(classes, "root").select("node", F.col("first.row").alias("stay")), "stays")
    judged = rows.select("doc", "row", "node").join(bounded(stays, most), "node", "left")
    return judged.filter("doc.doc_id is null or stay is null or row = stay").select("doc.*")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
