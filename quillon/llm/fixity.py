"""Fixity audit of archive replicas by Merkle trees.

A leaf is a record's digest.  Records that begin in one range of offsets make up a node of level 1: the digest of their
(offset, length, digest) in order; sixteen neighbouring ranges make up a node of the next level, up to one root per
archive.  Replicas are compared root by root, and only the children of nodes that differ are looked at, so an audit of a
sound replica reads the roots alone.

A node gathers the records of one range, or sixteen nodes: nothing grows with an archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_BYTES, bounded, stored

FANOUT_BITS = 4


@dataclass(frozen=True)
class FixitySettings:
    range_bytes: int = 1 << 16
    records_per_archive: int = 256  # of written archives
    broadcast_bytes: int = BROADCAST_BYTES  # of differing nodes that are sent to every executor; beyond, joined by a shuffle


def record_text(page_id: Column, url: Column, payload: Column) -> Column:
    """A WARC record of a page; null urls and payloads count as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def archive_records(pages: DataFrame, settings: FixitySettings = FixitySettings(), damage: Column | None = None) -> DataFrame:
    """Records (archive, offset, length, record_id, digest) of archives that hold so many page ids each, in their order.

    Null ids are in archives of their own, below those of any id and dealt out by their content's hash, so that no archive
    gathers them all; repeated rows are records of their own.  damage: the payload that is found in place of
    html, null where the record is lost; the layout stays that of the sound archive.
    """
    nameless = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("url", "html"), F.lit(1 << 16))
    archive = F.coalesce(F.floor(F.col("page_id") / settings.records_per_archive), nameless).cast("bigint").alias("archive")
    sound = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    found = sound if damage is None else F.when(damage.isNotNull(), record_text(F.col("page_id"), F.col("url"), damage))
    rows = pages.select(archive, F.col("page_id").alias("record_id"), F.octet_length(sound).cast("bigint").alias("room"), F.octet_length(found).cast("bigint").alias("length"), F.sha2(found, 256).alias("digest"), F.sha2(sound, 256).alias("_tie"))
    before = Window.partitionBy("archive").orderBy("record_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("room").over(before), F.lit(0)))
    return placed.filter("digest is not null").select("archive", "offset", "length", "record_id", "digest")


def digest_of(parts: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), ";", "").cast("binary"), 256)


def tree_levels(records: DataFrame, levels: int, settings: FixitySettings = FixitySettings()) -> list[DataFrame]:
    """Nodes (side, archive, node, hash) of each level from 1 on; the last holds one root per archive and side.

    records: those of all replicas, told apart by side.
    """
    place = F.floor(F.col("offset") / settings.range_bytes).cast("bigint")
    leaf = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), F.col("length").cast("string"), F.col("digest"))
    level = stored(records.groupBy("side", "archive", place.alias("node")).agg(digest_of(leaf).alias("hash")), "ranges")
    out = [level]
    for _ in range(levels - 1):
        child = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), F.col("hash"))
        level = stored(level.groupBy("side", "archive", F.shiftright("node", FANOUT_BITS).alias("up")).agg(digest_of(child).alias("hash")).withColumnRenamed("up", "node"), "level")
        out.append(level)
    return out


def levels_needed(last_offset: int, settings: FixitySettings = FixitySettings()) -> int:
    ranges, levels = max(0, last_offset) // settings.range_bytes, 1
    while ranges:
        ranges >>= FANOUT_BITS
        levels += 1
    return levels


def of_side(side: int, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def differing(level: DataFrame) -> DataFrame:
    """(archive, node) that only one side has or whose hashes differ: by one aggregation with a partial one before it."""
    both = level.groupBy("archive", "node").agg(*[F.max(of_side(k, F.col("hash"))).alias(n) for k, n in enumerate("ab")])
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node")


def audit(first: DataFrame, second: DataFrame, settings: FixitySettings = FixitySettings()) -> DataFrame:
    """Records that differ between two replicas: archive, offset, record_id, fault, expected_*, found_*.

    fault: missing (the second lacks it), extra (the first does), truncated (it is shorter), altered.  Of several records
    at one offset each is compared with those of its record_id.  What a side lacks has length 0 and an empty digest.  Equal
    or empty replicas give no rows.
    """
    columns = ("archive", "offset", "length", "record_id", "digest")
    records = stored(first.select(F.lit(0).alias("side"), *columns).unionByName(second.select(F.lit(1).alias("side"), *columns)), "records")
    levels = levels_needed(records.agg(F.max("offset")).first()[0] or 0, settings)
    tree = tree_levels(records, levels, settings)
    wrong = differing(tree[-1])
    for level in reversed(tree[:-1]):
        parents = bounded(stored(wrong.withColumnRenamed("node", "up"), "wrong"), settings.broadcast_bytes)
        wrong = differing(level.withColumn("up", F.shiftright("node", FANOUT_BITS)).join(parents, ["archive", "up"], "left_semi"))
    ranges = bounded(stored(wrong.withColumnRenamed("node", "range"), "wrong"), settings.broadcast_bytes)
    within = records.withColumn("range", F.floor(F.col("offset") / settings.range_bytes).cast("bigint")).join(ranges, ["archive", "range"], "left_semi")
    sides = [(0, "expected"), (1, "found")]
    met = within.groupBy("archive", "offset", "record_id").agg(
        *[F.coalesce(F.max(of_side(k, F.col("length"))), F.lit(0).cast("bigint")).alias(f"{n}_length") for k, n in sides],
        *[F.array_join(F.sort_array(F.collect_list(of_side(k, F.col("digest")))), ",").alias(f"{n}_digest") for k, n in sides],
    )
    fault = F.when(F.col("found_digest") == "", "missing").when(F.col("expected_digest") == "", "extra").when(F.col("found_length") < F.col("expected_length"), "truncated").otherwise("altered")
    return met.filter("expected_digest <> found_digest").select("archive", "offset", "record_id", fault.alias("fault"), "expected_length", "found_length", "expected_digest", "found_digest")
