import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import fixity, queries

SCHEMA = "page_id bigint, url string, html string, offset string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA)


ROWS = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(700)] + [(None, None, None), (3, "http://h/3", "again"), (3, "http://h/3", "again")]


def test_sound_replicas_have_equal_roots(spark):
    a = fixity.archive_records(pages(spark, ROWS))
    assert fixity.audit(a, fixity.archive_records(pages(spark, ROWS).repartition(5))).count() == 0


def test_faults_are_located(spark):
    sound = pages(spark, ROWS)
    bad = F.when(F.col("page_id") == 5, F.concat(F.lit("X"), F.substr("html", F.lit(2)))).when(F.col("page_id") == 300, "").when(F.col("page_id") == 6, F.lit(None)).otherwise(F.coalesce("html", F.lit("")))
    rows = fixity.audit(fixity.archive_records(sound), fixity.archive_records(sound, damage=bad)).collect()
    assert sorted((r.archive, r.record_id, r.fault) for r in rows) == [(0, 5, "altered"), (0, 6, "missing"), (1, 300, "truncated")]
    found = next(r for r in rows if r.record_id == 5)
    body = "<p>5</p>" * 5
    whole = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Target-URI: http://h/5\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    assert found.expected_digest == hashlib.sha256(whole.encode()).hexdigest() and found.expected_length == len(whole)
    extra = fixity.audit(fixity.archive_records(sound, damage=bad), fixity.archive_records(sound)).filter("fault = 'extra'").collect()
    assert [r.record_id for r in extra] == [6]


def test_null_ids_and_long_texts(spark):
    """Rows without an id share no archive with those that have one, negative ones among them; a very long text is a record."""
    rows = [(None, f"u{i}", f"<p>{i}") for i in range(5)] + [(-3, "v", "x" * 3_000_000), (-256, "w", None)]
    found = fixity.archive_records(pages(spark, rows)).collect()
    nameless = {r.archive for r in found if r.record_id is None}
    assert len(nameless) == 5 and {r.archive for r in found if r.record_id is not None} == {-1}
    bad = F.when(F.col("page_id") == -3, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    damaged = fixity.archive_records(pages(spark, rows), damage=F.coalesce(bad, F.lit("")))
    assert [(r.archive, r.record_id, r.fault) for r in fixity.audit(fixity.archive_records(pages(spark, rows)), damaged).collect()] == [(-1, -3, "altered")]


def test_empty(spark):
    none = fixity.archive_records(pages(spark, []))
    assert fixity.audit(none, none).count() == 0
    assert fixity.audit(fixity.archive_records(pages(spark, ROWS[:3])), none).count() == 3


@pytest.mark.parametrize(("last", "levels"), [(0, 1), (65_535, 1), (65_536, 2), (65_536 * 16, 3)])
def test_levels(last, levels):
    assert fixity.levels_needed(last) == levels


def test_only_bad_branches_are_read(spark):
    a = fixity.archive_records(pages(spark, ROWS))
    both = a.withColumn("side", F.lit(0)).unionByName(a.withColumn("side", F.lit(1)))
    tree = fixity.tree_levels(both, 2)
    assert tree[-1].count() == 8 and fixity.differing(tree[-1]).count() == 0
    assert fixity.differing(tree[-1].filter("side = 0 or archive <> 1")).collect() == [(1, 0)]


def test_damage_rule_is_registered():
    assert "op1_merkle_fixity_audit" in queries.queries()
