import corpus_pipeline
import duckdb
import pytest

from quillon.llm import queries

from .conftest import frame


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_dedup_and_benchmark_stages(spark, sf_dir, prose):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(1, prose(200, 1)), (2, prose(200, 1)), (3, prose(100, 2) + "\n" + item), (4, None), (5, prose(70, 3)), (None, prose(90, 4))]
    docs = frame(spark, rows)
    assert sorted((r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()), key=str) == [1, 3, 4, 5, None]
    assert sorted((r.doc_id for r in corpus_pipeline.benchmark(spark, docs, sf_dir).collect()), key=str) == [1, 2, 4, 5, None]


def test_stages_take_odd_tables(spark, sf_dir, prose, odd_texts):
    """Null, empty and blank texts, null ids, repeated rows, no rows, and columns named like the stages' own."""
    rows = [*enumerate(odd_texts[:6]), (None, None), (None, prose(40, 1)), (7, prose(60, 2)), (7, prose(60, 2)), (8, prose(80, 3))]
    docs = frame(spark, rows).selectExpr("*", "-5.0D AS _score", "'n' AS node", "1 AS row", "2 AS keys", "'f' AS fp", "3 AS _hit", "4 AS k", "'d' AS doc")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.dtypes == docs.dtypes
        found = kept.collect()
        assert {r._score for r in found} <= {-5.0} and {tuple(r) for r in found} <= {tuple(r) for r in docs.collect()}
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert {r.doc_id for r in corpus_pipeline.toxic(spark, docs, sf_dir).collect()} == {i for i, _ in rows}
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert packed.select("doc_id", "piece").count() >= len(rows) and corpus_pipeline.pack(spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    if name not in queries.oracle_sql():
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(str, (dict(zip(want.columns, r, strict=True))[c] for c in columns))) for r in want.fetchall())
