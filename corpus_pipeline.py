"""Corpus pipeline: quality, toxicity, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of docs; the last one gives
packed pieces.  A stage works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, near_copies, packing, quality_gam, toxicity
from quillon.llm.common import bounded, stored, table

GOOD_FROM, TOXIC_FROM = 0.3, 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough.

    Rows are judged each by its own text: repeated rows stay or go together, null and empty texts are scored like any other
    (features of zero); further columns are kept as they are.  No rows give no rows.
    """
    model, _ = quality_gam.trained(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_gam.score_column(F.col("text"), model) >= GOOD_FROM)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't scored as toxic.

    Rows are judged each by its own text, of any length: repeated rows stay or go together, null and empty texts score 0 and
    stay; further columns are kept as they are.  No rows give no rows.
    """
    network, _ = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(F.col("text"), network) < TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: texts whose runs of five words have a Jaccard similarity of 0.8 or more.
    Operator 4 settles copies and the closest pairs, MinHash bands find what its two bits leave apart; every link is compared.
    """
    return near_copies.first_of_each_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item.  Rows without an id share their hits and so their fate."""
    hit = decontaminate.contaminated_ids(docs, table(spark, sf_dir, "benchmark"))
    ids = bounded(stored(hit, "hit"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequence and place.  A null or empty text is its end id alone; repeated rows
    are documents of their own; of other columns only doc_id is kept.  No rows give no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", pack)]

#: Trained models, fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
