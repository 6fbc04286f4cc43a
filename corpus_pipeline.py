"""Corpus preparation: bad documents go, one of each group of near duplicates stays, personal data is replaced, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import neardup, packing, pii, quality
from quillspark.llm.batches import fresh_name
from quillspark.llm.queries import pii_key
from quillspark.plans.shared import materialize
from quillspark.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; those that the classifier rejects go.

    Null and empty texts are scored as one passage of zeros, so they stay or go together; repeated rows have equal scores; a column that is called like the
    score is kept as it is; without labels all documents have one score; an empty table gives no rows.
    """
    name = fresh_name(docs, "quality_score")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest doc_id.

    Rows are told apart by a number that is written with them, so repeated ids don't matter: of rows
    with the same smallest id one stays, and a null id counts as the largest.
    """
    row = fresh_name(docs, "row")
    # the number depends on how a scan is cut into partitions, so it is written once with its document
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ids = rows.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("own"))
    found = neardup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), neardup.NearDup())
    groups = found.select("doc_id", "component_id").join(ids, "doc_id")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "doc_id")).alias("first"))
    others = groups.join(first, (groups.component_id == first.component_id) & (F.col("doc_id") == F.col("first.doc_id")), "left_anti")
    gone = materialize(others.select(F.col("doc_id").alias(row)), "gone")
    if gone.count() <= neardup.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with keyed surrogates for personal data in their texts (see pii_key for the key).

    Null and empty texts stay as they are; repeated rows get equal texts; columns called like those of the operator are kept; an empty table gives no rows.
    """
    count, kinds = fresh_name(docs, "n_entities"), fresh_name(docs, "kinds")
    return pii.pseudonymize(docs, pii_key(spark), count=count, kinds=kinds).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in the training sequences; of the columns only doc_id stays.

    Null and empty texts are the end id alone; repeated rows, and rows without id, are packed each by itself; an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("private_data", private_data_stage),
    ("packing", packing_stage),
]
#: No SQL expresses these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
