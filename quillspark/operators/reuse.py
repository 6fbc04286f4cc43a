"""Reused passages: shared shingles and long common runs between two sets of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import materialize
from .text import prose_tokens

#: Fixed values of the rule: shingle size, least run, least Jaccard, least shared shingles.
SHINGLE, RUN, JACCARD, SHARED = 8, 12, 0.35, 4
#: Shingles of the prior texts, at most, that are sent to all tasks; beyond, both sides are shuffled.
BROADCAST_GRAMS = 1 << 20


def reused_passages(docs: DataFrame, prior: DataFrame) -> DataFrame:
    """doc_id, item_id, shared, jaccard, long_run for pairs that share enough shingles, or a run of RUN tokens.

    Texts are tokenised, and tokens hashed, once. Pairs come from equal 64-bit hashes of shingles, those of the prior texts sent to all tasks if they are few; a run of twelve
    holds shingles of eight, so runs are looked for in the texts of pairs that were found, and a pair costs what it shares.
    """
    grams = lambda n: F.array_distinct(T.gram_hashes(F.col("hashes"), n))
    rows = lambda d, tag: materialize(prose_tokens(d).select("doc_id", T.hashed(F.col("tokens")).alias("hashes")).select("doc_id", "hashes", grams(SHINGLE).alias("grams")), tag)
    a, b = rows(docs.select("doc_id", "text"), "shingles"), rows(prior.select(F.col("item_id").alias("doc_id"), "text"), "prior-shingles").withColumnRenamed("doc_id", "item_id")
    known = b.select("item_id", F.explode("grams").alias("gram"))
    if known.count() <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    shared = a.select("doc_id", F.explode("grams").alias("gram")).join(known, "gram").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    shared = materialize(shared, "shared")
    # only texts of pairs have their runs hashed, each once
    own = lambda d, key, n, runs: d.join(shared.select(key).distinct(), key, "left_semi").select(key, F.size("grams").alias(n), grams(RUN).alias(runs))
    pairs = shared.join(own(a, "doc_id", "na", "ra"), "doc_id").join(own(b, "item_id", "nb", "rb"), "item_id")
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    found = pairs.select("doc_id", "item_id", "shared", F.round(jaccard, 6).alias("jaccard"), F.arrays_overlap("ra", "rb").alias("long_run"))
    return found.where(((F.col("jaccard") >= JACCARD) & (F.col("shared") >= SHARED)) | F.col("long_run"))


def repeated_texts(docs: DataFrame) -> DataFrame:
    """text_hash, copies, first_id of texts that occur more than once, white space apart."""
    key = F.sha2(T.collapse(F.col("text")), 256)
    return docs.where("text is not null").groupBy(key.alias("text_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
