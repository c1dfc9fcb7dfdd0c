"""The corpus pipeline: quality, exact dedup, near-duplicate join, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents;
the last one returns the packing. run() applies them to documents, writing every stage's result to the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm import block_dedup, packing, quality, secret_ledger, set_join
from lumenweft.llm._common import small_batches, stored, table, without

#: The near-duplicate stage: word shingles and similarity.
SHINGLE_WORDS, SIMILAR_NUM, SIMILAR_DEN = 5, 8, 10
#: Words that the packing stage's workers remember; less than on its own, as other stages' workers need memory, too.
PACKING_WORDS = 200_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Without labels of both classes all stay."""
    small_batches(spark)
    model = quality.train(quality.features(docs), table(spark, sf_dir, "labels"))
    score = quality.scored(model, *map(F.col, ("text", "lang", "source", "n_chars")))
    return docs.where(score["score"] >= quality.KEEP_FROM)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the smallest doc_id stays; of rows that repeat a doc_id and its text, one. Rows without a doc_id stay."""
    found = stored(block_dedup.exact_dedup(docs), "exact")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("rows"))
    decided = stored(ids.where("not any or rows > 1"), "decided")
    kept = without(docs, decided.where("not any").select("doc_id"))
    several = decided.where("any and rows > 1").select("doc_id")
    if several.isEmpty():
        return kept
    # an id with several rows may have several texts, and each is kept or not by itself
    key = ["doc_id", "text_sha256"]
    rows = kept.join(several, "doc_id", "left_semi").select("doc_id", F.sha2(block_dedup.normalised(F.coalesce("text", F.lit(""))), 256).alias("text_sha256"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(found.where("kept").select(*key), key, "left_semi").groupBy(*key).agg(F.min("row").alias("row"))
    return without(kept, several).unionByName(rows.select("row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays. Rows without a doc_id or without words stay."""
    found = set_join.jaccard_components(docs, SHINGLE_WORDS, SIMILAR_NUM, SIMILAR_DEN)
    return without(docs, found.where("doc_id <> component_id").select("doc_id"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark and n_chars follows; no document goes."""
    return secret_ledger.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), entries=PACKING_WORDS, special=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("n-gram jaccard join", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
#: A learned classifier and a genetic algorithm have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
