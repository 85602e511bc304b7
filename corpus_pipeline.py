"""A corpus pipeline: documents to a cleaned, deduplicated, mixed and encoded training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, works on all rows its predecessor kept, and all but
the last return the columns of documents. Some stages have no SQL: ORACLE_SQL is None and the tests hold every stage
against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loam.llm.jaccard_join import one_of_each
from loam.llm.mixing import mixed_documents
from loam.llm.piece_sampling import sample_pieces
from loam.llm.quality_model import keep_quality
from loam.llm.substring_dedup import dedup_documents
from loam.shared import lean_workers


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the PU-learned classifier rejects (score below 0.5). Null and empty texts are scored by their (zero)
    features; null ids have no label; repeated rows share one fate; without labels, all stay; empty gives empty."""
    lean_workers(spark)
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (Jaccard of 5-word shingles of 0.8 or more): that of least id,
    null ids last. Null and empty texts are like nothing and stay; rows equal in id and text become one; empty gives
    empty."""
    lean_workers(spark)
    return one_of_each(docs, threshold=0.8, recall=0.99)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words whose 20-word windows stand earlier in the corpus, by id, null ids last. Every row stays, also one that
    loses all words; null texts stay null; repeated rows are cut alike; empty gives empty."""
    lean_workers(spark)
    return dedup_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the sources' targets: documents come as often as they are taken, dealt to shards and shuffled there. A null
    source is one of its own, the last; documents without words are taken with their block; repeated rows share one fate;
    empty gives empty."""
    lean_workers(spark)
    return mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode texts as sampled SentencePiece ids. A document that is taken twice has the same ids twice, as its key seeds
    the draws. Null and empty texts have no ids; empty gives empty."""
    lean_workers(spark)
    return sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_pieces", "lossless", "piece_ids")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("substring dedup", repeats), ("mixing sources", mixture), ("SentencePiece encoding", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again as the next one's docs. What a
    stage read is removed once its own rows are written."""
    from loam.shared import removed, shared_path

    folder = shared_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
