"""A training corpus from documents: toxic ones go, repeated lines go, one of each group of near copies stays, sources are mixed to weights, texts become tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from tempora.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels that op8 may learn from."""
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels"), 3, 1))
    return toxicity.score(docs, model, spans=False).filter("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less their repeated lines; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of linked documents."""
    return jaccard_join.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the SHA-256 of the decoded text of each document."""
    return bpe.encode_decode(docs, outputs=("n_tokens", "ids", "decoded_sha256")).select("doc_id", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_sources), ("BPE", tokenize)]

#: The classifier and the seeded choice of documents have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again by the next; what came before is deleted then."""
    docs, top, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{top}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        last = path
    return docs
