"""Corpus preparation in five stages over the documents table.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm._util import BATCH_BYTES, settings, shared_folder
from tracewarden.llm.decontaminate import drop_contaminated
from tracewarden.llm.langid import fit, held_out, keep_identified
from tracewarden.llm.packing import pack_documents
from tracewarden.llm.pii import pseudonymize
from tracewarden.llm.queries import surrogate_key, tokenizer_path
from tracewarden.llm.simhash import keep_one


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't in one language, by the network's prediction, go; all with a letter stay if no row is labelled."""
    return keep_identified(docs, fit(docs.where(~held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, of five-word Jaccard similarity 0.8 or more, stays: that with the least id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars follows the text."""
    out = pseudonymize(docs, surrogate_key(spark), entities_col="__entities").drop("__entities")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences; a row for each piece of a document."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontaminate", decontaminate), ("pii", replace_personal_data), ("pack", pack)]

#: A trained network, chained hashes and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder and read again. What the next stage has read is deleted."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with settings(spark, BATCH_BYTES):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
