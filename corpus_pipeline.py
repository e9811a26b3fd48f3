"""Training corpus pipeline over the ``documents`` table.

Five stages, each reading the Parquet table its predecessor wrote and keeping whole rows, texts included:

1. quality: drop documents that the pairwise quality ranking rejects (trained on the ``labels`` of its input),
2. near_dedup: of each group of near duplicates one document stays,
3. decontaminate: drop documents in which a window of a ``benchmark`` item occurs,
4. mix: repeat or thin documents so that sources reach their target weights,
5. tokens: write the mix as ORC token files and return what they hold, one row per document and repeat.

All stages but the last return the columns of ``documents``. An empty table passes through; a table without
labels or benchmark items passes the stage that needs them unchanged. A null text counts as empty and is judged as
such; very long texts go through every stage whole; of equal or near texts the smallest id stays, of rows that repeat
an id and its text one; columns beyond those of ``documents`` pass through, whatever their names.

A stage's result may run lazily, after its function has returned, so what bounds a batch that goes to a Python
worker (rows are bounded by the operators, bytes here) holds for the session, not for a call.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from starlit.llm.common import scratch_dir, table
from starlit.llm.decontaminate import drop_contaminated
from starlit.llm.mixing import mixed_documents
from starlit.llm.near_dedup import keep_one
from starlit.llm.quality import keep_quality, train_quality
from starlit.llm.token_files import encode_documents


BATCH_BYTES = 4 << 20  # of the rows that an executor hands to a Python worker at a time; a longer row goes alone


def bounded(stage):
    """A stage whose Arrow batches are bounded in bytes."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return run


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


@bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


@bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@bounded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


@bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

# Trained scores, hashed permutations and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_dir(spark, f"stage-{k}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
