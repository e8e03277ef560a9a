"""The corpus pipeline: documents to token ids, stage by stage.

Each stage is a function of (spark, docs, sf_dir).  Its result is written as
Parquet and read again as the next one's ``docs``, so that a lost executor costs
no more than a stage's own work.  When a stage begins, what the ones before it
stored on their way is discarded, unless their results are not written yet.

Every stage takes rows as they are: a null text is an empty one to the rules (and
is rejected), the joins and the encoder, and stays null in the PII stage; null
and repeated ids are rows like any other; an empty table gives an empty table;
columns beyond those of documents are left out.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontamination, jaccard_join, pii, quality, sentencepiece_codec
from codeloom.llm.common import Job, release_shuffles, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Jobs of earlier stages, by thread and input, whose tables are still stored.
_earlier: dict[tuple[int, str], list[Job]] = {}


def _stage(f):
    """A stage with a job of its own; what earlier stages on the same input stored is discarded, unless ``docs`` reads it.

    Stages on one input in one thread belong to one run: each begins when the one
    before is written, or takes its unwritten result as ``docs``.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        jobs = _earlier.setdefault((threading.get_ident(), sf_dir), [])
        for job in jobs:
            job.discard(spark, docs)
        jobs[:] = [job for job in jobs if job.paths]
        with Job().active() as own:
            jobs.append(own)
            return f(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep (operator 6)."""
    return quality.keep_good(docs).select(COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id (operator 4).

    ``docs`` is read from Parquet, so a row is known by its file and its place there.
    """
    docs = docs.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))
    return jaccard_join.keep_one(docs, row_col="row").select(COLUMNS)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (operator 9)."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kind (operator 10)."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, and whether these decode to the text (operator 7)."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", encoding),
]

#: Near-duplicate components, expectation-maximisation and segmentation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
        release_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
