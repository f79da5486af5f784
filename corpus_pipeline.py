"""A training-corpus pipeline over ``documents``: STAGES in order, each on what its predecessor kept.

The stages are one file's worth of calls into ``pagelens.llm``.  All but the last return the columns of documents,
whatever else these hold, and nothing from an empty table.

Rows with a null or empty text are scored as such, never count as copies, contaminated or secret, and are packed as an
end token.  Of rows of equal doc_id and text one stays; rows of one doc_id with different texts are decided each by its
own text; a row without a doc_id is only dropped for its score or for what it shares with the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.decontaminate import drop_contaminated
from pagelens.llm.ngram_join import keep_one_of_each_group
from pagelens.llm.packing import pack
from pagelens.llm.quality import THRESHOLD, score_documents
from pagelens.llm.registry import tokenizer
from pagelens.llm.secret_scan import redact
from pagelens.operators.ordering import settled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below the threshold go."""
    name = "_".join(["score", *docs.columns])  # longer than any other
    scored = score_documents(docs, _table(spark, sf_dir, "labels"), name=name)
    return scored.where(F.col(f"`{name}`") >= THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the smallest doc_id stays."""
    return keep_one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of tokens."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packing),
]
#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written as Parquet and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
