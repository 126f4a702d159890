"""The training-data pipeline over documents.

Each stage takes what the one before kept: toxic documents go, one document of each group of near copies stays,
documents that hold benchmark items go, sources are mixed to their target weights, and the mix is written as
token files. All stages but the last return the columns of documents, whatever their names: rows pass through the
operators that add columns as one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreframe.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from loreframe.llm.shared import stored


def _with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the whole row as ``row``."""
    return docs.select(F.struct(*docs.columns).alias("row"), *columns)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    scored = toxicity.toxicity(_with_row(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["row", "doc_id"])
    return scored.where("predicted = 0").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, rows without an id last."""
    return ngram_join.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that is drawn more than once is repeated."""
    return mixing.draws(mixing.mix(_with_row(docs, "doc_id", "text", "source")), ["row", "doc_id"]).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document."""
    return token_files.encoded(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("ngram_join", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mixing", mixed),
    ("token_files", tokens),
]
#: The classifier, the join and the tokenizer aren't SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
