"""The document pipeline: quality classifier, line dedup, n-gram Jaccard join,
mixing sources to target weights and best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; run() writes each stage's result as Parquet in the shared
folder and rereads it. All stages but the last return the columns of documents,
whatever their names, and rows of these alone.

Defined results: an empty table of documents gives an empty result; without two
different grades among the labels the classifier keeps all. A null text is an
empty one to every stage and stays null until it is packed; it is classified as
such, links with nothing, is mixed as 0 words and packed as its end id. A null
doc_id comes after all others, a null source is a source of its own. Repeated
rows are classified and cut alike; of those with words, the n-gram join keeps
one. Copies that the mix repeats are rows of their own to the packing, told apart
by their sequence and offset only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, mixing, ngram_join, ordinal, packing
from corpusloom.llm.common import fresh, table, written
from corpusloom.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, keeps."""
    keep = ordinal.names(docs)["keep"]
    return ordinal.classify(docs, table(spark, sf_dir, "labels")).where(F.col(keep)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come again; n_chars follows the text."""
    done, removed = line_dedup.dedup(docs), fresh(docs, "ln_removed")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the first by doc_id."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.repeated(mixing.mix(docs), mixing.names(docs)["copies"]).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("ngram_join", near_copies), ("mixing", mixed), ("packing", packed)]

#: the stages are beyond SQL; tests/llm compares them with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
