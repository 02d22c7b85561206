"""A training-corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, tokens are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next
stage's ``docs``. All but the last return the columns of ``documents``, whatever they are named beside doc_id, text and
source. Every stage takes a null text for an empty one, and an empty table gives an empty one in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm.exact_dedup import drop_copies
from rasterweave.llm.mixing import mixed_documents
from rasterweave.llm.near_join import one_of_each
from rasterweave.llm.packing import pack_documents
from rasterweave.llm.shared import materialize
from rasterweave.llm.tokens import WORD_BPE, tokenizer_path
from rasterweave.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the chain, fitted on ``labels``, does not reject. A null text is clean unless the chain rejects
    empty ones; rows that repeat an id are judged each by its own text; a null id is judged too."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id; a null id stays only where no other
    does; of rows that repeat id and text, one."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; rows with a null id are decided among themselves;
    texts without words stay, one of each id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times. A null source is one of its own; a
    text without words is taken as often as its probability says and weighs nothing."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed sequence. Rows that repeat an id are packed each by itself; a null id stays null; an
    empty text packs as its end id alone."""
    pieces = pack_documents(docs, tokenizer_path(WORD_BPE), end_id=1, max_tokens=2048, remembered=REMEMBERED)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Words that a worker's encoder remembers: fewer than where packing runs alone, as here the JVM's heap has grown before.
REMEMBERED = 60_000

STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixing), ("packing", packing)]

#: No SQL: the classifier chain and the tokenizer are outside of it; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
