"""A corpus from raw documents to token files, in five stages.

Each stage works on all that the one before kept and is written before the next.

A null text is empty: it has the score of a text without words, is like no other,
holds no item, and has the end id alone. A null id is an id: its rows are judged
by their texts. Rows that repeat an id are judged one by one; of the n-gram Jaccard
stage's components, those with the smallest id stay. A null source is a source.
Other columns, of any name, are kept up to the mix. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoptic.llm import decontam, jaccard, mixing, token_orc, toxicity
from isoptic.llm.queries import vocabulary
from isoptic.llm.store import keep, shared_path
from isoptic.llm.text import unused

#: Documents that score as much are rejected.
TOXIC = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``TOXIC``, by models of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    [name] = unused(docs.columns, "toxicity")
    return toxicity.score(docs, toxicity.fit(docs, labels), name=name, most=TOXIC).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, that of the smallest id."""
    return jaccard.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids as ORC files; one row a document, from these."""
    path = shared_path(spark, "tokens")
    token_orc.write_tokens(docs, path, vocabulary())
    return token_orc.digests(spark, path)


STAGES = [("toxicity", without_toxic), ("ngram_jaccard", one_of_each), ("decontamination", without_leaks), ("mixing", mixed), ("token_orc", tokens)]

#: Models, alignments and a tokenizer are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
