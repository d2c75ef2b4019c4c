"""From raw documents to a sharded training mix: five stages, each an operator of binloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes what a stage returns to the shared checkpoint folder and gives it to the next one as docs.

For all stages: further columns pass through, whatever their names (but for shard and slot in the last, which take the
place of such columns); an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binloom.llm.common import durable_table, table
from binloom.llm.decontaminate import clean_documents
from binloom.llm.mixing import mixed_corpus
from binloom.llm.near_copies import distinct_documents
from binloom.llm.quality import accepted_documents
from binloom.llm.sharding import shard_documents

SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts, fitted on the labelled ones among docs.

    Null and empty texts are judged by features of 0; equal texts stay or go together; a score at the threshold stays;
    repeated rows are judged each for itself; without labels of both classes all stay.
    """
    return accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5-word shingle sets of Jaccard similarity >= 0.8) the document of the smallest id.

    Null, empty and white-space texts are copies of each other; null ids come last, then the digest of the row decides;
    of rows repeated in id and text one stays.
    """
    return distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of the benchmark occurs.

    Null and wordless texts stay, as no window occurs there; repeated rows stay or go together; without benchmark all stay.
    """
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights, a row for each pass that takes a document, in training order.

    A null source is a source, last in order; null and wordless texts are never asked for and so not in the mix;
    positions that tie are in the order of a hash of id and text; repeated rows are documents of their own.
    """
    return mixed_corpus(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, by the id alone, and their slot in it.

    Slots are drawn by hash; rows that repeat an id with its text, as the passes of the mix do, are spread evenly over their
    shard. Rows of one id, or of none, are in one shard and have slots of their own; null texts count as others.
    """
    return shard_documents(docs, [1.0] * SHARDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier and the fingerprints are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
