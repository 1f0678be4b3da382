"""The corpus pipeline: documents without toxic ones, repeated runs of lines, near duplicates and leaked benchmark text, packed into sequences.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a DataFrame; run() writes
each as Parquet into the shared folder and reads it again. All stages but the last return the columns of documents.

Defined results. Null text: kept by the filters, packed as one end id. Documents whose text line dedup empties stay, as
empty texts. Extra columns stay up to packing. Empty documents: empty results. Repeated rows: see each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import common, decontaminate, jaccard, lines, packing, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle, a similarity of 0.8 or more; the smallest doc_id of each component stays."""
    return jaccard.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a smaller cache than the query's: the stages before have left their share of memory in the executors
    return packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), keep=200_000)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard_join", drop_near_duplicates), ("decontamination", drop_leaked), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs


#: A trained model and a tokenizer are not expressible in SQL.
ORACLE_SQL = None
