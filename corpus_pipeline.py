"""A corpus pipeline of five stages, each written as Parquet and read again.

Stages take (spark, docs, sf_dir). All but the last return the columns of
documents; the last adds size, source_size, target and taken.

Defined cases: null and empty texts, and those of white space, pass the first four
stages, each as a document of its own, and go in the last, which takes words; a null
doc_id, lang or source is kept as it is; of repeated rows, and of rows with one text,
one stays after the join; other columns are kept, whatever they are called (those
named as the last stage's are <name>_input after it); an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from geoflume.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from geoflume.llm._common import checkpoint_dir, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = toxicity.train(docs, toxicity.label_table(table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    return toxicity.accepted(docs, chain)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in the last of them only."""
    return line_dedup.without_repeated_lines(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.one_of_each(docs)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents of which nothing is taken go."""
    return mixing.mixed(docs)


STAGES = [("toxicity", not_toxic), ("line dedup", fresh_lines), ("n-gram Jaccard join", no_near_copies), ("benchmark decontamination", no_test_items), ("mixing", mixed)]

#: A classifier and approximate candidates aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each one's rows go to a folder of this run in the shared checkpoint folder, until the next one's are written."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            _drop(spark, f"{folder}/{n - 1}")
    return docs
