"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
reads it back from Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontam, langid, linededup, neardup, packing
from tallymark.llm.common import settle, table
from tallymark.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language has a mean probability of under 0.4, go."""
    docs = docs.select(*COLUMNS)
    return langid.label(docs, langid.train(docs)).where("lang_pred <> 'und' AND score >= 0.4").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents left without text (null and empty ones too); whole copies of which a line is left are the next stage's."""
    x = linededup.dedup(docs.select(*COLUMNS))
    return x.where("text RLIKE '\\\\S'").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a Jaccard similarity of 0.8 or more in five-word shingles are linked. Of each group of rows one with the smallest doc_id stays (null comes last)."""
    rows = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("nr"), F.monotonically_increasing_id().alias("row"))
    rows = settle(rows, "near-rows")
    roots = settle(neardup.groups(rows).withColumnRenamed("nr", "node"), "near-groups")
    named = rows.select("nr", "doc_id", "row").join(roots, F.col("nr") == F.col("node"), "left").select(F.coalesce("root", "nr").alias("root"), "doc_id", "row")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("kept"))
    return rows.join(first, F.col("row") == F.col("kept"), "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go, each by its own text (doc_id may be null, repeated or shared)."""
    rows = settle(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "contaminated-rows")
    found = decontam.contaminated(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    going = settle(found.select(F.col("doc_id").alias("gone")).distinct(), "contaminated")
    return rows.join(going, F.col("row") == F.col("gone"), "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of 4096, a row for each piece; a null or empty text is its end id alone, repeated rows and ids are documents of their own, no documents no rows."""
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packed)]

#: The network, the segment join and the packing cannot be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
