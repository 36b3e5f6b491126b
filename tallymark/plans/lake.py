"""The workload's frames over the test tables: a document is a generated program, its
language the configuration, its source the task; labels are the ground truth. Scores and
variants come from digests of the text, so that any engine derives the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANTS = ("minify", "rename", "strip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digits(text: str, start: int, size: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, size), 16, 10).cast("int")


def gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("config"), F.col("source").alias("task"), "text")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("toxic"))
    z = (digits("text", 1, 4) % 1201) / 100.0 - 4
    return d.join(lab, "id", "left").withColumn("z", z)


def obf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gen(spark, sf_dir)
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("obf"), F.when(digits("text", 5 + k, 1) >= 2, F.lit(f"ok{k}")).alias("solution"), (F.col("z") - 0.5 * (k + 1)).alias("z2"), (F.col("passed") & (digits("text", 9 + k, 1) >= 3)).alias("passed2"), (F.length("text") - k).alias("len2")) for k, n in enumerate(VARIANTS)]))
    return g.select("id", "config", "passed", v.alias("v")).select("id", "config", "passed", "v.*")


GEN_SQL = """gen AS (SELECT d.doc_id AS id, d.lang AS config, d.source AS task, d.text, l.quality = 1 AS passed, l.toxic = 1 AS toxic,
 (CAST('0x' || substr(md5(d.text), 1, 4) AS INTEGER) % 1201) / 100.0 - 4 AS z FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
OBF_SQL = GEN_SQL + ", obf AS (" + " UNION ALL ".join(f"SELECT id, config, passed, '{n}' AS obf, CASE WHEN CAST('0x' || substr(md5(text), {5 + k}, 1) AS INTEGER) >= 2 THEN 'ok{k}' END AS solution, z - {0.5 * (k + 1)} AS z2, passed AND CAST('0x' || substr(md5(text), {9 + k}, 1) AS INTEGER) >= 3 AS passed2, length(text) - {k} AS len2 FROM gen" for k, n in enumerate(VARIANTS)) + ")"
TOK_SQL = "tok AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents)"
POS_SQL = TOK_SQL + ", pos AS (SELECT doc_id, lang, unnest(range(1, len(t) + 1)) AS i, t FROM tok)"
#: 1 - Phi(z) by the same polynomial.
def tail_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    poly = f"(((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(1 - 0.5 * (1 + sign({z}) * (1 - {poly} * exp(-{x} * {x}))))"


def green_sql(ctx: str, tok: str, most: int = 32768, key: str = "k") -> str:
    return f"(CAST('0x' || substr(md5('{key}|' || {ctx} || '|' || {tok}), 1, 4) AS INTEGER) < {most})"
