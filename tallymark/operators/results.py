"""A table of results by key that outlives a run: distinct work is done once, over all runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import atomic as A
from ..sources.files import kept
from .relational import last_ok


def _rows(spark, path: str, schema: str) -> DataFrame:
    columns, files = f"digest string, run long, ok boolean, result struct<{schema}>", A.committed(path)
    return spark.read.schema(columns).json(files) if files else spark.createDataFrame([], columns)


def results_at(spark, path: str, schema: str) -> DataFrame:
    """The last good result of each digest: digest, run, result (struct of `schema`)."""
    return last_ok(_rows(spark, path, schema), "digest", "run", F.col("ok")).select("digest", "run", "result")


def cached_results(df: DataFrame, program: str, path: str, schema: str, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(df with `digest` and `result`, how many programs were worked on now).

    A program is known by its sha256. Those without a good result at `path` are made distinct and given to
    work(digest, program), which returns digest, ok (boolean) and the columns of `schema` (`name: type, ...`); its rows
    join the table whole, as one commit. A row that is not ok stays in the table but does not count: the program's
    next run tries again, and until then its result is null (as is that of a null program)."""
    spark, digest = df.sparkSession, F.sha2(F.col(program).cast("string"), 256)
    rows = df.withColumn("digest", digest)
    known = results_at(spark, path, schema)
    todo = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.any_value(program).alias("program")).join(known.select("digest"), "digest", "left_anti")
    todo = kept(todo, "todo")
    many = todo.count()
    if many:
        fields = [f.split(":")[0].strip() for f in schema.split(",")]
        run = (_rows(spark, path, schema).agg(F.max("run")).first()[0] or 0) + 1
        made = work(todo.select("digest", "program")).select("digest", F.lit(run).alias("run"), F.coalesce("ok", F.lit(False)).alias("ok"), F.struct(*fields).alias("result"))
        A.write_jsonl(made, path, "extend")
    found = results_at(spark, path, schema).select(F.col("digest").alias("_d"), "run", "result")
    return rows.join(found, F.col("digest") == F.col("_d"), "left").drop("_d"), many
