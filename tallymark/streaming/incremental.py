"""Detection over files as they arrive (one pass over what is new, then stop).

`run_new` appends scored rows. `merge_new` keeps a table by key: each micro-batch is one folder,
named after its number, and counts once its entry stands in the ledger. A replayed batch finds
its entry and does nothing; one that broke off is written anew over what it had left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import last_ok
from ..sources.atomic import Store


def run_new(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], sink: str, state: str) -> None:
    """Score the JSON lines added to `source` since the last call and append them to `sink` as Parquet.

    The file sink's log makes each micro-batch count once, so a restart after a lost driver repeats nothing.
    `score` is stateless: a row needs itself only, hence no watermark.
    """
    rows = spark.readStream.schema(schema).json(source)
    q = score(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def merge_batch(batch: DataFrame, number: int, sink: str, key: str, order: str) -> bool:
    """Add micro-batch `number` to the table at `sink`, once: False if its entry is there already.

    A key's rows of one batch are combined first; the greatest `order` wins, also against earlier batches (see `merged`)."""
    ledger = Store(sink)
    if ledger.has(f"ledger/{number:012d}"):
        return False
    rest = [c for c in batch.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, *[f"x.{c}" for c in rest])
    last.write.mode("overwrite").parquet(f"{sink}/batches/{number:012d}")
    try:
        ledger.publish(f"ledger/{number:012d}", b"")
    except FileExistsError:  # another driver was faster; it wrote the same batch
        return False
    return True


def merged(spark: SparkSession, sink: str, schema: str, key: str, order: str) -> DataFrame:
    """The last row of each key over the batches that the ledger holds (by `order`, then by batch)."""
    store = Store(sink)
    done = [f"{sink}/batches/{n}" for n in (f.rsplit("/", 1)[1] for f in store.names("ledger")) if n.isdigit()]
    if not done:
        return spark.createDataFrame([], schema)
    x = spark.read.schema(schema).parquet(*done).withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batches/(\d+)/", 1))
    x = x.withColumn("_last", F.struct(F.col(order).alias("o"), F.col("_batch").alias("b")))
    names = [c for c in x.columns if not c.startswith("_")]
    return last_ok(x, key, "_last", F.lit(True)).select(*names)


def merge_new(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], sink: str, state: str, key: str, order: str, files: int = 1000) -> None:
    """Score the JSON lines added to `source` since the last call and merge them by key into the table at `sink`."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
    q = score(rows).writeStream.foreachBatch(lambda b, n: merge_batch(b, n, sink, key, order) and None).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
