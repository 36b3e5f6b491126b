"""What the operators share: tables, the cluster's shared folder, batches of bytes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Only where the session names no folder of its own and is one machine (tests).
FALLBACK_DIR = "/tmp/checkpoints/tallymark"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir)."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master == "local" or master.startswith("local["):
        return FALLBACK_DIR
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of what is
    below, and so that later passes do not repeat the work.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*settled: DataFrame) -> None:
    """Delete tables of settle() that nothing unwritten reads any more."""
    for df in settled:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (length n + 1) of an Arrow string column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each (one row at least)."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def numbered(data: np.ndarray, cuts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct strings data[cuts[i]:cuts[i + 1]], and the number of each string among them."""
    if len(cuts) < 2:
        return [], np.zeros(0, np.int64)
    own = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return own.dictionary.to_pylist(), own.indices.to_numpy()
