"""Files: JSON lines, one JSON document a file, directory discovery, fingerprints, step caches, sinks.

All paths go through Spark's readers and writers, so any store that Spark knows will do.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; /tmp only on one machine whose session names none (tests)."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "local")
    if not shared and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or '/tmp/checkpoints/tallymark').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later passes and lost executors repeat nothing of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of kept() that nothing unwritten reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of JSON lines, plain or gzip (which Spark can't split); a malformed line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_marked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, but malformed lines come as rows with the line in `_corrupt`."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, mode="PERMISSIVE")


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file that is a single JSON value."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length of every file below `path`; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")


def partitions(listed: DataFrame, part: str = "config") -> DataFrame:
    """Files in numeric `<part>=N` folders, with N; paths that name a backup are left out."""
    n = F.regexp_extract("path", rf"/{re.escape(part)}=([0-9]+)/", 1)
    return listed.where(~F.contains(F.lower("path"), F.lit("backup"))).withColumn(part, n.try_cast("int")).where(F.col(part).isNotNull())


def latest(listed: DataFrame) -> DataFrame:
    """The file with the last modification; the greater path wins ties."""
    return listed.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of every file: a manifest."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def cached_step(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at `path`; made and written first if it isn't there or can't be read."""
    try:
        kept = spark.read.parquet(path)
        kept.count()  # reads every footer
        return kept
    except (PySparkException, Py4JJavaError):
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


#: Where each kind of benchmark keeps its id, prompt, entry point and tests.
DIALECTS = {
    "humaneval": ("task_id", "prompt", "entry_point", "test"),
    "mbpp": ("task_id", "text", None, "test_list"),
    "apps": ("problem_id", "question", None, "input_output"),
    "multiple": ("name", "prompt", None, "tests"),
    "humanevalpack": ("task_id", "prompt", "entry_point", "test"),
    "conala": ("question_id", "intent", None, "snippet"),
    "concode": ("id", "nl", None, "code"),
    "gsm8k": ("id", "question", None, "answer"),
}


def benchmark(raw: DataFrame, dialect: str) -> DataFrame:
    """id, prompt, entry_point, test as strings from the columns that the dialect names. Without an entry
    point of its own, it is the last `def NAME(` of the tests or the prompt."""
    i, prompt, entry, test = DIALECTS[dialect]
    t = F.array_join(test, "\n") if isinstance(raw.schema[test].dataType, T.ArrayType) else F.col(test).cast("string")
    named = F.try_element_at(F.regexp_extract_all(prompt, F.lit(r"def\s+(\w+)\s*\("), F.lit(1)), F.lit(-1))
    called = F.regexp_extract(t, r"assert\s+(\w+)\s*\(", 1)
    return raw.select(F.col(i).cast("string").alias("id"), F.col(prompt).alias("prompt"), (F.col(entry) if entry else F.coalesce(F.nullif(called, F.lit("")), named)).alias("entry_point"), t.alias("test"))


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.json(path, mode="overwrite", compression="gzip" if gzip else "none")


def write_once(df: DataFrame, path: str, inputs: tuple[str, ...] = ()) -> None:
    """Write JSON lines where nothing is yet; never into a folder of the inputs. Spark's committer renames whole outputs."""
    own = path.rstrip("/") + "/"
    if any(own.startswith(i.rstrip("/") + "/") for i in inputs):
        raise ValueError(f"{path} is among the inputs")
    df.write.json(path, mode="errorifexists")


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a resume log. Committed as a whole; a retry adds the rows again, so read it with `last_ok`."""
    df.write.json(path, mode="append")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without a finished row."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def scalars(df: DataFrame) -> list[Column]:
    flat = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, flat)]


def write_csv(df: DataFrame, path: str) -> None:
    """Scalar columns only."""
    df.select(*scalars(df)).write.csv(path, mode="overwrite", header=True, escape='"')


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table; over `most` rows it is an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"
