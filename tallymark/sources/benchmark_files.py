"""Benchmark files as a data source: one input partition a file, filters pushed to files and lines, errors by file and line.

A file's name begins with its dialect (``mbpp.jsonl``, ``humaneval-2.jsonl.gz``); files and
folders that begin with a dot or an underscore are not read. Where the folder is a table of
`atomic`, the files are those of its manifest. Each line is one JSON object that
has the dialect's fields; blank lines are passed over. A line that is not is an error that
names the file and the line, or (``errors=rows``) a row that holds only the message.

Equality and IN on ``dialect`` and ``file`` choose files before any is opened; on ``id`` they
choose lines before rows are made. Spark evaluates all other filters.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from .atomic import Store, newest
from .files import DIALECTS

NAME, ROWS = "benchmark_files", 1024
SCHEMA = "dialect string, id string, prompt string, entry_point string, test string, file string, line long, error string"
FIELDS = pa.schema([(c, pa.int64() if c == "line" else pa.string()) for c in (f.split()[0] for f in SCHEMA.split(", "))])


class BenchmarkFileError(ValueError):
    """A file or line that isn't what its dialect says."""


@dataclass
class OneFile(InputPartition):
    name: str
    path: str
    dialect: str


def as_text(value) -> str | None:
    """Lists become lines, objects JSON, other values their text."""
    if value is None or isinstance(value, str):
        return value
    return "\n".join(map(as_text, value)) if isinstance(value, list) and all(isinstance(x, str) for x in value) else json.dumps(value)


def checked(line: str, where: str, required: list[str]) -> dict:
    try:
        row = json.loads(line)
    except json.JSONDecodeError as e:
        raise BenchmarkFileError(f"{where}: not JSON ({e.msg})") from None
    if not isinstance(row, dict):
        raise BenchmarkFileError(f"{where}: an object is expected, not {type(row).__name__}")
    if missing := [f for f in required if f not in row]:
        raise BenchmarkFileError(f"{where}: fields are missing: {', '.join(missing)}")
    return row


class BenchmarkReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.uri, self.rows = options["path"], options.get("errors", "fail") == "rows"
        self.more = [f for f in options.get("required", "").split(",") if f]
        self.asked: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kind = f.attribute[0] if isinstance(f, (EqualTo, EqualNullSafe, In)) and len(f.attribute) == 1 else None
            if kind in ("dialect", "file", "id") and not self.rows:
                values = set(f.value if isinstance(f, In) else [f.value])
                self.asked[kind] = self.asked.get(kind, values) & values
            else:
                yield f

    def partitions(self) -> list[OneFile]:
        store, found = Store(self.uri), []
        number, listed = newest(store)
        shown = [(n, n) for n in store.names() if not any(p[0] in "._" for p in n.split("/"))]
        for name, path in [(f["name"], f["file"]) for f in listed] if number else shown:
            dialect = os.path.basename(name).split(".")[0].split("-")[0]
            if dialect not in DIALECTS:
                raise BenchmarkFileError(f"{name}: no dialect begins its name ({', '.join(DIALECTS)})")
            if name in self.asked.get("file", {name}) and dialect in self.asked.get("dialect", {dialect}):
                found.append(OneFile(name, path, dialect))
        return found or [OneFile("", "", "")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, (i, prompt, entry, test) = Store(self.uri), DIALECTS[partition.dialect]
        ids, out = self.asked.get("id"), []
        required = [f for f in (i, prompt, entry, test, *self.more) if f]
        with store.fs.open_input_stream(store.at(partition.path)) as raw:
            lines = io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8")  # Arrow decompresses by the name's ending
            for n, line in enumerate(lines, 1):
                if not line.strip():
                    continue
                try:
                    row = checked(line, f"{partition.name}:{n}", required)
                except BenchmarkFileError as e:
                    if not self.rows:
                        raise
                    out.append((partition.dialect, None, None, None, None, partition.name, n, str(e)))
                    continue
                if ids is None or as_text(row[i]) in ids:
                    out.append((partition.dialect, as_text(row[i]), as_text(row[prompt]), as_text(row[entry]) if entry else None, as_text(row[test]), partition.name, n, None))
                if len(out) == ROWS:
                    yield self.batch(out)
                    out = []
        if out:
            yield self.batch(out)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FIELDS)], schema=FIELDS)


class BenchmarkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BenchmarkReader:
        return BenchmarkReader(self.options)


def read_benchmarks(spark: SparkSession, path: str, required: tuple[str, ...] = (), errors: str = "fail") -> DataFrame:
    """The columns of SCHEMA. An item without an entry point of its own has the function that its test first asserts on, else the last `def` of its prompt."""
    spark.dataSource.register(BenchmarkFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    x = spark.read.format(NAME).option("required", ",".join(required)).option("errors", errors).load(path)
    called = F.nullif(F.regexp_extract("test", r"assert\s+(\w+)\s*\(", 1), F.lit(""))
    named = F.try_element_at(F.regexp_extract_all("prompt", F.lit(r"def\s+(\w+)\s*\("), F.lit(1)), F.lit(-1))
    return x.withColumn("entry_point", F.coalesce("entry_point", called, named))
