"""Files that appear whole or not at all: a data source writer with a two-phase commit, and its manifest.

Tasks write lines to files of an attempt folder, flushed and synced batch by batch, and
send back each file's rows, bytes and SHA-256. When all tasks are done, `commit` removes what
lost or repeated tasks left, renames the folder and publishes the next manifest, a file
that lists every file of the table: the table changes at that moment, whole. `abort`
marks the attempt (an empty hidden file) and removes the folder; tasks that Spark lets run
on see the mark and clear up, and the next writer of the table removes the mark and what
a task killed later has left. An existing table is refused unless it is to be replaced or extended;
so is a place inside an input tree. Two writers that finish at once do not overwrite each
other's manifest: the second extends the first's, or fails if it did not ask to.

Paths are mounted folders that all machines share (synced, published by a hard link,
which fails if the name is taken) or URIs of stores that Arrow knows (moved into place).
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME, MANIFEST = "atomic_lines", "manifest-"
ATTEMPT, ABORTED = ".attempt-", ".aborted-"
#: How often a writer that extends a table takes up the manifest of another that was faster.
TRIES = 20


class Store:
    """The files below one URI."""

    def __init__(self, uri: str) -> None:
        local = re.sub(r"^file:/+", "/", uri)
        self.local = "://" not in local
        self.fs, self.root = (pafs.LocalFileSystem(), local) if self.local else pafs.FileSystem.from_uri(uri)
        self.root = self.root.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def names(self, folder: str = "") -> list[str]:
        """Files below the folder, relative to the root."""
        found = self.fs.get_file_info(pafs.FileSelector(self.at(folder), allow_not_found=True, recursive=True))
        return sorted(x.path[len(self.root) + 1 :] for x in found if x.type == pafs.FileType.File)

    def top(self) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == pafs.FileType.File)

    def create(self, name: str):
        self.fs.create_dir(os.path.dirname(self.at(name)), recursive=True)
        return open(self.at(name), "wb") if self.local else self.fs.open_output_stream(self.at(name))

    def sync(self, handle) -> None:
        handle.flush()
        if self.local:
            os.fsync(handle.fileno())

    def sync_folder(self, folder: str) -> None:
        if self.local:
            held = os.open(self.at(folder), os.O_RDONLY)
            try:
                os.fsync(held)
            finally:
                os.close(held)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(self.at(name)) as f:
            return f.read()

    def move(self, old: str, new: str) -> None:
        self.fs.move(self.at(old), self.at(new))

    def has(self, name: str) -> bool:
        return self.fs.get_file_info(self.at(name)).type != pafs.FileType.NotFound

    def drop(self, folder: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            self.fs.delete_dir(self.at(folder))

    def publish(self, name: str, content: bytes, replace: bool = False) -> None:
        """The file whole under its name; FileExistsError if there is one already and it isn't to be replaced."""
        draft = f".{os.path.basename(name)}.{uuid.uuid4().hex}.tmp"
        draft = f"{os.path.dirname(name)}/{draft}".lstrip("/")
        try:
            with self.create(draft) as f:
                f.write(content)
                self.sync(f)
            if replace:
                self.move(draft, name)
            elif self.local:
                os.link(self.at(draft), self.at(name))
            elif self.has(name):
                raise FileExistsError(name)
            else:
                self.move(draft, name)
            self.sync_folder(os.path.dirname(name))
        finally:
            if self.has(draft):
                self.fs.delete_file(self.at(draft))


def newest(store: Store) -> tuple[int, list[dict]]:
    """The number of the last manifest (0: none) and the files that it lists."""
    names = [n for n in store.top() if n.startswith(MANIFEST)]
    return (int(names[-1][len(MANIFEST) : -5]), json.loads(store.read(names[-1]))["files"]) if names else (0, [])


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class AtomicWriter(DataSourceArrowWriter):
    def __init__(self, options, fields: list[str], overwrite: bool) -> None:
        if sorted(fields) not in (["line"], ["file", "line"]):
            raise ValueError(f"{NAME} writes the column line, and file if rows name their files; it got {fields}")
        self.uri, self.fields, self.replace, self.extend = options["path"], fields, overwrite, options.get("extend", "false").lower() == "true"
        self.attempt = uuid.uuid4().hex
        self.folder, self.marker = ATTEMPT + self.attempt, ABORTED + self.attempt
        store, own = Store(self.uri), Store(self.uri).root + "/"
        for tree in json.loads(options.get("inputs", "[]")):
            if own.startswith(Store(tree).root + "/"):
                raise ValueError(f"{self.uri} is inside the input tree {tree}")
        if newest(store)[0] and not (self.replace or self.extend):
            raise FileExistsError(f"{self.uri} is there already")
        for old in store.top():
            if old.startswith(ABORTED):
                store.drop(old.replace(ABORTED, ATTEMPT))
                store.fs.delete_file(store.at(old))

    def _stop_if_aborted(self, store: Store) -> None:
        if store.has(self.marker):
            raise RuntimeError("the write was aborted")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for the task, or one for each run of rows that name the same file."""
        store, done, handle, name = Store(self.uri), [], None, None
        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}" if task else "part-00000"
        folder = f"{self.folder}/{part}-{uuid.uuid4().hex[:8]}"

        def close() -> None:
            store.sync(handle)
            handle.close()
            done[-1]["sha256"] = done[-1]["sha256"].hexdigest()

        try:
            for batch in iterator:
                lines = batch.column(self.fields.index("line")).to_pylist()
                files = batch.column(self.fields.index("file")).to_pylist() if "file" in self.fields else [part] * len(lines)
                a = 0
                while a < len(lines):
                    z = a + 1
                    while z < len(lines) and files[z] == files[a]:
                        z += 1
                    if files[a] != name or handle is None:
                        if handle is not None:
                            close()
                        name = files[a]
                        if not name or name.startswith((".", "_", "/")) or ".." in name.split("/"):
                            raise ValueError(f"no file can have the name {name!r}")
                        self._stop_if_aborted(store)
                        handle = store.create(f"{folder}/{name}")
                        done.append({"draft": f"{folder}/{name}", "file": name, "rows": 0, "bytes": 0, "sha256": hashlib.sha256()})
                    content = "".join([f"{x or ''}\n" for x in lines[a:z]]).encode()
                    handle.write(content)
                    done[-1]["rows"] += z - a
                    done[-1]["bytes"] += len(content)
                    done[-1]["sha256"].update(content)
                    a = z
                if handle is not None:
                    store.sync(handle)
            if handle is not None:
                close()
            self._stop_if_aborted(store)
        except BaseException:
            if handle is not None:
                handle.close()
            store.drop(folder)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = Store(self.uri), self.folder
        new = [f for m in messages if m is not None for f in m.files]
        names = [f["file"] for f in new]
        try:
            if len(names) != len(set(names)):
                raise ValueError(f"rows of one file came in several tasks or runs: {sorted({n for n in names if names.count(n) > 1})[:5]}")
            kept = {f["draft"] for f in new}
            for name in store.names(folder):
                if name not in kept:
                    store.fs.delete_file(store.at(name))
            data = f"data-{self.attempt}"
            if new:
                store.move(folder, data)
            new = [{"file": f["draft"].replace(folder, data, 1), "name": f["file"], "rows": f["rows"], "bytes": f["bytes"], "sha256": f["sha256"]} for f in new]
            for k in range(TRIES):
                number, old = newest(store)
                if number and not (self.replace or self.extend):
                    raise FileExistsError(f"{self.uri} is there already")
                files = new if self.replace else old + new
                try:
                    store.publish(f"{MANIFEST}{number + 1:08d}.json", json.dumps({"files": files}, indent=1).encode())
                    break
                except FileExistsError:
                    if k == TRIES - 1:
                        raise
        except BaseException:
            store.drop(folder)
            store.drop(f"data-{self.attempt}")
            raise
        store.drop(folder)
        if self.replace:
            for gone in {f["file"].split("/")[0] for f in old}:
                store.drop(gone)

    def abort(self, messages: list[Written | None]) -> None:
        store = Store(self.uri)
        if not messages or None in messages:  # a task without a message may be at work still
            store.publish(self.marker, b"")
        store.drop(self.folder)


class AtomicLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite: bool) -> AtomicWriter:
        return AtomicWriter(self.options, schema.names, overwrite)


MANIFEST_SCHEMA = "files array<struct<file: string, name: string, rows: long, bytes: long, sha256: string>>"


def write_lines(df: DataFrame, path: str, mode: str = "new", inputs: tuple[str, ...] = ()) -> None:
    """Write the column `line` (and `file`: rows of a file lie together in one partition). mode: new, replace or extend."""
    df.sparkSession.dataSource.register(AtomicLines)
    w = df.write.format(NAME).option("inputs", json.dumps(list(inputs))).option("extend", mode == "extend")
    w.mode("overwrite" if mode == "replace" else "append").save(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "new", inputs: tuple[str, ...] = (), file: str | None = None, order: tuple[str, ...] = ()) -> None:
    """Rows as JSON lines, nulls written out. file: the column that names each row's file (not written); order: how rows lie in a file."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != file]), {"ignoreNullFields": "false"}).alias("line")
    if file is None:
        write_lines(df.select(line), path, mode, inputs)
    else:
        write_lines(df.repartition(file).sortWithinPartitions(file, *order).select(F.col(file).alias("file"), line), path, mode, inputs)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, name, rows, bytes, sha256 of every file of the table; no table: no rows."""
    number, _ = newest(Store(path))
    if not number:
        return spark.createDataFrame([], "file string, name string, rows long, bytes long, sha256 string")
    x = spark.read.schema(MANIFEST_SCHEMA).json(f"{path.rstrip('/')}/{MANIFEST}{number:08d}.json", multiLine=True)
    return x.select(F.inline("files"))


def recount(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 as the files are now: what a manifest must equal."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path.rstrip('/')}/data-*")
    return x.select(F.regexp_extract("path", r"(data-[0-9a-f]{32}/.*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def committed(path: str) -> list[str]:
    """Paths of the files of the table (one each task that wrote), for Spark's readers."""
    return [f"{path.rstrip('/')}/{f['file']}" for f in newest(Store(path))[1]]


def put_text(path: str, text: str, replace: bool = False) -> None:
    """A small file whole: a report or a status."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    Store(folder).publish(name, text.encode(), replace)
