"""Registered queries over files that are written whole and read one partition a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import atomic as A
from ..sources import benchmark_files as B
from ..sources import files as IO
from .extra import DOC, DOC_SQL, _digest
from .lake import table
from .registry import _docs, query


@query("""WITH x AS (SELECT doc_id, lang || '-' || CAST(doc_id % 16 AS VARCHAR) || '.txt' AS name, CAST(doc_id AS VARCHAR) || chr(9) || md5(text) || chr(10) AS line FROM documents)
SELECT name, count(*) AS "rows", CAST(sum(strlen(line)) AS BIGINT) AS bytes, sha256(string_agg(line, '' ORDER BY doc_id)) AS sha256, true AS same FROM x GROUP BY 1""")
def s10_manifest(spark, d):
    """The manifest of a table of files (name, rows, bytes, sha256), and whether a recount of the files gives the same."""
    path = IO.scratch(spark, "manifest")
    x = _docs(spark, d).select(F.concat_ws("", "lang", F.lit("-"), (F.col("doc_id") % 16).cast("string"), F.lit(".txt")).alias("file"), F.concat_ws("\t", F.col("doc_id").cast("string"), F.md5("text")).alias("line"), "doc_id")
    A.write_lines(x.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "line"), path)
    now = A.recount(spark, path).select("file", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    m = A.manifest(spark, path).join(now, "file", "full")
    return m.select("name", "rows", "bytes", "sha256", (F.col("bytes").eqNullSafe(F.col("b")) & F.col("sha256").eqNullSafe(F.col("s"))).alias("same"))


@query(DOC_SQL)
def k2_atomic_files(spark, d):
    """A table written whole, replaced, and extended by a second writer, read by its manifest (K1, K2)."""
    path = IO.scratch(spark, "atomic")
    x = _docs(spark, d).select("doc_id", "text", "lang")
    A.write_jsonl(x.limit(3), path)
    A.write_jsonl(x.where("doc_id % 2 = 0"), path, "replace", (d,))
    A.write_jsonl(x.where("doc_id % 2 = 1"), path, "extend", (d,))
    return _digest(spark.read.schema(DOC).json(A.committed(path)))


@query("SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS run FROM events")
def k3_resume_log(spark, d):
    """A resume log: the first run fails on clicks, the second takes up what has no good row yet; each key's last good row counts."""
    path, schema = IO.scratch(spark, "log"), "event_id long, user_id long, run int, ok boolean"
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    A.write_jsonl(e.select("event_id", "user_id", F.lit(1).alias("run"), (F.col("event_type") != "click").alias("ok")), path)
    done = spark.read.schema(schema).json(A.committed(path)).where("ok")
    A.write_jsonl(IO.pending(e, done, ["event_id"]).select("event_id", "user_id", F.lit(2).alias("run"), F.lit(True).alias("ok")), path, "extend")
    return R.last_ok(spark.read.schema(schema).json(A.committed(path)), "event_id", "run", F.col("ok")).select("event_id", "user_id", "run")


@query("""WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT '| lang | n |' AS value UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || lang || ' | ' || n || ' |' FROM s""")
def k5_report(spark, d):
    """A Markdown report as one file, written whole and read back (K5)."""
    path = f"{IO.scratch(spark, 'report')}/report.md"
    A.put_text(path, IO.markdown(_docs(spark, d).groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")))
    return spark.read.text(path)


def _benchmark_files(spark, d) -> str:
    """The benchmark's items as files of two dialects, several files each."""
    path = IO.scratch(spark, "dialects")
    b = table(spark, d, "benchmark")
    name = lambda kind: F.format_string(f"{kind}-%d.jsonl", (F.col("item_id") % 5).cast("int"))
    i = F.col("item_id").cast("string")
    m = b.where("item_id % 2 = 0").select(F.col("item_id").alias("task_id"), "text", F.array(F.format_string("assert f%s(1) == 2", i), F.lit("assert true")).alias("test_list"), name("mbpp").alias("file"))
    A.write_jsonl(m, path, file="file", order=("task_id",))
    h = b.where("item_id % 2 = 1").select(F.concat(F.lit("H/"), i).alias("task_id"), F.concat(F.lit("def g(x):\n"), "text").alias("prompt"), F.lit(None).cast("string").alias("entry_point"), F.lit("check").alias("test"), name("humaneval").alias("file"))
    A.write_jsonl(h, path, "extend", file="file", order=("task_id",))
    return path


@query("""SELECT 'mbpp' AS dialect, CAST(item_id AS VARCHAR) AS id, md5(text) AS prompt, 'f' || item_id AS entry_point, 'assert f' || item_id || '(1) == 2' || chr(10) || 'assert true' AS test, 'mbpp-' || item_id % 5 || '.jsonl' AS file FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT 'humaneval', 'H/' || item_id, md5('def g(x):' || chr(10) || text), 'g', 'check', 'humaneval-' || item_id % 5 || '.jsonl' FROM benchmark WHERE item_id % 2 = 1""")
def s5_benchmark_files(spark, d):
    """Files of several dialects as one typed table, one partition a file."""
    return B.read_benchmarks(spark, _benchmark_files(spark, d)).select("dialect", "id", F.md5("prompt").alias("prompt"), "entry_point", "test", "file")


@query("SELECT 'H/' || item_id AS id, CAST(row_number() OVER (PARTITION BY item_id % 5 ORDER BY 'H/' || item_id) AS BIGINT) AS line FROM benchmark WHERE item_id % 2 = 1 QUALIFY item_id % 5 = 3 AND item_id % 3 = 0")
def s5_benchmark_filter(spark, d):
    """Filters that reach the reader: other files are not opened, other lines make no rows; what it can't take Spark filters."""
    x = B.read_benchmarks(spark, _benchmark_files(spark, d)).where("dialect = 'humaneval' AND file = 'humaneval-3.jsonl'")
    return x.where("CAST(substr(id, 3) AS LONG) % 3 = 0").select("id", "line")
