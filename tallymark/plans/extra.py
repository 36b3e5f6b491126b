"""More registered queries: files, programs in text, keyed detectors, joins, summaries, reports and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import scalar as S
from ..operators import detection as D
from ..operators import keyed as K
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import scans as N
from ..operators import rewrite as W
from ..sources import files as IO
from .lake import GEN_SQL, OBF_SQL, POS_SQL, gen, green_sql, obf, table, tail_sql
from .registry import COHORT_SQL, WINDOW_SQL, _docs, _patches, _r, _toks, query

# --- sources and sinks ----------------------------------------------------------------------

DOC = "doc_id long, text string, lang string"
DOC_SQL = "SELECT doc_id, lang, md5(text) AS h FROM documents"


def _digest(df):
    return df.select("doc_id", "lang", F.md5("text").alias("h"))


@query(DOC_SQL)
def s1_jsonl(spark, d):
    """Documents written as JSON lines and read back with their types."""
    path = IO.scratch(spark, "jsonl")
    IO.write_jsonl(_docs(spark, d).select("doc_id", "text", "lang"), path)
    return _digest(IO.read_jsonl(spark, path, DOC))


@query(DOC_SQL)
def s2_jsonl_gzip(spark, d):
    path = IO.scratch(spark, "jsonl-gz")
    IO.write_jsonl(_docs(spark, d).select("doc_id", "text", "lang"), path, gzip=True)
    return _digest(IO.read_jsonl(spark, path, DOC))


@query("SELECT CAST(doc_id % 7 AS INTEGER) AS config, count(*) AS n FROM documents GROUP BY 1")
def s3_discovery(spark, d):
    """Rows by numeric configuration folder; a backup folder and one without a number are not read."""
    path = IO.scratch(spark, "tree")
    x = _docs(spark, d).select("doc_id", (F.col("doc_id") % 7).cast("string").alias("config"))
    x.repartition("config").write.partitionBy("config").json(path)
    x.where("config = '0'").drop("config").write.json(f"{path}/config=backup")
    x.where("config = '0'").drop("config").write.json(f"{path}/config=x1")
    rows = spark.read.schema("doc_id long").option("recursiveFileLookup", True).json(path).select("doc_id", F.col("_metadata.file_path").alias("path"))
    return IO.partitions(rows).groupBy("config").agg(F.count("*").alias("n"))


@query("SELECT item_id, md5(text) AS h FROM benchmark")
def s4_json_files(spark, d):
    """One JSON value a file."""
    path = IO.scratch(spark, "cases")
    b = table(spark, d, "benchmark").select("item_id", "text")
    b.withColumn("k", F.col("item_id")).repartition("k").write.partitionBy("k").json(path)
    return IO.read_json_files(spark, path, "item_id long, text string").select("item_id", F.md5("text").alias("h"))


@query("SELECT CAST(item_id AS VARCHAR) AS id, length(text)::BIGINT AS n, 'f' || item_id AS entry_point FROM benchmark")
def s5_benchmark_dialect(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), "text", F.array(F.format_string("assert f%s(1) == 2", F.col("item_id").cast("string"))).alias("test_list"))
    return IO.benchmark(b, "mbpp").select("id", F.length("prompt").cast("long").alias("n"), "entry_point")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def s9_cached_step(spark, d):
    """A step's table: made on the first use, reread on the second."""
    path = IO.scratch(spark, "step")
    make = lambda: _docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))
    IO.cached_step(spark, path, make)
    return IO.cached_step(spark, path, make)


@query("SELECT doc_id, lang, n_chars FROM documents")
def k4_scalar_csv(spark, d):
    path = IO.scratch(spark, "csv")
    IO.write_csv(_docs(spark, d).select("doc_id", "lang", "n_chars", F.split("text", " ").alias("words")), path)
    return spark.read.schema("doc_id long, lang string, n_chars long").csv(path, header=True, escape='"', enforceSchema=False)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k7_pending(spark, d):
    return IO.pending(_docs(spark, d).select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT event_id, user_id, value > 100 AS flag FROM events")
def k3_incremental(spark, d):
    """Rows that arrive in two drops, each scored once by the incremental run (K3, streaming)."""
    from ..streaming.incremental import run_new

    src, sink, state = (IO.scratch(spark, n) for n in ("drops", "scored", "state"))
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    for part in (0, 1):
        IO.append_log(e.where(F.col("event_id") % 2 == part), src)
        run_new(spark, src, "event_id long, user_id long, value double", lambda x: x.select("event_id", "user_id", (F.col("value") > 100).alias("flag")), sink, state)
    return spark.read.parquet(sink)


# --- projections ----------------------------------------------------------------------------

GRID_SQL = """s AS (SELECT * FROM (VALUES ('wllm', 1.0::DOUBLE, 0.25::DOUBLE), ('wllm', 2.0, 0.5), ('sweet', 1.0, 0.25), ('sweet', 2.0, 0.5)) s(scheme, delta, gamma)),
c AS (SELECT *, row_number() OVER (ORDER BY scheme, delta, gamma) - 1 AS k FROM s)"""


def _grid(spark):
    v = lambda name, xs: spark.createDataFrame([(x,) for x in xs], name)
    x = v("scheme string", ["wllm", "sweet"]).crossJoin(spark.createDataFrame([(1.0, 0.25), (2.0, 0.5)], "delta double, gamma double"))
    return x.withColumn("k", F.row_number().over(Window.orderBy("scheme", "delta", "gamma")) - 1)


TASKS_SQL = f"WITH {GRID_SQL} SELECT 'm' || '-' || scheme || '-' || lpad(CAST(k AS VARCHAR), 3, '0') || '-' || item_id AS id, scheme, delta, gamma, item_id FROM c, benchmark"


def _tasks(spark, d):
    """A task for each configuration and item; the grid is a constant of four rows."""
    x = table(spark, d, "benchmark").select("item_id").crossJoin(F.broadcast(_grid(spark)))
    return x.select(F.concat_ws("-", F.lit("m"), "scheme", F.format_string("%03d", "k"), F.col("item_id").cast("string")).alias("id"), "scheme", "delta", "gamma", "item_id")


@query(TASKS_SQL)
def p2_task_grid(spark, d):
    """Parameter grid (P1) times items, with ids."""
    return _tasks(spark, d)


@query(f"SELECT id, count(*) AS n FROM (SELECT id FROM ({TASKS_SQL}) UNION ALL SELECT id FROM ({TASKS_SQL}) WHERE scheme = 'sweet' AND item_id % 5 = 0) GROUP BY 1 HAVING count(*) > 1")
def p3_repeated_ids(spark, d):
    """The ids that break uniqueness where a run's tasks (a fifth of one scheme's) are listed once more."""
    x = _tasks(spark, d)
    return R.repeated(x.unionAll(x.where("scheme = 'sweet' AND item_id % 5 = 0")), ["id"])


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS shown FROM documents")
def p4_display_names(spark, d):
    names = F.create_map(F.lit("en"), F.lit("English"), F.lit("fr"), F.lit("French"))
    return _docs(spark, d).select("doc_id", F.coalesce(names[F.col("lang")], F.col("lang")).alias("shown"))


@query("SELECT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS suffix, count(*) AS n FROM documents WHERE regexp_matches(source, '^src[0-9]+$') GROUP BY 1, 2")
def p5_numeric_suffix(spark, d):
    x = _docs(spark, d).where(F.col("source").rlike("^src[0-9]+$"))
    return x.groupBy("source", F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("suffix")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) FILTER (isfinite(x)) AS n FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE value END AS x FROM events) GROUP BY 1")
def p6_finite(spark, d):
    k = F.col("event_id") % 4
    x = table(spark, d, "events").select("event_type", F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 3, F.col("value")).alias("x"))
    return x.groupBy("event_type").agg(F.count_if(S.finite(F.col("x"))).alias("n"))


@query(f"SELECT doc_id, z FROM ({WINDOW_SQL}) WHERE NOT invalid AND z IS NOT NULL")
def p7_valid_detection(spark, d):
    x = D.scored(_toks(spark, d), D.green_mask(F.col("t"), 3))
    return x.where("NOT invalid AND z IS NOT NULL").select("doc_id", _r(F.col("z"), "z"))


CONFIG_SQL = f"{GEN_SQL}, m AS (SELECT config, task, count(*) FILTER (passed) * 1.0::DOUBLE / count(*) AS pass1, avg(1 - {tail_sql('z')}) AS auroc FROM gen GROUP BY 1, 2), b AS (SELECT config, pass1 AS base FROM m WHERE task = 'src0')"


def _configs(spark, d):
    m = gen(spark, d).groupBy("config", "task").agg((F.count_if("passed") / F.count("*")).alias("pass1"), M.ideal_auroc(F.col("z")).alias("auroc"))
    return m, m.where("task = 'src0'").select("config", F.col("pass1").alias("base"))


@query(f"WITH {CONFIG_SQL} SELECT m.config, m.task, round(auroc, 6) AS auroc FROM m JOIN b ON m.config = b.config WHERE auroc > 0.8 AND pass1 > 0.8 * base")
def p8_useful_configs(spark, d):
    """Configurations that detect well at little loss against the baseline (P8; strictly over both limits)."""
    m, b = _configs(spark, d)
    return m.join(b, "config").where("auroc > 0.8D AND pass1 > 0.8D * base").select("config", "task", _r(F.col("auroc"), "auroc"))


def _cut_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '\\n[^\\t#\\n ]') THEN regexp_replace(regexp_extract({x}, '(?s)^(.*?)\\n[^\\t#\\n ]', 1), '\\s+$', '') ELSE {x} END"


@query(f"""WITH g AS (SELECT doc_id, doc_id % 2 = 0 AS chat, regexp_replace(text, '\\s+$', '') AS own, strpos(regexp_replace(text, '\\s+$', ''), 'de') AS place FROM documents),
r AS (SELECT *, substr(own, place + 1) AS rest FROM g)
SELECT doc_id, md5(CASE WHEN NOT chat THEN 'def f():' || chr(10) || ({_cut_sql('own')}) WHEN place > 0 AND regexp_matches(rest, '\\n[^\\t#\\n ]') THEN regexp_replace(substr(own, 1, place) || regexp_extract(rest, '(?s)^(.*?)\\n[^\\t#\\n ]', 1), '\\s+$', '') ELSE own END) AS h FROM r""")
def p11_solutions(spark, d):
    """Python programs: base completions of a prompt, and chat replies with a closing fence and the entry point `de`."""
    x = _docs(spark, d).withColumn("chat", F.col("doc_id") % 2 == 0)
    x = x.withColumn("t", F.when(F.col("chat"), F.concat(C.stripped(F.col("text")), F.lit("\n```\nthat is all"))).otherwise(F.col("text")))
    return x.select("doc_id", F.md5(C.solution(F.col("t"), F.lit("def f():\n"), F.lit("py"), F.col("chat"), F.lit("de"))).alias("h"))


@query("""WITH g AS (SELECT doc_id, regexp_replace(replace(replace(text, ',', '{'), '.', '}'), '\\s+$', '') AS g FROM documents),
c AS (SELECT doc_id, unnest(string_split(g, '')) AS c, generate_subscripts(string_split(g, ''), 1) AS i FROM g),
b AS (SELECT doc_id, i, 1 + sum(CASE c WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS debt FROM c WHERE c IN ('{', '}')),
e AS (SELECT doc_id, min(i) AS i FROM b WHERE debt = 0 GROUP BY 1)
SELECT g.doc_id, length('function f() {' || regexp_replace(CASE WHEN i IS NULL THEN g ELSE substr(g, 1, i) END, '\\s+$', '')) AS n FROM g LEFT JOIN e ON g.doc_id = e.doc_id""")
def p11_brace_solutions(spark, d):
    """Completions of a prompt that leaves one brace open; commas open and full stops close one."""
    t = F.translate("text", ",.", "{}")
    return _docs(spark, d).select("doc_id", F.length(C.solution(t, F.lit("function f() {"), F.lit("js"), F.lit(False), F.lit("f"))).cast("long").alias("n"))


@query()
def p12_brace_cut(spark, d):
    return _docs(spark, d).select("doc_id", F.length(C.brace_cut(F.concat(F.lit("f() {"), "text", F.lit("} rest")))).alias("n"))


@query("SELECT doc_id, md5(CASE WHEN strpos(text, '. ') > 0 THEN substr(text, strpos(text, '. ') + 2) END) AS h FROM documents")
def p13_suffix(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(C.after_first(F.col("text"), ". ")).alias("h"))


@query("SELECT doc_id, md5('Complete the following ' || lang || ' program. Answer with code only.' || chr(10) || '```' || lang || chr(10) || text || chr(10) || '```') AS h FROM documents WHERE lang IS NOT NULL")
def p14_chat_prompt(spark, d):
    return _docs(spark, d).where("lang IS NOT NULL").select("doc_id", F.md5(C.chat_prompt(F.col("text"), F.col("lang"))).alias("h"))


@query("SELECT doc_id, 'py' AS language, md5(replace(text, '`', '')) AS h FROM documents")
def p15_fenced_block(spark, d):
    t = F.concat(F.lit("So:\n```Py\n"), F.replace("text", F.lit("`"), F.lit("")), F.lit("``` and ```js\nx```"))
    return _docs(spark, d).select("doc_id", C.fence(t).alias("f")).select("doc_id", "f.language", F.md5("f.code").alias("h"))


@query("SELECT doc_id, 'a' || doc_id % 5 || '.py' AS path FROM documents")
def p17_diff_paths(spark, d):
    n = (F.col("doc_id") % 5).cast("string")
    patch = F.concat(F.lit("--- a/x\n+++ b/a"), n, F.lit(".py\n+++ b/y.js\n+++ /dev/null\n+++ b/a"), n, F.lit(".py\n"))
    return _docs(spark, d).select("doc_id", F.explode(C.diff_paths(patch, ".py")).alias("path"))


@query("SELECT item_id, md5(list_reduce(list_prepend(text || ' short', list_filter(string_split(replace(text, '. ', chr(10)), chr(10)), lambda x: length(x) > 20)), lambda a, x: replace(a, x, ''))) AS h FROM benchmark")
def p21_without_solution(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.md5(C.without_long_lines(F.concat("text", F.lit(" short")), F.replace("text", F.lit(". "), F.lit("\n")))).alias("h"))


@query("SELECT lang, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY r)) AS prompt FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY sha256(lang || chr(0) || CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 3 GROUP BY 1")
def p22_few_shot(spark, d):
    """Three examples of each language in hashed order."""
    x = R.hashed_sample(_docs(spark, d), ["lang"], "doc_id", 3)
    order = F.sha2(F.concat_ws("\0", "lang", F.col("doc_id").cast("string")), 256)
    x = x.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "text"))).alias("s"))  # three at most
    return x.select("lang", F.md5(F.array_join("s.text", "\n---\n")).alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'resolved' WHEN doc_id % 7 IN (1, 2) THEN 'unresolved' WHEN doc_id % 7 = 3 THEN 'empty_patch' WHEN doc_id % 7 = 4 THEN 'error' WHEN doc_id % 7 = 5 THEN 'incomplete' ELSE 'unknown' END AS outcome FROM documents")
def p23_outcome(spark, d):
    """An id may stand in several of a report's lists; the first list counts."""
    ids = lambda *xs: F.array(*[F.lit(x).cast("long") for x in xs])
    lists = {"resolved": ids(0), "unresolved": ids(0, 1, 2), "empty_patch": ids(2, 3), "error": ids(3, 4), "incomplete": ids(0, 4, 5)}
    return _docs(spark, d).select("doc_id", S.outcome(F.col("doc_id") % 7, lists).alias("outcome"))


@query(f"WITH {GEN_SQL} SELECT id, CASE WHEN passed AND toxic THEN 'preserved' WHEN passed AND NOT toxic THEN 'regression' WHEN NOT passed AND toxic THEN 'improved' WHEN NOT passed AND NOT toxic THEN 'baseline_failed' END AS label FROM gen")
def p24_test_label(spark, d):
    return gen(spark, d).select("id", C.test_label(F.col("passed"), F.col("toxic")).alias("label"))


@query()
def p26_digest_seed(spark, d):
    return _docs(spark, d).select("doc_id", C.sha3_seed(F.col("doc_id").cast("string")).alias("seed"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey // 2 AS VARCHAR) ELSE (n_nationkey // 2) || '.5' END AS shown FROM nation")
def p27_short_numbers(spark, d):
    return table(spark, d, "nation").select("n_nationkey", C.short_number(F.col("n_nationkey") / 2.0).alias("shown"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM documents")
def p28_flags(spark, d):
    t = F.element_at(F.array(*[F.lit(x) for x in (" TRUE", "no", "maybe", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", S.to_flag(t).alias("flag"))


# --- detection ------------------------------------------------------------------------------


@query()
def d14_pair_green(spark, d):
    """One of each two neighbours by logit is green."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", K.pair_token_green(F.col("embedding"), (F.col("vec_id") % 8).cast("int"), F.col("vec_id")).alias("green"))


@query(f"WITH {POS_SQL} SELECT doc_id, i - 1 AS pos, {green_sql('t[i-1]', 't[i]')} AS green FROM pos WHERE i >= 2 UNION ALL SELECT doc_id, 0, false FROM tok WHERE len(t) >= 1")
def d21_token_colours(spark, d):
    """A mask padded on the left with false to one flag a token."""
    x = _toks(spark, d).withColumn("m", D.green_mask(F.col("t"), 2))
    pad = F.array_repeat(F.lit(False), F.size("t") - F.size("m"))
    return x.select("doc_id", F.posexplode(F.concat(pad, "m")).alias("pos", "green")).withColumn("pos", F.col("pos").cast("long"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents) SELECT doc_id, CAST(coalesce(list_position(t, 'the'), len(t) + 1) - 1 AS BIGINT) AS n FROM t")
def d23_trim(spark, d):
    """Tokens before the first stop token."""
    at = F.array_position("t", "the")
    return _toks(spark, d).select("doc_id", F.when(at > 0, at - 1).otherwise(F.size("t")).cast("long").alias("n"))


@query(f"WITH {POS_SQL}, s AS (SELECT doc_id, count(*) AS n_scored, count(*) FILTER ({green_sql('t[i-1]', 't[i]')}) AS n_green FROM pos WHERE i >= 2 GROUP BY 1) SELECT k.doc_id, coalesce(n_scored, 0) AS n_scored, coalesce(n_green, 0) AS n_green FROM tok k LEFT JOIN s ON k.doc_id = s.doc_id")
def d25_patch_detection(spark, d):
    """The window score of what a patch adds, without a prefix."""
    lines = _patches(spark, d).select("doc_id", D.tokens(F.array_join(R.added(F.col("patch")), "\n")).alias("t"))
    x = D.scored(lines, D.green_mask(F.col("t"), 2))
    return x.select("doc_id", F.col("n_scored").cast("long").alias("n_scored"), F.col("n_green").cast("long").alias("n_green"))


_VARIANTS_SQL = "v AS (SELECT doc_id, 'whole' AS variant, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents UNION ALL SELECT doc_id, 'no_e', regexp_extract_all(replace(lower(text), 'e', ''), '[a-z]+') FROM documents)"


@query(f"WITH {_VARIANTS_SQL}, p AS (SELECT doc_id, variant, unnest(range(2, len(t) + 1)) AS i, t FROM v) SELECT doc_id, variant, count(*) AS n_scored, count(*) FILTER ({green_sql('t[i-1]', 't[i]')}) AS n_green FROM p GROUP BY 1, 2")
def d26_variants(spark, d):
    """Several variants of a document under one detector."""
    v = F.explode(F.array(F.struct(F.lit("whole").alias("variant"), F.lower("text").alias("s")), F.struct(F.lit("no_e").alias("variant"), F.replace(F.lower("text"), F.lit("e"), F.lit("")).alias("s"))))
    x = _docs(spark, d).select("doc_id", v.alias("v")).select("doc_id", "v.variant", D.tokens(F.col("v.s")).alias("t"))
    return D.scored(x, D.green_mask(F.col("t"), 2)).where("n_scored > 0").select("doc_id", "variant", F.col("n_scored").cast("long").alias("n_scored"), F.col("n_green").cast("long").alias("n_green"))


# --- joins and sets -------------------------------------------------------------------------


@query(f"WITH {OBF_SQL} SELECT id, max(z2) FILTER (obf = 'minify') AS minify, max(z2) FILTER (obf = 'rename') AS rename, max(z2) FILTER (obf = 'strip') AS strip FROM obf GROUP BY 1")
def j6_wide(spark, d):
    return obf(spark, d).groupBy("id").pivot("obf", ["minify", "rename", "strip"]).agg(F.max("z2"))


@query("""WITH b AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 3 > 0)
SELECT d.doc_id, d.n_chars <> b.n_chars AS n_chars_differs, d.text <> b.text AS text_differs, d.lang IS DISTINCT FROM b.lang AS lang_differs, d.source IS DISTINCT FROM b.source AS source_differs
FROM documents d JOIN b ON d.doc_id = b.doc_id WHERE d.n_chars <> b.n_chars OR d.text <> b.text OR d.lang IS DISTINCT FROM b.lang OR d.source IS DISTINCT FROM b.source""")
def j8_field_mismatch(spark, d):
    """Rows of a second copy of the table (some are missing, some changed) of which one of four fields differs, and which."""
    a, fields = _docs(spark, d), ("n_chars", "text", "lang", "source")
    b = a.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"), F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), "lang", "source")
    x = a.alias("a").join(b.alias("b"), "doc_id").select("doc_id", *[(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"{f}_differs") for f in fields])
    return x.where(" OR ".join(f"{f}_differs" for f in fields))


@query("SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def j9_membership(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality").join(_docs(spark, d).where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")


@query("SELECT text_md5, doc_id FROM (SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY 1)")
def j12_first_match(spark, d):
    """The first document of each text."""
    return _docs(spark, d).groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH {GEN_SQL} SELECT config, z FROM gen WHERE task = 'src0' UNION ALL SELECT config, z FROM gen WHERE task = 'src1' AND config IN (SELECT config FROM gen WHERE task = 'src0')")
def j4_scheme_union(spark, d):
    g = gen(spark, d)
    a = g.where("task = 'src0'").select("config", "z")
    return a.unionByName(g.where("task = 'src1'").select("config", "z").join(a.select("config").distinct(), "config", "left_semi"))


@query("SELECT doc_id, CAST('0x' || substr(md5('42|' || doc_id), 1, 4) AS INTEGER) < 52428 AS train FROM documents")
def u4_split(spark, d):
    """A split by hashed id: the same rows on any cluster."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("int")
    return _docs(spark, d).select("doc_id", (h < 52428).alias("train"))


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE lang = 'en' UNION ALL SELECT source FROM documents WHERE lang = 'fr' AND CAST('0x' || substr(md5('7|' || doc_id), 1, 4) AS INTEGER) < 32768) GROUP BY 1")
def u3_weighted_union(spark, d):
    """All of one set and a hashed half of another."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("int")
    x = _docs(spark, d)
    return x.where("lang = 'en'").select("source").unionByName(x.where((F.col("lang") == "fr") & (h < 32768)).select("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT source FROM documents WHERE lang = 'en' INTERSECT ALL SELECT source FROM documents WHERE lang = 'fr'")
def u5_multiset_intersection(spark, d):
    x = _docs(spark, d)
    return x.where("lang = 'en'").select("source").intersectAll(x.where("lang = 'fr'").select("source"))


# --- aggregates -----------------------------------------------------------------------------

COUNTS_SQL = f"{GEN_SQL}, n AS (SELECT config, task, count(*) AS n, count(*) FILTER (passed) AS c FROM gen WHERE passed IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {COUNTS_SQL} SELECT config, round(avg(c * 1.0::DOUBLE / n), 6) AS pass_1, round(avg(CASE WHEN n >= 5 THEN CASE WHEN c = 0 THEN 0 WHEN n - c < 5 THEN 1 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 5.0::DOUBLE / i)) END END), 6) AS pass_5 FROM n GROUP BY 1")
def a8_mean_pass(spark, d):
    n = gen(spark, d).where("passed IS NOT NULL").groupBy("config", "task").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))
    p = lambda k: _r(F.avg(F.when(F.col("n") >= k, S.pass_at_k(F.col("n"), F.col("c"), k))), f"pass_{k}")
    return n.groupBy("config").agg(p(1), p(5))


@query(f"WITH {OBF_SQL}, f AS (SELECT o.*, g.z AS z1 FROM obf o JOIN gen g ON o.id = g.id) SELECT obf, count(*) FILTER (solution IS NOT NULL) AS transformed, count(*) FILTER (solution IS NULL) AS failed, round(avg(z2 - z1) FILTER (solution IS NOT NULL), 6) AS mean_change, count(*) FILTER (solution IS NOT NULL AND z2 > 4) * 1.0::DOUBLE / count(*) FILTER (solution IS NOT NULL AND z1 > 4) AS retained FROM f GROUP BY 1")
def a14_transform_summary(spark, d):
    """Status counts, and detection before and after over the transformed rows only."""
    x = obf(spark, d).join(gen(spark, d).select("id", F.col("z").alias("z1")), "id")
    ok = F.col("solution").isNotNull()
    return x.groupBy("obf").agg(F.count_if(ok).alias("transformed"), F.count_if(~ok).alias("failed"), _r(F.avg(F.when(ok, F.col("z2") - F.col("z1"))), "mean_change"), F.try_divide(F.count_if(ok & (F.col("z2") > 4)), F.count_if(ok & (F.col("z1") > 4))).alias("retained"))


@query(f"WITH {OBF_SQL} SELECT o.config, o.obf, count(*) AS n, count(*) FILTER (o.z2 > 4) * 1.0::DOUBLE / count(*) AS detection_rate, count(*) FILTER (o.passed AND g.toxic) * 1.0::DOUBLE / nullif(count(*) FILTER (o.passed), 0) AS preserved_given_pass, round(avg(1 - {tail_sql('o.z2')}), 6) AS auroc FROM obf o JOIN gen g ON o.id = g.id GROUP BY 1, 2")
def a15_config_row(spark, d):
    x = obf(spark, d).join(gen(spark, d).select("id", "toxic"), "id")
    return x.groupBy("config", "obf").agg(F.count("*").alias("n"), (F.count_if(F.col("z2") > 4) / F.count("*")).alias("detection_rate"), F.try_divide(F.count_if(F.col("passed") & F.col("toxic")), F.count_if("passed")).alias("preserved_given_pass"), _r(M.ideal_auroc(F.col("z2")), "auroc"))


@query(f"WITH {OBF_SQL}, t AS (SELECT id, z FROM gen ORDER BY z DESC, id LIMIT 20) SELECT o.obf, round(avg(t.z), 6) AS old_mean, round(avg(o.z2), 6) AS new_mean, round(median(o.z2), 6) AS new_median, round(min(o.z2), 6) AS new_min, round(max(o.z2), 6) AS new_max, count(*) FILTER (o.z2 > 4) AS still FROM t JOIN obf o ON t.id = o.id GROUP BY 1")
def a17_high_z(spark, d):
    """What the variants do to the twenty highest scores."""
    t = F.broadcast(R.top_k(gen(spark, d).select("id", "z"), 20, F.desc("z"), F.asc("id")).select("id", "z"))  # twenty rows
    z2, x = F.col("z2"), IO.kept(obf(spark, d).join(t, "id").select("obf", "z", "z2"), "high-z")
    g = x.groupBy("obf").agg(_r(F.avg("z"), "old_mean"), _r(F.avg(z2), "new_mean"), _r(F.min(z2), "new_min"), _r(F.max(z2), "new_max"), F.count_if(z2 > 4).alias("still"))
    return N.with_quantiles(g, x, ["obf"], {"new_median": ("z2", 0.5)}).withColumn("new_median", F.round("new_median", 6))


@query(f"WITH {POS_SQL}, e AS (SELECT lang, CAST('0x' || substr(md5(t[i]), 1, 1) AS INTEGER) / 4.0 AS e FROM pos), s AS (SELECT lang, round(avg(e), 6) AS entropy FROM e GROUP BY 1), w AS (SELECT lang, round(avg(len(t)), 6) AS mean_len, round(avg(CASE WHEN len(t) > 0 THEN greatest(len(t) - 1, 0) * 1.0::DOUBLE / len(t) END), 6) AS fraction FROM tok GROUP BY 1) SELECT w.lang, entropy, mean_len, fraction FROM w LEFT JOIN s ON w.lang IS NOT DISTINCT FROM s.lang")
def a18_harness_summary(spark, d):
    """Entropy over all tokens (not over rows), length, and scored fractions without the rows of length 0."""
    n = F.size("t")
    e = F.aggregate("t", F.lit(0.0), lambda a, x: a + F.conv(F.substring(F.md5(x), 1, 1), 16, 10).cast("double") / 4)
    x = _toks(spark, d).select("lang", n.alias("n"), e.alias("e"))
    return x.groupBy("lang").agg(_r(F.try_divide(F.sum("e"), F.sum("n")), "entropy"), _r(F.avg("n"), "mean_len"), _r(F.avg(F.when(F.col("n") > 0, (F.col("n") - 1) / F.col("n"))), "fraction"))


@query(f"WITH {GEN_SQL}, s AS (SELECT config, -round({tail_sql('z')}, 9) AS s, passed FROM gen WHERE passed IS NOT NULL) SELECT a.config, round(avg(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5 ELSE 0 END), 6) AS auroc FROM s a JOIN s b ON a.config = b.config WHERE a.passed AND NOT b.passed GROUP BY 1")
def a19_p_value_auroc(spark, d):
    """AUROC of p-values: the smaller, the more positive."""
    x = gen(spark, d).where("passed IS NOT NULL").withColumn("s", -F.round(S.upper_tail(F.col("z")), 9))
    return M.auroc(x, ["config"], "s", "passed").where("auroc IS NOT NULL").select("config", _r(F.col("auroc"), "auroc"))


@query(f"WITH {CONFIG_SQL} SELECT task, metric, round(value, 6) AS observed, target, round(100 * (value - target), 4) AS points FROM (SELECT task, 'pass1' AS metric, pass1 AS value FROM m WHERE config = 'en' UNION ALL SELECT task, 'auroc', auroc FROM m WHERE config = 'en') JOIN (VALUES ('pass1', 0.6413::DOUBLE), ('auroc', 0.9338)) t(name, target) ON metric = name")
def a21_targets(spark, d):
    """Observed metrics against published targets, in percentage points."""
    t = spark.createDataFrame([("pass1", 0.6413), ("auroc", 0.9338)], "metric string, target double")
    m = _configs(spark, d)[0].where("config = 'en'").unpivot("task", ["pass1", "auroc"], "metric", "value")
    return m.join(F.broadcast(t), "metric").select("task", "metric", _r(F.col("value"), "observed"), "target", _r(100 * (F.col("value") - F.col("target")), "points", 4))


@query(f"WITH {CONFIG_SQL} SELECT m.config, m.task, round(m.pass1 - b.pass1, 6) AS pass1, round(m.auroc - b.auroc, 6) AS auroc FROM m JOIN (SELECT * FROM m WHERE task = 'src0') b ON m.config = b.config")
def a22_metric_difference(spark, d):
    m = _configs(spark, d)[0]
    b = m.where("task = 'src0'").select("config", F.col("pass1").alias("p0"), F.col("auroc").alias("a0"))
    return m.join(b, "config").select("config", "task", _r(F.col("pass1") - F.col("p0"), "pass1"), _r(F.col("auroc") - F.col("a0"), "auroc"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'incomplete' WHEN quality = 1 THEN 'resolved' ELSE 'unresolved' END AS state, count(*) AS n FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id GROUP BY 1")
def a25_report_union(spark, d):
    """The union of the reports' ids against the selection; whoever is in none is incomplete."""
    rep = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    x = _docs(spark, d).select("doc_id").join(rep, "doc_id", "left")
    state = F.when(F.col("q") == 1, "resolved").when(F.col("q").isNotNull(), "unresolved").otherwise("incomplete")
    return x.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def _mteval_sql(x: str) -> str:
    for old, new in M.MTEVAL_JOIN:
        quoted = "chr(10)" if old == "\n" else "'-' || chr(10)" if old == "-\n" else f"'{old}'"
        x = f"replace({x}, {quoted}, '{new}')"
    x = f"lower(' ' || {x} || ' ')"
    for pattern, new in M.MTEVAL_SPLIT:
        x = f"regexp_replace({x}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


BLEU_SQL = f"""WITH t AS (SELECT item_id, {_mteval_sql("replace(replace(text, ' de ', ' la '), ' the ', ' of ')")} AS c, {_mteval_sql("text")} AS r FROM benchmark),
v AS (SELECT unnest([1, 2, 3, 4]) AS n), a AS (SELECT item_id, n, g, count(*) AS a FROM (SELECT item_id, n, array_to_string(c[i:i+n-1], ' ') AS g FROM (SELECT item_id, n, c, unnest(range(1, len(c) - n + 2)) AS i FROM t, v)) GROUP BY 1, 2, 3),
b AS (SELECT item_id, n, g, count(*) AS b FROM (SELECT item_id, n, array_to_string(r[i:i+n-1], ' ') AS g FROM (SELECT item_id, n, r, unnest(range(1, len(r) - n + 2)) AS i FROM t, v)) GROUP BY 1, 2, 3),
h AS (SELECT a.item_id, a.n, sum(least(a, coalesce(b, 0))) AS hit FROM a LEFT JOIN b ON a.item_id = b.item_id AND a.n = b.n AND a.g = b.g GROUP BY 1, 2),
p AS (SELECT t.item_id, v.n, len(c) AS c, len(r) AS r, coalesce(hit, 0) AS hit, greatest(len(c) - v.n + 1, 0) AS guess FROM t CROSS JOIN v LEFT JOIN h ON t.item_id = h.item_id AND v.n = h.n)"""
_ITEM_BLEU = "SELECT item_id, exp(sum(ln(hit + CASE n WHEN 1 THEN 0 ELSE 1 END + 2.2250738585072014e-308) - ln(guess + CASE n WHEN 1 THEN 0 ELSE 1 END + 2.2250738585072014e-308)) / 4 + least(0, 1 - (max(r) + 1) / (max(c) + 1))) AS bleu FROM p GROUP BY 1"


def _bleu_pair(spark, d):
    b = table(spark, d, "benchmark")
    own = F.replace(F.replace("text", F.lit(" de "), F.lit(" la ")), F.lit(" the "), F.lit(" of "))
    return b, M.mteval_words(own), F.array(M.mteval_words(F.col("text")))


@query(f"{BLEU_SQL}, i AS ({_ITEM_BLEU}) SELECT item_id, round(100 * bleu, 6) AS bleu FROM i")
def a27_bleu(spark, d):
    """Smoothed BLEU-4 of each item's text with some words changed against the text, after the mteval normalisation."""
    return M.bleu(*_bleu_pair(spark, d)[:1], ["item_id"], *_bleu_pair(spark, d)[1:]).select("item_id", F.round(100 * F.col("bleu"), 6).alias("bleu"))


@query(f"{BLEU_SQL}, s AS (SELECT item_id % 3 AS part, n, sum(hit) AS hit, sum(guess) AS guess, sum(c) AS c, sum(r) AS r FROM p GROUP BY 1, 2) SELECT part, round(exp(sum(ln((hit + 1) / (guess + 1))) / 4) * CASE WHEN max(c) > max(r) THEN 1 ELSE exp(1 - max(r) / max(c)) END, 6) AS bleu FROM s GROUP BY 1")
def a28_corpus_bleu(spark, d):
    """BLEU-4 of all rows of a part together, smoothed at every order."""
    b, own, ref = _bleu_pair(spark, d)
    return M.corpus_bleu(b.withColumn("part", F.col("item_id") % 3), ["item_id"], ["part"], own, ref).select("part", _r(F.col("bleu"), "bleu"))


@query(f"WITH {GEN_SQL} SELECT task, count(*) AS n, round(count(*) FILTER (passed) * 1.0::DOUBLE / count(*), 6) AS accuracy FROM gen GROUP BY 1")
def a29_accuracy(spark, d):
    return gen(spark, d).groupBy("task").agg(F.count("*").alias("n"), _r(F.count_if("passed") / F.count("*"), "accuracy"))


@query()
def a33_rule_counts(spark, d):
    """Random walks over programs that hold the items' words, and how often each rule was taken."""
    words = F.array_join(F.transform(D.tokens(F.col("text")), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
    src = F.concat(F.lit("def f(a):\n    names = ["), words, F.lit("]\n    total = a+"), (F.col("item_id") + 3).cast("string"), F.lit("  # sum\n    return total, names\n"))
    x = W.walks(table(spark, d, "benchmark").select("item_id", src.alias("source")), "source", "item_id", 8)
    return W.rule_counts(x, ["item_id"])


# --- order ----------------------------------------------------------------------------------


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE n_chars >= 100) WHERE r <= 5")
def w6_first_rows(spark, d):
    w = Window.partitionBy("lang").orderBy("doc_id")
    return _docs(spark, d).where("n_chars >= 100").withColumn("r", F.row_number().over(w)).where("r <= 5").select("lang", "doc_id")


@query("SELECT source, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+$') AS INTEGER), source) AS INTEGER) AS place FROM (SELECT DISTINCT source FROM documents)")
def w7_natural_order(spark, d):
    """Names by their number (distinct names only, so one partition is enough)."""
    w = Window.orderBy(F.regexp_extract("source", "[0-9]+$", 0).try_cast("int"), "source")
    return _docs(spark, d).select("source").distinct().withColumn("place", F.row_number().over(w))


@query(f"WITH {CONFIG_SQL} SELECT config, task, round(auroc, 6) AS auroc FROM m ORDER BY m.auroc DESC")
def w9_by_auroc(spark, d):
    return _configs(spark, d)[0].orderBy(F.desc("auroc")).select("config", "task", _r(F.col("auroc"), "auroc"))


@query("SELECT doc_id FROM documents ORDER BY sha256('' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def w10_seeded_sample(spark, d):
    """Fifty ids in hashed order."""
    return _docs(spark, d).select("doc_id").orderBy(F.sha2(F.concat(F.lit("\0"), F.col("doc_id").cast("string")), 256), "doc_id").limit(50)


@query("SELECT CAST(p AS INTEGER) AS pos, doc_id, n_chars FROM (VALUES (0, 9), (1, 3), (2, 7)) v(p, k) JOIN documents ON k = doc_id")
def w13_selection_order(spark, d):
    s = spark.createDataFrame([(0, 9), (1, 3), (2, 7)], "pos int, k int")
    return _docs(spark, d).join(F.broadcast(s), F.col("doc_id") == F.col("k")).select("pos", "doc_id", "n_chars")


# --- reports --------------------------------------------------------------------------------


@query("SELECT c.lang, c.source, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT source FROM documents)) c LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) d ON c.lang = d.lang AND c.source = d.source WHERE coalesce(n, 0) < 20")
def q1_unfinished(spark, d):
    """Cells of the grid with too few rows; the grid is of distinct names."""
    x = _docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))
    grid = x.select("lang").distinct().crossJoin(x.select("source").distinct())
    return grid.join(x, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")).where("n < 20")


@query(f"WITH {OBF_SQL} SELECT o.obf, count(*) AS n, count(*) FILTER (o.solution IS NULL OR NOT coalesce(g.toxic, false)) AS changed FROM obf o JOIN gen g ON o.id = g.id WHERE g.passed GROUP BY 1")
def q2_bad_transforms(spark, d):
    """Of the programs that passed, those whose variant does not."""
    x = obf(spark, d).join(gen(spark, d).where("passed").select("id", "toxic"), "id")
    return x.groupBy("obf").agg(F.count("*").alias("n"), F.count_if(F.col("solution").isNull() | ~F.coalesce("toxic", F.lit(False))).alias("changed"))


@query(COHORT_SQL + f" SELECT g.config, g.task, count(*) AS exp_c, round(avg(g.z), 6) AS z, round(avg({tail_sql('g.z')}), 6) AS p, round(avg(1 - {tail_sql('g.z')}), 6) AS auroc FROM gen g JOIN c ON g.id = c.id GROUP BY 1, 2")
def q3_metrics(spark, d):
    x = gen(spark, d).join(R.cohort(obf(spark, d), "id", "obf", "solution"), "id", "left_semi")
    return x.groupBy("config", "task").agg(F.count("*").alias("exp_c"), _r(F.avg("z"), "z"), _r(F.avg(S.upper_tail(F.col("z"))), "p"), _r(M.ideal_auroc(F.col("z")), "auroc"))


@query(f"WITH {CONFIG_SQL} SELECT config, round(avg(m.pass1) - max(m.pass1) FILTER (task = 'src0'), 6) AS pass1_diff, round(avg(auroc), 6) AS auroc FROM m GROUP BY ROLLUP (config)")
def q4_scheme_difference(spark, d):
    """Difference from the baseline and mean AUROC by configuration, and over all."""
    m = _configs(spark, d)[0]
    return m.rollup("config").agg(_r(F.avg("pass1") - F.max(F.when(F.col("task") == "src0", F.col("pass1"))), "pass1_diff"), _r(F.avg("auroc"), "auroc"))


@query(f"WITH {OBF_SQL}, a AS (SELECT config, avg(1 - {tail_sql('z')}) AS a FROM gen GROUP BY 1), b AS (SELECT config, avg(1 - {tail_sql('z2')}) AS b FROM obf WHERE obf = 'strip' GROUP BY 1) SELECT round(avg(a), 6) AS original, round(avg(b), 6) AS variant, round(stddev_samp(b), 6) AS std FROM a JOIN b ON a.config = b.config")
def q10_one_variant(spark, d):
    a = gen(spark, d).groupBy("config").agg(M.ideal_auroc(F.col("z")).alias("a"))
    b = obf(spark, d).where("obf = 'strip'").groupBy("config").agg(M.ideal_auroc(F.col("z2")).alias("b"))
    return a.join(b, "config").agg(_r(F.avg("a"), "original"), _r(F.avg("b"), "variant"), _r(F.stddev_samp("b"), "std"))


@query(f"WITH {CONFIG_SQL} SELECT m.config, task, CAST(regexp_extract(task, '[0-9]+$') AS INTEGER) AS n_gram, round(pass1, 6) AS pass1, round(auroc, 6) AS auroc, round(0.8 * base, 6) AS line FROM m LEFT JOIN b ON m.config = b.config")
def f1_figure_frame(spark, d):
    """Points and reference line of the pass rate / AUROC figures."""
    m, b = _configs(spark, d)
    return m.join(b, "config", "left").select("config", "task", F.regexp_extract("task", "[0-9]+$", 0).try_cast("int").alias("n_gram"), _r(F.col("pass1"), "pass1"), _r(F.col("auroc"), "auroc"), _r(0.8 * F.col("base"), "line"))


# --- checks ---------------------------------------------------------------------------------


@query("SELECT shard, count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT doc_id) AS ok FROM (SELECT doc_id, doc_id // 100 AS shard FROM labels) GROUP BY 1")
def v6_shard_coverage(spark, d):
    x = table(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 100).alias("shard")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
    return x.withColumn("ok", F.col("n") == F.col("ids"))


@query(f"WITH {OBF_SQL} SELECT config, obf, count(*) AS n, count(*) FILTER (solution IS NULL) AS missing, count(*) FILTER (isfinite(z2)) AS finite FROM obf GROUP BY 1, 2")
def v7_shard_status(spark, d):
    return obf(spark, d).groupBy("config", "obf").agg(F.count("*").alias("n"), F.count_if(F.col("solution").isNull()).alias("missing"), F.count_if(S.finite(F.col("z2"))).alias("finite"))


@query("SELECT o_orderkey, n FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) WHERE n <> 4")
def v12_key_coverage(spark, d):
    """Orders without exactly four lines (tasks without their number of completions; V5, V8, V10, V12)."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"))
    x = table(spark, d, "orders").select("o_orderkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return x.select("o_orderkey", F.coalesce("c", F.lit(0)).alias("n")).where("n <> 4")


@query(f"WITH {GEN_SQL}, saved AS (SELECT id, z + CASE WHEN id % 10 = 3 THEN 0.000001 WHEN id % 10 = 4 THEN 0.000000000001 ELSE 0 END AS old FROM gen) SELECT g.id, round(abs(z - old), 9) AS gap FROM gen g JOIN saved s ON g.id = s.id WHERE abs(z - old) > 0.0000000001")
def v9_saved_scores(spark, d):
    """Scores that differ from saved ones by more than 1e-10 (a tenth of the saved ones is off by 1e-6, another by 1e-12)."""
    k = F.col("id") % 10
    g = gen(spark, d).select("id", "z")
    saved = g.select("id", (F.col("z") + F.when(k == 3, 1e-6).when(k == 4, 1e-12).otherwise(0.0)).alias("old"))
    x = g.join(saved, "id").withColumn("gap", F.abs(F.col("z") - F.col("old")))
    return x.where("gap > 1e-10").select("id", _r(F.col("gap"), "gap", 9))


@query("SELECT (SELECT count(*) FROM labels) AS present, (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM labels) >= (SELECT count(*) FROM documents) AS complete")
def v13_progress(spark, d):
    """Present and expected rows, and the gate before the aggregates."""
    p = table(spark, d, "labels").agg(F.count("*").alias("present"))
    return p.crossJoin(_docs(spark, d).agg(F.count("*").alias("expected"))).withColumn("complete", F.col("present") >= F.col("expected"))
