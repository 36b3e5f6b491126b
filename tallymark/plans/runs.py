"""Registered queries of a run's reports: metric rows, high scores by scheme, unions of reports, coverage, baselines, seeded shots, suffixes by syntax."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..operators import benchmarks as B
from ..operators import keyed as K
from ..operators import relational as R
from ..operators import runs as U
from .lake import GEN_SQL, OBF_SQL, gen, obf, table, tail_sql
from .registry import _docs, _r, query

_GRID = "t AS (SELECT i, -15 + i * (30.0::DOUBLE / 2999) AS t FROM (SELECT unnest(range(0, 3000)) AS i))"


def _curve_sql(name: str, rows: str) -> str:
    return f"""{name}_c AS (SELECT config_key, i, t, avg(CASE WHEN z > t THEN 1.0::DOUBLE ELSE 0 END) AS tpr, {tail_sql('t')} AS fpr FROM {rows}, t GROUP BY config_key, i, t),
{name}_a AS (SELECT config_key, (lag(fpr) OVER w - fpr) * (lag(tpr) OVER w + tpr) / 2 AS area FROM {name}_c WINDOW w AS (PARTITION BY config_key ORDER BY i)), {name} AS (SELECT config_key, round(sum(area), 4) AS auroc FROM {name}_a GROUP BY 1)"""


def _kinds_sql(name: str, rows: str, kind: str) -> str:
    return f"{name} AS (SELECT config_key, to_json(map_from_entries(list((k, n) ORDER BY k))) AS m FROM (SELECT config_key, {kind} AS k, count(*) AS n FROM {rows} GROUP BY 1, 2) GROUP BY 1)"


_STATUS = "CASE WHEN solution IS NULL THEN 'error' WHEN id % 9 = 0 THEN 'timeout' ELSE 'ok' END"


@query(f"""WITH {OBF_SQL}, g AS (SELECT config AS config_key, id AS task, CASE WHEN id % 8 > 0 THEN z END AS z FROM gen WHERE config IS NOT NULL),
tr AS (SELECT config AS config_key, id AS task, {_STATUS} AS status, passed AS b, passed2 AS f, id % 4 > 0 AS changed, CASE WHEN id % 5 = 0 THEN 3 ELSE 1 END AS ident, id % 6 AS renames FROM obf WHERE obf = 'minify' AND config IS NOT NULL),
sc AS (SELECT config AS config_key, id AS task, {_STATUS} AS status, z2 AS z FROM obf WHERE obf = 'strip' AND config IS NOT NULL), ok AS (SELECT * FROM sc WHERE status = 'ok'), co AS (SELECT * FROM g WHERE z IS NOT NULL AND (config_key, task) IN (SELECT config_key, task FROM ok)), {_GRID},
{_curve_sql('same', 'co')}, {_curve_sql('final', 'ok')}, {_kinds_sql('ts', 'tr', 'status')}, {_kinds_sql('ss', 'sc', 'status')},
ru AS (SELECT config_key, to_json(map_from_entries([('identity', CAST(sum(ident) AS BIGINT)), ('rename', CAST(sum(renames) AS BIGINT))])) AS m FROM tr GROUP BY 1),
a AS (SELECT config_key, count(*) AS attempted FROM g GROUP BY 1), s AS (SELECT config_key, count(*) AS score_rows, count(*) FILTER (status = 'ok') AS scored, round(avg(z) FILTER (status = 'ok'), 6) AS step100_mean_z, round(count(*) FILTER (status = 'ok' AND z > 4) * 1.0::DOUBLE / count(*) FILTER (status = 'ok'), 6) AS step100_detection_rate_z_gt_4 FROM sc GROUP BY 1),
x AS (SELECT config_key, count(*) AS transform_rows, count(*) FILTER (status = 'ok') AS transformed_ok, count(*) FILTER (b) AS baseline_passed, count(*) FILTER (f) AS final_passed, count(*) FILTER (b AND f) AS preserved_baseline_passed, count(*) FILTER (b AND NOT f) AS semantic_regressions, count(*) FILTER (changed) AS changed_outputs, CAST(sum(ident) AS BIGINT) AS identity_steps FROM tr GROUP BY 1)
SELECT a.config_key, 'slug-' || a.config_key AS model_slug, 'Model ' || a.config_key AS model_name, 'wllm' AS watermark, 'documents' AS dataset, '7' AS config_id, 0.8::DOUBLE AS temperature, 2.0::DOUBLE AS delta, 0.5::DOUBLE AS gamma, CAST(NULL AS DOUBLE) AS entropy_threshold, 3 AS ngram_len,
0.9::DOUBLE AS selection_original_auroc, 0.5::DOUBLE AS selection_original_pass1, 0.6::DOUBLE AS selection_no_wm_pass1, 0.833333::DOUBLE AS selection_pass1_retention, same.auroc AS same_cohort_original_auroc, same.auroc AS same_cohort_saved_original_auroc, false AS baseline_recomputed, 0.0::DOUBLE AS baseline_z_abs_drift_mean, 0.0::DOUBLE AS baseline_z_abs_drift_max,
final.auroc AS step100_auroc, step100_mean_z, step100_detection_rate_z_gt_4, attempted, transform_rows, score_rows, transformed_ok, scored, baseline_passed, final_passed, round(final_passed * 1.0::DOUBLE / attempted, 6) AS final_pass1, preserved_baseline_passed, semantic_regressions,
round(preserved_baseline_passed * 1.0::DOUBLE / nullif(baseline_passed, 0), 6) AS conditional_pass_preservation, changed_outputs, identity_steps, ts.m AS transform_status_counts, ss.m AS score_status_counts, ru.m AS rule_counts
FROM a JOIN x USING (config_key) JOIN s USING (config_key) JOIN same USING (config_key) JOIN final USING (config_key) JOIN ts USING (config_key) JOIN ss USING (config_key) JOIN ru USING (config_key)""")
def a15_full_metric_row(spark, d):
    """All 39 columns of a configuration's metric row."""
    g = gen(spark, d).where("config IS NOT NULL").select(F.col("config").alias("config_key"), F.col("id").alias("task"), F.when(F.col("id") % 8 > 0, F.col("z")).alias("z"))
    o = obf(spark, d).where("config IS NOT NULL").withColumn("status", F.expr(_STATUS)).withColumnRenamed("config", "config_key").withColumn("task", F.col("id"))
    i = F.col("id")
    rules = F.create_map(F.lit("identity"), F.when(i % 5 == 0, 3).otherwise(1).cast("long"), F.lit("rename"), i % 6)
    t = o.where("obf = 'minify'").select("config_key", "task", "status", F.col("passed").alias("baseline_passed"), F.col("passed2").alias("final_passed"), (i % 4 > 0).alias("changed"), rules.alias("rule_counts"))
    s = o.where("obf = 'strip'").select("config_key", "task", "status", F.col("z2").alias("z"))
    k = F.col("config_key")
    own = {"watermark": F.lit("wllm"), "dataset": F.lit("documents"), "config_id": F.lit("7"), "temperature": F.lit(0.8), "delta": F.lit(2.0), "gamma": F.lit(0.5), "entropy_threshold": F.lit(None).cast("double"), "ngram_len": F.lit(3),
           "selection_original_auroc": F.lit(0.9), "selection_original_pass1": F.lit(0.5), "selection_no_wm_pass1": F.lit(0.6), "selection_pass1_retention": F.lit(0.833333)}
    c = g.select("config_key").distinct().withColumns({"model_slug": F.concat(F.lit("slug-"), k), "model_name": F.concat(F.lit("Model "), k)} | own)
    x = U.metric_rows(c, g, t, s)
    digits = {"same_cohort_original_auroc": 4, "same_cohort_saved_original_auroc": 4, "step100_auroc": 4, "step100_mean_z": 6, "step100_detection_rate_z_gt_4": 6, "final_pass1": 6, "conditional_pass_preservation": 6}
    return x.withColumns({n: F.round(n, q) for n, q in digits.items()} | {n: F.to_json(n) for n in ("transform_status_counts", "score_status_counts", "rule_counts")})


@query(f"""WITH {OBF_SQL}, t AS (SELECT id, z FROM gen ORDER BY z DESC, id LIMIT 20), c AS (SELECT config, t.z AS old_z, o.z2 AS new_z, o.id % 3 / 1000.0 AS drift, passed, passed2 FROM t JOIN obf o ON t.id = o.id WHERE obf = 'rename')
SELECT config, count(*) AS cases, round(avg(old_z), 6) AS old_z_mean, round(avg(new_z), 6) AS new_z_mean, count(*) FILTER (old_z > 4) AS old_z_gt_4, count(*) FILTER (new_z > 4) AS new_z_gt_4, count(*) FILTER (passed AND NOT passed2) AS semantic_regressions, round(max(drift), 6) AS max_old_score_abs_drift FROM c GROUP BY ROLLUP (config)""")
def a17_high_z_by_scheme(spark, d):
    """The twenty highest scores before and after, by scheme and in all."""
    t = F.broadcast(R.top_k(gen(spark, d).select("id", "z"), 20, F.desc("z"), F.asc("id")).select("id", "z"))  # twenty rows
    c = obf(spark, d).where("obf = 'rename'").join(t, "id").select("config", F.col("z").alias("old_z"), F.col("z2").alias("new_z"), ((F.col("id") % 3) / 1000.0).alias("drift"), F.col("passed").alias("baseline_passed"), F.col("passed2").alias("final_passed"))
    return U.high_z(c, "config").withColumns({n: F.round(n, 6) for n in ("old_z_mean", "new_z_mean", "max_old_score_abs_drift")})


@query("""WITH r AS (SELECT doc_id AS id, 'r' || doc_id % 3 AS report, CASE WHEN quality = 1 THEN 'resolved' WHEN toxic = 1 THEN 'error' ELSE 'unresolved' END AS state FROM labels UNION ALL SELECT doc_id, 'r1', 'submitted' FROM documents WHERE doc_id % 5 = 0),
b AS (SELECT id, min(list_position(['resolved', 'unresolved', 'error', 'empty_patch', 'submitted'], state)) AS k, count(DISTINCT report) AS reports FROM r GROUP BY 1)
SELECT doc_id AS id, coalesce(['resolved', 'unresolved', 'error', 'empty_patch', 'submitted'][k], 'incomplete') AS state, coalesce(reports, 0) AS reports FROM documents LEFT JOIN b ON doc_id = id""")
def a25_report_states(spark, d):
    """Each selected id's state over the union of all reports; a missing report fails the query."""
    lab = table(spark, d, "labels")
    r = lab.select(F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("report"), F.when(F.col("quality") == 1, "resolved").when(F.col("toxic") == 1, "error").otherwise("unresolved").alias("state"), F.col("doc_id").alias("id"))
    x = _docs(spark, d).select(F.col("doc_id").alias("id"))
    r = r.unionAll(x.where("id % 5 = 0").select(F.lit("r1").alias("report"), F.lit("submitted").alias("state"), "id"))
    return U.report_union(x, r, ["r0", "r1", "r2"])


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS c FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 13 = 0 UNION ALL SELECT -l_orderkey, 1 FROM lineitem WHERE l_orderkey % 101 = 0 AND l_linenumber = 1),
g AS (SELECT k, count(*) AS n, count(DISTINCT c) AS p FROM r GROUP BY 1)
SELECT coalesce(o_orderkey, k) AS l_orderkey, coalesce(n, 0) AS "rows", coalesce(p, 0) AS pairs, CASE WHEN o_orderkey IS NULL THEN 'extra' WHEN coalesce(p, 0) < 4 THEN 'missing' WHEN n > p THEN 'duplicate' WHEN p > 4 THEN 'more' END AS fault
FROM (SELECT DISTINCT o_orderkey FROM orders) FULL JOIN g ON o_orderkey = k WHERE o_orderkey IS NULL OR coalesce(p, 0) <> 4 OR n > p""")
def v12_completion_coverage(spark, d):
    """Tasks (orders) whose completions are not the expected four, once each: missing, duplicate, more, or not a task."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    x = x.unionAll(x.where("l_orderkey % 13 = 0")).unionAll(x.where("l_orderkey % 101 = 0 AND l_linenumber = 1").select(-F.col("l_orderkey"), F.lit(1)))
    return U.key_coverage(x, table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "l_linenumber", 4)


@query(f"""WITH {GEN_SQL}, m AS (SELECT config AS model, id % 2 AS dataset, id % 3 AS temperature, task, avg(z) AS m FROM gen WHERE config IS NOT NULL GROUP BY 1, 2, 3, 4), b AS (SELECT model, dataset, temperature, m AS base FROM m WHERE task = 'src0')
SELECT m.model, m.dataset, m.temperature, m.task, round(m.m - base, 6) AS lift FROM m LEFT JOIN b ON m.model = b.model AND m.dataset = b.dataset AND m.temperature = b.temperature""")
def j3_three_keys(spark, d):
    """The difference from the baseline of the same model, dataset and temperature."""
    m = gen(spark, d).where("config IS NOT NULL").groupBy(F.col("config").alias("model"), (F.col("id") % 2).alias("dataset"), (F.col("id") % 3).alias("temperature"), "task").agg(F.avg("z").alias("m"))
    x = R.baseline(m, m.where("task = 'src0'"), ["model", "dataset", "temperature"], "m", "base")
    return x.select("model", "dataset", "temperature", "task", _r(F.col("m") - F.col("base"), "lift"))


_SHOTS = ", ".join(f"({i}, {', '.join(map(str, K.permutation(25, i, 3).tolist()))})" for i in range(1000))


@query(f"""WITH p AS (SELECT * FROM (VALUES {_SHOTS}) v(i, a, b, c)), n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name FROM nation)
SELECT item_id, x.n_name || '|' || y.n_name || '|' || z.n_name AS shots FROM benchmark JOIN p ON i = item_id JOIN n x ON x.pos = a JOIN n y ON y.pos = b JOIN n z ON z.pos = c WHERE item_id < 1000""")
def p22_seeded_shots(spark, d):
    """Three shots of each task, the first of a permutation of the training rows that the task's id seeds."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("text"), F.array("n_name").alias("test_list"), F.col("n_name").alias("code"))
    items = table(spark, d, "benchmark").where("item_id < 1000").select(F.col("item_id").cast("int").alias("task_id"))
    return B.mbpp_shots(items, n).select(F.col("task_id").cast("long").alias("item_id"), F.array_join(F.transform("examples", lambda x: x["text"]), "|").alias("shots"))


_SIGNATURE = "(a, b: dict = {1: 2}, *, c=lambda x: x) -> dict[str, int]:"


@query(f"""WITH x AS (SELECT doc_id, regexp_replace(text, '[^a-z ]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 3 = 1 THEN md5('    # c: d' || chr(10) || '    # ' || t || chr(10) || '    return 1' || chr(10)) ELSE md5('    # ' || t || chr(10) || '    return 1' || chr(10)) END AS suite,
CASE WHEN doc_id % 3 = 2 THEN 'expected one top-level function ''g' || doc_id || ''', found 0' END AS error FROM x""")
def p13_suite_suffix(spark, d):
    """What follows the colon of the entry function, found by syntax; a program without it says so."""
    t, i = F.regexp_replace("text", "[^a-z ]+", " "), F.col("doc_id").cast("string")
    third = F.col("doc_id") % 3
    source = F.concat(F.lit("import os\ndef f"), i, F.lit(_SIGNATURE), F.when(third == 1, "  # c: d").otherwise(""), F.lit("\n    # "), t, F.lit("\n    return 1\n"))
    x = _docs(spark, d).select("doc_id", C.suite_suffix(source, F.concat(F.when(third == 2, "g").otherwise("f"), i)).alias("s"))
    return x.select("doc_id", F.md5("s.suite").alias("suite"), "s.error")


_MARK = {k: " || ".join(f"'{p}'" if p else "''" for p in v.split("\n")).replace(" || ", " || chr(10) || ") for k, v in B.TEXT_MARKS.items()}


@query(f"""WITH x AS (SELECT item_id, regexp_replace(text, '[^a-z ]+', ' ', 'g') AS t, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS p FROM benchmark)
SELECT 'humanevalpack' AS name, item_id, md5(p) AS prompt, md5(p || ' {{ return 1; }}') AS answer FROM x
UNION ALL SELECT 'code_to_text_python', item_id, md5('def f(x):' || chr(10) || '    return x' || chr(10) || {_MARK['python']}), md5('The goal') FROM x
UNION ALL SELECT 'code_to_text_ruby', item_id, md5('def f; ' || t || '; end' || {_MARK['ruby']}), md5('The goal') FROM x""")
def s6_code_adapters(spark, d):
    """The adapters whose items are programs: prompts and answers of HumanEvalPack and of code to text in Python and Ruby."""
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^a-z ]+", " ").alias("t"), F.col("text").alias("prompt"))
    known, doc = B.adapters(), F.concat(F.lit("Doc: "), "t", F.lit("."))
    said = {"humanevalpack": F.lit(" { return 1; } more { }"), "code_to_text_python": F.lit("The goal\nmore"), "code_to_text_ruby": F.lit("The goal\nmore")}
    code = {"code_to_text_python": F.concat(F.lit('def f(x):\n    """'), doc, F.lit('"""\n    return x\n')), "code_to_text_ruby": F.concat(F.lit("def f; "), "t", F.lit("; end"))}
    out = None
    for name, tail in said.items():
        a = known[name]
        x = b.withColumn("docstring", doc).withColumn("code", code.get(name, F.col("prompt"))).withColumn("p", a.prompt()).withColumn("g", F.concat("p", tail))
        x = x.select(F.lit(name).alias("name"), "item_id", F.md5("p").alias("prompt"), F.md5(a.answer(F.col("g"), F.col("p"))).alias("answer"))
        out = x if out is None else out.unionAll(x)
    return out
