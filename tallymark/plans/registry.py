"""All registered queries and the SQL that says the same. Names begin with the operator's
number in the survey (d6: window score, a5: empirical AUROC, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import detection as D
from ..operators import keyed as K
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import scans as N
from .lake import GEN_SQL, OBF_SQL, POS_SQL, TOK_SQL, VARIANTS, gen, green_sql, obf, table, tail_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from . import extra, keyed_tables, reports, runs, stores  # noqa: F401  (register their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def _docs(spark, d):
    return table(spark, d, "documents")


def _toks(spark, d):
    return _docs(spark, d).select("doc_id", "lang", D.tokens(F.col("text")).alias("t"))


def _r(c, name: str, digits_: int = 6):
    return F.round(c, digits_).alias(name)


# --- detection -----------------------------------------------------------------------------

CTX3 = "t[i-1] || ',' || t[i-2]"
WINDOW_SQL = f"""WITH {POS_SQL}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({green_sql(CTX3, 't[i]')}) AS g FROM pos WHERE i >= 3 GROUP BY doc_id),
r AS (SELECT k.doc_id, coalesce(n, 0) AS n_scored, coalesce(g, 0) AS n_green, CASE WHEN n >= 1 THEN (g - 0.5 * n) / sqrt(n * 0.25) ELSE 0 END AS z FROM tok k LEFT JOIN s ON k.doc_id = s.doc_id)
SELECT doc_id, n_scored, n_green, round(z, 6) AS z, round({tail_sql('z')}, 6) AS p, z > 4 AS prediction, n_scored < 1 AS invalid FROM r"""


@query(WINDOW_SQL)
def d6_window_score(spark, d):
    """Every document's green tokens under a context of two tokens, z, p and prediction."""
    x = D.scored(_toks(spark, d), D.green_mask(F.col("t"), 3))
    return x.select("doc_id", "n_scored", "n_green", _r(F.col("z"), "z"), _r(F.col("p"), "p"), "prediction", "invalid")


@query(f"""WITH {POS_SQL}, s AS (SELECT doc_id, count(*) AS n_scored, count(*) FILTER ({green_sql('t[i-1]', 't[i]', 16384, 'z9')}) AS n_green FROM pos WHERE i > 20 GROUP BY doc_id)
SELECT doc_id, n_scored, n_green, round((n_green - 0.25 * n_scored) / sqrt(n_scored * 0.1875), 6) AS z FROM s""")
def d5_prefix_score(spark, d):
    """A context of one token, gamma .25, the first 20 tokens are the prompt and are not scored."""
    x = D.scored(_toks(spark, d), D.green_mask(F.col("t"), 2, D.md5_green(0.25, "z9"), 20), 0.25)
    return x.where("NOT invalid").select("doc_id", "n_scored", "n_green", _r(F.col("z"), "z"))


def _entropy(t):
    """A stand-in for a model's entropies: a digit of each token's digest, in quarters."""
    return F.transform(t, lambda x: F.conv(F.substring(F.md5(x), 1, 1), 16, 10).cast("double") / 4)


def _sweet_sql(shift: bool) -> str:
    e = "(CAST('0x' || substr(md5(t[i-1]), 1, 1) AS INTEGER) / 4.0)" if shift else "(CAST('0x' || substr(md5(t[i]), 1, 1) AS INTEGER) / 4.0)"
    return f"""WITH {POS_SQL}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({green_sql('t[i-1]', 't[i]')}) AS g FROM pos WHERE i >= 2 AND {e} > 1.2 GROUP BY doc_id)
SELECT k.doc_id, coalesce(n, 0) AS n_scored, coalesce(g, 0) AS n_green, round(CASE WHEN n >= 1 THEN (g - 0.5 * n) / sqrt(n * 0.25) ELSE -100 END, 6) AS z FROM tok k LEFT JOIN s ON k.doc_id = s.doc_id"""


def _sweet(spark, d, shift):
    t = F.col("t")
    x = D.scored(_toks(spark, d), D.high_entropy(t, _entropy(t), 2, 1.2, shift))
    return x.select("doc_id", "n_scored", "n_green", _r(F.when(F.col("invalid"), -100.0).otherwise(F.col("z")), "z"))


@query(_sweet_sql(False))
def d11_entropy_score(spark, d):
    """Only tokens of an entropy over 1.2 are scored; none: the sentinel -100."""
    return _sweet(spark, d, False)


@query(_sweet_sql(True))
def d12_entropy_score_shifted(spark, d):
    """The same with entropies shifted right by one."""
    return _sweet(spark, d, True)


@query("SELECT doc_id, round(-(a * ln(a) + (1 - a) * ln(1 - a)), 6) AS entropy FROM (SELECT doc_id, (1 + n_chars % 98) / 100.0 AS a FROM documents)")
def d13_entropy(spark, d):
    """-sum p ln p of a probability column."""
    a = (1 + F.col("n_chars") % 98) / 100.0
    x = _docs(spark, d).select("doc_id", F.array(a, 1 - a).alias("p"))
    return x.select("doc_id", _r(-F.aggregate("p", F.lit(0.0), lambda s, q: s + F.when(q > 0, q * F.log(q)).otherwise(0.0)), "entropy"))


@query(f"""WITH {POS_SQL}, g AS (SELECT DISTINCT doc_id, t[i-1] AS c, t[i] AS x FROM pos WHERE i >= 2), s AS (SELECT doc_id, count(*) AS n_scored, count(*) FILTER ({green_sql('c', 'x')}) AS n_green FROM g GROUP BY doc_id)
SELECT doc_id, n_scored, n_green, round((n_green - 0.5 * n_scored) / sqrt(n_scored * 0.25), 6) AS z FROM s""")
def d16_distinct_ngram_score(spark, d):
    """Each n-gram of a document counts once."""
    x = D.ngram_scores(_toks(spark, d), ["doc_id"], "t", 2)
    return x.select("doc_id", "n_scored", "n_green", _r(F.col("z"), "z"))


@query(f"""WITH {POS_SQL} SELECT doc_id, i - 1 AS t, round((sum(CASE WHEN {green_sql('t[i-1]', 't[i]')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 0.5 * (i - 1)) / sqrt((i - 1) * 0.25), 6) AS z FROM pos WHERE i >= 2""")
def d17_running_z(spark, d):
    """The z-score after each scored token."""
    x = D.running_z(_toks(spark, d).withColumn("mask", D.green_mask(F.col("t"), 2)), ["doc_id"])
    return x.select("doc_id", "t", _r(F.col("z"), "z"))


@query(f"""WITH {POS_SQL}, k AS (SELECT unnest(range(0, 30)) AS k), s AS (SELECT doc_id, count(*) AS n_scored, count(*) FILTER (CAST('0x' || substr(md5(k || '|' || t[i-2] || ',' || t[i-1] || ',' || t[i]), 1, 1) AS INTEGER) >= 8) AS n_green FROM pos, k WHERE i >= 3 GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_scored, 0) AS n_scored, coalesce(n_green, 0) AS n_green, coalesce(round((n_green - 0.5 * n_scored) / sqrt(n_scored * 0.25), 6), 0) AS z FROM tok t LEFT JOIN s ON t.doc_id = s.doc_id""")
def d19_g_values(spark, d):
    """Bits of each window under thirty keys against a fair coin; texts shorter than a window have z 0."""
    x = _toks(spark, d).select("doc_id", K.g_value_counts(F.col("t"), 3, 30).alias("c"))
    x = D.with_scores(x, F.col("c.n_scored").cast("int"), F.col("c.n_green").cast("int"))
    return x.select("doc_id", "n_scored", "n_green", _r(F.col("z"), "z"))


@query(f"""WITH {POS_SQL}, a AS (SELECT doc_id, t, len(t) AS n FROM tok WHERE len(t) >= 16)
SELECT doc_id, min(i) AS at FROM (SELECT doc_id, t, unnest(range(1, n - 8)) AS i FROM a) WHERE t[i:i+9] = t[6:15] GROUP BY doc_id""")
def d22_align(spark, d):
    """Where ten tokens from the sixth on first occur in the whole."""
    x = _toks(spark, d).where("size(t) >= 16")
    return x.select("doc_id", D.align(F.col("t"), F.slice("t", 6, 10)).cast("long").alias("at"))


@query(f"""WITH {GEN_SQL}, f AS (SELECT task, min(id) FILTER (passed) AS chosen FROM gen WHERE passed IS NOT NULL GROUP BY task)
SELECT f.task, g.z AS z, f.chosen, (SELECT count(*) FROM gen b WHERE b.task = f.task AND NOT b.passed AND (f.chosen IS NULL OR b.id < f.chosen)) AS n_skipped, f.chosen IS NULL AS invalid FROM f LEFT JOIN gen g ON g.id = f.chosen""")
def d24_first_valid(spark, d):
    """Each task's first passing completion and how many were skipped before it."""
    return D.first_valid(gen(spark, d).where("passed IS NOT NULL"), ["task"], "id", F.col("passed"), "z")


# --- joins and set operators ----------------------------------------------------------------


@query(f"WITH {OBF_SQL} SELECT g.config, o.obf, count(*) AS n, count(*) FILTER (g.z <> o.z2) AS moved, round(avg(g.z - o.z2), 6) AS drift FROM obf o JOIN gen g ON o.id = g.id GROUP BY 1, 2")
def j1_variant_join(spark, d):
    g = gen(spark, d).select("id", "config", "z")
    x = obf(spark, d).select("id", "obf", "z2").join(g, "id")
    return x.groupBy("config", "obf").agg(F.count("*").alias("n"), F.count_if(F.col("z") != F.col("z2")).alias("moved"), _r(F.avg(F.col("z") - F.col("z2")), "drift"))


COHORT_SQL = f"WITH {OBF_SQL}, c AS (SELECT id FROM obf WHERE solution IS NOT NULL GROUP BY id HAVING count(DISTINCT obf) = (SELECT count(DISTINCT obf) FROM obf))"


@query(COHORT_SQL + " SELECT g.config, count(*) AS exp_c, round(avg(z), 6) AS z FROM gen g JOIN c ON g.id = c.id GROUP BY 1")
def j2_cohort(spark, d):
    """Programs every variant of which compiled, by configuration."""
    x = gen(spark, d).join(R.cohort(obf(spark, d), "id", "obf", "solution"), "id", "left_semi")
    return x.groupBy("config").agg(F.count("*").alias("exp_c"), _r(F.avg("z"), "z"))


@query(f"WITH {GEN_SQL}, b AS (SELECT config, avg(z) AS base FROM gen WHERE task = 'src0' GROUP BY 1) SELECT g.config, g.task, round(avg(z) - max(base), 6) AS lift FROM gen g LEFT JOIN b ON g.config = b.config GROUP BY 1, 2")
def j3_baseline(spark, d):
    g = gen(spark, d)
    base = g.where("task = 'src0'").groupBy("config").agg(F.avg("z").alias("b"))
    x = R.baseline(g.groupBy("config", "task").agg(F.avg("z").alias("m")), base, ["config"], "b", "base")
    return x.select("config", "task", _r(F.col("m") - F.col("base"), "lift"))


@query("SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN a.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT doc_id AS k FROM documents) a FULL JOIN (SELECT doc_id AS k FROM labels) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def j5_key_difference(spark, d):
    return R.key_difference(_docs(spark, d), table(spark, d, "labels"), "doc_id")


@query("""WITH s AS (SELECT l_orderkey AS g, l_linenumber * 7 AS lo, l_linenumber * 7 + CAST(l_quantity AS INTEGER) AS hi FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS g, l_partkey % 60 AS pt FROM lineitem)
SELECT g, pt, lo, hi FROM (SELECT p.g, p.pt, s.lo, s.hi, row_number() OVER (PARTITION BY p.g, p.pt ORDER BY s.hi - s.lo, s.lo DESC) AS r FROM p JOIN s ON p.g = s.g AND p.pt BETWEEN s.lo AND s.hi) WHERE r = 1""")
def j10_smallest_span(spark, d):
    """The smallest interval that holds each point (lines as functions' spans)."""
    li = table(spark, d, "lineitem")
    s = li.select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") * 7).alias("lo"), (F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int")).alias("hi"))
    p = li.select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 60).alias("pt")).distinct()
    return R.smallest_span(p, s, "g", "pt", "lo", "hi")


@query(f"WITH {GEN_SQL} SELECT a.task, round(a.m - b.m, 6) AS diff FROM (SELECT task, avg(z) AS m FROM gen WHERE config = 'en' GROUP BY 1) a JOIN (SELECT task, avg(z) AS m FROM gen WHERE config = 'fr' GROUP BY 1) b ON a.task = b.task")
def j11_pair_difference(spark, d):
    g = gen(spark, d).groupBy("task").agg(F.avg(F.when(F.col("config") == "en", F.col("z"))).alias("a"), F.avg(F.when(F.col("config") == "fr", F.col("z"))).alias("b"))
    return g.where("a IS NOT NULL AND b IS NOT NULL").select("task", _r(F.col("a") - F.col("b"), "diff"))


# --- aggregates -----------------------------------------------------------------------------


@query(COHORT_SQL + f""", n AS (SELECT config, count(*) AS exp_c FROM gen GROUP BY 1), r AS (SELECT id, config, 'Original' AS obf, passed, z, length(text) AS len FROM gen UNION ALL SELECT id, config, obf, passed2, z2, len2 FROM obf)
SELECT r.config, obf, round(count(*) FILTER (passed) * 1.0 / max(exp_c), 6) AS pass1, round(avg(1 - {tail_sql('z')}), 6) AS auroc, round(avg(z), 6) AS z, round(avg({tail_sql('z')}), 6) AS p, CAST(max(exp_c) AS BIGINT) AS exp_c, count(*) AS comp_c, CAST(sum(len) AS BIGINT) AS len_sum
FROM r JOIN c ON r.id = c.id JOIN n ON r.config = n.config GROUP BY 1, 2""")
def a1_metric_rows(spark, d):
    """A row for the programs as they were and for each variant, over the cohort that every variant has (A1, A2):
    its own passes over all programs, means of z and p, the ideal AUROC and the sum of lengths."""
    g, o = gen(spark, d), obf(spark, d)
    n = g.groupBy("config").agg(F.count("*").alias("exp_c"))
    rows = g.select("id", "config", F.lit("Original").alias("obf"), "passed", "z", F.length("text").alias("len")).unionAll(o.select("id", "config", "obf", "passed2", "z2", "len2"))
    x = rows.join(R.cohort(o, "id", "obf", "solution"), "id", "left_semi").groupBy("config", "obf").agg(F.count_if("passed").alias("ok"), _r(M.ideal_auroc(F.col("z")), "auroc"), _r(F.avg("z"), "z"), _r(F.avg(S.upper_tail(F.col("z"))), "p"), F.count("*").alias("comp_c"), F.sum("len").cast("long").alias("len_sum"))
    return x.join(n, "config").select("config", "obf", _r(F.col("ok") / F.col("exp_c"), "pass1"), "auroc", "z", "p", "exp_c", "comp_c", "len_sum")


@query(f"""WITH {GEN_SQL}, t AS (SELECT i, -15 + i * (30.0::DOUBLE / 2999) AS t FROM (SELECT unnest(range(0, 3000)) AS i)),
c AS (SELECT config, i, t, avg(CASE WHEN z > t THEN 1.0::DOUBLE ELSE 0 END) AS tpr, {tail_sql('t')} AS fpr FROM gen, t GROUP BY config, i, t),
a AS (SELECT config, (lag(fpr) OVER w - fpr) * (lag(tpr) OVER w + tpr) / 2 AS area FROM c WINDOW w AS (PARTITION BY config ORDER BY i)) SELECT config, round(sum(area), 4) AS auroc FROM a GROUP BY 1""")
def a3_ideal_auroc_grid(spark, d):
    return M.ideal_auroc_grid(gen(spark, d), ["config"], "z").select("config", _r(F.col("auroc"), "auroc", 4))


@query(f"WITH {GEN_SQL} SELECT config, round(avg(1 - {tail_sql('z')}), 6) AS auroc FROM gen GROUP BY 1")
def a4_ideal_auroc(spark, d):
    return gen(spark, d).groupBy("config").agg(_r(M.ideal_auroc(F.col("z")), "auroc"))


@query(f"WITH {GEN_SQL}, r AS (SELECT config, passed, rank() OVER (PARTITION BY config ORDER BY z) + (count(*) OVER (PARTITION BY config, z) - 1) / 2.0 AS r FROM gen WHERE passed IS NOT NULL), s AS (SELECT config, count(*) FILTER (passed) AS n_pos, count(*) FILTER (NOT passed) AS n_neg, sum(r) FILTER (passed) AS s FROM r GROUP BY 1) SELECT config, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / (n_pos * 1.0 * n_neg), 6) AS auroc FROM s")
def a5_auroc(spark, d):
    x = M.auroc(gen(spark, d).where("passed IS NOT NULL"), ["config"], "z", "passed")
    return x.select("config", "n_pos", "n_neg", _r(F.col("auroc"), "auroc"))


@query(f"""WITH {GEN_SQL}, g AS (SELECT config, z, count(*) FILTER (passed) AS p, count(*) FILTER (NOT passed) AS n FROM gen WHERE passed IS NOT NULL GROUP BY 1, 2),
c AS (SELECT config, sum(p) OVER w * 1.0 / nullif(sum(p) OVER (PARTITION BY config), 0) AS tpr, sum(n) OVER w * 1.0 / nullif(sum(n) OVER (PARTITION BY config), 0) AS fpr FROM g WINDOW w AS (PARTITION BY config ORDER BY z DESC))
SELECT config, round(coalesce(max(tpr) FILTER (fpr <= 0), 0), 6) AS tpr_0, round(coalesce(max(tpr) FILTER (fpr <= 0.01), 0), 6) AS tpr_1, round(coalesce(max(tpr) FILTER (fpr <= 0.05), 0), 6) AS tpr_2 FROM c GROUP BY 1""")
def a6_tpr_at_fpr(spark, d):
    x = M.tpr_at_fpr(gen(spark, d).where("passed IS NOT NULL"), ["config"], "z", "passed", (0.0, 0.01, 0.05))
    return x.select("config", *[_r(F.col(f"tpr_{i}"), f"tpr_{i}") for i in range(3)])


@query(f"""WITH {GEN_SQL}, n AS (SELECT task, count(*) AS n, count(*) FILTER (passed) AS c FROM gen WHERE passed IS NOT NULL GROUP BY 1),
k AS (SELECT unnest([1, 5, 10]) AS k) SELECT task, k, round(CASE WHEN c = 0 THEN 0 WHEN n - c < k THEN 1 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k * 1.0::DOUBLE / i)) END, 6) AS pass FROM n, k WHERE k <= n""")
def a7_pass_at_k(spark, d):
    n = gen(spark, d).where("passed IS NOT NULL").groupBy("task").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))
    x = n.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 10))))).where("k <= n")
    return x.select("task", "k", _r(S.pass_at_k(F.col("n"), F.col("c"), F.col("k")), "pass"))


@query(f"WITH {GEN_SQL} SELECT config, count(*) FILTER (passed AND toxic) AS preserved, count(*) FILTER (passed AND NOT toxic) AS regressions, count(*) FILTER (NOT passed AND toxic) AS improvements FROM gen GROUP BY 1")
def a9_paired_flags(spark, d):
    p, t = F.col("passed"), F.col("toxic")
    return gen(spark, d).groupBy("config").agg(F.count_if(p & t).alias("preserved"), F.count_if(p & ~t).alias("regressions"), F.count_if(~p & t).alias("improvements"))


@query(COHORT_SQL + """, p AS (SELECT o.config, o.obf, round(z2, 4) AS s FROM obf o JOIN c ON o.id = c.id), g AS (SELECT config, 'passed' AS neg, round(z, 4) AS s FROM gen WHERE passed UNION ALL SELECT config, 'failed', round(z, 4) FROM gen WHERE NOT passed),
m AS (SELECT p.config, p.obf, g.neg, avg(CASE WHEN p.s > g.s THEN 1.0::DOUBLE WHEN p.s = g.s THEN 0.5 ELSE 0 END) AS a FROM p JOIN g ON p.config = g.config GROUP BY 1, 2, 3) SELECT config, obf, neg AS negative, round(a, 6) AS auroc FROM m""")
def a10_negative_matrix(spark, d):
    """AUROC of every variant's cohort against every negative class."""
    o = obf(spark, d)
    pos = o.join(R.cohort(o, "id", "obf", "solution"), "id", "left_semi").select("config", "obf", F.explode(F.array(F.lit("passed"), F.lit("failed"))).alias("negative"), F.round("z2", 4).alias("s"), F.lit(True).alias("p"))
    neg = gen(spark, d).where("passed IS NOT NULL").select("config", F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("obf"), F.when(F.col("passed"), "passed").otherwise("failed").alias("negative"), F.round("z", 4).alias("s"), F.lit(False).alias("p"))
    x = M.auroc(pos.unionAll(neg), ["config", "obf", "negative"], "s", "p")
    return x.where("auroc IS NOT NULL").select("config", "obf", "negative", _r(F.col("auroc"), "auroc"))


@query("SELECT lang, count(*) AS n, sha256(string_agg(k, chr(10) ORDER BY k)) AS fp FROM (SELECT DISTINCT lang, CAST(doc_id AS VARCHAR) AS k FROM documents) GROUP BY 1")
def a11_fingerprint(spark, d):
    return R.fingerprint(_docs(spark, d), ["lang"], "doc_id")


@query(f"WITH {GEN_SQL} SELECT config, count(*) AS n, count(*) FILTER (z > 4) AS detected, round(avg(z), 6) AS mean_z, round(median(z), 6) AS median_z, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, round(avg({tail_sql('z')}), 6) AS mean_p FROM gen GROUP BY 1")
def a13_detection_summary(spark, d):
    z = F.col("z")
    return gen(spark, d).groupBy("config").agg(F.count("*").alias("n"), F.count_if(z > 4).alias("detected"), _r(F.avg(z), "mean_z"), _r(F.median(z), "median_z"), _r(F.min(z), "min_z"), _r(F.max(z), "max_z"), _r(F.avg(S.upper_tail(z)), "mean_p"))


@query(f"WITH {GEN_SQL} SELECT config, task, count(*) AS n, round(avg(z), 6) AS z, count(*) FILTER (z < 0.6) AS low FROM gen GROUP BY GROUPING SETS ((config, task), (config), ())")
def a16_scheme_summary(spark, d):
    g = gen(spark, d)
    return g.groupingSets([[F.col("config"), F.col("task")], [F.col("config")], []], F.col("config"), F.col("task")).agg(F.count("*").alias("n"), _r(F.avg("z"), "z"), F.count_if(F.col("z") < 0.6).alias("low"))


@query("SELECT lang, min(source) AS value, count(DISTINCT source) = 1 AND count(source) = count(*) OR count(source) = 0 AS ok FROM documents GROUP BY 1")
def a23_single_valued(spark, d):
    return R.single_valued(_docs(spark, d), ["lang"], "source")


@query(f"WITH {OBF_SQL} SELECT o.obf, count(*) FILTER (round(abs(g.z - o.z2), 9) <= 1) AS close, round(max(abs(g.z - o.z2)), 6) AS worst FROM obf o JOIN gen g ON o.id = g.id GROUP BY 1")
def a24_match_counts(spark, d):
    x = obf(spark, d).join(gen(spark, d).select("id", "z"), "id")
    gap = F.abs(F.round(F.col("z") - F.col("z2"), 9))
    return x.groupBy("obf").agg(F.count_if(gap <= 1).alias("close"), _r(F.max(gap), "worst"))


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, event_type AS answer, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen) AS r FROM a) WHERE r = 1""")
def a26_majority(spark, d):
    return M.majority(table(spark, d, "events"), ["user_id"], "event_type", "event_id").select("user_id", "answer", "votes")


@query(f"""WITH {POS_SQL}, w AS (SELECT t[i-2] || ' ' || t[i-1] AS prefix, t[i] AS next FROM pos WHERE i >= 3) SELECT prefix, next, count(*) AS n FROM w GROUP BY 1, 2""")
def a30_ngram_table(spark, d):
    return M.ngram_table(_docs(spark, d), D.tokens(F.col("text")), 3)


@query("SELECT event_type, quantile_disc(value, 0.1) AS p10, median(value) AS p50, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def a31_nearest_rank(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY value)").alias("p10"), F.median("value").alias("p50"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("""WITH x AS (SELECT source, unnest(string_split(text, chr(10))) AS line, doc_id % 2 AS side FROM documents), c AS (SELECT source, line, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM x GROUP BY 1, 2),
g AS (SELECT source, sum(least(a, b)) AS k, sum(a) AS na, sum(b) AS nb FROM c GROUP BY 1), p AS (SELECT source, CASE WHEN nb > 0 THEN k / nb ELSE 0 END AS p, CASE WHEN na > 0 THEN k / na ELSE 0 END AS r FROM g)
SELECT source, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p""")
def a32_multiset_f1(spark, d):
    """Lines of even documents against those of odd ones, by source."""
    x = _docs(spark, d).select("source", F.explode(F.split("text", "\n")).alias("line"), (F.col("doc_id") % 2).alias("side"))
    y = M.multiset_f1(x.where("side = 0"), x.where("side = 1"), ["source"], "line")
    return y.select("source", _r(F.col("precision"), "precision"), _r(F.col("recall"), "recall"), _r(F.col("f1"), "f1"))


# --- order, sampling, slices ----------------------------------------------------------------


@query(f"WITH {GEN_SQL} SELECT id, z, CAST(row_number() OVER (ORDER BY z DESC, id) AS INTEGER) AS rank FROM gen ORDER BY z DESC, id LIMIT 20")
def w4_top_k(spark, d):
    return R.top_k(gen(spark, d).select("id", "z"), 20, F.desc("z"), F.asc("id"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(lang || chr(0) || CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 5")
def w5_hashed_sample(spark, d):
    return R.hashed_sample(_docs(spark, d), ["lang"], "doc_id", 5).select("lang", "doc_id")


@query("SELECT lang, slice, count(*) AS n, min(doc_id) AS first FROM (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 50 AS slice FROM documents) GROUP BY 1, 2")
def w11_slices(spark, d):
    return R.slices(_docs(spark, d).select("lang", "doc_id"), ["lang"], "doc_id", 50).groupBy("lang", "slice").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""WITH RECURSIVE o AS (SELECT source, w, row_number() OVER (ORDER BY w DESC, source) AS k FROM (SELECT source, sum(n_chars) AS w FROM documents GROUP BY 1)),
r AS (SELECT CAST(0 AS BIGINT) AS k, [0, 0, 0, 0]::DOUBLE[] AS loads, CAST(NULL AS VARCHAR) AS source, CAST(0 AS INTEGER) AS bin UNION ALL
SELECT o.k, [loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN w ELSE 0 END FOR i IN [1, 2, 3, 4]], o.source, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER) FROM r JOIN o ON o.k = r.k + 1)
SELECT source, bin FROM r WHERE k > 0""")
def w12_balanced_bins(spark, d):
    return R.balanced_bins(_docs(spark, d).groupBy("source").agg(F.sum("n_chars").alias("w")), "source", "w", 4)


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u1_intersection(spark, d):
    return _docs(spark, d).select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def u2_difference(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey").subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))


# --- text projections -----------------------------------------------------------------------


@query("SELECT doc_id, length(CASE WHEN p > 0 THEN substr(text, 1, p - 1) ELSE text END) AS n FROM (SELECT doc_id, text, list_min(list_filter([strpos(text, '. '), strpos(text, chr(10)), strpos(text, ', ')], lambda x: x > 0)) AS p FROM documents)")
def p9_stop_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.length(S.stop_at(F.col("text"), [". ", "\n", ", "])).cast("long").alias("n"))


@query("SELECT doc_id, md5(rtrim(string_split(text, '.')[1])) AS block FROM documents")
def p10_first_block(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(S.first_block(F.col("text"), r"\.")).alias("block"))


@query("SELECT doc_id, TRY_CAST(replace(string_split('x #### ' || n_chars || ',000', '#### ')[-1], ',', '') AS DOUBLE) AS answer FROM documents")
def p19_answer_number(spark, d):
    return _docs(spark, d).select("doc_id", S.answer_number(F.concat(F.lit("x #### "), F.col("n_chars").cast("string"), F.lit(",000"))).alias("answer"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'the')), chr(10))) AS kept FROM documents")
def p20_banner_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(S.without_lines(F.col("text"), "the")).alias("kept"))


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256(source || chr(0) || doc_id), 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS seed FROM documents")
def p25_stable_seed(spark, d):
    return _docs(spark, d).select("doc_id", S.stable_seed(F.col("source"), F.col("doc_id").cast("string")).alias("seed"))


PATCH_SQL = "SELECT doc_id, 'diff --git a/x b/x' || chr(10) || '@@ -1,2 +' || (doc_id % 9 + 1) || ',' || (n_chars % 4) || ' @@' || chr(10) || '+' || replace(text, chr(10), chr(10) || '+') AS patch FROM documents"


def _patches(spark, d):
    body = F.concat(F.lit("diff --git a/x b/x\n@@ -1,2 +"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(","), (F.col("n_chars") % 4).cast("string"), F.lit(" @@\n+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    return _docs(spark, d).select("doc_id", body.alias("patch"))


@query("SELECT doc_id, count(*) AS n, sum(length(l)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1")
def p16_added_lines(spark, d):
    """Added lines of synthetic patches, in hunks only."""
    x = R.added_lines(_patches(spark, d), "doc_id", "patch")
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("SELECT doc_id, CAST(unnest(range(doc_id % 9 + 1, doc_id % 9 + 1 + n_chars % 4)) AS INTEGER) AS line FROM documents")
def p18_changed_lines(spark, d):
    return R.changed_lines(_patches(spark, d), "doc_id", "patch")


# --- reports and validation -----------------------------------------------------------------


@query(f"""WITH {OBF_SQL}, e AS (SELECT config, task, count(DISTINCT g.id) AS tot, count(DISTINCT CASE WHEN solution IS NOT NULL THEN o.id END) AS comp FROM gen g JOIN (SELECT id, solution FROM obf) o ON g.id = o.id GROUP BY 1, 2)
SELECT CAST(floor(comp * 10.0 / tot) AS INTEGER) AS bucket, count(*) AS n, CAST(sum(comp) AS BIGINT) AS comp, CAST(sum(tot) AS BIGINT) AS tot FROM e GROUP BY 1""")
def q5_compile_histogram(spark, d):
    """Experiments (configuration and task) by the tenth of their programs that any variant compiled."""
    one = obf(spark, d).groupBy("id").agg(F.max(F.col("solution").isNotNull()).alias("some"))
    e = gen(spark, d).join(one, "id").groupBy("config", "task").agg(F.countDistinct("id").alias("tot"), F.countDistinct(F.when(F.col("some"), F.col("id"))).alias("comp"))
    return e.groupBy(F.expr("cast(comp * 10 div tot as int)").alias("bucket")).agg(F.count("*").alias("n"), F.sum("comp").alias("comp"), F.sum("tot").alias("tot"))


@query("SELECT lang, sum(n_chars)::BIGINT AS total, count(*) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.9), 6) AS p90 FROM documents WHERE source <> 'src0' GROUP BY 1")
def q6_length(spark, d):
    x = _docs(spark, d).where("source <> 'src0'").select("lang", "n_chars")
    g = x.groupBy("lang").agg(F.sum("n_chars").alias("total"), F.count("*").alias("n"), _r(F.avg("n_chars"), "mean"))
    return N.with_quantiles(g, x, ["lang"], {"p90": ("n_chars", 0.9)}).withColumn("p90", F.round("p90", 6))


@query(f"WITH {OBF_SQL}, a AS (SELECT obf, config, avg(1 - {tail_sql('z2')}) AS auroc FROM obf GROUP BY 1, 2) SELECT obf, round(avg(auroc), 6) AS mean, round(avg(CASE WHEN abs(auroc - 0.5) > 0.05 THEN 1 ELSE 0 END), 6) AS outside, round(stddev_samp(auroc), 6) AS std FROM a GROUP BY 1")
def q7_centralise(spark, d):
    a = obf(spark, d).groupBy("obf", "config").agg(M.ideal_auroc(F.col("z2")).alias("a"))
    return a.groupBy("obf").agg(_r(F.avg("a"), "mean"), _r(F.avg((F.abs(F.col("a") - 0.5) > 0.05).cast("int")), "outside"), _r(F.stddev_samp("a"), "std"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v2_repeated_keys(spark, d):
    return R.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT e.lang, e.n AS expected, coalesce(c.n, 0) AS found FROM (VALUES ('en', 600), ('fr', 150), ('it', 1)) e(lang, n) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) c ON e.lang = c.lang WHERE coalesce(c.n, 0) <> e.n")
def v3_row_counts(spark, d):
    e = spark.createDataFrame([("en", 600), ("fr", 150), ("it", 1)], "lang string, expected int")
    c = _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    return e.join(c, "lang", "left").select("lang", "expected", F.coalesce("n", F.lit(0)).alias("found")).where("found <> expected")


@query("SELECT a.lang, b.source FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT source FROM documents) b EXCEPT SELECT lang, source FROM documents WHERE doc_id % 3 = 0")
def v4_grid_completeness(spark, d):
    """Cells of the (language, source) grid without a document of the class (a few values on either side)."""
    x = _docs(spark, d)
    grid = x.select("lang").distinct().crossJoin(F.broadcast(x.select("source").distinct()))
    return grid.join(x.where("doc_id % 3 = 0").select("lang", "source").distinct(), ["lang", "source"], "left_anti")


@query("SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type <> 'click' GROUP BY 1")
def s8_last_ok(spark, d):
    """The last good row of each key of an append-only log."""
    x = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return R.last_ok(x, "user_id", "event_id", F.col("event_type") != "click").select("user_id", "event_id", "value")
