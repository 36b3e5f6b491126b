"""Registered queries: matrices, summaries, trimming, joins that check their sides, gates and validations.

Gates and assertions are in the plan (``R.required``): the query fails when its rows are read if the condition is
broken. Test tables stand for the workload as in ``lake``; faults are planted by rules on ids, so that a
validation has something to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import benchmarks as B
from ..operators import detection as D
from ..operators import gates as G
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import rewrite as W
from ..operators import scans as N
from ..sources import files as IO
from .extra import CONFIG_SQL, _configs
from .lake import GEN_SQL, OBF_SQL, VARIANTS, gen, obf, table, tail_sql
from .registry import WINDOW_SQL, _docs, _r, _toks, query

# --- matrices and summaries -----------------------------------------------------------------

#: Four negative classes by rules on the score and the id; a missing score is null.
NEGATIVES = {"passed": ("z - 1", 3), "failed": ("z - 2", 4), "shifted": ("-z", 5), "rounded": ("round(z)", 6)}
LONG_SQL = OBF_SQL + """, pos AS (SELECT id, config, obf, CASE WHEN solution IS NOT NULL THEN round(z2, 4) END AS s FROM obf),
kept AS (SELECT id, config FROM pos GROUP BY 1, 2 HAVING count(s) = 3), neg AS (""" + " UNION ALL ".join(f"SELECT g.id, g.config, '{n}' AS negative, CASE WHEN id % {k} > 0 THEN round({e}, 4) END AS s FROM gen g" for n, (e, k) in NEGATIVES.items()) + ")"


@query(f"""WITH {LONG_SQL}, drops AS (SELECT config, obf, count(*) - count(s) AS d FROM pos GROUP BY 1, 2),
nk AS (SELECT n.* FROM neg n JOIN kept k ON n.id = k.id), pk AS (SELECT p.* FROM pos p JOIN kept k ON p.id = k.id),
r AS (SELECT p.config, negative, obf, avg(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5 ELSE 0 END) AS a FROM pk p JOIN nk n ON p.config = n.config WHERE n.s IS NOT NULL GROUP BY 1, 2, 3),
np AS (SELECT config, count(*) AS n_positive, sha256(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY CAST(id AS VARCHAR))) AS positive_ids FROM kept GROUP BY 1),
nn AS (SELECT config, negative, count(s) AS n_negative, count(*) - count(s) AS dropped_negative, sha256(string_agg(CASE WHEN s IS NOT NULL THEN CAST(id AS VARCHAR) END, chr(10) ORDER BY CAST(id AS VARCHAR))) AS negative_ids FROM nk GROUP BY 1, 2)
SELECT r.config, r.negative, r.obf AS positive, round(a, 6) AS auroc, n_positive, n_negative, positive_ids, negative_ids, nullif(dropped_negative, 0) AS dropped_negative, nullif(d, 0) AS dropped_positive
FROM r JOIN np ON r.config = np.config JOIN nn ON r.config = nn.config AND r.negative = nn.negative JOIN drops ON r.config = drops.config AND r.obf = drops.obf""")
def a10_matrix_4x3(spark, d):
    """AUROC of three positives against four negatives. The cohort is fixed to the programs with a score in all
    positives; a missing negative score shortens its own class only. Drop counts are null instead of 0."""
    x = obf(spark, d)
    pos = x.select("id", "config", "obf", F.when(F.col("solution").isNotNull(), F.round("z2", 4)).alias("s"))
    drops = pos.groupBy("config", "obf").agg(F.nullif(F.count_if(F.col("s").isNull()), F.lit(0)).alias("dropped_positive"))
    kept = pos.groupBy("id", "config").agg(F.count("s").alias("k")).where(F.col("k") == len(VARIANTS)).select("id", "config")
    g = gen(spark, d).join(kept.select("id"), "id", "left_semi")
    classes = F.explode(F.array(*[F.struct(F.lit(n).alias("negative"), F.when(F.col("id") % k > 0, F.round(F.expr(e), 4)).alias("s")) for n, (e, k) in NEGATIVES.items()]))
    neg = g.select("id", "config", classes.alias("v")).select("id", "config", "v.negative", "v.s")
    own = pos.join(kept.select("id"), "id", "left_semi").select("config", "obf", F.explode(F.array(*map(F.lit, NEGATIVES))).alias("negative"), "s", F.lit(True).alias("p"))
    other = neg.where("s IS NOT NULL").select("config", F.explode(F.array(*map(F.lit, VARIANTS))).alias("obf"), "negative", "s", F.lit(False).alias("p"))
    m = M.auroc(own.unionByName(other), ["config", "obf", "negative"], "s", "p").where("auroc IS NOT NULL")
    pid = R.fingerprint(kept, ["config"], "id").select("config", F.col("fp").alias("positive_ids"))
    nid = R.fingerprint(neg.where("s IS NOT NULL"), ["config", "negative"], "id").select("config", "negative", F.col("fp").alias("negative_ids"))
    nn = neg.groupBy("config", "negative").agg(F.nullif(F.count_if(F.col("s").isNull()), F.lit(0)).alias("dropped_negative"))
    m = m.join(pid, "config").join(nid, ["config", "negative"]).join(nn, ["config", "negative"]).join(drops, ["config", "obf"])
    return m.select("config", "negative", F.col("obf").alias("positive"), _r(F.col("auroc"), "auroc"), F.col("n_pos").alias("n_positive"), F.col("n_neg").alias("n_negative"), "positive_ids", "negative_ids", "dropped_negative", "dropped_positive")


@query(f"WITH {OBF_SQL} SELECT config, 'standard_normal' AS negative, obf AS positive, round(avg(1 - {tail_sql('z2')}), 6) AS auroc, count(*) AS n_positive, 'existing' AS source FROM obf WHERE solution IS NOT NULL GROUP BY 1, 3")
def a12_existing_rows(spark, d):
    """The saved N(0,1) rows in the matrix' shape; each configuration must have exactly three."""
    m = obf(spark, d).where("solution IS NOT NULL").groupBy("config", "obf").agg(_r(M.ideal_auroc(F.col("z2")), "auroc"), F.count("*").alias("n_positive"))
    n = m.groupBy(F.col("config").alias("c2")).agg(F.count("*").alias("rows"))
    x = R.required(m.join(n, F.col("config").eqNullSafe(F.col("c2"))), F.col("rows") == len(VARIANTS), "a configuration has not three existing rows")
    return x.select("config", F.lit("standard_normal").alias("negative"), F.col("obf").alias("positive"), "auroc", "n_positive", F.lit("existing").alias("source"))


@query(f"""WITH w AS ({WINDOW_SQL}), v AS (SELECT w.*, d.lang AS config, coalesce(l.quality = 1, false) AS ok FROM w JOIN documents d ON w.doc_id = d.doc_id LEFT JOIN labels l ON w.doc_id = l.doc_id)
SELECT config, count(*) AS scored_cases, count(*) FILTER (NOT invalid) AS valid_cases, count(*) FILTER (invalid) AS invalid_cases, count(*) FILTER (NOT invalid AND prediction) AS detected_cases,
round(count(*) FILTER (NOT invalid AND prediction) * 1.0::DOUBLE / nullif(count(*) FILTER (NOT invalid), 0), 6) AS detection_rate,
round(avg(1 - {tail_sql('z')}) FILTER (NOT invalid), 4) AS auroc_all, round(avg(1 - {tail_sql('z')}) FILTER (NOT invalid AND ok), 4) AS auroc_passed, count(*) FILTER (NOT invalid AND ok) AS passed_cases,
round(avg(z) FILTER (NOT invalid), 5) AS mean_z, round(median(z) FILTER (NOT invalid), 5) AS median_z, round(min(z) FILTER (NOT invalid), 5) AS min_z, round(max(z) FILTER (NOT invalid), 5) AS max_z, round(avg(p) FILTER (NOT invalid), 5) AS mean_p,
CAST(sum(n_scored) FILTER (NOT invalid) AS BIGINT) AS tokens_scored, CAST(sum(n_green) FILTER (NOT invalid) AS BIGINT) AS green_tokens, round(sum(n_green) FILTER (NOT invalid) * 1.0::DOUBLE / nullif(sum(n_scored) FILTER (NOT invalid), 0), 6) AS weighted_green_fraction FROM v GROUP BY 1""")
def a13_full_summary(spark, d):
    """Valid, invalid and detected cases, rates, z and p, AUROCs of all and of the passed cases, and the green share weighted by tokens."""
    ok = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    x = D.scored(_toks(spark, d), D.green_mask(F.col("t"), 3)).join(ok, "doc_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    x = x.withColumns({"z": F.round("z", 6), "p": F.round(S.upper_tail(F.round("z", 6)), 6)})
    x = IO.kept(x.select(F.col("lang").alias("config"), "ok", "z", "p", "n_scored", "n_green", "prediction", "invalid"), "scored")
    v, z = ~F.col("invalid"), F.col("z")
    on = lambda c, also=F.lit(True): F.when(v & also, c)
    g = x.groupBy("config").agg(
        F.count("*").alias("scored_cases"), F.count_if(v).alias("valid_cases"), F.count_if(~v).alias("invalid_cases"), F.count_if(v & F.col("prediction")).alias("detected_cases"),
        _r(F.try_divide(F.count_if(v & F.col("prediction")), F.count_if(v)), "detection_rate"), _r(M.ideal_auroc(on(z)), "auroc_all", 4), _r(M.ideal_auroc(on(z, F.col("ok"))), "auroc_passed", 4), F.count_if(v & F.col("ok")).alias("passed_cases"),
        _r(F.avg(on(z)), "mean_z", 5), _r(F.min(on(z)), "min_z", 5), _r(F.max(on(z)), "max_z", 5), _r(F.avg(on(F.col("p"))), "mean_p", 5),
        F.sum(on(F.col("n_scored"))).cast("long").alias("tokens_scored"), F.sum(on(F.col("n_green"))).cast("long").alias("green_tokens"), _r(F.try_divide(F.sum(on(F.col("n_green"))), F.sum(on(F.col("n_scored")))), "weighted_green_fraction"))
    return N.with_quantiles(g, x.where(v), ["config"], {"median_z": ("z", 0.5)}).withColumn("median_z", F.round("median_z", 5))


#: A transform's seconds and the F1 of its lines, from the length of the text.
_T14 = ("(n_chars % 97) / 100.0", "least(1.0, 0.4 + (n_chars % 61) / 100.0)")
_BANDS = (("exact", 1.0), ("f1_95", 0.95), ("f1_90", 0.9), ("f1_80", 0.8), ("f1_50", 0.5))


@query(f"""WITH {OBF_SQL}, f AS (SELECT o.obf, o.solution IS NOT NULL AS ok, o.passed2, o.passed, o.z2, g.z, CAST({_T14[0]} AS DOUBLE) AS secs, CAST({_T14[1]} AS DOUBLE) AS f1, 1 + n_chars % 3 AS functions FROM obf o JOIN gen g ON o.id = g.id JOIN documents d ON d.doc_id = o.id)
SELECT obf, count(*) FILTER (ok) AS transformed, count(*) FILTER (NOT ok) AS failed, round(avg(secs) FILTER (ok), 6) AS mean_s, round(median(secs) FILTER (ok), 6) AS median_s, round(sum(secs) FILTER (ok), 4) AS total_s, round(sum(secs) FILTER (ok) / sum(functions) FILTER (ok), 6) AS s_per_function,
round(count(*) FILTER (ok AND passed2) * 1.0::DOUBLE / count(*), 6) AS solve_rate, round(count(*) FILTER (ok AND passed AND passed2) * 1.0::DOUBLE / nullif(count(*) FILTER (passed), 0), 6) AS retained_rate,
{', '.join(f"count(*) FILTER (ok AND f1 >= {x}) AS {n}" for n, x in _BANDS)}, round(avg(z2 - z) FILTER (ok), 6) AS mean_z_change, round(median(z2 - z) FILTER (ok), 6) AS median_z_change FROM f GROUP BY 1""")
def a14_full_summary(spark, d):
    """Transforms by status, with times (all, and for each function), solved and retained shares, F1 bands and the paired change of z; all but the counts over transformed rows only."""
    n = _docs(spark, d).select(F.col("doc_id").alias("id"), F.expr(_T14[0]).cast("double").alias("secs"), F.expr(_T14[1]).cast("double").alias("f1"), (1 + F.col("n_chars") % 3).alias("functions"))
    x = obf(spark, d).join(gen(spark, d).select("id", "z"), "id").join(n, "id").withColumn("ok", F.col("solution").isNotNull())
    on = lambda c: F.when(F.col("ok"), c)
    x = IO.kept(x.select("obf", "passed", "passed2", "ok", (F.col("z2") - F.col("z")).alias("gap"), "secs", "f1", "functions"), "transforms")
    p, p2, ok, gap = F.col("passed"), F.col("passed2"), F.col("ok"), F.col("gap")
    g = x.groupBy("obf").agg(
        F.count_if(ok).alias("transformed"), F.count_if(~ok).alias("failed"), _r(F.avg(on(F.col("secs"))), "mean_s"), _r(F.sum(on(F.col("secs"))), "total_s", 4), _r(F.sum(on(F.col("secs"))) / F.sum(on(F.col("functions"))), "s_per_function"),
        _r(F.count_if(ok & p2) / F.count("*"), "solve_rate"), _r(F.try_divide(F.count_if(ok & p & p2), F.count_if(p)), "retained_rate"), *[F.count_if(ok & (F.col("f1") >= b)).alias(n) for n, b in _BANDS], _r(F.avg(on(gap)), "mean_z_change"))
    g = N.with_quantiles(g, x.where("ok"), ["obf"], {"median_s": ("secs", 0.5), "median_z_change": ("gap", 0.5)})
    return g.withColumns({c: F.round(c, 6) for c in ("median_s", "median_z_change")})


@query(f"""WITH {OBF_SQL}, r AS (SELECT o.*, g.z, d.source, CASE WHEN id2 % 5 = 0 THEN 'identity' WHEN id2 % 5 < 3 THEN 'rename' ELSE 'split' END AS rule FROM (SELECT *, id AS id2 FROM obf) o JOIN gen g ON o.id = g.id JOIN documents d ON d.doc_id = o.id),
c AS (SELECT config, obf, rule, count(*) AS n FROM r GROUP BY 1, 2, 3), k AS (SELECT config, obf, to_json(map_from_entries(list((rule, n) ORDER BY rule))) AS rules FROM c GROUP BY 1, 2),
m AS (SELECT config, obf, count(*) AS n, count(*) FILTER (rule = 'identity') AS identity_steps, count(*) FILTER (solution IS NULL) AS errors, round(count(*) FILTER (passed) * 1.0::DOUBLE / count(*), 6) AS baseline_pass1, round(count(*) FILTER (passed2) * 1.0::DOUBLE / count(*), 6) AS pass1,
count(*) FILTER (passed AND passed2) AS preserved, count(*) FILTER (passed AND NOT passed2) AS regressions, round(count(*) FILTER (passed AND passed2) * 1.0::DOUBLE / nullif(count(*) FILTER (passed), 0), 6) AS preserved_given_pass, round(avg(z), 6) AS baseline_z, round(avg(z2), 6) AS mean_z, round(median(z2), 6) AS median_z,
round(avg({tail_sql('z2')}), 6) AS mean_p, round(count(*) FILTER (z > 4) * 1.0::DOUBLE / count(*), 6) AS baseline_detection_rate, round(count(*) FILTER (z2 > 4) * 1.0::DOUBLE / count(*), 6) AS detection_rate, round(avg(1 - {tail_sql('z')}), 6) AS baseline_auroc, round(avg(1 - {tail_sql('z2')}), 6) AS auroc, CAST(sum(len2) AS BIGINT) AS len_sum FROM r GROUP BY 1, 2)
SELECT m.*, round(auroc - baseline_auroc, 6) AS auroc_change, round(pass1 - baseline_pass1, 6) AS pass1_change, rules FROM m JOIN k ON m.config IS NOT DISTINCT FROM k.config AND m.obf = k.obf""")
def a15_metric_row(spark, d):
    """A configuration's row before and after: counts, the rules taken as a map, passes, scores, detection and changes."""
    rule = F.when(F.col("id") % 5 == 0, "identity").when(F.col("id") % 5 < 3, "rename").otherwise("split")
    x = obf(spark, d).join(gen(spark, d).select("id", "z"), "id").withColumn("rule", rule)
    share = lambda c, name: _r(F.count_if(c) / F.count("*"), name)
    p, p2, z, z2 = (F.col(c) for c in ("passed", "passed2", "z", "z2"))
    m = x.groupBy("config", "obf").agg(
        F.count("*").alias("n"), F.count_if(F.col("rule") == "identity").alias("identity_steps"), F.count_if(F.col("solution").isNull()).alias("errors"), share(p, "baseline_pass1"), share(p2, "pass1"), F.count_if(p & p2).alias("preserved"), F.count_if(p & ~p2).alias("regressions"),
        _r(F.try_divide(F.count_if(p & p2), F.count_if(p)), "preserved_given_pass"), _r(F.avg(z), "baseline_z"), _r(F.avg(z2), "mean_z"), _r(F.median(z2), "median_z"), _r(F.avg(S.upper_tail(z2)), "mean_p"), share(z > 4, "baseline_detection_rate"), share(z2 > 4, "detection_rate"),
        _r(M.ideal_auroc(z), "baseline_auroc"), _r(M.ideal_auroc(z2), "auroc"), F.sum("len2").cast("long").alias("len_sum"), *[F.count_if(F.col("rule") == r).alias(f"_{r}") for r in ("identity", "rename", "split")])
    rules = F.map_filter(F.create_map(*[c for r in ("identity", "rename", "split") for c in (F.lit(r), F.col(f"_{r}"))]), lambda k, v: v > 0)
    m = m.withColumn("rules", F.to_json(rules)).withColumn("auroc_change", F.round(F.col("auroc") - F.col("baseline_auroc"), 6)).withColumn("pass1_change", F.round(F.col("pass1") - F.col("baseline_pass1"), 6))
    return m.drop("_identity", "_rename", "_split")


@query(f"WITH {CONFIG_SQL} SELECT config, count(*) AS configs, round(min(auroc), 6) AS min_auroc, round(avg(auroc), 6) AS mean_auroc, round(max(auroc), 6) AS max_auroc, count(*) FILTER (auroc < 0.6) AS below, count(*) FILTER (pass1 = 0) AS errors FROM m GROUP BY ROLLUP (config)")
def a16_scheme_bounds(spark, d):
    """By scheme and in all: configurations, the bounds and mean of AUROC, those below .6 and those without a pass."""
    a = F.col("auroc")
    return _configs(spark, d)[0].rollup("config").agg(F.count("*").alias("configs"), _r(F.min(a), "min_auroc"), _r(F.avg(a), "mean_auroc"), _r(F.max(a), "max_auroc"), F.count_if(a < 0.6).alias("below"), F.count_if(F.col("pass1") == 0).alias("errors"))


@query(f"WITH w AS ({WINDOW_SQL}) SELECT d.lang AS config, count(*) AS n, round(count(*) FILTER (w.z > 2) * 1.0::DOUBLE / count(*), 6) AS detection_rate, round(avg(len(t)), 6) AS mean_len, round(avg(w.n_scored * 1.0::DOUBLE / nullif(len(t), 0)), 6) AS watermarking_fraction, round(avg(w.n_green * 1.0::DOUBLE / nullif(w.n_scored, 0)), 6) AS green_fraction, count(*) FILTER (len(t) = 0) AS empty FROM w JOIN (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents) k ON w.doc_id = k.doc_id JOIN documents d ON d.doc_id = w.doc_id GROUP BY 1")
def a20_evaluator_summary(spark, d):
    """Detection rate, lengths (texts of length 0 count), and fractions over the texts that have one."""
    x = D.scored(_toks(spark, d), D.green_mask(F.col("t"), 3)).withColumn("n", F.size("t"))
    return x.groupBy(F.col("lang").alias("config")).agg(F.count("*").alias("n"), _r(F.count_if(F.round("z", 6) > 2) / F.count("*"), "detection_rate"), _r(F.avg("n"), "mean_len"), _r(F.avg(F.try_divide("n_scored", "n")), "watermarking_fraction"), _r(F.avg(F.try_divide("n_green", "n_scored")), "green_fraction"), F.count_if(F.col("n") == 0).alias("empty"))


# --- detection ------------------------------------------------------------------------------


@query(f"SELECT doc_id, z, z > 2 AS prediction, CASE WHEN z > 2 THEN round(1 - {tail_sql('z')}, 6) END AS confidence FROM ({WINDOW_SQL}) WHERE NOT invalid")
def d9_confidence(spark, d):
    """The prediction at a threshold of 2, with 1 - p for positive ones only; a threshold of 0 or null means the default of 4."""
    x = D.scored(_toks(spark, d), D.green_mask(F.col("t"), 3), threshold=2.0).where("NOT invalid").withColumn("z", F.round("z", 6))
    return x.select("doc_id", "z", "prediction", F.round(D.confidence(F.col("z"), F.col("prediction")), 6).alias("confidence"))


@query(f"WITH w AS ({WINDOW_SQL}), k AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n FROM documents) SELECT w.doc_id, n AS generated, w.n_scored, CASE WHEN w.n_scored = 0 THEN 0 ELSE round(w.n_scored * 1.0::DOUBLE / n, 6) END AS watermarking_fraction, w.z FROM w JOIN k ON w.doc_id = k.doc_id")
def d15_aligned_scores(spark, d):
    """Scores of which the mask must be as long as the tokens behind the prefix (else the query fails), with the share of tokens scored."""
    x = D.scored(_toks(spark, d), D.green_mask(F.col("t"), 3))
    x = R.required(x, F.size("mask") == F.greatest(F.size("t") - 2, F.lit(0)), "a mask does not fit its tokens")
    return x.select("doc_id", F.size("t").cast("long").alias("generated"), F.col("n_scored").cast("long").alias("n_scored"), F.round(F.coalesce(F.try_divide("n_scored", F.size("t")), F.lit(0.0)), 6).alias("watermarking_fraction"), _r(F.col("z"), "z"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents), i AS (SELECT doc_id, len(t) AS n, unnest(range(1, len(t) + 1)) AS i, t FROM t),
e AS (SELECT doc_id, min(i) + 1 AS stop FROM i WHERE t[i] = 'the' AND t[i+1] = 'of' GROUP BY 1), o AS (SELECT doc_id, min(i) - 1 AS eos FROM i WHERE t[i] IN ('de', 'and') GROUP BY 1)
SELECT t.doc_id, CAST(CASE WHEN stop IS NULL AND eos IS NULL THEN len(t) ELSE least(coalesce(stop, 2000000000), coalesce(eos, 2000000000)) END AS BIGINT) AS n, CASE WHEN stop IS NULL AND eos IS NULL THEN 'max_new_tokens' WHEN coalesce(stop, 2000000000) <= coalesce(eos, 2000000000) THEN 'patch_end' ELSE 'eos_token' END AS reason FROM t LEFT JOIN e ON t.doc_id = e.doc_id LEFT JOIN o ON t.doc_id = o.doc_id""")
def d23_trimmed(spark, d):
    """Token lists cut behind the first end sequence or before the first stop token, whichever is earlier (the sequence wins ties), and why."""
    x = _toks(spark, d).withColumn("cut", D.trimmed(F.col("t"), ["the", "of"], ["de", "and"]))
    return x.select("doc_id", F.col("cut.end").cast("long").alias("n"), "cut.reason")


# --- joins ----------------------------------------------------------------------------------


@query("SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def j7_equal_keys(spark, d):
    """Two tables joined on a key that both must hold alike, else the query fails (here the labels and the documents that they name)."""
    lab, doc = table(spark, d, "labels").select("doc_id", "quality"), _docs(spark, d).select("doc_id", "n_chars")
    return R.joined_equal(lab, doc.join(lab.select("doc_id"), "doc_id", "left_semi"), "doc_id")


@query("SELECT d.doc_id, d.lang AS gold, CASE WHEN d.doc_id % 9 = 0 THEN 'en' ELSE d.lang END AS predicted FROM documents d WHERE d.doc_id % 4 > 0 AND d.doc_id % 6 > 0")
def j13_prediction_gold(spark, d):
    """Predictions and gold answers by id; ids of one side only are left out."""
    gold = _docs(spark, d).where("doc_id % 4 > 0").select("doc_id", F.col("lang").alias("gold"))
    own = _docs(spark, d).where("doc_id % 6 > 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "en").otherwise(F.col("lang")).alias("predicted"))
    return gold.join(own, "doc_id")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS g, l_linenumber * 7 AS lo, l_linenumber * 7 + CAST(l_quantity AS INTEGER) AS hi FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS g, l_partkey % 60 AS pt FROM lineitem),
b AS (SELECT DISTINCT g, lo, hi FROM (SELECT p.g, s.lo, s.hi, row_number() OVER (PARTITION BY p.g, p.pt ORDER BY s.hi - s.lo, s.lo DESC) AS r FROM p JOIN s ON p.g = s.g AND p.pt BETWEEN s.lo AND s.hi) WHERE r = 1)
SELECT g, lo, hi FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.g = b.g AND o.lo <= b.lo AND o.hi >= b.hi AND (o.lo < b.lo OR o.hi > b.hi))""")
def j10_outer_spans(spark, d):
    """The smallest spans that hold the points, without those that lie in another one of them."""
    li = table(spark, d, "lineitem")
    s = li.select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") * 7).alias("lo"), (F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int")).alias("hi"))
    p = li.select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 60).alias("pt")).distinct()
    return R.outer_spans(R.smallest_span(p, s, "g", "pt", "lo", "hi").select("g", "lo", "hi").distinct(), "g", "lo", "hi")


# --- reports --------------------------------------------------------------------------------


@query(f"WITH {CONFIG_SQL} SELECT m.config, m.task, round(auroc, 6) AS auroc, row_number() OVER (ORDER BY auroc DESC, m.config, m.task) AS place FROM m JOIN b ON m.config = b.config WHERE auroc > 0.55 AND pass1 > 0.8 * base")
def q8_maintained(spark, d):
    """Configurations that detect (over .55) at little loss against the baseline, the best first (as many rows as configurations)."""
    from pyspark.sql import Window

    m, b = _configs(spark, d)
    x = m.join(b, "config").where("auroc > 0.55D AND pass1 > 0.8D * base")
    return x.select("config", "task", _r(F.col("auroc"), "auroc"), F.row_number().over(Window.orderBy(F.desc("auroc"), "config", "task")).alias("place"))


@query(f"WITH {OBF_SQL}, a AS (SELECT obf, config, task, avg(1 - {tail_sql('z2')}) AS a FROM (SELECT o.*, g.task FROM obf o JOIN gen g ON o.id = g.id) GROUP BY 1, 2, 3) SELECT obf, count(*) AS n, round(avg(a), 6) AS mean, {', '.join(f'round(avg(CASE WHEN a > 0.5 - {x} AND a < 0.5 + {x} THEN 0 ELSE 1 END), 6) AS outside_{k}' for k, x in ((1, 0.01), (5, 0.05), (10, 0.1)))}, round(stddev_samp(a), 6) AS std FROM a GROUP BY 1")
def q7_centralised_limits(spark, d):
    """For each variant the mean AUROC of its experiments and the shares outside .5 +- .01, .05 and .1 (strictly inside counts as inside)."""
    t = gen(spark, d).select("id", "task")
    a = obf(spark, d).join(t, "id").groupBy("obf", "config", "task").agg(M.ideal_auroc(F.col("z2")).alias("a"))
    out = lambda x: F.avg(F.when((F.col("a") > 0.5 - x) & (F.col("a") < 0.5 + x), 0).otherwise(1))
    return a.groupBy("obf").agg(F.count("*").alias("n"), _r(F.avg("a"), "mean"), *[_r(out(x), f"outside_{k}") for k, x in ((1, 0.01), (5, 0.05), (10, 0.1))], _r(F.stddev_samp("a"), "std"))


#: A program's temperature, from its task's number.
_TEMP = "CAST(regexp_extract(task, '[0-9]+$') AS INTEGER) % 4"


@query(f"WITH {GEN_SQL}, t AS (SELECT *, {_TEMP} AS temperature FROM gen) SELECT temperature, round(avg(CASE WHEN config = 'en' THEN (CASE WHEN passed THEN 1.0::DOUBLE ELSE 0 END) END), 6) AS pass1_before, round(avg(CASE WHEN config <> 'en' THEN (CASE WHEN passed THEN 1.0::DOUBLE ELSE 0 END) END), 6) AS pass1_after, round(avg(1 - {tail_sql('z')}), 6) AS auroc, row_number() OVER (ORDER BY temperature) AS place FROM t WHERE temperature IS NOT NULL GROUP BY 1")
def f2_temperature_lines(spark, d):
    """Pass rates before and after, and AUROC, by temperature in ascending order (F2, Q4, W8); both sides must have the same temperatures."""
    from pyspark.sql import Window

    x = gen(spark, d).withColumn("temperature", F.regexp_extract("task", "[0-9]+$", 0).try_cast("int") % 4).where("temperature IS NOT NULL")
    rate = lambda c: F.avg(F.when(c, F.coalesce(F.col("passed"), F.lit(False)).cast("int")))
    m = x.groupBy("temperature").agg(_r(rate(F.col("config") == "en"), "pass1_before"), _r(rate(F.col("config") != "en"), "pass1_after"), _r(M.ideal_auroc(F.col("z")), "auroc"))
    m = R.required(m, F.col("pass1_before").isNotNull() & F.col("pass1_after").isNotNull(), "a temperature stands on one side only")
    return m.withColumn("place", F.row_number().over(Window.orderBy("temperature")))


@query(f"WITH {OBF_SQL}, t AS (SELECT id, 2 + {_TEMP} AS ngram_len, passed, z FROM gen) SELECT t.ngram_len, round(avg(CASE WHEN t.passed THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass1, round(avg(1 - {tail_sql('t.z')}), 6) AS auroc, round(avg(CASE WHEN o.passed2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS variant_pass1, round(avg(1 - {tail_sql('o.z2')}), 6) AS variant_auroc FROM t JOIN obf o ON t.id = o.id WHERE o.obf = 'rename' AND ngram_len IS NOT NULL GROUP BY 1")
def f3_ngram_lengths(spark, d):
    """Pass rate and AUROC by the length of the n-grams, of the programs and of one variant."""
    x = gen(spark, d).select("id", (F.regexp_extract("task", "[0-9]+$", 0).try_cast("int") % 4 + 2).alias("ngram_len"), "z").where("ngram_len IS NOT NULL").join(obf(spark, d).where("obf = 'rename'"), "id")
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    return x.groupBy("ngram_len").agg(_r(rate("passed"), "pass1"), _r(M.ideal_auroc(F.col("z")), "auroc"), _r(rate("passed2"), "variant_pass1"), _r(M.ideal_auroc(F.col("z2")), "variant_auroc"))


@query(f"WITH {CONFIG_SQL} SELECT config, task, round(auroc, 6) AS auroc, CAST(regexp_extract(task, '[0-9]+$') AS INTEGER) AS ngram_len FROM m")
def q9_added_column(spark, d):
    """Saved metric rows read, given the length of their n-grams (from the task's name) and written anew."""
    path = IO.scratch(spark, "metrics")
    m = _configs(spark, d)[0]
    IO.write_jsonl(m.select("config", "task", _r(F.col("auroc"), "auroc")), path)
    old = IO.read_jsonl(spark, path, "config string, task string, auroc double")
    IO.write_jsonl(old.withColumn("ngram_len", F.regexp_extract("task", "[0-9]+$", 0).try_cast("int")), f"{path}-new")
    return IO.read_jsonl(spark, f"{path}-new", "config string, task string, auroc double, ngram_len int")


# --- checks ---------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS runs, min(doc_id) AS run FROM documents WHERE abs((doc_id % 50) / 50.0 - 0.2) < 1e-9 GROUP BY 1 HAVING count(*) <> 1")
def v5_single_run(spark, d):
    """Groups without exactly one run at the expected temperature (equal up to 1e-9)."""
    x = _docs(spark, d).where(F.abs((F.col("doc_id") % 50) / 50.0 - 0.2) < 1e-9)
    return x.groupBy("lang").agg(F.count("*").alias("runs"), F.min("doc_id").alias("run")).where("runs <> 1")


@query("""WITH e AS (SELECT doc_id, doc_id // 100 AS shard, lang FROM documents), f AS (SELECT doc_id, doc_id // 100 AS shard, CASE WHEN doc_id % 31 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 37 = 0 THEN 0.25 ELSE 0.5 END AS gamma FROM documents WHERE doc_id % 17 > 0
UNION ALL SELECT doc_id, doc_id // 100, lang, 0.5 FROM documents WHERE doc_id % 41 = 1 UNION ALL SELECT doc_id + 1000000, doc_id // 100, lang, 0.5 FROM documents WHERE doc_id % 43 = 2),
g AS (SELECT doc_id, count(*) AS n, min(shard) AS shard, min(lang) AS lang, max(lang) AS lang2, min(gamma) AS lo, max(gamma) AS hi FROM f GROUP BY 1)
SELECT coalesce(e.doc_id, g.doc_id) AS doc_id, coalesce(e.shard, g.shard) AS shard, CASE WHEN g.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' WHEN e.lang IS DISTINCT FROM g.lang OR e.lang IS DISTINCT FROM g.lang2 THEN 'wrong_metadata' WHEN lo <> 0.5 OR hi <> 0.5 THEN 'wrong_parameters' END AS fault
FROM e FULL JOIN g ON e.doc_id = g.doc_id WHERE g.doc_id IS NULL OR e.doc_id IS NULL OR n > 1 OR e.lang IS DISTINCT FROM g.lang OR e.lang IS DISTINCT FROM g.lang2 OR lo <> 0.5 OR hi <> 0.5""")
def v6_shard_faults(spark, d):
    """What is wrong with the shards' rows against the tasks: missing, extra, duplicate, of other metadata or other parameters (the first of these)."""
    e = _docs(spark, d).select("doc_id", F.expr("doc_id div 100").alias("shard"), "lang")
    half = F.lit(0.5)
    f = e.where("doc_id % 17 > 0").select("doc_id", "shard", F.when(F.col("doc_id") % 31 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 37 == 0, 0.25).otherwise(half).alias("gamma"))
    f = f.unionAll(e.where("doc_id % 41 = 1").withColumn("gamma", half)).unionAll(e.where("doc_id % 43 = 2").select((F.col("doc_id") + 1000000).alias("doc_id"), "shard", "lang", half.alias("gamma")))
    return R.shard_faults(e, f, "doc_id", ["lang"], {"gamma": 0.5}).select("doc_id", "shard", "fault")


@query(f"WITH {OBF_SQL}, w AS (SELECT config, obf, count(*) AS expected FROM obf GROUP BY 1, 2), s AS (SELECT config, obf, count(*) AS present, count(*) FILTER (solution IS NOT NULL) AS finite, count(*) FILTER (solution IS NULL) AS invalid FROM obf WHERE id % 3 > 0 AND NOT (config = 'de' AND obf = 'strip') GROUP BY 1, 2) SELECT w.config, w.obf, expected, coalesce(present, 0) AS present, expected - coalesce(present, 0) AS missing, coalesce(finite, 0) AS finite, coalesce(invalid, 0) AS invalid FROM w LEFT JOIN s ON w.config IS NOT DISTINCT FROM s.config AND w.obf = s.obf")
def v7_status_report(spark, d):
    """Expected, present, missing, finite and invalid rows of each class, classes without any row included."""
    o = obf(spark, d)
    w = o.groupBy("config", "obf").agg(F.count("*").alias("expected"))
    s = o.where("id % 3 > 0 AND NOT (config = 'de' AND obf = 'strip')").groupBy(F.col("config").alias("c"), F.col("obf").alias("v")).agg(F.count("*").alias("present"), F.count("solution").alias("finite"), F.count_if(F.col("solution").isNull()).alias("invalid"))
    x = w.join(s, F.col("config").eqNullSafe(F.col("c")) & (F.col("obf") == F.col("v")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("config", "obf", "expected", zero("present").alias("present"), (F.col("expected") - zero("present")).alias("missing"), zero("finite").alias("finite"), zero("invalid").alias("invalid"))


_WALK_SQL = """w AS (SELECT conv_id, count(*) AS programs, count(*) - CASE WHEN conv_id % 11 = 0 THEN 2 ELSE 1 END AS trace, CASE WHEN conv_id % 5 > 0 THEN 'ok' ELSE 'error' END AS status,
CASE WHEN conv_id % 10 = 0 THEN 'syntax' WHEN conv_id % 3 = 0 THEN 'projection' END AS error_type, conv_id % 13 > 0 AS detection, conv_id % 19 > 0 AS final FROM conversations GROUP BY conv_id),
r AS (SELECT * FROM w UNION ALL SELECT * FROM w WHERE conv_id % 17 = 0)"""


@query(f"""WITH {_WALK_SQL}, v AS (
SELECT conv_id, 'failure' AS kind, conv_id || ': status ' || status || ' programs ' || programs || ' trace ' || greatest(trace, 0) AS message FROM r WHERE status <> 'ok' AND NOT (programs = 1 AND greatest(trace, 0) = 0 AND coalesce(error_type, '') <> '') AND NOT (programs = 4 AND trace = 3 AND coalesce(error_type, '') = 'projection')
UNION ALL SELECT conv_id, 'programs', conv_id || ': programs ' || programs FROM r WHERE status = 'ok' AND programs <> 4 UNION ALL SELECT conv_id, 'trace', conv_id || ': trace ' || greatest(trace, 0) FROM r WHERE status = 'ok' AND greatest(trace, 0) <> 3
UNION ALL SELECT conv_id, 'detection', conv_id || ': no detection' FROM r WHERE status = 'ok' AND NOT detection UNION ALL SELECT conv_id, 'final', conv_id || ': no final result' FROM r WHERE status = 'ok' AND NOT final
UNION ALL SELECT conv_id, 'duplicate', conv_id || ': ' || count(*) || ' records' FROM r GROUP BY conv_id HAVING count(*) > 1),
m AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY message) AS i FROM v)
SELECT kind, count(*) AS n, string_agg(message, chr(10) ORDER BY i) FILTER (i <= 20) AS messages FROM m GROUP BY 1""")
def v8_walk_faults(spark, d):
    """Violations of walks (conversations: a turn is a program) by kind, with the first messages: failures not allowed, step counts, missing results, repeated records."""
    w = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("programs"))
    k = F.col("conv_id")
    some = lambda n: F.when(k % n > 0, "x")
    w = w.select(k.alias("record_id"), "programs", F.slice("programs", 1, F.greatest(F.size("programs") - F.when(k % 11 == 0, 2).otherwise(1), F.lit(0))).alias("trace"), F.when(k % 5 > 0, "ok").otherwise("error").alias("status"), F.when(k % 10 == 0, "syntax").when(k % 3 == 0, "projection").alias("error_type"), some(13).alias("detection"), some(19).alias("final"))
    x = G.capped(G.walk_violations(w.unionAll(w.where("record_id % 17 = 0")), 3), 20)
    return x.select("kind", "n", F.array_join("messages", "\n").alias("messages"))


@query("WITH c AS (SELECT lang, count(DISTINCT source) AS configs, count(*) AS walks FROM documents GROUP BY 1) SELECT * FROM c")
def v10_frozen_counts(spark, d):
    """Configurations and walks of each scheme, observed in the pass that writes them, against a frozen list on disk; any difference fails the query."""
    path, x = IO.scratch(spark, "frozen"), _docs(spark, d).select("lang", "source")
    G.freeze(x.groupBy("lang").agg(F.count_distinct("source").alias("configs"), F.count("*").alias("walks")), path)
    counts = {"configs": lambda own: F.size(F.collect_set(F.when(own, F.col("source")))), "walks": lambda own: F.count_if(own)}
    out, _ = G.against_frozen(x, path, "lang string, configs long, walks long", "lang", counts)
    return out.groupBy("lang").agg(F.count_distinct("source").alias("configs"), F.count("*").alias("walks"))


@query(f"WITH {CONFIG_SQL} SELECT config, round(avg(auroc), 6) AS auroc, count(*) AS n FROM m GROUP BY 1")
def v11_gated_aggregate(spark, d):
    """An aggregate behind a gate: the pass that makes its rows sees that no configuration has an empty part, else the query fails."""
    m = G.gated(_configs(spark, d)[0], "configurations", no_auroc=F.col("auroc").isNull(), no_pass1=F.col("pass1").isNull())
    return m.groupBy("config").agg(_r(F.avg("auroc"), "auroc"), F.count("*").alias("n"))


@query("SELECT 'b' AS name, count(*) AS n FROM nation")
def s7_latest_file(spark, d):
    """Of several files the one that was written last is read; a sink refuses to write twice."""
    path = IO.scratch(spark, "versions")
    n = table(spark, d, "nation").select("n_nationkey")
    IO.write_once(n.where("n_nationkey < 3").coalesce(1).withColumn("name", F.lit("a")), f"{path}/a")
    IO.write_once(n.coalesce(1).withColumn("name", F.lit("b")), f"{path}/b")
    at = IO.latest(IO.files(spark, path, "*.json*")).first().path
    return spark.read.schema("n_nationkey long, name string").json(at).groupBy("name").agg(F.count("*").alias("n"))


# --- benchmark adapters ---------------------------------------------------------------------

_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_TWO = [("q one", "a one"), ("q two", "a two")]
_NL = "chr(10)"


def _text_sql(text: str) -> str:
    """A constant as SQL."""
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n"))


def _two_sql(entry: str, ask: str, give: str, text: str) -> str:
    shots = "".join(f"\n{ask}:\n{q}{B.PAD}\n{give}:\n{a}{B.PAD}" for q, a in _TWO)
    return f"{_text_sql(f'{entry}{shots}{chr(10)}{ask}:{chr(10)}')} || {text} || {_text_sql(f'{B.PAD}{chr(10)}{give}:{chr(10)}')}"


_HEAD = lambda text, tests: f"'\"\"\"' || chr(10) || {text} || ' Your code should satisfy these tests:' || chr(10) || {tests} || chr(10) || '\"\"\"' || chr(10)"
_TESTS = "'assert a' || chr(10) || 'assert b' || chr(10) || 'assert c'"
#: For each adapter the prompt, what a model says behind it (or in all, from =), and the answer, as SQL over text and item_id.
ADAPTER_SQL = {
    "humaneval": (_STRIP("text"), "'  return 1' || chr(10) || 'class X: pass' || chr(10) || 'def y'", f"{_STRIP('text')} || '  return 1'"),
    "mbpp": (f"{_HEAD(chr(39) + 'first' + chr(39), chr(39) + 'assert x' + chr(39))} || 'x = 1' || chr(10) || {_HEAD('text', f'CASE WHEN item_id = 493 THEN {chr(39)}assert c{chr(39)} ELSE {_TESTS} END')}", "'y = 2  ' || chr(10) || 'print(y)'", f"{_HEAD(chr(39) + 'first' + chr(39), chr(39) + 'assert x' + chr(39))} || 'x = 1' || chr(10) || {_HEAD('text', f'CASE WHEN item_id = 493 THEN {chr(39)}assert c{chr(39)} ELSE {_TESTS} END')} || 'y = 2'"),
    "apps": ("chr(10) || 'QUESTION:' || chr(10) || text || CASE WHEN item_id % 3 = 0 THEN 'def f():' ELSE '' END || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'Use Call-Based format' ELSE chr(10) || 'Use Standard Input format' END || chr(10) || 'ANSWER:' || chr(10)", "'print(1)'", None),
    "ds1000": ("text", "='noise BEGIN SOLUTION' || chr(10) || '<code>' || chr(10) || text || ' </code> # SOLUTION END'", f"text || {_STRIP('text')}"),
    "multiple": (_STRIP("text"), "'a b' || chr(10) || '#end de'", f"{_STRIP('text')} || 'a b'"),
    "gsm8k": ("'Q: q one' || chr(10) || chr(10) || '# solution in Python:' || chr(10) || chr(10) || chr(10) || 'def solution():' || chr(10) || '    \"\"\"q one\"\"\"' || chr(10) || 'a one' || repeat(chr(10), 6) || 'Q: ' || text || chr(10) || chr(10) || '# solution in Python:' || repeat(chr(10), 3)", "'def solution():' || chr(10) || '  return 1' || chr(10) || 'Q: more'", "'def solution():' || chr(10) || '  return 1' || chr(10) || chr(10) || 'print(solution())'"),
    "conala": (_two_sql(B.ONE_LINE["conala"], "Instruction", "Solution", f"CASE WHEN item_id % 2 = 0 THEN 'rewritten' ELSE {_STRIP('text')} END"), "' x = 1 '", "'x = 1'"),
    "concode": (_two_sql(B.ONE_LINE["concode"], "Instruction", "Solution", f"CASE WHEN {_STRIP('text')} LIKE '%.' THEN {_STRIP(f'substr({_STRIP(chr(116) + chr(101) + chr(120) + chr(116))}, 1, length({_STRIP(chr(116) + chr(101) + chr(120) + chr(116))}) - 1)')} ELSE {_STRIP('text')} END"), "' int x = 1; '", "'int x = 1;'"),
    "text_to_text": (_two_sql("Translate the following documentation from Danish to English:\n", "Danish", "English", "text"), "' the text '", "'the text'"),
    "code_to_text_java": (f"text || {_text_sql(B.TEXT_MARKS['other'])}", "' sum two numbers ' || chr(10) || 'and more'", "'sum two numbers '"),
    "code_evaluation_prompts": (f"'system' || chr(10) || chr(10) || 'Human: ' || {_STRIP('text')} || chr(10) || chr(10) || 'Assistant: '", "'yes'", None),
}


def _adapter_sql() -> str:
    out = []
    for name, (prompt, said, answer) in ADAPTER_SQL.items():
        whole = said[1:] if said.startswith("=") else f"({prompt}) || {said}"
        out.append(f"SELECT '{name}' AS name, item_id, md5({prompt}) AS prompt, md5({answer or whole}) AS answer FROM benchmark")
    return " UNION ALL ".join(out)


@query(_adapter_sql())
def s6_adapters(spark, d):
    """Every adapter's prompt of each item, and the answer in a generation (the registry of benchmarks, S6)."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    one = F.struct(F.lit("first").alias("text"), F.array(F.lit("assert x")).alias("test_list"), F.lit("x = 1").alias("code"))
    lists = {"prompt": F.col("text"), "question": F.col("text"), "source": F.col("text"), "code": F.col("text"), "intent": F.col("text"), "nl": F.concat("text", F.lit(" concode_field_sep int x")), "task_id": F.col("item_id")}
    cols = lists | {"test_list": F.array(*map(F.lit, ("assert a", "assert b", "assert c"))), "examples": F.array(one), "starter_code": F.when(F.col("item_id") % 3 == 0, "def f():"), "input_output": F.when(F.col("item_id") % 2 == 0, '{"fn_name": "f"}').otherwise("no json"), "stop_tokens": F.array(F.lit("de "), F.lit("\n#")), "rewritten_intent": F.when(F.col("item_id") % 2 == 0, "rewritten").otherwise("")}
    known, out = B.adapters([("q one", "a one")], _TWO, "system"), None
    for name, (_, said, _) in ADAPTER_SQL.items():
        a = known[name]
        x = b.withColumns(cols).withColumn("p", a.prompt())
        tail = F.expr(said.lstrip("=").replace("chr(10)", "char(10)").replace(" || ", " || "))
        x = x.withColumn("g", tail if said.startswith("=") else F.concat("p", tail))
        x = x.select(F.lit(name).alias("name"), "item_id", F.md5("p").alias("prompt"), F.md5(a.answer(F.col("g"), F.col("p"))).alias("answer"))
        out = x if out is None else out.unionAll(x)
    return out


# --- votes, tables of n-grams, rates, baselines ----------------------------------------------


@query("""WITH a AS (SELECT user_id, round(value) AS answer, count(*) AS votes, min(event_id) AS seen FROM events WHERE event_type <> 'click' AND value IS NOT NULL GROUP BY 1, 2),
m AS (SELECT user_id, answer FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen) AS r FROM a) WHERE r = 1),
g AS (SELECT user_id, round(min(value)) AS gold, count(*) FILTER (event_type = 'click' OR value IS NULL) AS failures FROM events GROUP BY 1)
SELECT count(*) AS users, count(*) FILTER (abs(answer - gold) < 1e-3) AS correct, round(count(*) FILTER (abs(answer - gold) < 1e-3) * 1.0::DOUBLE / count(*), 6) AS accuracy, CAST(sum(failures) AS BIGINT) AS failures FROM g LEFT JOIN m ON g.user_id = m.user_id""")
def a26_vote_accuracy(spark, d):
    """The majority of each key's successful answers (the first seen wins ties) against the gold answer, equal up to 1e-3; failed answers are counted, and a key without an answer is wrong."""
    e = table(spark, d, "events")
    ok = (F.col("event_type") != "click") & F.col("value").isNotNull()
    m = M.majority(e.where(ok).withColumn("answer", F.round("value")), ["user_id"], "answer", "event_id").select(F.col("user_id").alias("u"), "answer")
    g = e.groupBy("user_id").agg(F.round(F.min("value")).alias("gold"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failures"))
    x = g.join(m, F.col("user_id") == F.col("u"), "left")
    right = F.count_if(F.abs(F.col("answer") - F.col("gold")) < 1e-3)
    return x.agg(F.count("*").alias("users"), right.alias("correct"), _r(right / F.count("*"), "accuracy"), F.sum("failures").alias("failures"))


@query("""WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents), w AS (SELECT doc_id, lang, t[i] AS prefix, t[i+1] AS next FROM (SELECT doc_id, lang, t, unnest(range(1, len(t))) AS i FROM t))
SELECT prefix, next, count(*) AS n, count(DISTINCT doc_id) AS sources, min(doc_id) AS first_doc, min_by(lang, doc_id) AS first_lang FROM w GROUP BY 1, 2""")
def a30_ngram_sources(spark, d):
    """Bigrams with how often and in how many documents they stand, and what belongs to the first document that has them."""
    return M.ngram_sources(_docs(spark, d), "doc_id", "lang", D.tokens(F.col("text")))


@query("SELECT event_type, count(*) AS requests, round(sum(value) / (epoch(max(ts)) - epoch(min(ts))), 6) AS rate, quantile_disc(value, 0.1) AS p10 FROM events GROUP BY 1")
def a31_throughput(spark, d):
    """Total over the time from the first to the last request, and the nearest-rank tenth percentile."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, d, "events")
    g = e.groupBy("event_type").agg(F.count("*").alias("requests"), _r(F.sum("value") / (F.max(s) - F.min(s)), "rate"))
    return N.with_quantiles(g, e, ["event_type"], {"p10": ("value", 0.1)}, nearest=True)


@query(f"WITH {GEN_SQL}, m AS (SELECT config, task, CAST(id % 3 AS BIGINT) AS temperature, avg(z) AS m FROM gen GROUP BY 1, 2, 3), b AS (SELECT config, temperature, m AS base FROM m WHERE task = 'src0') SELECT m.config, m.task, m.temperature, round(m - base, 6) AS lift FROM m LEFT JOIN b ON m.config = b.config AND m.temperature = b.temperature WHERE m.config IS NOT NULL")
def j3_baseline_keys(spark, d):
    """The difference from the baseline of the same model and temperature; two baselines that disagree fail the query."""
    m = gen(spark, d).where("config IS NOT NULL").groupBy("config", "task", (F.col("id") % 3).alias("temperature")).agg(F.avg("z").alias("m"))
    x = R.baseline(m, m.where("task = 'src0'"), ["config", "temperature"], "m", "base")
    return x.select("config", "task", "temperature", _r(F.col("m") - F.col("base"), "lift"))


@query(f"WITH {GEN_SQL} SELECT id, config, task, round(z, 6) AS z, CAST(row_number() OVER (ORDER BY z DESC, config, task, id) AS INTEGER) AS rank FROM gen ORDER BY z DESC, config, task, id LIMIT 20")
def w4_exact_top(spark, d):
    """The twenty highest scores by score, configuration and task; fewer than twenty fail the query."""
    top = R.top_k(gen(spark, d).select("id", "config", "task", "z"), 20, F.desc("z"), F.asc("config"), F.asc("task"), F.asc("id"))
    n = top.agg(F.count("*").alias("n"))
    return R.required(top.crossJoin(F.broadcast(n)), F.col("n") == 20, "fewer than twenty cases").select("id", "config", "task", _r(F.col("z"), "z"), "rank")


@query("SELECT d.doc_id, md5(d.text) AS walk, CASE WHEN l.doc_id IS NOT NULL THEN quality ELSE -1 END AS baseline FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def t6_refreshed_baseline(spark, d):
    """Saved walks whose baseline outcome is taken anew where there is one; the walks stay."""
    saved = _docs(spark, d).select("doc_id", F.md5("text").alias("walk"), F.lit(-1).alias("baseline"))
    return W.refreshed(saved, table(spark, d, "labels").select("doc_id", F.col("quality").alias("baseline")), "doc_id", ["baseline"])


@query(f"WITH {GEN_SQL} SELECT id, CASE WHEN NOT coalesce(passed, false) THEN 'baseline_failed' WHEN id % 9 = 0 THEN 'obfuscator_error' WHEN toxic THEN 'preserved' ELSE 'regression' END AS status FROM gen")
def x3_differential_status(spark, d):
    """What became of each program: its baseline failed, the tool failed, or its tests pass as before or no more."""
    state = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "passed").otherwise("failed")
    return gen(spark, d).select("id", W.differential(state("passed"), state("toxic"), F.col("id") % 9 == 0).alias("status"))


@query(f"WITH {GEN_SQL} SELECT id, id % 10 = 0 AS invalid, CASE WHEN id % 10 <> 0 AND z > 0 THEN round(z, 6) END AS z, CASE WHEN id % 10 = 0 THEN 'failed' WHEN z > 0 THEN 'ok' ELSE 'no_detection' END AS status FROM gen")
def t5_transform_rows(spark, d):
    """Transform rows as they are saved: a nested detection that only transformed programs have, and errors as rows."""
    x = gen(spark, d).select("id", (F.col("id") % 10 == 0).alias("invalid"), "z")
    x = x.withColumn("detection", F.when(~F.col("invalid") & (F.col("z") > 0), F.struct(F.round("z", 6).alias("z"), F.lit("ok").alias("status"))))
    return x.select("id", "invalid", "detection.z", F.coalesce("detection.status", F.when(F.col("invalid"), "failed").otherwise("no_detection")).alias("status"))
