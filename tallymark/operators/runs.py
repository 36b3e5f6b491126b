"""A run's reports: a configuration's whole metric row, high scores by scheme, unions of reports, coverage of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M


def kinds(df: DataFrame, key: str, kind: str, name: str, n: Column | None = None) -> DataFrame:
    """key, name: a map of kind -> rows (or the sum of n), kinds in order."""
    c = df.where(F.col(kind).isNotNull()).groupBy(key, kind).agg((F.sum(n) if n is not None else F.count("*")).cast("long").alias("_n"))
    return c.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind), F.col("_n"))))).alias(name))  # a row for each kind


def metric_rows(configs: DataFrame, generations: DataFrame, transforms: DataFrame, scores: DataFrame, limit: float = 4.0) -> DataFrame:
    """One row for each configuration: its own columns, what was selected, and 24 columns of results.

    configs: config_key and any columns of its own. generations: config_key, task, z. transforms: config_key, task, status,
    baseline_passed, final_passed, changed (booleans), rule_counts map<string, long>. scores: config_key, task, status, z.
    A score counts if its status is ok and z is not null; the same cohort are the generations of scored tasks that have
    a z. AUROCs are by the threshold grid. The baseline is not recomputed, so its drifts are zero."""
    key = "config_key"
    ok = scores.where((F.col("status") == "ok") & F.col("z").isNotNull()).select(key, "task", "z")
    tasks = ok.select(key, "task").distinct()
    cohort = generations.where("z IS NOT NULL").join(tasks, [key, "task"], "left_semi").select(key, "z")
    curve = lambda df, name: M.ideal_auroc_grid(df, [key], "z").withColumnRenamed("auroc", name)
    b, f = F.col("baseline_passed"), F.col("final_passed")
    t = transforms.groupBy(key).agg(F.count("*").alias("transform_rows"), F.count_if(F.col("status") == "ok").alias("transformed_ok"), F.count_if(b).alias("baseline_passed"), F.count_if(f).alias("final_passed"),
                                    F.count_if(b & f).alias("preserved_baseline_passed"), F.count_if(b & ~f).alias("semantic_regressions"), F.count_if("changed").alias("changed_outputs"),
                                    F.sum(F.coalesce(F.try_element_at("rule_counts", F.lit("identity")), F.lit(0))).cast("long").alias("identity_steps"))
    s = scores.groupBy(key).agg(F.count("*").alias("score_rows"))
    z = ok.groupBy(key).agg(F.count("*").alias("scored"), F.avg("z").alias("step100_mean_z"), (F.count_if(F.col("z") > limit) / F.count("*")).alias("step100_detection_rate_z_gt_4"))
    rules = transforms.select(key, F.explode("rule_counts").alias("_rule", "_k"))
    parts = [generations.groupBy(key).agg(F.count("*").alias("attempted")), t, s, z, curve(cohort, "same_cohort_original_auroc"), curve(ok, "step100_auroc"),
             kinds(transforms, key, "status", "transform_status_counts"), kinds(scores, key, "status", "score_status_counts"), kinds(rules, key, "_rule", "rule_counts", F.col("_k"))]
    x = configs
    for p in parts:  # a row for each configuration on either side
        x = x.join(p, key, "left")
    for c in ("attempted", "transform_rows", "transformed_ok", "baseline_passed", "final_passed", "preserved_baseline_passed", "semantic_regressions", "changed_outputs", "identity_steps", "score_rows", "scored"):
        x = x.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    return x.withColumns({
        "same_cohort_saved_original_auroc": F.col("same_cohort_original_auroc"), "baseline_recomputed": F.lit(False), "baseline_z_abs_drift_mean": F.lit(0.0), "baseline_z_abs_drift_max": F.lit(0.0),
        "final_pass1": F.try_divide("final_passed", "attempted"), "conditional_pass_preservation": F.try_divide("preserved_baseline_passed", "baseline_passed"),
    })


def high_z(cases: DataFrame, scheme: str, limit: float = 4.0) -> DataFrame:
    """By scheme and in all (null): cases, means of the old and new score, how many of each are over the limit, regressions, the largest drift of the old score.

    cases: scheme, old_z, new_z, drift, baseline_passed, final_passed."""
    over = lambda c: F.count_if(F.col(c) > limit)
    return cases.rollup(scheme).agg(F.count("*").alias("cases"), F.avg("old_z").alias("old_z_mean"), F.avg("new_z").alias("new_z_mean"), over("old_z").alias("old_z_gt_4"), over("new_z").alias("new_z_gt_4"),
                                    F.count_if(F.col("baseline_passed") & ~F.col("final_passed")).alias("semantic_regressions"), F.max("drift").alias("max_old_score_abs_drift"))


#: The lists of a report, the first one that holds an id counts.
STATES = ("resolved", "unresolved", "error", "empty_patch", "submitted")


class MissingReport(ValueError):
    """A report that should be there is not."""


def report_union(selected: DataFrame, reports: DataFrame, expected: list[str], key: str = "id") -> DataFrame:
    """key, state, reports: each selected id's state over all reports (the first of STATES), and in how many reports it stands.

    reports: report, state, key. Ids that were not selected are left out; selected ones in no list are incomplete. Every
    expected report must have rows, else MissingReport names those without."""
    there = {r[0] for r in reports.where(F.col("report").isin(expected)).select("report").distinct().collect()}  # at most the expected names
    if missing := sorted(set(expected) - there):
        raise MissingReport(", ".join(missing))
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    best = reports.where(F.col("report").isin(expected)).groupBy(F.col(key).alias("_id")).agg(F.min(F.when(rank > 0, rank)).alias("_r"), F.count_distinct("report").alias("reports"))
    x = selected.select(key).distinct().join(best, F.col(key) == F.col("_id"), "left")
    state = F.coalesce(F.try_element_at(F.array(*map(F.lit, STATES)), F.col("_r").cast("int")), F.lit("incomplete"))
    return x.select(key, state.alias("state"), F.coalesce("reports", F.lit(0).cast("long")).alias("reports"))


def key_coverage(rows: DataFrame, tasks: DataFrame, task: str, completion: str, expected: int) -> DataFrame:
    """task, rows, pairs, fault of the tasks whose (task, completion) pairs are not `expected` different ones, once each.

    fault: extra (not among the tasks), missing (fewer pairs), duplicate (a pair twice), more (more pairs)."""
    g = rows.groupBy(F.col(task).alias("_t"), completion).agg(F.count("*").alias("_n")).groupBy("_t").agg(F.sum("_n").alias("rows"), F.count("*").alias("pairs"))
    x = tasks.select(task).distinct().join(g, F.col(task).eqNullSafe(F.col("_t")), "full")
    n, p = (F.coalesce(c, F.lit(0).cast("long")) for c in ("rows", "pairs"))
    known = F.col(task).isNotNull() | F.col("_t").isNull()
    fault = F.when(~known, "extra").when(p < expected, "missing").when(n > p, "duplicate").when(p > expected, "more")
    return x.select(F.coalesce(task, "_t").alias(task), n.alias("rows"), p.alias("pairs"), fault.alias("fault")).where("fault IS NOT NULL")
