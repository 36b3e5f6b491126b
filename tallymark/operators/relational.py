"""Cohorts, lookups, sampling, sharding and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import before


def cohort(variants: DataFrame, key: str, variant: str, value: str) -> DataFrame:
    """Keys whose value is non-null for every variant that occurs."""
    some = variants.where(F.col(value).isNotNull()).select(key, variant).distinct().groupBy(key).agg(F.count("*").alias("n"))
    need = variants.agg(F.count_distinct(variant).alias("need"))
    return some.join(F.broadcast(need), F.col("n") == F.col("need")).select(key)  # one row


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def baseline(rows: DataFrame, base: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the baseline of their keys; two different baselines of one key are an error."""
    b = base.groupBy(*keys).agg(F.min(value).alias(name), F.max(value).alias("_hi"))
    ok = F.when(F.col(name).eqNullSafe(F.col("_hi")), F.col(name)).otherwise(F.raise_error(F.lit("conflicting baselines")).cast("double"))
    return rows.join(b.withColumn(name, ok).drop("_hi"), keys, "left")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side ('missing' in left, 'extra' in left) where the key sets differ."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    j = a.join(b, key, "full").where("l IS NULL OR r IS NULL")
    return j.select(key, F.when(F.col("l").isNull(), "missing").otherwise("extra").alias("side"))


def smallest_span(points: DataFrame, spans: DataFrame, group: str, at: str, low: str, high: str, bucket: int = 1024) -> DataFrame:
    """Each point with the smallest span of its group that holds it (ties: the later start).

    Spans are put in every bucket they touch, points in theirs: an equi-join on (group, bucket).
    """
    s = spans.select(F.col(group).alias("_g"), low, high, F.explode(F.sequence(F.expr(f"cast({low} div {bucket} as long)"), F.expr(f"cast({high} div {bucket} as long)"))).alias("_b"))
    p = points.withColumn("_pb", F.expr(f"cast({at} div {bucket} as long)"))
    j = p.join(s, (F.col(group) == F.col("_g")) & (F.col("_pb") == F.col("_b")) & (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    best = j.groupBy(group, at).agg(F.min(F.struct((F.col(high) - F.col(low)).alias("w"), (-F.col(low)).alias("s"))).alias("m"))
    return best.select(group, at, (-F.col("m.s")).alias(low), (F.col("m.w") - F.col("m.s")).alias(high))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by the order, with their rank (a bounded sort, then a window over k rows)."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hashed_sample(df: DataFrame, groups: list[str], key: str, n: int) -> DataFrame:
    """n rows of each group, the least by sha256(groups NUL key)."""
    h = F.sha2(F.concat_ws("\0", *[F.col(g).cast("string") for g in groups], F.col(key).cast("string")), 256)
    return df.withColumn("_o", F.row_number().over(Window.partitionBy(*groups).orderBy(h))).where(F.col("_o") <= n).drop("_o")


def slices(df: DataFrame, groups: list[str], key: str, size: int) -> DataFrame:
    """df with its slice number: `size` rows each, in the order of the number key."""
    x = before(df.withColumn("_one", F.lit(1)), groups, key, ["_one"])
    return x.withColumn("slice", F.floor(F.col("_one_before") / size)).drop("_one", "_one_before")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def single_valued(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """groups, value, ok: whether the column is one value, or null, throughout the group."""
    g = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count(column).alias("some"), F.min(column).alias("value"), F.max(column).alias("_hi"))
    ok = (F.col("some") == 0) | ((F.col("some") == F.col("n")) & (F.col("value") == F.col("_hi")))
    return g.select(*groups, "value", ok.alias("ok"))


def fingerprint(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """groups, n, fp: sha256 of each group's sorted ids, one to a line."""
    k = F.col(key).cast("string")
    return df.select(*groups, k.alias("_k")).distinct().groupBy(*groups).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("_k")), "\n"), 256).alias("fp"))


def last_ok(df: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """An append-only log's last good row for each key (an aggregate, so a hot key is combined early)."""
    rest = [c for c in df.columns if c != key]
    g = df.where(ok).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return g.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def added_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """key, pos, line: lines that a unified diff adds, inside hunks only."""
    return patches.select(key, F.posexplode(added(F.col(patch))).alias("pos", "line"))


def added(patch: Column) -> Column:
    """The added lines as an array, in order."""
    parts = F.filter(F.split(patch, r"(?m)^(?=@@|diff )"), lambda p: F.startswith(p, F.lit("@@")))
    plus = F.flatten(F.transform(parts, lambda p: F.filter(F.split(p, "\n"), lambda x: F.startswith(x, F.lit("+")))))
    return F.transform(plus, lambda x: F.substring(x, 2, 1 << 30))


def changed_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """key, line: post-image line numbers that the hunk headers name (default count 1, 0: none)."""
    heads = F.regexp_extract_all(patch, F.lit(r"(?m)^@@ -[0-9,]+ \+([0-9]+(?:,[0-9]+)?) @@"), F.lit(1))
    h = patches.select(key, F.explode(heads).alias("h")).select(key, F.split_part("h", F.lit(","), F.lit(1)).cast("int").alias("a"), F.when(F.contains("h", F.lit(",")), F.split_part("h", F.lit(","), F.lit(2)).cast("int")).otherwise(1).alias("n"))
    return h.where("n > 0").select(key, F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)).alias("line"))


def balanced_bins(df: DataFrame, key: str, weight: str, bins: int) -> DataFrame:
    """key, bin: longest first to the least loaded bin (index breaks ties). A sequential rule: for
    bounded lists of work items only; rows of data are dealt by Spark's own partitioning."""
    import heapq

    heap, out = [(0.0, b) for b in range(bins)], []
    for k, w in df.select(key, weight).orderBy(F.desc(weight), key).limit(100_001).collect():
        load, b = heapq.heappop(heap)
        out.append((k, b))
        heapq.heappush(heap, (load + w, b))
    if len(out) > 100_000:
        raise ValueError("balanced_bins is for at most 100,000 work items")
    return df.sparkSession.createDataFrame(out, f"{key} {dict(df.dtypes)[key]}, bin int")


def required(df: DataFrame, ok, message: str) -> DataFrame:
    """df; reading a row of which `ok` is not true fails with the message."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def joined_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right on a key whose values both must hold once each alike; reading a row of one side only fails."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    x = required(a.join(b, key, "full"), F.col("_l").isNotNull() & F.col("_r").isNotNull(), f"both sides must hold the same {key}")
    return x.drop("_l", "_r")


def outer_spans(spans: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """The distinct spans of a group that lie in no other one: in the order of their starts (the longest first) those
    that end behind all before them. A group is one source file's spans."""
    w = Window.partitionBy(group).orderBy(low, F.desc(high)).rowsBetween(Window.unboundedPreceding, -1)
    x = spans.withColumn("_far", F.max(high).over(w))
    return x.where(F.col("_far").isNull() | (F.col(high) > F.col("_far"))).drop("_far")


def shard_faults(expected: DataFrame, found: DataFrame, key: str, same: list[str], fixed: dict) -> DataFrame:
    """key, shard, fault: the first of missing, extra, duplicate, wrong_metadata, wrong_parameters that holds for a key.

    same: columns in which found rows must equal the expected; fixed: values that found rows must have."""
    lows = [c for s in same for c in (F.min(s).alias(f"_lo_{s}"), F.max(s).alias(f"_hi_{s}"), F.count_if(F.col(s).isNull()).alias(f"_no_{s}"))]
    odd = [F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(f"_odd_{c}") for c, v in fixed.items()]
    g = found.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.min("shard").alias("_shard"), *lows, *odd)
    x = expected.join(g, F.col(key) == F.col("_key"), "full")
    meta = F.lit(False)
    for s in same:
        meta = meta | ~F.col(s).eqNullSafe(F.col(f"_lo_{s}")) | ~F.col(s).eqNullSafe(F.col(f"_hi_{s}")) | ((F.col(f"_no_{s}") > 0) & F.col(s).isNotNull())
    wrong = F.lit(False)
    for c in fixed:
        wrong = wrong | (F.col(f"_odd_{c}") > 0)
    fault = F.when(F.col("_key").isNull(), "missing").when(F.col(key).isNull(), "extra").when(F.col("_n") > 1, "duplicate").when(meta, "wrong_metadata").when(wrong, "wrong_parameters")
    return x.select(F.coalesce(key, "_key").alias(key), F.coalesce("shard", "_shard").alias("shard"), fault.alias("fault")).where("fault IS NOT NULL")
