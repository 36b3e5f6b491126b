"""Detection quality and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf
from .scans import before, order_bin


def score_counts(df: DataFrame, groups: list[str], score: str, positive: str) -> DataFrame:
    """groups, score, pos, neg: one row for each different score, combined before the shuffle."""
    return df.groupBy(*groups, score).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))


def auroc(df: DataFrame, groups: list[str], score: str, positive: str) -> DataFrame:
    """groups, n_pos, n_neg, auroc (ties count half). Ranks come from counts of different scores, inside bins first and then over bins, so that no task holds a group."""
    c = score_counts(df.where(F.col(score).isNotNull()), groups, score, positive).withColumn("_bin", order_bin(F.col(score)))
    below = lambda *by, order: F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("below", below(*groups, "_bin", order=score))
    bins = c.groupBy(*groups, "_bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"))
    bins = bins.withColumn("below", below(*groups, order="_bin"))
    g = bins.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("u") + F.col("pos") * F.col("below")).alias("u"))
    return g.select(*groups, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"))


def tpr_at_fpr(df: DataFrame, groups: list[str], score: str, positive: str, limits: tuple[float, ...]) -> DataFrame:
    """groups and tpr_<i> for each limit: the highest TPR of a threshold whose FPR is within the limit, 0 if none."""
    c = score_counts(df.where(F.col(score).isNotNull()), groups, score, positive)
    x = before(c, groups, score, ["pos", "neg"], descending=True)
    whole = c.groupBy(*[F.col(g).alias(f"_w{k}") for k, g in enumerate(groups)]).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    on = F.lit(True)
    for k, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_w{k}"))
    c = x.join(whole, on).select(*groups, F.try_divide(F.col("pos_before") + F.col("pos"), F.col("_pos")).alias("tpr"), F.try_divide(F.col("neg_before") + F.col("neg"), F.col("_neg")).alias("fpr"))
    return c.groupBy(*groups).agg(*[F.coalesce(F.max(F.when(F.col("fpr") <= x, F.col("tpr"))), F.lit(0.0)).alias(f"tpr_{i}") for i, x in enumerate(limits)])


def ideal_auroc(z: Column) -> Column:
    """Against N(0,1) negatives, closed form: mean of Phi(z)."""
    return F.avg(normal_cdf(z))


def ideal_auroc_grid(df: DataFrame, groups: list[str], score: str, low: float = -15.0, high: float = 15.0, points: int = 3000) -> DataFrame:
    """The same by the trapezoid rule over thresholds. A score is put in its grid cell once; the
    curve is then a running sum over at most `points` cells, not scores times thresholds."""
    step = (high - low) / (points - 1)
    spark = df.sparkSession
    cell = F.least(F.greatest(F.ceil((F.col(score) - low) / step), F.lit(0)), F.lit(points)).cast("int")  # thresholds under the score
    counts = df.where(F.col(score).isNotNull()).groupBy(*groups, cell.alias("cell")).agg(F.count("*").alias("n"))
    keys = counts.select(*groups).distinct()
    grid = spark.range(points).select(F.col("id").cast("int").alias("i"), (F.lit(low) + F.col("id") * step).alias("t"))
    full = keys.crossJoin(F.broadcast(grid)).withColumn("cell", F.col("i") + 1).join(counts, [*groups, "cell"], "left")
    zero = counts.where("cell = 0").groupBy(*groups).agg(F.sum("n").alias("n0"))
    w = Window.partitionBy(*groups).orderBy("i")
    up = w.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*groups)) + F.coalesce("n0", F.lit(0))
    full = full.join(zero, groups, "left").withColumn("tpr", F.sum(F.coalesce("n", F.lit(0))).over(up) / total).withColumn("fpr", 1 - normal_cdf(F.col("t")))
    area = (F.lag("fpr").over(w) - F.col("fpr")) * (F.lag("tpr").over(w) + F.col("tpr")) / 2
    return full.withColumn("area", area).groupBy(*groups).agg(F.sum("area").alias("auroc"))


def multiset_f1(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, precision, recall, f1 of the items of left against those of right (both empty: 1)."""
    c = left.select(*keys, item, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(*keys, item, F.lit(0).alias("a"), F.lit(1).alias("b")))
    c = c.groupBy(*keys, item).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    g = c.groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("both"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    p = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), 1.0).otherwise(F.coalesce(F.try_divide("both", "n_b"), F.lit(0.0)))
    r = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), 1.0).otherwise(F.coalesce(F.try_divide("both", "n_a"), F.lit(0.0)))
    return g.select(*keys, p.alias("precision"), r.alias("recall")).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def majority(df: DataFrame, keys: list[str], answer: str, order: str) -> DataFrame:
    """The most frequent non-null answer of each key; the first seen wins ties."""
    c = df.where(F.col(answer).isNotNull()).groupBy(*keys, answer).agg(F.count("*").alias("votes"), F.min(order).alias("seen"))
    return c.groupBy(*keys).agg(F.max_by(answer, F.struct(F.col("votes"), -F.col("seen"))).alias("answer"), F.max("votes").alias("votes"))


def _gram_key(prefix: Column, last: Column) -> Column:
    """An n-gram as one key with a byte between that no text holds (no last token: two of them): fewer bytes a row to shuffle than two."""
    mark = F.expr("CAST(X'FF' AS STRING)")
    return F.concat(prefix, mark, F.coalesce(last, mark))


def _gram_parts(key: str = "_key") -> list[Column]:
    """prefix and next of such a key."""
    part = lambda k: F.call_function("substring_index", F.col(key), F.expr("CAST(X'FF' AS STRING)"), F.lit(k))
    return [part(1).alias("prefix"), F.when(~F.endswith(key, F.expr("CAST(X'FFFF' AS STRING)")), part(-1)).alias("next")]


def ngram_table(df: DataFrame, toks: Column, n: int) -> DataFrame:
    """prefix, next, count of the n-grams of token arrays."""
    grams = df.select(toks.alias("toks")).select(F.explode(F.when(F.size("toks") >= n, F.transform(F.sequence(F.lit(1), F.size("toks") - n + 1), lambda i: F.slice("toks", i, n)))).alias("g"))
    key = _gram_key(F.array_join(F.slice("g", 1, n - 1), " "), F.element_at("g", -1))
    return grams.groupBy(key.alias("_key")).agg(F.count("*").alias("n")).select(*_gram_parts(), "n")


def ngram_sources(df: DataFrame, doc: str, label: str, toks: Column) -> DataFrame:
    """prefix, next, n, sources, first_doc, first_lang of the bigrams of token arrays: in how many documents they stand, and the label of the first.

    Texts are dealt by document, so that its bigrams become distinct without a shuffle of their own (a document may have
    several rows; those without an id are dealt evenly and are no source); what is shuffled after it is combined."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: texts grow manifold as bigrams
    given = df.where(F.col(doc).isNotNull()).repartition(tasks, doc)
    pairs = F.when(F.size("_t") > 1, F.arrays_zip(F.slice("_t", 1, F.size("_t") - 1).alias("a"), F.slice("_t", 2, F.size("_t") - 1).alias("b")))
    each = lambda x: x.select(F.col(doc).alias("doc"), F.col(label).alias("label"), toks.alias("_t")).select("doc", "label", F.explode(pairs).alias("g")).select("doc", "label", _gram_key(F.col("g.a"), F.col("g.b")).alias("_key"))
    once = each(given).groupBy("_key", "doc").agg(F.count("*").alias("k"), F.any_value("label").alias("label"))
    none = each(df.where(F.col(doc).isNull())).select("_key", "doc", F.lit(1).cast("long").alias("k"), "label")
    out = once.unionByName(none).groupBy("_key").agg(F.sum("k").alias("n"), F.count("doc").alias("sources"), F.min("doc").alias("first_doc"), F.min_by("label", "doc").alias("first_lang"))
    return out.select(*_gram_parts(), "n", "sources", "first_doc", "first_lang")


# The patterns of the mteval normalisation, in their order.
MTEVAL_JOIN = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
MTEVAL_SPLIT = ((r"([\{-~\[-\x60 -&\(-\+:-@/])", r" $1 "), (r"([^0-9])([\.,])", r"$1 $2 "), (r"([\.,])([^0-9])", r" $1 $2"), (r"([0-9])(-)", r"$1 $2 "))
TINY = 2.2250738585072014e-308


def mteval_words(text: Column) -> Column:
    """Lower-cased words with punctuation apart."""
    for old, new in MTEVAL_JOIN:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.lower(F.concat(F.lit(" "), text, F.lit(" ")))
    for pattern, new in MTEVAL_SPLIT:
        text = F.regexp_replace(text, pattern, new)
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def bleu_parts(df: DataFrame, keys: list[str], candidate: Column, references: Column, order: int = 4) -> DataFrame:
    """keys, c (words of the candidate), r (of its shortest reference), hit1.., guess1..: n-grams that a reference has too
    (each at most as often as the reference that has it most), and all. N-grams are counted by key and joined."""
    rows = df.select(*keys, candidate.alias("_c"), references.alias("_r"))

    def grams(x: Column) -> Column:
        own = lambda n: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(x, i, n), " ").alias("g"))))
        return F.flatten(F.array(*[F.coalesce(own(n), F.array().cast("array<struct<n:int,g:string>>")) for n in range(1, order + 1)]))

    a = rows.select(*keys, F.explode(grams(F.col("_c"))).alias("_x")).groupBy(*keys, "_x").agg(F.count("*").alias("_a"))
    b = rows.select(*keys, F.posexplode("_r").alias("_k", "_one")).select(*keys, "_k", F.explode(grams(F.col("_one"))).alias("_x")).groupBy(*keys, "_k", "_x").agg(F.count("*").alias("_b")).groupBy(*keys, "_x").agg(F.max("_b").alias("_b"))
    hits = a.join(b, [*keys, "_x"], "left").groupBy(*keys).agg(*[F.sum(F.when(F.col("_x.n") == n, F.least("_a", F.coalesce("_b", F.lit(0))))).alias(f"hit{n}") for n in range(1, order + 1)])
    lens = rows.select(*keys, F.size("_c").alias("c"), F.array_min(F.transform("_r", F.size)).alias("r"))
    x = lens.join(hits, keys, "left")
    return x.select(*keys, "c", "r", *[F.coalesce(f"hit{n}", F.lit(0)).alias(f"hit{n}") for n in range(1, order + 1)], *[F.greatest(F.col("c") - (n - 1), F.lit(0)).alias(f"guess{n}") for n in range(1, order + 1)])


def bleu(df: DataFrame, keys: list[str], candidate: Column, references: Column, order: int = 4) -> DataFrame:
    """keys, bleu of each row: smoothed above unigrams, the lengths of the brevity penalty one greater. Its mean over ids is the task's score."""
    logs = F.lit(0.0)
    for n in range(1, order + 1):
        add = 0 if n == 1 else 1
        logs = logs + (F.log(F.col(f"hit{n}") + add + F.lit(TINY)) - F.log(F.col(f"guess{n}") + add + F.lit(TINY))) / order
    short = F.least(F.lit(0.0), 1 - (F.col("r") + 1) / (F.col("c") + 1))
    return bleu_parts(df, keys, candidate, references, order).select(*keys, F.exp(logs + short).alias("bleu"))


def corpus_bleu(df: DataFrame, keys: list[str], groups: list[str], candidate: Column, references: Column, order: int = 4) -> DataFrame:
    """groups, bleu of all rows together: counts are added up first, one is added to every precision, and short candidates pay exp(1 - r / c)."""
    parts = bleu_parts(df, [*groups, *keys], candidate, references, order)
    sums = parts.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in (*groups, *keys)])
    logs = F.lit(0.0)
    for n in range(1, order + 1):
        logs = logs + F.log((F.col(f"hit{n}") + 1) / (F.col(f"guess{n}") + 1)) / order
    short = F.when(F.col("c") > F.col("r"), 1.0).when(F.col("c") == 0, 0.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    return sums.select(*groups, (F.exp(logs) * short).alias("bleu"))
