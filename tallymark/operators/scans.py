"""Running totals and order statistics of groups of any size.

No task holds a group. Values fall into bins that keep their order: a bin's number is a step
function of the value, so it needs neither a sample nor a second look. Totals by bin are a
small table; running sums over it give what lies before each bin, and what is left to do
happens inside single bins. Order statistics look into the bins that hold them, split those
anew between their own bounds, and so on until a bin's values are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import dropped, kept

#: Bins for each factor of e in the size of a value; sub-bins of a split; values that a bin may hold at the end.
FINE, SPLIT, FEW = 4096, 4096, 4096
SMALLEST = 1e-6
#: Group and interval tables of so many rows at most are broadcast.
BROADCAST = 50_000


def order_bin(x: Column, fine: int = FINE) -> Column:
    """A long that never falls as the number x rises (null for null, NaN above all): signed logarithmic steps."""
    v = x.cast("double")
    size = F.floor(F.log1p(F.least(F.abs(v), F.lit(1e300)) / SMALLEST) * fine)
    return F.when(F.isnan(v), F.lit(1 << 62)).when(v < 0, -size).when(v.isNotNull(), size).cast("long")  # least() passes over nulls


def _same(left: list[Column], right: list[Column]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & a.eqNullSafe(b)
    return on


def before(df: DataFrame, groups: list[str], order: str, sums: list[str], descending: bool = False, fine: int = FINE) -> DataFrame:
    """df with `<s>_before` for each s of sums: its total over the rows of the group that come earlier by the number `order`.

    Rows that tie in `order` come in any order; aggregate them first where that matters. A null comes first (last
    if descending). df is written once, as it is read for its totals and for its rows."""
    rows = kept(df.withColumn("_bin", order_bin(F.col(order), fine)), "ordered")
    totals = rows.groupBy(*groups, "_bin").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    turn = (lambda c: F.desc_nulls_last(c)) if descending else (lambda c: F.asc_nulls_first(c))
    ahead = Window.partitionBy(*groups).orderBy(turn("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_bin").alias("_b"), *[F.coalesce(F.sum(f"_sum_{s}").over(ahead), F.lit(0)).alias(f"_off_{s}") for s in sums])
    own = Window.partitionBy(*groups, "_bin").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_own_{s}": F.coalesce(F.sum(s).over(own), F.lit(0)) for s in sums})
    x = rows.join(offsets, _same([F.col(c) for c in (*groups, "_bin")], [*[F.col(f"_g{k}") for k in range(len(groups))], F.col("_b")]))
    return x.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_own_{s}") + F.col(f"_off_{s}")).alias(f"{s}_before") for s in sums])


def _found(bins: DataFrame, keys: list[str], order: str, wanted: DataFrame, names: list[str]) -> DataFrame:
    """wanted (keys as `_k<i>`, _i, _r) with the columns `names` of the bin that holds row _r, counted inside it; bins: keys, order, _n."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    c = bins.withColumn("_upto", F.sum("_n").over(w))
    on = _same([F.col(k) for k in keys], [F.col(f"_k{j}") for j in range(len(keys))])
    x = c.join(wanted, on & (F.col("_r") <= F.col("_upto")) & (F.col("_r") > F.col("_upto") - F.col("_n")))
    return x.select(*[f"_k{j}" for j in range(len(keys))], "_i", (F.col("_r") - F.col("_upto") + F.col("_n")).alias("_r"), *names)


def order_statistics(df: DataFrame, groups: list[str], value: str, ranks: list[Callable[[Column], Column]], few: int = FEW, split: int = SPLIT, fine: int = FINE) -> DataFrame:
    """groups, n (numbers, nulls and NaN left out) and r0, r1, ...: the value at each rank (from 1, a function of n).

    Exact. A pass is one aggregate into bins; the first splits by size, each later one splits the bins that hold a
    rank between their least and greatest value. Passes end when those bins hold one value or `few` rows at most."""
    g = [f"_g{k}" for k in range(len(groups))]
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(groups, g)], v.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    rows = kept(rows.withColumn("_bin", order_bin(F.col("_v"), fine)), "selection")
    bins = kept(rows.groupBy(*g, "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "selection-bins")
    total = bins.groupBy(*g).agg(F.sum("_n").alias("n"))
    asked = F.posexplode(F.array(*[f(F.col("n")).cast("long") for f in ranks])).alias("_i", "_r")
    wanted = total.select(*[F.col(a).alias(f"_k{j}") for j, a in enumerate(g)], asked)
    found = kept(_found(bins, g, "_bin", wanted, ["_lo", "_hi", "_n"]), "selection-found")
    while True:
        most, many = found.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_n"))), F.count("*")).first()
        last = not most or most <= few
        open_ = found.where("_lo < _hi").select(*[F.col(f"_k{j}").alias(f"_o{j}") for j in range(len(g))], F.col("_lo").alias("_a"), F.col("_hi").alias("_z")).distinct()
        open_ = F.broadcast(open_) if many <= BROADCAST else open_  # intervals: ranks x groups at most
        inside = rows.join(open_, _same([F.col(a) for a in g], [F.col(f"_o{j}") for j in range(len(g))]) & (F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_z"))).select(*g, "_a", "_z", "_v")
        at = F.col("_v") if last else F.least(F.floor((F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_z") / 2 - F.col("_a") / 2) * split), F.lit(split - 1))
        cells = inside.groupBy(*g, "_a", "_z", at.alias("_at")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        keys = [*g, "_a", "_z"]
        asked = found.where("_lo < _hi").select(*[F.col(f"_k{j}") for j in range(len(g))], F.col("_lo").alias(f"_k{len(g)}"), F.col("_hi").alias(f"_k{len(g) + 1}"), "_i", "_r")
        narrowed = _found(cells, keys, "_at", asked, ["_lo", "_hi", "_n"]).select(*[f"_k{j}" for j in range(len(g))], "_i", "_r", "_lo", "_hi", "_n")
        wider, found = found, kept(found.where("_lo = _hi").select(narrowed.columns).union(narrowed), "selection-found")
        dropped(wider)
        if last:
            break
    picked = found.groupBy(*[f"_k{j}" for j in range(len(g))]).agg(*[F.max(F.when(F.col("_i") == i, F.col("_lo"))).alias(f"r{i}") for i in range(len(ranks))])
    out = total.join(picked, _same([F.col(a) for a in g], [F.col(f"_k{j}") for j in range(len(g))]))
    out = kept(out.select(*[F.col(a).alias(c) for a, c in zip(g, groups)], "n", *[f"r{i}" for i in range(len(ranks))]), "selected")
    dropped(rows, bins, found)
    return out


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """The rank ceil(q n), 1 at least."""
    return lambda n: F.greatest(F.ceil(F.lit(q) * n), F.lit(1))


def with_quantiles(base: DataFrame, df: DataFrame, groups: list[str], asked: dict[str, tuple[str, float]], nearest: bool = False) -> DataFrame:
    """base (one row a group) with a column for each of asked: name -> (column, q), by linear interpolation or by nearest rank.

    The median is q .5. Null where a group has no number."""
    out = base
    by_column: dict[str, list[tuple[str, float]]] = {}
    for name, (column, q) in asked.items():
        by_column.setdefault(column, []).append((name, q))
    for column, own in by_column.items():
        ranks = []
        for _, q in own:
            if nearest:
                ranks.append(nearest_rank(q))
            else:
                ranks += [lambda n, q=q: F.floor((n - 1) * q) + 1, lambda n, q=q: F.ceil((n - 1) * q) + 1]
        s = order_statistics(df, groups, column, ranks)
        for k, (name, q) in enumerate(own):
            if nearest:
                s = s.withColumn(name, F.col(f"r{k}"))
            else:
                low, high, at = F.col(f"r{2 * k}"), F.col(f"r{2 * k + 1}"), (F.col("n") - 1) * q
                s = s.withColumn(name, low + (high - low) * (at - F.floor(at)))
        s = s.select(*[F.col(g).alias(f"_q{j}") for j, g in enumerate(groups)], *[n for n, _ in own])
        out = out.join(s, _same([F.col(g) for g in groups], [F.col(f"_q{j}") for j in range(len(groups))]), "left").drop(*[f"_q{j}" for j in range(len(groups))])
    return out
