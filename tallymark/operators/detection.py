"""N-gram watermark detection on token arrays.

A document's score needs its own tokens only, so everything happens inside the row
(higher-order functions): no explode, no shuffle, however long the corpus. The
pseudo-random partition is md5 based; ``prf`` may be any function of columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import upper_tail, z_score

WORD = "[a-z]+"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it and wherever the optimiser moves it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def segments(prefix: Column, suffix: Column) -> Column:
    """struct(tokens, prefix_len) of a prompt's tokens and a continuation's. A continuation of one token or none is dropped."""
    whole = F.when(F.size(suffix) <= 1, prefix).otherwise(F.concat(prefix, suffix))
    return F.struct(whole.alias("tokens"), F.size(prefix).alias("prefix_len"))


def context(toks: Column, i: Column, n: int) -> Column:
    """The n - 1 tokens before position i (from 0), the nearest first, joined by commas."""
    return F.concat_ws(",", *[F.get(toks, i - k) for k in range(1, n)])


def md5_green(gamma: float = 0.5, key: str = "k") -> Callable[[Column, Column], Column]:
    """Green if the first four hex digits of md5(key|context|token) are under gamma of their range."""
    most = int(gamma * 65536)  # four hex digits compare as text as they do as numbers
    return lambda ctx, tok: F.substring(F.md5(F.concat_ws("|", F.lit(key), ctx, tok)), 1, 4) < (f"{most:04x}" if most < 65536 else "g")


def positions(toks: Column, start: Column | int) -> Column:
    s = F.lit(start) if isinstance(start, int) else start
    return F.when(F.size(toks) > s, F.sequence(s, F.size(toks) - 1)).otherwise(F.array().cast("array<int>"))


def green_mask(toks: Column, n: int, prf=None, start: Column | int | None = None) -> Column:
    prf = prf or md5_green()
    return let(toks, lambda t: F.transform(positions(t, n - 1 if start is None else start), lambda i: prf(context(t, i, n), F.get(t, i))))


def scored(df: DataFrame, mask: Column, gamma: float = 0.5, threshold: float | None = 4.0, by: str = "mask") -> DataFrame:
    """df with n_scored, n_green, z, p, prediction and invalid: no scored token means z 0, p .5, no prediction.

    A threshold of None or 0 means the default of 4."""
    # by explode of one: however often the mask is used and filters are pushed down, it is made once
    m = df.drop(by).select("*", F.explode(F.array(mask)).alias(by))
    t, g = F.size(by), F.size(F.filter(by, lambda x: x))
    return with_scores(m, t, g, gamma, threshold)


def with_scores(df: DataFrame, t: Column, g: Column, gamma: float = 0.5, threshold: float | None = 4.0) -> DataFrame:
    """df with the columns of `scored` from how many tokens were scored and how many of them are green."""
    z = F.coalesce(z_score(g, t, gamma), F.lit(0.0))
    m = df.select("*", t.alias("n_scored"), g.alias("n_green"), z.alias("z"), (t < 1).alias("invalid"))
    return m.withColumn("p", upper_tail(F.col("z"))).withColumn("prediction", F.col("z") > (threshold or 4.0))


def high_entropy(toks: Column, entropy: Column, n: int, tau: float, shift: bool, prf=None) -> Column:
    """Mask of the positions whose entropy is over tau; shift: entropy[i] describes the next token."""
    e = F.concat(F.array(F.lit(0.0)), F.slice(entropy, 1, F.greatest(F.size(entropy) - 1, F.lit(0)))) if shift else entropy
    prf = prf or md5_green()

    def mask(x: Column) -> Column:
        where = F.filter(positions(x["t"], n - 1), lambda i: F.get(x["e"], i) > tau)
        return F.transform(where, lambda i: prf(context(x["t"], i, n), F.get(x["t"], i)))

    return let(F.struct(toks.alias("t"), e.alias("e")), mask)


def pair_rank(logits: Column, token: Column) -> Column:
    """The place of a token (from 0) in the order of falling logits, ties by number; null for a token outside."""
    own = F.get(logits, token)
    before = F.size(F.filter(logits, lambda x, i: (x > own) | ((x == own) & (i < token))))
    return F.when(own.isNotNull(), before)


def pair_bit_green(logits: Column, token: Column, seed: Column) -> Column:
    """One of each two neighbours in the order of falling logits is green, by a bit of md5(seed|pair); an odd last one by the bit itself."""

    def judge(r: Column) -> Column:
        pair = F.floor(r / 2)
        bit = F.substring(F.md5(F.concat_ws("|", seed.cast("string"), pair.cast("string"))), 1, 1) >= "8"
        return F.when(pair * 2 + 1 < F.size(logits), (r % 2 == 1) == bit).otherwise(bit)

    return let(pair_rank(logits, token), lambda r: F.when(r.isNotNull(), judge(r)))


def confidence(z: Column, prediction: Column) -> Column:
    """1 - p of positive predictions; null for the others."""
    return F.when(prediction, 1 - upper_tail(z))


def trimmed(toks: Column, end: list[str], stops: list[str]) -> Column:
    """struct(end, reason): where a generation ends, behind the first `end` sequence or before the first stop token.

    The earlier one counts and the sequence wins ties; with neither the whole is kept (max_new_tokens)."""
    want, n = F.array(*map(F.lit, end)), len(end)

    def cut(t: Column) -> Column:
        at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        seq = F.get(F.filter(at, lambda i: F.slice(t, i, n) == want), F.lit(0)) + (n - 1)
        stop = F.array_min(F.filter(F.array(*[F.array_position(t, s) for s in stops]), lambda i: i > 0)) - 1
        options = F.filter(F.array(F.struct(seq.cast("long").alias("end"), F.lit(0).alias("rank"), F.lit("patch_end").alias("reason")), F.struct(stop.cast("long").alias("end"), F.lit(1).alias("rank"), F.lit("eos_token").alias("reason"))), lambda o: o["end"].isNotNull())
        first = F.array_min(options)
        return F.struct(F.coalesce(first["end"], F.size(t).cast("long")).alias("end"), F.coalesce(first["reason"], F.lit("max_new_tokens")).alias("reason"))

    return let(toks, cut)


def running_z(df: DataFrame, keys: list[str], mask: str = "mask", gamma: float = 0.5) -> DataFrame:
    """keys, t, z: the z-score after each scored token."""
    rows = df.select(*keys, F.posexplode(mask).alias("t0", "g"))
    w = Window.partitionBy(*keys).orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, (F.col("t0") + 1).alias("t"), z_score(F.sum(F.col("g").cast("int")).over(w), F.col("t0") + 1, gamma).alias("z"))


def ngram_scores(df: DataFrame, keys: list[str], toks: str, n: int, prf=None, switch: Callable[[Column, Column], Column] | None = None, threshold: float = 0.0, repeats: bool = False, gamma: float = 0.5) -> DataFrame:
    """keys, n_scored, n_green, z, p of each row's n-grams, in the row (no row for texts without an n-gram).

    Each distinct n-gram counts once, or as often as it occurs with `repeats`. switch(context, token): a learned gate;
    only n-grams whose value is over the threshold are scored, and with none of them z is 0 and p 1."""
    prf = prf or md5_green()
    over = (lambda c, t: switch(c, t) > threshold) if switch else (lambda c, t: F.lit(True))
    # an n-gram's text with its marks (scored, green): texts are made distinct by hashing, structs pair by pair
    mark = lambda c, t: F.concat(c, F.lit("\0"), t, F.when(F.coalesce(over(c, t), F.lit(False)), F.when(prf(c, t), "2").otherwise("1")).otherwise("0"))
    grams = let(F.col(toks), lambda t: F.transform(positions(t, n - 1), lambda i: mark(context(t, i, n), F.get(t, i))))
    grams = grams if repeats else F.array_distinct(grams)
    ends = lambda y, *m: F.substring(y, -1, 1).isin(*m)
    counts = let(grams, lambda g: F.struct(F.size(g).alias("_any"), F.size(F.filter(g, lambda y: ends(y, "1", "2"))).cast("long").alias("n_scored"), F.size(F.filter(g, lambda y: ends(y, "2"))).cast("long").alias("n_green")))
    # one row or none by explode: a filter would be pushed below and make everything twice
    x = df.select(*keys, F.explode(F.filter(F.array(counts), lambda c: c["_any"] > 0)).alias("_c")).select(*keys, "_c.n_scored", "_c.n_green")
    z = z_score(F.col("n_green"), F.col("n_scored"), gamma)
    return x.withColumn("z", F.coalesce(z, F.lit(0.0))).withColumn("p", F.when(F.col("n_scored") == 0, 1.0).otherwise(upper_tail(F.col("z"))))


def g_values(toks: Column, n: int, keys: int) -> Column:
    """Bits of each window's hash under each key, flattened (SynthID-like)."""
    w = let(toks, lambda t: F.transform(positions(t, n - 1), lambda i: F.concat_ws(",", F.slice(t, i - n + 2, n))))

    def bits(windows: Column, key: int) -> Column:
        return F.transform(windows, lambda x: F.substring(F.md5(F.concat_ws("|", F.lit(str(key)), x)), 1, 1) >= "8")

    return let(w, lambda x: F.flatten(F.array(*[bits(x, k) for k in range(keys)])))


def first_valid(df: DataFrame, keys: list[str], index: str, valid: Column, value: str) -> DataFrame:
    """Per key the value of the first valid candidate, its index and how many were skipped before it (all, if none is valid)."""
    x = df.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_v"), F.coalesce(valid, F.lit(False)).alias("_ok"))
    g = x.groupBy(*keys).agg(F.min(F.when(F.col("_ok"), F.struct("_i", "_v"))).alias("_b")).select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_b")
    on = F.lit(True)
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    skipped = F.count_if(~F.col("_ok") & (F.col("_b").isNull() | (F.col("_i") < F.col("_b._i"))))
    g = x.join(g, on).groupBy(*keys).agg(F.any_value("_b").alias("_b"), skipped.alias("n_skipped"))
    return g.select(*keys, F.col("_b._v").alias(value), F.col("_b._i").alias("chosen"), "n_skipped", F.col("_b").isNull().alias("invalid"))


#: Row numbers that one bitmap holds (Spark's bitmap buckets).
BUCKET = 32768


def skipped(df: DataFrame, keys: list[str], index: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """The first valid candidate of each key (reason is null), and what was passed over before it, by reason.

    Returns (keys, chosen: its index, null if none is valid; bitmaps: keys, reason, bucket, n, bitmap of the indexes from 0
    that were skipped). A key's indexes are bitmaps of 4 KB for each 32,768 of them, combined before the shuffle, however
    many candidates it has. Keys may be null; an index that stands twice counts once."""
    x = df.select(*keys, F.col(index).cast("long").alias("_i"), reason.alias("_why"))
    first = x.groupBy(*keys).agg(F.min(F.when(F.col("_why").isNull(), F.col("_i"))).alias("chosen"))
    names = first.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "chosen")
    on = F.lit(True)
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    over = x.where("_why IS NOT NULL").join(names, on).where("chosen IS NULL OR _i < chosen")
    over = over.groupBy(*keys, F.col("_why").alias("reason"), F.bitmap_bucket_number(F.col("_i") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_i") + 1)).alias("bitmap"))
    return first, over.select(*keys, "reason", "bucket", F.bitmap_count("bitmap").alias("n"), "bitmap")


def indexes(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reason, index: the bitmaps' row numbers again."""
    byte = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 8 - 1)), lambda k: F.struct(k.alias("at"), F.conv(F.hex(F.substring("bitmap", k + 1, F.lit(1))), 16, 10).cast("int").alias("bits"))), lambda b: b["bits"] > 0))
    x = bitmaps.select(*keys, "reason", "bucket", byte.alias("_b"))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.getbit(F.col("_b.bits"), j) == 1)).alias("_j")
    return x.select(*keys, "reason", "bucket", "_b", bit).select(*keys, "reason", ((F.col("bucket") - 1) * BUCKET + F.col("_b.at") * 8 + F.col("_j")).alias("index"))


#: The rolling hash's base and modulus (a prime under 2^31, so that products fit a long).
BASE, PRIME = 1_000_003, 2_147_483_629


def window_at(a: Column, b: Column, last: int = 0) -> Column:
    """Offset (from 0) of the first window of a that equals the array b, -1 if there is none; the last `last` offsets are not looked at.

    One pass: a hash of the window rolls over a, and only a window whose hash is b's is compared."""

    def find(x: Column) -> Column:
        n, own = F.size(x["b"]), F.size(x["a"])
        value = lambda arr: F.transform(arr, lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))
        roll = lambda h, v: F.pmod(h * BASE + v, F.lit(PRIME))
        want = F.aggregate(value(x["b"]), F.lit(0).cast("long"), roll)
        power = F.aggregate(F.transform(x["b"], lambda _: F.lit(BASE).cast("long")), F.lit(1).cast("long"), lambda p, c: F.pmod(p * c, F.lit(PRIME)))

        def search(y: Column) -> Column:
            def step(s: Column, e: Column) -> Column:
                gone = F.coalesce(F.get(y["v"], e - n), F.lit(0).cast("long")) * y["power"]
                h = F.pmod(roll(s["h"], F.get(y["v"], e)) - gone, F.lit(PRIME))
                here = let(h, lambda now: F.struct(now.alias("h"), F.when((e >= n - 1) & (now == y["want"]), F.when(F.slice(x["a"], e - n + 2, n) == x["b"], e - n + 1).otherwise(-1)).otherwise(-1).alias("at")))
                return F.when(s["at"] >= 0, s).otherwise(here)

            ends = F.when(own - last > 0, F.sequence(F.lit(0), own - last - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(ends, F.struct(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("at")), step, lambda s: s["at"])

        return F.when((n > 0) & (own >= n), let(F.struct(value(x["a"]).alias("v"), want.alias("want"), power.alias("power")), search)).otherwise(-1)

    return let(F.struct(a.alias("a"), b.alias("b")), find)


def align_prefix(prefix: Column, code: Column, width: int = 10) -> Column:
    """struct(offset, prefix_len, ok): where in the prefix the code begins, and whether code and prefix agree from there.

    They agree if all of the prefix but its last token begins the code. If the whole prefix does not, it is cut in front
    of the first place that holds the code's first `width` tokens (the place that ends with the prefix is not looked
    at) and must agree then. Without such a place the offset is -1 and the prefix its last token alone, which agrees
    with every code."""

    def agree(p: Column, c: Column) -> Column:
        n = F.greatest(F.size(p) - 1, F.lit(0))
        return (F.size(c) >= n) & (F.slice(c, F.lit(1), n) == F.slice(p, F.lit(1), n))

    def cut(x: Column) -> Column:
        p, c = x["p"], x["c"]
        out = lambda at, own: let(own, lambda q: F.struct(at.alias("offset"), F.size(q).alias("prefix_len"), agree(q, c).alias("ok")))
        behind = lambda at: F.slice(p, F.when(at >= 0, at + 1).otherwise(F.greatest(F.size(p), F.lit(1))), F.greatest(F.size(p), F.lit(1)))
        moved = let(F.when(F.size(c) >= width, window_at(p, F.slice(c, 1, width), 1)).otherwise(-1), lambda at: out(at, behind(at)))
        return F.when(agree(p, c), F.struct(F.lit(0).alias("offset"), F.size(p).alias("prefix_len"), F.lit(True).alias("ok"))).otherwise(moved)

    return let(F.struct(prefix.alias("p"), code.alias("c")), cut)


def align(a: Column, b: Column, width: int = 10) -> Column:
    """First offset (from 1) of the first `width` tokens of b in a; null if there is none."""
    def first(x: Column) -> Column:
        at = F.when(F.size(x["a"]) >= width, F.sequence(F.lit(1), F.size(x["a"]) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(at, lambda i: F.slice(x["a"], i, width) == x["b"]), F.lit(0))

    return let(F.struct(a.alias("a"), F.slice(b, 1, width).alias("b")), first)
