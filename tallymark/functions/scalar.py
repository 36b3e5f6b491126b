"""Scalar functions as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / F.sqrt(F.lit(2.0))))


def upper_tail(z: Column) -> Column:
    return 1 - normal_cdf(z)


def z_score(green: Column, total: Column, gamma: float = 0.5) -> Column:
    """(G - gamma T) / sqrt(T gamma (1 - gamma)); null where T < 1."""
    t = total.cast("double")
    return F.when(total >= 1, (green - gamma * t) / F.sqrt(t * gamma * (1 - gamma)))


def pass_at_k(n: Column, c: Column, k: Column | int) -> Column:
    """1 - C(n - c, k) / C(n, k); 1 if fewer than k fail, 0 if none passes."""
    k = F.lit(k) if isinstance(k, int) else k
    some = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - k.cast("double") / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - some)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def stable_seed(a: Column, b: Column) -> Column:
    """First eight bytes of sha256(a NUL b), as decimal(20,0): 64 unsigned bits do not fit a long."""
    return F.conv(F.substring(F.sha2(F.concat(a, F.lit("\0"), b), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def first_block(text: Column, pattern: str) -> Column:
    return F.rtrim(F.get(F.split(text, pattern, 2), F.lit(0)))


def stop_at(text: Column, stops: list[str]) -> Column:
    """text up to the earliest of the stops."""
    at = F.array_min(F.filter(F.array(*[F.instr(text, s) for s in stops]), lambda p: p > 0))
    return F.when(at.isNull(), text).otherwise(F.substring(text, 1, at - 1))


def fenced_block(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)```[A-Za-z]*\n(.*?)```", 1)


def answer_number(text: Column) -> Column:
    """The number behind the last '#### ', without thousands commas; null if it is none."""
    return F.replace(F.element_at(F.split(text, "#### "), -1), F.lit(","), F.lit("")).try_cast("double")


def without_lines(text: Column, banner: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.contains(x, F.lit(banner))), "\n")


def to_flag(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "1"), True).when(t.isin("false", "no", "0"), False)


def outcome(i: Column, lists: dict[str, Column]) -> Column:
    """The name of the first list that holds i, else 'unknown'."""
    out = None
    for name, ids in lists.items():
        out = F.when(F.array_contains(ids, i), name) if out is None else out.when(F.array_contains(ids, i), name)
    return out.otherwise("unknown")
