"""Program rewrites and test runs as row transforms (Arrow batches, errors become rows).

The rewriter walks at random over the small meaning-keeping edits of ``rules``. Running programs is off unless asked for: `run_program` starts a subprocess with
limits in the executor, never in the driver.
"""

from __future__ import annotations

import ast
import random
import subprocess
import sys
import tempfile
import tokenize
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import FAMILIES, PLAIN, Source

RESULT = "ok boolean, code string, output string"


def external(df: DataFrame, column: str, tool: Callable[[str], str]) -> DataFrame:
    """df with `result`: ok, code ('ok', 'invalid_input', 'timeout' or 'process_error') and the output, null on failure."""

    def one(source: str | None) -> tuple:
        if source is None or not source.strip():
            return False, "invalid_input", None
        try:
            return True, "ok", tool(source)
        except (TimeoutError, subprocess.TimeoutExpired):
            return False, "timeout", None
        except Exception:  # a tool's failure is a row, not a failed job
            return False, "process_error", None

    @F.pandas_udf(RESULT)
    def run(source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(s) for s in source], columns=["ok", "code", "output"])

    return df.withColumn("result", run(column))


def walk(source: str, steps: int, seed: int, rules: dict = FAMILIES, bucket: int = 2000) -> tuple[list[str], list[str]]:
    """(programs, rules taken): each step picks evenly among staying and every edit that still parses and
    stays in the source's bucket of UTF-8 length. Same seed, same walk."""
    rng, programs, taken = random.Random(seed), [source], []
    ast.parse(source)
    home = len(source.encode()) // bucket
    for _ in range(steps):
        options = [("identity", programs[-1])]
        now = Source(programs[-1])
        for name in sorted(rules):
            for new in sorted(set(rules[name](now))):
                if len(new.encode()) // bucket == home:
                    try:
                        ast.parse(new)
                    except SyntaxError:
                        continue
                    options.append((name, new))
        name, new = options[rng.randrange(len(options))]
        programs.append(new)
        taken.append(name)
    return programs, taken


def walks(df: DataFrame, column: str, seed: str, steps: int = 10, profile: str = "all") -> DataFrame:
    """profile: all families, or no_advanced without those that change the flow of control. df with `walk`: status ('ok' or 'transform_failed'), programs (steps + 1), trace and the last program."""
    rules = PLAIN if profile == "no_advanced" else FAMILIES

    @F.pandas_udf("status string, programs array<string>, trace array<string>, final string")
    def run(source: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        out = []
        for s, k in zip(source, seeds):
            try:
                p, t = walk(s, steps, int(k), rules)
                out.append(("ok", p, t, p[-1]))
            except (SyntaxError, ValueError, TypeError, tokenize.TokenError, IndexError):
                out.append(("transform_failed", None, None, None))
        return pd.DataFrame(out, columns=["status", "programs", "trace", "final"])

    return df.withColumn("walk", run(column, seed))


def rule_counts(walked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, n of the steps taken."""
    return walked.select(*keys, F.explode("walk.trace").alias("rule")).groupBy(*keys, "rule").agg(F.count("*").alias("n"))


def run_program(df: DataFrame, column: str, enabled: bool = False, timeout: float = 10.0, tail: int = 4000) -> DataFrame:
    """df with `outcome`: 'passed', 'failed', 'timeout' or 'disabled', and the tail of what was printed.

    Each distinct program runs once in a subprocess with memory, file and process-group limits, an empty
    environment and a fixed hash seed. Programs are untrusted: unless enabled, nothing runs."""
    if not enabled:
        return df.withColumn("outcome", F.lit("disabled")).withColumn("output", F.lit(None).cast("string"))

    def limits() -> None:
        import os
        import resource

        os.setsid()
        resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
        resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))

    def one(code: str) -> tuple[str, str]:
        import os
        import signal

        with tempfile.TemporaryDirectory() as d:
            p = subprocess.Popen([sys.executable, "-I", "-c", code], cwd=d, env={"PYTHONHASHSEED": "0"}, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, preexec_fn=limits)
            try:
                out, _ = p.communicate(timeout=timeout)
            except subprocess.TimeoutExpired:
                os.killpg(p.pid, signal.SIGKILL)
                p.communicate()
                return "timeout", ""
        return ("passed" if p.returncode == 0 else "failed"), out.decode("utf-8", "replace")[-tail:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(c, *one(c)) for c in b["_code"]], columns=["_code", "outcome", "output"])

    once = df.select(F.col(column).alias("_code")).where("_code IS NOT NULL").distinct().mapInPandas(run, "_code string, outcome string, output string")
    return df.join(once, df[column].eqNullSafe(once["_code"]), "left").drop("_code")


def differential(before: Column, after: Column, failed: Column) -> Column:
    """baseline_failed, obfuscator_error, preserved or regression of a program and its rewrite."""
    return F.when(before != "passed", "baseline_failed").when(failed, "obfuscator_error").when(after == "passed", "preserved").otherwise("regression")


def refreshed(saved: DataFrame, baseline: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """saved rows with only these columns taken anew where baseline has the key; walks and all else stay as they are."""
    new = baseline.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_has"))
    x = saved.join(new, F.col(key) == F.col("_key"), "left")
    return x.select(*[F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in saved.columns])
