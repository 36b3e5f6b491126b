"""Gates: what a pass saw while it made its rows, against what it may see."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources import atomic as A
from ..sources.files import kept


class GateError(RuntimeError):
    """A gate is shut: the counts of what may not be."""


def watched(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """df written once to the shared folder, and aggregates observed in the same pass."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    own = [c.alias(k) for k, c in metrics.items()]
    out = kept(df.observe(seen, *own), name)
    if out.isEmpty():  # the optimiser drops a pass over nothing with what observes it, and get() would wait for ever
        return out, out.agg(*own).first().asDict()
    return out, seen.get


def gated(df: DataFrame, name: str, **faults: Column) -> DataFrame:
    """df, written once; GateError with all counts if a row is at fault (null: not at fault)."""
    out, seen = watched(df, name, **{k: F.count_if(F.coalesce(c, F.lit(False))) for k, c in faults.items()})
    if bad := {k: n for k, n in seen.items() if n}:
        raise GateError(f"{name}: " + ", ".join(f"{k} {n}" for k, n in sorted(bad.items())))
    return out


def freeze(df: DataFrame, path: str) -> None:
    """Keep a small table of expected counts as a manifest (refused if there is one)."""
    A.write_jsonl(df.coalesce(1), path)


def against_frozen(df: DataFrame, path: str, schema: str, key: str, counts: dict[str, Column], most: int = 10_000) -> tuple[DataFrame, list[dict]]:
    """df, written once, and the counts of each key of the frozen list as the pass saw them; GateError names what differs.

    counts: frozen column -> an aggregate over the rows of one key (count_if, collect_set sizes). A key that the list
    lacks is a difference too. The list is a few rows (`most`); its counts ride along as observed metrics."""
    frozen = [r.asDict() for r in df.sparkSession.read.schema(schema).json(A.committed(path)).limit(most + 1).collect()]
    if len(frozen) > most:
        raise ValueError(f"a frozen list has at most {most} rows")
    own = {f"m{i}_{c}": f(F.col(key).eqNullSafe(F.lit(r[key]))) for i, r in enumerate(frozen) for c, f in counts.items()}
    known = F.lit(False)
    for r in frozen:
        known = known | F.col(key).eqNullSafe(F.lit(r[key]))
    out, seen = watched(df, "frozen", unknown=F.count_if(~known), **own)
    now = [{key: r[key], **{c: seen[f"m{i}_{c}"] for c in counts}} for i, r in enumerate(frozen)]
    odd = [f"{r[key]}: {c} {n[c]} for {r[c]}" for r, n in zip(frozen, now) for c in counts if n[c] != r[c]]
    if seen["unknown"] or odd:
        raise GateError("not the frozen universe: " + "; ".join([*odd[:20], *([f"{seen['unknown']} rows of other keys"] if seen["unknown"] else [])]))
    return out, now


#: Kinds of violations of a walk record.
WALK_FAULTS = ("duplicate", "failure", "programs", "trace", "detection", "final")


def walk_violations(walks: DataFrame, steps: int, projection_kind: str = "projection") -> DataFrame:
    """record_id, kind, message: every violation of the walk records.

    walks: record_id, status, programs and trace (arrays), error_type, detection (text), final (text). A walk is ok with
    steps + 1 programs, steps trace entries, a detection and a final result; a failed one is allowed only before the
    first step (one program, no trace, a kind of error), or after all of them if its error is of `projection_kind`.
    An id may stand once."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    p, t, ok = size("programs"), size("trace"), F.col("status") == "ok"
    first = (F.col("status") == "error") & (p == 1) & (t == 0) & (F.coalesce("error_type", F.lit("")) != "")
    late = (F.col("status") == "error") & (p == steps + 1) & (t == steps) & F.col("error_type").eqNullSafe(projection_kind)
    ok, first, late = (F.coalesce(x, F.lit(False)) for x in (ok, first, late))
    said = lambda cond, kind, *text: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.concat(*[F.coalesce(x.cast("string"), F.lit("null")) if isinstance(x, Column) else F.lit(x) for x in text]).alias("message")))
    found = F.array_compact(F.array(
        said(~ok & ~first & ~late, "failure", F.col("record_id"), ": status ", F.col("status"), " programs ", p, " trace ", t),
        said(ok & (p != steps + 1), "programs", F.col("record_id"), ": programs ", p),
        said(ok & (t != steps), "trace", F.col("record_id"), ": trace ", t),
        said(ok & F.col("detection").isNull(), "detection", F.col("record_id"), ": no detection"),
        said(ok & F.col("final").isNull(), "final", F.col("record_id"), ": no final result"),
    ))
    own = walks.select("record_id", F.explode(found).alias("x")).select("record_id", "x.kind", "x.message")
    twice = walks.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")
    return own.unionByName(twice.select("record_id", F.lit("duplicate").alias("kind"), F.concat(F.coalesce(F.col("record_id").cast("string"), F.lit("null")), F.lit(": "), F.col("n").cast("string"), F.lit(" records")).alias("message")))


def capped(violations: DataFrame, most: int) -> DataFrame:
    """kind, n, messages: how many of each kind, and its first `most` messages in order of the text."""
    w = Window.partitionBy("kind").orderBy("message", "record_id")
    few = violations.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)  # cut before the shuffle, too
    few = few.groupBy(F.col("kind").alias("_k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "message"))), lambda x: x["message"]).alias("messages"))
    return violations.groupBy("kind").agg(F.count("*").alias("n")).join(few, F.col("kind") == F.col("_k")).select("kind", "n", "messages")
