"""Programs in text: extraction, cuts, templates and outcome labels.

Column expressions where Spark's functions can say it; Arrow-batched pandas functions for the scanners.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTES = "\"'`"


def balanced_end(code: str, start: int = 0) -> int | None:
    """The end (exclusive) of the first balanced {...} block from `start` on; braces in strings and comments don't count."""
    depth, i, n = 0, start, len(code)
    while i < n:
        c = code[i]
        if c in QUOTES:
            i += 1
            while i < n and code[i] != c:
                i += 2 if code[i] == "\\" else 1
        elif code.startswith("//", i):
            j = code.find("\n", i)
            i = n if j < 0 else j
        elif code.startswith("/*", i):
            j = code.find("*/", i + 2)
            i = n if j < 0 else j + 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
            if depth < 0:
                return None
        i += 1
    return None


def debt_end(code: str, start: int = 0, debt: int = 1) -> int | None:
    """The end (exclusive) of the character that pays off so many open braces from `start` on; every brace counts."""
    for m in re.finditer("[{}]", code[start:]):
        debt += 1 if m[0] == "{" else -1
        if debt == 0:
            return start + m.end()
    return None


def _lengths(of, *columns: pa.Array) -> pa.Array:
    """of(...) row by row, one text at a time; null for nulls. Texts are cut by Spark, so that Python holds none of its own."""
    rows = zip(*columns)
    return pa.array((None if any(not x.is_valid for x in r) else of(*(x.as_py() for x in r)) for r in rows), pa.int32(), size=len(columns[0]))


@F.arrow_udf(T.IntegerType())
def _balanced_length(code: pa.Array) -> pa.Array:
    return _lengths(lambda c: len(c) if (end := balanced_end(c)) is None else end, code)


@F.arrow_udf(T.IntegerType())
def _paid_length(code: pa.Array) -> pa.Array:
    return _lengths(lambda c: len(c[: debt_end(c)].rstrip()), code)


@F.arrow_udf(T.IntegerType())
def _entry_length(code: pa.Array, entry: pa.Array) -> pa.Array:
    def length(c: str, name: str) -> int:
        at = c.find(name)
        opens = c.find("{", at + 1) if name and at >= 0 else -1
        end = debt_end(c, opens + 1) if opens >= 0 else None
        return len(c[:end].rstrip()) if end else len(c)

    return _lengths(length, code, entry)


def brace_cut(code: Column | str) -> Column:
    """code up to the end of its first balanced block; unchanged without one."""
    code = F.col(code) if isinstance(code, str) else code
    return F.substring(code, F.lit(1), _balanced_length(code))


def paid_off(code: Column) -> Column:
    """A completion up to the brace that closes the one its prompt left open; unchanged if none does."""
    return F.substring(code, F.lit(1), _paid_length(code))


def entry_block(code: Column, entry: Column) -> Column:
    """A program up to the end of its entry point's block; unchanged without one."""
    return F.substring(code, F.lit(1), _entry_length(code, entry))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


#: A line break before anything but a tab, a comment, a line break or a space: where a Python block ends.
LEAVES = "\n(?=[^\t#\n ])"


def python_cut(code: Column) -> Column:
    """A completion up to where it leaves its block."""
    return stripped(F.get(F.split(code, LEAVES, 2), F.lit(0)))


def python_entry(code: Column, entry: Column) -> Column:
    """A program up to where the entry point's block ends; unchanged without the entry point or an end."""
    at = F.instr(code, entry)
    head, rest = F.substring(code, F.lit(1), at), F.substring(code, at + 1, F.length(code))
    ends = (entry != "") & (at > 0) & rest.rlike(LEAVES)
    return F.when(ends, stripped(F.concat(head, F.get(F.split(rest, LEAVES, 2), F.lit(0))))).otherwise(code)


def fence(text: Column) -> Column:
    """struct(language, code) of the first fenced block; without one both are null. An unclosed fence runs to the end."""
    pat = r"(?s)```([A-Za-z0-9+#]*)[ \t]*\n(.*?)(?:```|\z)"
    lang, code = F.regexp_extract(text, pat, 1), F.regexp_extract(text, pat, 2)
    has = F.regexp_like(text, F.lit(pat))
    return F.struct(F.when(has, F.lower(lang)).alias("language"), F.when(has, code).alias("code"))


def solution(text: Column, prompt: Column, language: Column, chat: Column, entry: Column) -> Column:
    """A program from a completion. Chat models (the prompt opens the fence): what stands before the closing
    fence, up to the end of the entry point's block. Base models: the prompt and its completion, up to where it
    leaves the block (py) or pays off the brace that the prompt left open (js, cpp)."""
    own = stripped(text)
    before = F.get(F.split(own, "\n```", 2), F.lit(0))
    fenced = F.when(F.contains(own, F.lit("\n```")), before).otherwise(F.get(F.split(own, "```", 2), F.lit(0)))
    base = F.concat(prompt, F.when(language == "py", python_cut(own)).otherwise(paid_off(own)))
    return F.when(chat, F.when(language == "py", python_entry(fenced, entry)).otherwise(entry_block(fenced, entry))).otherwise(base)


def after_first(text: Column, marker: str) -> Column:
    """What follows the first marker (a program's body behind its prompt); null without one."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at + len(marker), F.lit(1 << 30)))


def chat_prompt(task: Column, language: Column) -> Column:
    return F.format_string("Complete the following %s program. Answer with code only.\n```%s\n%s\n```", language, language, task)


def diff_paths(patch: Column, suffix: str = "") -> Column:
    """Paths that a diff's +++ headers name, each once, in order; deleted files (/dev/null) have none."""
    heads = F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/([^\n\t]+)"), F.lit(1))
    return F.array_distinct(F.filter(heads, lambda p: F.endswith(p, F.lit(suffix))))


def without_long_lines(text: Column, code: Column, least: int = 20) -> Column:
    """text without each line of the code that has more than `least` characters."""
    long = F.filter(F.split(code, "\n"), lambda x: F.length(x) > least)
    return F.aggregate(long, text, lambda acc, x: F.replace(acc, x, F.lit("")))


def test_label(before: Column, after: Column) -> Column:
    """preserved, regression, improved or baseline_failed from two outcomes; null if one is unknown."""
    return F.when(before & after, "preserved").when(before & ~after, "regression").when(~before & after, "improved").when(~before & ~after, "baseline_failed")


@F.pandas_udf(T.DecimalType(20, 0))
def sha3_seed(text: pd.Series) -> pd.Series:
    """The last eight bytes of SHA3-512, big endian."""
    from decimal import Decimal

    return text.map(lambda s: Decimal(int.from_bytes(hashlib.sha3_512(s.encode()).digest()[-8:], "big")), na_action="ignore")


@F.pandas_udf(T.StringType())
def short_number(x: pd.Series) -> pd.Series:
    """%g."""
    return x.map(lambda v: f"{v:g}", na_action="ignore").astype(object).where(x.notna(), None)


def _suite(source: str, entry: str) -> tuple[str | None, str | None]:
    """What follows the colon of the one top-level function `entry`, or why there is none."""
    try:
        found = [x for x in ast.parse(source).body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and x.name == entry]
    except (SyntaxError, ValueError) as e:
        return None, type(e).__name__
    if len(found) != 1:
        return None, f"expected one top-level function {entry!r}, found {len(found)}"
    f = found[0]
    # the last place of the signature that the tree knows; colons of annotations, slices and lambdas lie before it
    known = [n for part in (f.args, f.returns, *getattr(f, "type_params", ())) if part for n in ast.walk(part) if hasattr(n, "end_lineno")]
    raw = source.encode().split(b"\n")
    least = max([(n.end_lineno, len(raw[n.end_lineno - 1][: n.end_col_offset].decode())) for n in known], default=(f.lineno, f.col_offset))
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type == tokenize.OP and t.string == ":" and t.start >= least:
            lines = source.split("\n")
            tail = "\n".join([lines[t.end[0] - 1][t.end[1] :], *lines[t.end[0] :]])
            if tail[:1] in ("\n", "\r"):
                return re.sub(r"^\r?\n", "", tail), None
            return ("    " + tail.lstrip() if tail.strip() else ""), None
    return None, f"no colon behind {entry!r}"


@F.pandas_udf(T.StructType([T.StructField("suite", T.StringType()), T.StructField("error", T.StringType())]))
def suite_suffix(source: pd.Series, entry: pd.Series) -> pd.DataFrame:
    """The detector's suffix of a whole Python program: what follows the colon of its entry function, which is found by syntax. Null for a null source."""
    rows = [(None, None) if s is None else (None, "no entry point") if not e else _suite(s, e) for s, e in zip(source, entry)]
    return pd.DataFrame(rows, columns=["suite", "error"])
