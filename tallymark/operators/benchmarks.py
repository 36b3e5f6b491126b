"""Benchmark adapters: how each task makes a prompt and a reference, and cuts a program or an answer out of a generation.

An adapter's functions are column expressions over the columns that its benchmark has, so they run over any table
of items and generations; no hub is asked. ``ADAPTERS`` is the registry by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import brace_cut
from ..functions.scalar import answer_number, first_block, stop_at
from .keyed import permutation

# Stop words, markers and templates of the benchmarks.
HUMANEVAL_STOPS = ["\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif", "\n```", "<file_sep>"]
MBPP_BLOCK = '\nclass|\nassert|\n"""|\nprint|\nif|\n<|/'
DS1000_STARTS, DS1000_STOPS = ["BEGIN SOLUTION\n<code>", "# SOLUTION START"], ["</code>", "# SOLUTION END"]
GSM_MARK, GSM_END, GSM_SHOTS = "# solution in Python:", "print(solution())", 8
TEXT_MARKS = {"python": '\n""" The goal of this function is to:\n', "ruby": "\n=begin The goal of this function is to:\n", "other": "\n/* The goal of this function is to:\n"}
ONE_LINE = {"conala": "Answer the following instructions in one line of Python code:\n", "concode": "Answer the following instructions in a one line of Java code:\n"}
PAD = " " * 19  # stands before each line break of the two-shot templates


@dataclass(frozen=True)
class Adapter:
    """prompt and reference of an item; answer(generation, prompt); the metric's name."""

    prompt: Callable[[], Column]
    reference: Callable[[], Column]
    answer: Callable[[Column, Column], Column]
    metric: str


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def behind(generation: Column, prompt: Column) -> Column:
    return F.substring(generation, F.length(prompt) + 1, F.length(generation))


def part(text: Column, mark: str, index: int, most: int = -1) -> Column:
    """Element `index` (from the end if negative) of the text split at a literal mark, at most `most` parts."""
    return F.element_at(F.split(text, f"\\Q{mark}\\E", most), index + 1 if index >= 0 else index)


def stop_at_any(text: Column, stops: Column) -> Column:
    """text up to the earliest of an array of stops."""
    at = F.array_min(F.filter(F.transform(stops, lambda s: F.position(s, text)), lambda p: p > 0))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))


def mbpp_head(text: Column, tests: Column) -> Column:
    return F.concat(F.lit('"""\n'), text, F.lit(" Your code should satisfy these tests:\n"), F.array_join(tests, "\n"), F.lit('\n"""\n'))


def mbpp_prompt() -> Column:
    """With the column `examples` (text, test_list, code of the few shots, from `mbpp_shots`). Task 493 shows its third test only."""
    shots = F.array_join(F.transform("examples", lambda x: F.concat(mbpp_head(x["text"], x["test_list"]), x["code"], F.lit("\n"))), "")
    tests = F.when(F.col("task_id") == 493, F.slice("test_list", 3, 1)).otherwise(F.col("test_list"))
    return F.concat(shots, mbpp_head(F.col("text"), tests))


def mbpp_shots(items: DataFrame, train: DataFrame, shots: int = 3) -> DataFrame:
    """items with `examples`: the first rows of a permutation of train (pos, text, test_list, code) seeded by the task's id.

    train is a benchmark's few hundred rows; one array of row numbers is made for each item."""
    n = train.count()

    @F.pandas_udf("array<int>")
    def places(seed: pd.Series) -> pd.Series:
        return seed.map(lambda s: permutation(n, int(s), shots).tolist())

    x = items.select("*", F.posexplode_outer(places("task_id")).alias("_k", "_pos"))
    t = train.select(F.col("pos").alias("_p"), F.struct("text", "test_list", "code").alias("_x"))
    g = x.select("task_id", "_k", "_pos").join(F.broadcast(t), F.col("_pos") == F.col("_p")).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("_k", "_x"))).alias("_s"))
    return items.join(g.select("task_id", F.col("_s._x").alias("examples")), "task_id", "left")


def apps_prompt() -> Column:
    """The question, starter code if there is any, and how the program is called."""
    name = F.get_json_object("input_output", "$.fn_name")
    call = F.when(F.coalesce(name, F.lit("")) != "", "\nUse Call-Based format").otherwise("\nUse Standard Input format")
    return F.concat(F.lit("\nQUESTION:\n"), F.col("question"), F.coalesce("starter_code", F.lit("")), call, F.lit("\nANSWER:\n"))


def ds1000_answer(generation: Column, prompt: Column) -> Column:
    out = generation
    for mark in DS1000_STARTS:
        out = part(out, mark, -1, 2)
    for mark in DS1000_STOPS:
        out = part(out, mark, 0)
    return F.concat(prompt, strip(out))


def ds1000_insertion(prompt: Column) -> Column:
    """struct(prefix, suffix) of a prompt with an [insert] mark."""
    return F.struct(F.concat(strip(part(prompt, "[insert]", 0)), F.lit("\n")).alias("prefix"), F.concat(F.lit("\n"), strip(part(prompt, "[insert]", 1)), F.lit("\n")).alias("suffix"))


def gsm_prompt(examples: list[tuple[str, str]]) -> Callable[[], Column]:
    shots = "".join(f'Q: {q}\n\n{GSM_MARK}\n\n\ndef solution():\n    """{q}"""\n{s}\n\n\n\n\n\n' for q, s in examples[:GSM_SHOTS])
    return lambda: F.concat(F.lit(f"{shots}Q: "), F.col("question"), F.lit(f"\n\n{GSM_MARK}\n\n\n"))


def gsm_answer(generation: Column, prompt: Column) -> Column:
    """The program behind the last of the prompt's marks, without a next question, and a call of it."""
    own = strip(part(generation, GSM_MARK, -1, GSM_SHOTS + 2))
    return F.concat(part(own, "Q:", 0), F.lit("\n" + GSM_END))


def two_shot(entry: str, ask: str, give: str, examples: list[tuple[str, str]], text: Column) -> Column:
    shots = "".join(f"\n{ask}:\n{q}{PAD}\n{give}:\n{a}{PAD}" for q, a in examples)
    return F.concat(F.lit(f"{entry}{shots}\n{ask}:\n"), text, F.lit(f"{PAD}\n{give}:\n"))


def concode_text() -> Column:
    text = strip(part(F.col("nl"), "concode_field_sep", 0))
    return F.when(F.endswith(text, F.lit(".")), strip(F.substring(text, F.lit(1), F.length(text) - 1))).otherwise(text)


def code_to_text_prompt(language: str) -> Callable[[], Column]:
    """The function without its docstring, and the mark behind which the goal is asked for."""
    mark = TEXT_MARKS.get(language, TEXT_MARKS["other"])

    def python() -> Column:
        code, doc = F.col("code"), F.col("docstring")
        at = F.position(doc, code)
        head, tail = F.substring(code, F.lit(1), at - 1), F.substring(code, at + F.length(doc), F.length(code))
        head = F.when(F.contains(head, F.lit('"""')), part(head, '"""', 0)).otherwise(part(head, "'''", 0))
        head = F.regexp_replace(F.regexp_replace(head, "[^'\"]'\\s*$", ""), "[^'\"]\"\\s*$", "")
        head = F.regexp_replace(strip(head), "'''$", "")
        return F.concat(head, F.regexp_replace(tail, "\"\"\"|'''", ""), F.lit(mark))

    return python if language == "python" else lambda: F.concat(F.col("code"), F.lit(mark))


def code_to_text(language: str) -> Adapter:
    mark = TEXT_MARKS.get(language, TEXT_MARKS["other"])
    return Adapter(code_to_text_prompt(language), lambda: F.array_join("docstring_tokens", " "), lambda g, p: part(strip(part(g, mark, 1)), "\n", 0), "mteval_bleu")


def text_to_text(language: str, examples: list[tuple[str, str]]) -> Adapter:
    entry = f"Translate the following documentation from {language.title()} to English:\n"
    return Adapter(lambda: two_shot(entry, language.title(), "English", examples, F.col("source")), lambda: strip(F.col("target")), lambda g, p: strip(part(g, "\nEnglish:\n", -1, 4)), "corpus_bleu")


def one_line(name: str, examples: list[tuple[str, str]]) -> Adapter:
    text = (lambda: strip(F.coalesce(F.nullif(F.col("rewritten_intent"), F.lit("")), F.col("intent")))) if name == "conala" else concode_text
    reference = "snippet" if name == "conala" else "code"
    return Adapter(lambda: two_shot(ONE_LINE[name], "Instruction", "Solution", examples, text()), lambda: F.col(reference), lambda g, p: strip(part(g, "Solution:\n", -1, 4)), "corpus_bleu")


def adapters(gsm_examples: list[tuple[str, str]] = (), two: list[tuple[str, str]] = (), system: str = "") -> dict[str, Adapter]:
    """The registry. Few-shot examples and the chat task's system text are the caller's (they come with the benchmarks)."""
    humaneval = lambda: F.concat(F.lit("\n"), F.col("test"), F.lit("\ncheck("), F.col("entry_point"), F.lit(")"))
    gsm = Adapter(gsm_prompt(list(gsm_examples)), lambda: answer_number(F.col("answer")), gsm_answer, "majority_accuracy")
    return {
        "humaneval": Adapter(lambda: strip(F.col("prompt")), humaneval, lambda g, p: F.concat(p, stop_at(behind(g, p), HUMANEVAL_STOPS)), "pass_at_k"),
        "humanevalpack": Adapter(lambda: strip(F.col("prompt")), humaneval, lambda g, p: F.concat(p, brace_cut(behind(g, p))), "pass_at_k"),
        "mbpp": Adapter(mbpp_prompt, lambda: F.array_join("test_list", "\n"), lambda g, p: F.concat(p, first_block(behind(g, p), MBPP_BLOCK)), "pass_at_k"),
        "apps": Adapter(apps_prompt, lambda: F.lit(None).cast("string"), lambda g, p: g, "pass_at_k"),
        "ds1000": Adapter(lambda: F.col("prompt"), lambda: F.col("reference_code"), ds1000_answer, "mean_accuracy"),
        "multiple": Adapter(lambda: strip(F.col("prompt")), lambda: F.col("tests"), lambda g, p: F.concat(p, stop_at_any(behind(g, p), F.col("stop_tokens"))), "pass_at_k"),
        "gsm8k": gsm,
        "gsm_hard": gsm,
        "conala": one_line("conala", list(two)),
        "concode": one_line("concode", list(two)),
        "text_to_text": text_to_text("danish", list(two)),
        "code_to_text_python": code_to_text("python"),
        "code_to_text_ruby": code_to_text("ruby"),
        "code_to_text_java": code_to_text("java"),
        "code_evaluation_prompts": Adapter(lambda: F.concat(F.lit(f"{system}\n\nHuman: "), strip(F.col("prompt")), F.lit("\n\nAssistant: ")), lambda: F.lit(None).cast("string"), lambda g, p: g, "none"),
    }
