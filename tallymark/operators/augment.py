"""Variants of Python programs for augmentation, by rewriting their trees at random.

Unlike the walks of ``rewrite`` these need not keep a program's meaning for every type (``-(-a - b)`` for ``a + b``
fails for texts); a variant must only parse and differ from all others.
"""

from __future__ import annotations

import ast
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Renamed(ast.NodeTransformer):
    """Parameters and variables that a function stores get numbered names throughout it."""

    def visit_FunctionDef(self, node: ast.FunctionDef) -> ast.AST:
        names = [a.arg for a in node.args.posonlyargs + node.args.args + node.args.kwonlyargs]
        names += [n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        new = {x: f"var_{k}" for k, x in enumerate(dict.fromkeys(names))}
        for n in ast.walk(node):
            if isinstance(n, ast.Name) and n.id in new:
                n.id = new[n.id]
            elif isinstance(n, ast.arg) and n.arg in new:
                n.arg = new[n.arg]
        return node


class Unary(ast.NodeTransformer):
    """A number n as -(-n)."""

    def visit_Constant(self, node: ast.Constant) -> ast.AST:
        if isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return ast.UnaryOp(ast.USub(), ast.UnaryOp(ast.USub(), node))
        return node


class Loop(ast.NodeTransformer):
    """`for i in range(n)` without break, continue or else as a while loop."""

    def visit_For(self, node: ast.For) -> ast.AST | list[ast.stmt]:
        self.generic_visit(node)
        call = node.iter
        plain = isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "range" and len(call.args) == 1 and isinstance(node.target, ast.Name)
        if not plain or node.orelse or any(isinstance(n, (ast.Break, ast.Continue)) for n in ast.walk(node)):
            return node
        i = node.target.id
        start = ast.Assign([ast.Name(i, ast.Store())], ast.Constant(0))
        step = ast.AugAssign(ast.Name(i, ast.Store()), ast.Add(), ast.Constant(1))
        return [start, ast.While(ast.Compare(ast.Name(i, ast.Load()), [ast.Lt()], [call.args[0]]), [*node.body, step], [])]


class Expression(ast.NodeTransformer):
    """a + b as -(-a - b)."""

    def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
        self.generic_visit(node)
        if isinstance(node.op, ast.Add):
            return ast.UnaryOp(ast.USub(), ast.BinOp(ast.UnaryOp(ast.USub(), node.left), ast.Sub(), node.right))
        return node


class Boolean(ast.NodeTransformer):
    """Conditions by De Morgan: a and b as not (not a or not b)."""

    def visit_BoolOp(self, node: ast.BoolOp) -> ast.AST:
        self.generic_visit(node)
        other = ast.Or() if isinstance(node.op, ast.And) else ast.And()
        return ast.UnaryOp(ast.Not(), ast.BoolOp(other, [ast.UnaryOp(ast.Not(), v) for v in node.values]))


class Comprehension(ast.NodeTransformer):
    """A list comprehension as list() of a generator."""

    def visit_ListComp(self, node: ast.ListComp) -> ast.AST:
        self.generic_visit(node)
        return ast.Call(ast.Name("list", ast.Load()), [ast.GeneratorExp(node.elt, node.generators)], [])


KINDS = (Renamed, Unary, Loop, Expression, Boolean, Comprehension)


def variants(source: str, seed: int, tries: int = 10) -> list[str]:
    """Different programs, each from one to six kinds in random order; none for a source that does not parse."""
    try:
        own = ast.unparse(ast.parse(source))
    except (SyntaxError, ValueError):
        return []
    rng, out = random.Random(seed), []
    for _ in range(tries):
        tree = ast.parse(source)
        for kind in rng.sample(KINDS, rng.randint(1, len(KINDS))):
            tree = ast.fix_missing_locations(kind().visit(tree))
        try:
            new = ast.unparse(ast.parse(ast.unparse(tree)))
        except (SyntaxError, ValueError, RecursionError):
            continue
        if new != own and new not in out:
            out.append(new)
    return out


def augmented(df: DataFrame, column: str, seed: str, tries: int = 10) -> DataFrame:
    """df with `variants` (array of programs; null for a null source)."""

    @F.pandas_udf("array<string>")
    def made(source: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else variants(s, int(k), tries) for s, k in zip(source, seeds)], dtype=object)

    return df.withColumn("variants", made(column, seed))
