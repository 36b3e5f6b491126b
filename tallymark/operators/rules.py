"""Families of small rewrites of Python source that keep its meaning.

A family maps a source to the sources that one edit makes. Edits go by the byte offsets of `ast` and `tokenize`;
what they cannot do safely they leave out: sources with tabs or continued lines for layout, functions whose names can
be seen from outside, docstrings. The walk in ``rewrite`` takes an edit only if the result still parses.
"""

from __future__ import annotations

import ast
import builtins
import io
import keyword
import tokenize
from collections.abc import Callable, Iterator

SIMPLE = (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr, ast.Pass, ast.Delete, ast.Import, ast.ImportFrom, ast.Assert)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class Source:
    """A text with its tree, tokens and byte offsets."""

    def __init__(self, text: str) -> None:
        self.text, self.data, self.tree = text, text.encode(), ast.parse(text)
        self.lines = self.data.splitlines(keepends=True)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))
        self.tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))

    def at(self, line: int, byte: int) -> int:
        return self.starts[line - 1] + byte

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def token(self, t: tokenize.TokenInfo) -> tuple[int, int]:
        def of(place: tuple[int, int]) -> int:
            line = self.lines[place[0] - 1].decode() if place[0] <= len(self.lines) else ""
            return self.at(place[0], len(line[: place[1]].encode()))

        return of(t.start), of(t.end)

    def put(self, *edits: tuple[int, int, str]) -> str:
        data = self.data
        for a, b, new in sorted(edits, reverse=True):
            data = data[:a] + new.encode() + data[b:]
        return data.decode()

    def code(self, node: ast.AST) -> str:
        a, b = self.span(node)
        return self.data[a:b].decode()

    def indent(self, node: ast.stmt) -> str | None:
        """The white space before a statement that begins its line; None if it does not."""
        head = self.lines[node.lineno - 1][: node.col_offset]
        return head.decode() if not head.strip() else None

    def whole_line(self, node: ast.stmt) -> tuple[int, int] | None:
        """The lines of a statement that has them to itself."""
        if self.indent(node) is None or self.lines[node.end_lineno - 1][node.end_col_offset :].strip():
            return None
        return self.starts[node.lineno - 1], self.starts[node.end_lineno]

    def bodies(self) -> Iterator[tuple[ast.AST, list[ast.stmt]]]:
        for n in ast.walk(self.tree):
            for field in ("body", "orelse", "finalbody"):
                body = getattr(n, field, None)
                if isinstance(body, list) and body and isinstance(body[0], ast.stmt):
                    yield n, body

    def plain_layout(self) -> bool:
        """No tabs, continued lines or strings over lines: a line is one piece of layout."""
        strings = any(t.type in (tokenize.STRING, getattr(tokenize, "FSTRING_MIDDLE", -1)) and t.start[0] != t.end[0] for t in self.tokens)
        depth = 0
        for t in self.tokens:
            depth += (t.string in "([{") - (t.string in ")]}") if t.type == tokenize.OP else 0
            if depth and t.type == tokenize.NL:
                return False
        return not strings and "\t" not in self.text and "\\\n" not in self.text


def is_docstring(owner: ast.AST, body: list[ast.stmt], s: ast.stmt) -> bool:
    return s is body[0] and isinstance(owner, (ast.Module, ast.ClassDef, *FUNCTIONS)) and isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)


def fresh(text: str, stem: str) -> str:
    return next(x for x in (f"{stem}{i}" for i in range(10_000)) if x not in text and not keyword.iskeyword(x))


def rename_local(s: Source) -> list[str]:
    """A function's own variable gets a fresh name. Functions with nested scopes, global or nonlocal names, or
    sources that call what can see names (locals, vars, eval, exec, dir) are left alone."""
    out = []
    seen = {n.id for n in ast.walk(s.tree) if isinstance(n, ast.Name)}
    if seen & {"locals", "vars", "eval", "exec", "dir"}:
        return []
    for f in [n for n in ast.walk(s.tree) if isinstance(n, FUNCTIONS)]:
        inner = [n for n in ast.walk(f) if n is not f]
        nested = (*FUNCTIONS, ast.Lambda, ast.ClassDef, ast.Global, ast.Nonlocal, ast.Import, ast.ImportFrom, ast.ExceptHandler, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.MatchAs, ast.MatchStar, ast.MatchMapping)
        if any(isinstance(n, nested) for n in inner):
            continue
        own = {n.id for n in inner if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} - {a.arg for a in ast.walk(f.args) if isinstance(a, ast.arg)}
        for name in sorted(own):
            new = fresh(s.text, "v")
            out.append(s.put(*[(*s.span(n), new) for n in inner if isinstance(n, ast.Name) and n.id == name]))
    return out


def comment_line(s: Source) -> list[str]:
    """A comment goes, or gets another text; a statement gets one."""
    out = []
    for t in s.tokens:
        if t.type == tokenize.COMMENT and not t.string.startswith("#!") and "coding" not in t.string:
            out += [s.put((*s.token(t), "")), s.put((*s.token(t), "# next step"))]
    for _, body in s.bodies():
        for x in body:
            if (at := s.whole_line(x)) and s.plain_layout():
                out.append(s.put((at[0], at[0], f"{s.indent(x)}# next step\n")))
    return out


def assigned_string(s: Source) -> list[str]:
    """A function's body begins with a string in a name that nothing reads; a bare string behind a first statement goes."""
    out = []
    for owner, body in s.bodies():
        if isinstance(owner, FUNCTIONS):
            x = body[1] if is_docstring(owner, body, body[0]) and len(body) > 1 else body[0]
            if not is_docstring(owner, body, x) and (at := s.whole_line(x)) and not getattr(x, "decorator_list", None):
                out.append(s.put((at[0], at[0], f'{s.indent(x)}{fresh(s.text, "note")} = "see below"\n')))
        for x in body[1:]:
            if isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str) and (at := s.whole_line(x)):
                out.append(s.put((*at, "")))
    return out


def optional_space(s: Source) -> list[str]:
    """Spaces around an operator between operands, or behind a comma, come or go."""
    out = []
    for a, t, b in zip(s.tokens, s.tokens[1:], s.tokens[2:]):
        if t.type != tokenize.OP or a.end[0] != t.start[0] or t.end[0] != b.start[0]:
            continue
        x, y, z, w = s.token(a)[1], *s.token(t), s.token(b)[0]
        if t.string in ("+", "*", "/", "<", ">", "==", "!=", "%") and (a.type in (tokenize.NAME, tokenize.NUMBER) and not keyword.iskeyword(a.string) or a.string in (")", "]")) and (b.type in (tokenize.NAME, tokenize.NUMBER) and not keyword.iskeyword(b.string) or b.string in "(["):
            out.append(s.put((x, w, t.string if y > x else f" {t.string} ")))
        elif t.string == "," and b.type in (tokenize.NAME, tokenize.NUMBER):
            out.append(s.put((z, w, "" if w > z else " ")))
    return out


def number_spelling(s: Source) -> list[str]:
    """Decimal integers as hexadecimal and back."""
    out = []
    for a, t in zip([None, *s.tokens], s.tokens):
        if t.type == tokenize.NUMBER and t.string.isdigit():
            out.append(s.put((*s.token(t), hex(int(t.string)))))
        elif t.type == tokenize.NUMBER and t.string.lower().startswith("0x"):
            out.append(s.put((*s.token(t), str(int(t.string, 16)))))
    return out


def grouping_parentheses(s: Source) -> list[str]:
    """The value of an assignment or a return gets parentheses, or loses them."""
    out = []
    for n in ast.walk(s.tree):
        v = getattr(n, "value", None) if isinstance(n, (ast.Assign, ast.Return, ast.AugAssign)) else None
        if v is None or isinstance(v, (ast.Tuple, ast.Yield, ast.YieldFrom, ast.GeneratorExp, ast.NamedExpr, ast.Starred)):
            continue
        a, b = s.span(v)
        if s.data[a - 1 : a] == b"(" and s.data[b : b + 1] == b")" and v.lineno == v.end_lineno:
            out.append(s.put((a - 1, a, " " if s.data[a - 2 : a - 1].isalnum() else ""), (b, b + 1, "")))
        else:
            out.append(s.put((a, a, "("), (b, b, ")")))
    return out


def trailing_comma(s: Source) -> list[str]:
    """The last element of a list, set, dict or call gets a comma, or loses it."""
    out = []
    for n in ast.walk(s.tree):
        last = None
        if isinstance(n, (ast.List, ast.Set)) and n.elts:
            last = n.elts[-1]
        elif isinstance(n, ast.Dict) and n.values:
            last = n.values[-1]
        elif isinstance(n, ast.Call) and (n.args or n.keywords) and not any(isinstance(x, ast.GeneratorExp) for x in n.args):
            last = max([*n.args, *[k.value for k in n.keywords]], key=lambda x: (x.end_lineno, x.end_col_offset))
        if last is None:
            continue
        end, close = s.span(last)[1], s.span(n)[1] - 1
        between = s.data[end:close].strip()
        if between == b"":
            out.append(s.put((end, end, ",")))
        elif between == b",":
            out.append(s.put((end, close, "")))
    return out


def statement_boundary(s: Source) -> list[str]:
    """Two simple statements share a line with a semicolon, or part."""
    out = []
    for _, body in s.bodies():
        for a, b in zip(body, body[1:]):
            if not (isinstance(a, SIMPLE) and isinstance(b, (*SIMPLE, ast.Return))):
                continue
            x, y = s.span(a)[1], s.span(b)[0]
            between, pad = s.data[x:y], s.indent(a)
            if between.strip() == b";" and pad is not None and a.lineno == b.lineno:
                out.append(s.put((x, y, f"\n{pad}")))
            elif not between.strip() and s.indent(b) is not None and between.count(b"\n") == 1 and a.end_lineno == a.lineno:
                out.append(s.put((x, y, "; ")))
    return out


def simple_suite(s: Source) -> list[str]:
    """A block of one simple statement moves to its header's line, or from it."""
    out = []
    for owner, body in s.bodies():
        if not isinstance(owner, (ast.If, ast.For, ast.While, *FUNCTIONS)) or body is not owner.body or len(body) != 1 or not isinstance(body[0], (*SIMPLE, ast.Return, ast.Break, ast.Continue)):
            continue
        x, pad = body[0], s.indent(owner)
        a, b = s.span(x)
        head = s.data[: a].rstrip()
        if pad is None or not head.endswith(b":"):
            continue
        if s.indent(x) is not None and x.lineno == x.end_lineno and b"\n" in s.data[len(head) : a] and not s.data[len(head) : a].strip():
            out.append(s.put((len(head), a, " ")))
        elif s.indent(x) is None and not s.lines[x.end_lineno - 1][x.end_col_offset :].strip():
            out.append(s.put((len(head), a, f"\n{pad}    ")))
    return out


def indentation_unit(s: Source) -> list[str]:
    """All blocks are indented by another number of spaces."""
    if not s.plain_layout():
        return []
    deep = [len(line) - len(line.lstrip(b" ")) for line in s.lines if line.strip() and not line.strip().startswith(b"#")]
    unit = min((x for x in deep if x), default=0)
    if not unit or any(x % unit for x in deep):
        return []
    out = []
    for new in (2, 4, 8):
        if new != unit:
            out.append(b"".join(b" " * ((len(x) - len(x.lstrip(b" "))) // unit * new) + x.lstrip(b" ") for x in s.lines).decode())
    return out


def import_boundary(s: Source) -> list[str]:
    """`import a, b` in two statements, and two in one."""
    out = []
    name = lambda a: a.name + (f" as {a.asname}" if a.asname else "")
    for _, body in s.bodies():
        for x, y in zip(body, [*body[1:], None]):
            if isinstance(x, ast.Import) and (at := s.whole_line(x)):
                pad = s.indent(x)
                if len(x.names) > 1:
                    out.append(s.put((*at, "".join(f"{pad}import {name(a)}\n" for a in x.names))))
                if isinstance(y, ast.Import) and (next_ := s.whole_line(y)) and at[1] == next_[0]:
                    out.append(s.put((at[0], next_[1], f"{pad}import {', '.join(name(a) for a in [*x.names, *y.names])}\n")))
    return out


def redundant_pass(s: Source) -> list[str]:
    """A block with other statements gets a pass, or loses one."""
    out = []
    for owner, body in s.bodies():
        for x in body:
            if not (at := s.whole_line(x)) or isinstance(x, (*FUNCTIONS, ast.ClassDef)):
                continue
            if isinstance(x, ast.Pass) and len(body) > 1:
                out.append(s.put((*at, "")))
            elif not is_docstring(owner, body, x) and not (isinstance(x, ast.ImportFrom) and x.module == "__future__"):
                out.append(s.put((at[0], at[0], f"{s.indent(x)}pass\n")))
    return out


def sole_pass(s: Source) -> list[str]:
    """A block that is nothing but pass is nothing but 0, and back."""
    out = []
    for owner, body in s.bodies():
        x = body[0]
        if len(body) == 1 and not isinstance(owner, ast.Module):
            if isinstance(x, ast.Pass):
                out.append(s.put((*s.span(x), "0")))
            elif isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and x.value.value == 0 and s.code(x) == "0":
                out.append(s.put((*s.span(x), "pass")))
    return out


def return_none(s: Source) -> list[str]:
    """`return` and `return None`."""
    out = []
    for n in ast.walk(s.tree):
        if isinstance(n, ast.Return):
            if n.value is None:
                out.append(s.put((*s.span(n), "return None")))
            elif isinstance(n.value, ast.Constant) and n.value.value is None:
                out.append(s.put((*s.span(n), "return")))
    return out


def final_return(s: Source) -> list[str]:
    """A function's body ends with a bare return, or does not."""
    out = []
    for owner, body in s.bodies():
        if not isinstance(owner, FUNCTIONS) or body is not owner.body:
            continue
        x = body[-1]
        if isinstance(x, ast.Return) and x.value is None and len(body) > 1 and (at := s.whole_line(x)):
            out.append(s.put((*at, "")))
        elif not isinstance(x, (ast.Return, ast.Raise)) and s.indent(body[0]) is not None and not s.lines[x.end_lineno - 1][x.end_col_offset :].strip():
            end = s.starts[x.end_lineno]
            lead = "" if s.data[:end].endswith(b"\n") else "\n"
            out.append(s.put((end, end, f"{lead}{s.indent(body[0])}return\n")))
    return out


def object_base(s: Source) -> list[str]:
    """`class A:` and `class A(object):`, where no other name hides object."""
    if any(isinstance(n, ast.Name) and n.id == "object" and isinstance(n.ctx, ast.Store) for n in ast.walk(s.tree)):
        return []
    out = []
    for n in ast.walk(s.tree):
        if isinstance(n, ast.ClassDef) and not n.keywords and not n.type_params:
            a = s.span(n)[0]
            at = s.data.index(n.name.encode(), a + 5) + len(n.name.encode())
            if not n.bases and s.data[at : at + 1] == b":":
                out.append(s.put((at, at, "(object)")))
            elif len(n.bases) == 1 and s.data[at:].startswith(b"(object):"):
                out.append(s.put((at, at + 8, "")))
    return out


def raise_parentheses(s: Source) -> list[str]:
    """`raise E` and `raise E()` of a built-in exception that no other name hides."""
    hidden = {n.id for n in ast.walk(s.tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    known = {k for k, v in vars(builtins).items() if isinstance(v, type) and issubclass(v, Exception)} - hidden - {"UnicodeDecodeError", "UnicodeEncodeError", "UnicodeTranslateError", "ExceptionGroup", "BaseExceptionGroup"}
    out = []
    for n in ast.walk(s.tree):
        if isinstance(n, ast.Raise) and n.exc is not None:
            if isinstance(n.exc, ast.Name) and n.exc.id in known:
                out.append(s.put((*s.span(n.exc), f"{n.exc.id}()")))
            elif isinstance(n.exc, ast.Call) and isinstance(n.exc.func, ast.Name) and n.exc.func.id in known and not n.exc.args and not n.exc.keywords:
                out.append(s.put((*s.span(n.exc), n.exc.func.id)))
    return out


def split_integer(s: Source) -> list[str]:
    """A decimal integer n as (n - 1 + 1)."""
    inside = [s.span(n) for n in ast.walk(s.tree) if isinstance(n, ast.JoinedStr)]
    return [s.put((a, b, f"({int(t.string) - 1} + 1)")) for t in s.tokens if t.type == tokenize.NUMBER and t.string.isdigit() and int(t.string) > 0 for a, b in [s.token(t)] if not any(x <= a < y for x, y in inside)]


def opaque_predicate(s: Source) -> list[str]:
    """A simple statement of a function stands under a condition that always holds, or no longer does."""
    out = []
    always = "if 7 * 7 - 49 == 0:"
    for owner, body in s.bodies():
        for x in body:
            if isinstance(x, (ast.Assign, ast.AugAssign)) and (at := s.whole_line(x)) and x.lineno == x.end_lineno:
                pad = s.indent(x)
                out.append(s.put((*at, f"{pad}{always}\n{pad}    {s.code(x)}\n")))
            elif isinstance(x, ast.If) and not x.orelse and s.data[s.span(x)[0] :].startswith(always.encode()) and len(x.body) == 1 and (at := s.whole_line(x)) and not isinstance(x.body[0], ast.If):
                out.append(s.put((*at, f"{s.indent(x)}{s.code(x.body[0])}\n")))
    return out


def dispatcher(s: Source) -> list[str]:
    """Two assignments behind one another in a function become the states of a loop."""
    out = []
    for owner, body in s.bodies():
        if not isinstance(owner, FUNCTIONS):
            continue
        for a, b in zip(body, body[1:]):
            x, y = s.whole_line(a), s.whole_line(b)
            if not (isinstance(a, (ast.Assign, ast.AugAssign)) and isinstance(b, (ast.Assign, ast.AugAssign)) and x and y and x[1] == y[0] and a.lineno == a.end_lineno and b.lineno == b.end_lineno):
                continue
            pad, state = s.indent(a), fresh(s.text, "state")
            loop = f"{pad}{state} = 0\n{pad}while {state} < 2:\n{pad}    if {state} == 0:\n{pad}        {s.code(a)}\n{pad}    else:\n{pad}        {s.code(b)}\n{pad}    {state} += 1\n"
            out.append(s.put((x[0], y[1], loop)))
    return out


#: In a stable order.
FAMILIES: dict[str, Callable[[Source], list[str]]] = {
    f.__name__: f
    for f in (rename_local, comment_line, assigned_string, optional_space, number_spelling, grouping_parentheses, trailing_comma, statement_boundary, simple_suite, indentation_unit,
              import_boundary, redundant_pass, sole_pass, return_none, final_return, object_base, raise_parentheses, split_integer, opaque_predicate, dispatcher)
}
#: The profile without the two families that change the flow of control.
PLAIN = {k: v for k, v in FAMILIES.items() if k not in ("opaque_predicate", "dispatcher")}
