"""Table functions over Python source text: where Spark has no built-in."""

from __future__ import annotations

import ast
import io
import tokenize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType


def comment_spans(source: str) -> list[tuple[int, int, int]]:
    """(line, start, end) of comment tokens; raises if the text does not tokenize."""
    tokens = tokenize.generate_tokens(io.StringIO(source).readline)
    return [(t.start[0], t.start[1], t.end[1]) for t in tokens if t.type == tokenize.COMMENT]


def docstring_lines(source: str) -> set[int]:
    """Lines of module, class and function docstrings; raises if the text does not parse."""
    owners = (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
    lines: set[int] = set()
    for node in ast.walk(ast.parse(source)):
        first = node.body[0] if isinstance(node, owners) and node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            lines.update(range(first.lineno, first.end_lineno + 1))
    return lines


@udtf(returnType="kind: string, line: int, c0: int, c1: int")
class LexicalSpans:
    """Comment spans and docstring lines of one file.

    A file that neither tokenizes nor parses yields nothing of that kind, so
    nothing in it is ever judged to be a comment or docstring.
    """

    def eval(self, source: str):
        if source is None:
            return
        try:
            yield from [("comment", *s) for s in comment_spans(source)]
        except (tokenize.TokenError, SyntaxError, ValueError):
            pass
        try:
            yield from [("docstring", line, None, None) for line in sorted(docstring_lines(source))]
        except (SyntaxError, ValueError, RecursionError):
            pass


def imported_names(source: str, package: list[str]) -> list[str] | None:
    """Dotted names that a module may import, relative ones resolved in ``package``; null if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    names: set[str] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names.update(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            base = package[: len(package) + 1 - node.level] if node.level else []
            module = ".".join([*base, *([node.module] if node.module else [])]) if node.level else node.module
            names.add(module)
            names.update(f"{module}.{a.name}" for a in node.names)
    return sorted(names)


@F.pandas_udf(ArrayType(StringType()))
def imports_of(source: pd.Series, package: pd.Series) -> pd.Series:
    """Per file: the names of :func:`imported_names`; null for files that are null or do not parse."""
    return pd.Series([None if s is None else imported_names(s, list(p)) for s, p in zip(source, package)])


@F.pandas_udf(StringType())
def parse_error(source: pd.Series) -> pd.Series:
    """Null if the text parses as Python, else the error."""

    def check(text):
        try:
            ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError) as error:
            return f"{type(error).__name__}: {error}"
        return None

    return source.map(check)


def stand_in_lines(source: str) -> list[int]:
    """Lines that set an attribute on a module object built in this file, or on an entry of ``sys.modules``."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    is_module = lambda e: isinstance(e, ast.Call) and ast.unparse(e.func) in ("types.ModuleType", "ModuleType")
    is_entry = lambda e: isinstance(e, ast.Subscript) and ast.unparse(e.value) == "sys.modules"
    assigned = [n for n in ast.walk(tree) if isinstance(n, ast.Assign)]
    built = {ast.unparse(t) for n in assigned if is_module(n.value) or is_entry(n.value) or any(map(is_entry, n.targets)) for t in n.targets}
    found = [n.lineno for n in assigned for t in n.targets if isinstance(t, ast.Attribute) and (is_entry(t.value) or ast.unparse(t.value) in built)]
    found += [n.lineno for n in ast.walk(tree) if isinstance(n, ast.Call) and ast.unparse(n.func) == "setattr" and n.args and (is_entry(n.args[0]) or ast.unparse(n.args[0]) in built)]
    return sorted(set(found))


@F.pandas_udf(ArrayType(IntegerType()))
def stand_in_lines_of(source: pd.Series) -> pd.Series:
    """Per file: the lines of :func:`stand_in_lines`."""
    return source.map(lambda s: stand_in_lines(s or ""))
