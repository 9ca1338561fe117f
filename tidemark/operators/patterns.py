"""A prioritised vocabulary of regular expressions: checks, dialect, and matching."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import bound, running
from tidemark.operators.dialect import can_be_empty, to_java

#: Method names too general to search for on their own.
GENERIC_METHODS = {
    "get", "set", "add", "remove", "delete", "update", "list", "count", "query", "info", "type", "range",
    "put", "post", "head", "options", "keys", "values", "items", "pop", "copy", "clear", "format", "strip",
    "split", "join", "replace", "encode", "decode", "index", "extend", "append", "insert", "sort", "reverse",
    "next", "run", "start", "stop", "execute", "commit", "rollback", "save", "load", "loads", "dump",
    "dumps", "parse", "match", "search", "group", "groups", "read", "write", "open", "close", "send", "recv",
    "find", "filter", "map", "reduce", "json",
}
#: The forms of a bare call and of a global flag.
_BARE_CALL = re.compile(r"\\\.\(?([A-Za-z_]+(?:\|[A-Za-z_]+)*)\)?(?:\\s\*)?\\\(")
_GLOBAL_FLAG = re.compile(r"\(\?[aiLmsux]+\)")


class VocabularyError(ValueError):
    """A vocabulary that must not be searched with."""


@dataclass(frozen=True)
class Pattern:
    """A named regular expression; the place in its list is its priority."""

    name: str
    regex: str


def top_level_alternatives(regex: str) -> list[str]:
    """The branches of ``|`` outside parentheses; an escaped character never counts."""
    branches, depth, held, escaped = [], 0, [], False
    for c in regex:
        if escaped or c == "\\":
            escaped = not escaped
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            branches.append("".join(held))
            held = []
            continue
        held.append(c)
    return [*branches, "".join(held)]


def bare_generic_calls(regex: str) -> list[str]:
    """Generic method names that a branch searches for with nothing else to anchor it."""
    calls = (_BARE_CALL.fullmatch(b.strip()) for b in top_level_alternatives(regex))
    return [n for m in calls if m for n in m.group(1).split("|") if n.lower() in GENERIC_METHODS]


def check_vocabulary(patterns: Sequence[Pattern]) -> None:
    """Raise :class:`VocabularyError` unless every pattern is usable alone and in one alternation."""
    seen: set[str] = set()
    if not patterns:
        raise VocabularyError("the vocabulary is empty")
    for p in patterns:
        if not p.name.strip() or not p.regex.strip():
            raise VocabularyError("a pattern has a blank name or regex")
        if p.name in seen:
            raise VocabularyError(f"{p.name}: the name occurs twice")
        seen.add(p.name)
        if _GLOBAL_FLAG.search(p.regex):
            raise VocabularyError(f"{p.name}: a global inline flag would change the other patterns; use (?i:...)")
        if found := bare_generic_calls(p.regex):
            raise VocabularyError(f"{p.name}: bare generic call of {', '.join(found)}")
        try:
            re.compile(p.regex)
            if can_be_empty(p.regex):
                raise VocabularyError(f"{p.name}: it matches the empty string, so every line")
            _check_java(to_java(p.regex))
        except VocabularyError:
            raise
        except (re.error, ValueError) as error:
            raise VocabularyError(f"{p.name}: {error}") from error
    try:
        _check_java(to_java("|".join(f"(?:{p.regex})" for p in patterns)))
    except (re.error, ValueError) as error:
        raise VocabularyError(f"the patterns together: {error}") from error


def _check_java(regex: str) -> None:
    """Raise ValueError unless Java's engine, which the executors use, takes the expression; without a session nothing is known."""
    session = SparkSession.getActiveSession()
    if session is None:
        return
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile(regex)
    except Exception as error:
        reason = str(getattr(error, "java_exception", error)).splitlines()[0]
        raise ValueError(f"not an expression for the executors: {reason}") from error


def matches_any(text: Column, patterns: Sequence[Pattern], unicode: bool = True) -> Column:
    """One alternation of all patterns: the cheap test before the names are told apart."""
    return text.rlike(to_java("|".join(f"(?:{p.regex})" for p in patterns), unicode))


def first_match(text: Column, patterns: Sequence[Pattern], unicode: bool = True) -> Column:
    """Name of the first pattern in order that matches, else null."""
    return F.coalesce(*[F.when(text.rlike(to_java(p.regex, unicode)), F.lit(p.name)) for p in patterns])


def match_spans(text: Column, regex: str, unicode: bool = False) -> Column:
    """Array of (start, end) of all matches, in code points; none for nulls.

    For expressions that match no empty string.  The text is searched twice,
    for the matches and for what lies between them; their lengths add up to
    the ends.
    """
    if can_be_empty(regex):
        raise VocabularyError(f"{regex}: matches the empty string")
    java = to_java(regex, unicode)
    lengths = lambda parts: F.transform(parts, lambda p: F.char_length(p))
    both = F.struct(lengths(F.regexp_extract_all(text, F.lit(java), F.lit(0))).alias("found"), lengths(F.split(text, java, -1)).alias("between"))

    def spans(v: Column) -> Column:
        n = F.size(v["found"])
        steps = F.zip_with(v["found"], F.slice(v["between"], F.lit(1), n), lambda m, g: m + g)
        return F.zip_with(v["found"], running(steps, lambda a, b: a + b), lambda m, e: F.struct((e - m).alias("start"), e.alias("end")))

    found = F.when(text.isNotNull(), bound(both, spans))
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int>>"))


def line_local(patterns: Sequence[Pattern]) -> bool:
    """Whether a line can match only if its whole text does: no anchors and nothing that looks around."""
    return not any(re.search(r"\^|\$|\\[AZzbBG]|\(\?<?[=!]", p.regex) for p in patterns)


def all_matches(text: Column, patterns: Sequence[Pattern], unicode: bool = True) -> Column:
    """Names of all patterns that match, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(to_java(p.regex, unicode)), F.lit(p.name)) for p in patterns]))


def relevance_regex(package: str) -> str:
    """One expression for the ways in which a file can refer to a package.

    The forms are fixed values; quoted dotted paths and dotted uses cover what
    patching and aliased imports look like.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", package, re.ASCII):
        raise ValueError(f"not a bare package name: {package!r}")
    quoted = r"""\(['"][^'"]*""" + package
    forms = [
        rf"\bimport\s+{package}\b", rf"\bfrom\s+{package}[.\s]", rf"\b{package}\.\w+",
        rf"""sys\.modules\[['"][^'"]*{package}""", r"importlib\.import_module" + quoted, r"__import__" + quoted,
        rf"""['"][^'"]*\b{package}\.[a-zA-Z_]""",
    ]
    return "|".join(forms)
