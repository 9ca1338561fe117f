"""Column expressions for text, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks of Python's ``str.splitlines``.
LINE_BREAKS = r"\R|[\x1c-\x1e]"
#: Phrases that mark a fact as not breaking.
NON_BREAKING_MARKERS = (
    "out of scope", "not a breaking change", "confirmed unchanged",
    "not breaking", "unaffected by", "does not change", "no change needed",
)
#: Code spans that are literal values, not identifiers.
LITERAL_SPANS = ("none", "true", "false", "self", "cls")


def split_lines(text: Column, mode: str = "universal") -> Column:
    """Array of lines; ``universal`` breaks where Python's splitlines does, ``lf`` at line feeds only.

    A final line break opens no further line, and an empty text has no line.
    """
    return without_last_empty(raw_lines(text, mode))


def raw_lines(text: Column, mode: str = "universal") -> Column:
    """What lies between line breaks."""
    return F.split(text, LINE_BREAKS if mode == "universal" else "\n")


def without_last_empty(parts: Column) -> Column:
    """An array without its last entry, if that is empty."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty, or white space alone."""
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def normalize_path(path: Column, host: bool = True) -> Column:
    """Stripped, without one leading ``./`` and, if ``host``, then one leading ``host/``."""
    out = F.regexp_replace(strip(path), r"^\./", "")
    return F.regexp_replace(out, "^host/", "") if host else out


def normalize_line(line: Column) -> Column:
    """A line as fixes compare it: stripped, single spaces, single quotes."""
    return F.translate(F.regexp_replace(strip(line), r"(?U)\s+", " "), '"', "'")


def request_key(system: Column, user: Column) -> Column:
    """First 24 hex digits of the SHA-256 of system text, a NUL, and user text."""
    return F.substring(F.sha2(F.concat(system, F.lit("\0"), user), 256), 1, 24)


def code_spans(text: Column) -> Column:
    """Distinct back-ticked spans without a line break, stripped, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("`([^`\n]+)`"), F.lit(1)), strip))


def identifier_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores of at least two characters."""
    return F.transform(F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: F.length(w) >= 2), F.lower)


def identifier_spans(fact: Column) -> Column:
    """Spans of a fact that name code, each with its tokens; value shapes and literals are left out."""
    named = F.filter(code_spans(fact), lambda s: ~F.substring(s, 1, 1).isin("[", "(", "{") & ~F.lower(s).isin(*LITERAL_SPANS))
    return F.transform(named, lambda s: F.struct(s.alias("span"), identifier_tokens(s).alias("tokens")))


def is_non_breaking(fact: Column) -> Column:
    """Whether a fact says of itself that nothing breaks."""
    low = F.lower(fact)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in NON_BREAKING_MARKERS])


def is_import_line(snippet: Column) -> Column:
    """A line that starts with ``from`` or ``import``."""
    return snippet.rlike(r"^\s*(from|import)\s")


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    """``top / bottom`` as double, and ``empty`` where bottom is zero."""
    return F.when(bottom == 0, F.lit(empty).cast("double")).otherwise(top.cast("double") / bottom)
