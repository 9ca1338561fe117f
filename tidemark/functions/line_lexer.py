"""Comments and strings of source texts by composing what each line does to the lexer's state.

A line maps every state in which it may be entered to the state in which it is
left: normal, inside a triple-quoted string of either kind, or inside a string
of either kind that a backslash continues.  Composing these maps is
associative, so the state at every line comes from one fold over the lines, and
nothing leaves the JVM.  A text that ends inside a string, or has a string that
its line does not close, is not lexed at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import bound, running
from tidemark.functions.text import split_lines

NORMAL, BAD = 0, 5
#: States 1 to 4: what is open, and what closes it.
OPEN = {1: "'''", 2: '"""', 3: "'", 4: '"'}
#: Strings and the comment of a line whose escaped characters are masked; an open string reaches its end.
_TOKENS = r"""(?s)'''.*?(?:'''|\z)|\"\"\".*?(?:\"\"\"|\z)|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|#.*"""
SPANS = "array<struct<kind:string,line:int,c0:int,c1:int>>"


def _left(last: Column) -> Column:
    """The state after the last token of a line."""
    state = F.when(last.isNull() | last.startswith("#"), NORMAL)
    for number, mark in OPEN.items():
        closed = (F.char_length(last) >= 2 * len(mark)) & last.endswith(mark)
        state = state.when(last.startswith(mark), F.when(closed, NORMAL).otherwise(F.when(last.endswith("\\"), number).otherwise(BAD) if len(mark) == 1 else F.lit(number)))
    return state


def _rest(masked: Column, state: int) -> Column:
    """What a line entered in a state has after that state's string is closed; null if the line does not close it."""
    if state == NORMAL:
        return masked
    at = F.locate(OPEN[state], masked)
    return F.when(at > 0, F.substring(masked, at + len(OPEN[state]), F.char_length(masked)))


def _exit(masked: Column, state: int) -> Column:
    """The state in which a line is left that is entered in ``state``."""
    rest = _rest(masked, state)
    stays = F.lit(BAD) if state == NORMAL else F.lit(state) if len(OPEN[state]) == 3 else F.when(masked.endswith("\\"), state).otherwise(BAD)
    last = F.try_element_at(F.regexp_extract_all(rest, F.lit(_TOKENS), F.lit(0)), F.lit(-1))
    return bound(F.struct(rest.isNull().alias("open"), last.alias("last")), lambda v: F.when(v["open"], stays).otherwise(_left(v["last"])))


def _line(line: Column) -> Column:
    """struct(masked, map): the line with escaped characters masked, and its map of states in 3 bits each."""

    def facts(masked: Column) -> Column:
        states = sum((F.call_function("shiftleft", _exit(masked, s), F.lit(3 * s)) for s in range(5)), F.lit(BAD << 15))
        return F.struct(masked.alias("masked"), states.alias("map"))

    plain = F.struct(line.alias("masked"), F.lit(sum(s << 3 * s for s in range(6))).alias("map"))
    return F.when(line.rlike(r"['\"#\\]"), bound(F.regexp_replace(line, r"(?s)\\.", "\x01\x01"), facts)).otherwise(plain)


def _tokens_of(masked: Column, state: Column, number: Column) -> Column:
    """Array of (kind, line, c0, c1) of a line that is entered in a known state."""
    rest = F.when(state == NORMAL, masked)
    for s in OPEN:
        rest = rest.when(state == s, _rest(masked, s))

    def spans(v: Column) -> Column:
        rest, n = v["rest"], v["n"]
        found = F.transform(F.regexp_extract_all(rest, F.lit(_TOKENS), F.lit(0)), lambda t: F.struct(F.char_length(t).alias("size"), t.startswith("#").alias("comment")))
        between = F.transform(F.split(rest, _TOKENS, -1), lambda g: F.char_length(g))

        def placed(w: Column) -> Column:
            steps = F.zip_with(w["found"], F.slice(w["between"], F.lit(1), F.size(w["found"])), lambda t, g: t["size"] + g)
            kind = lambda t: F.when(t["comment"], "comment").otherwise("string")
            return F.zip_with(w["found"], running(steps, lambda a, b: a + b), lambda t, e: F.struct(kind(t).alias("kind"), number.alias("line"), (v["before"] + e - t["size"]).alias("c0"), (v["before"] + e).alias("c1")))

        head = F.when(v["before"] > 0, F.array(F.struct(F.lit("string").alias("kind"), number.alias("line"), F.lit(0).alias("c0"), v["before"].alias("c1")))).otherwise(F.array().cast(SPANS))
        whole = F.when(n > 0, F.array(F.struct(F.lit("string").alias("kind"), number.alias("line"), F.lit(0).alias("c0"), n.alias("c1")))).otherwise(F.array().cast(SPANS))
        inside = F.concat(head, bound(F.struct(found.alias("found"), between.alias("between")), placed))
        return F.when(rest.isNull(), whole).otherwise(inside)

    n = F.char_length(masked)
    facts = F.struct(rest.alias("rest"), n.alias("n"), (n - F.char_length(rest)).alias("before"))
    simple = (state == NORMAL) & ~masked.rlike("['\"#]")
    return F.when(simple, F.array().cast(SPANS)).otherwise(bound(facts, spans))


def _then(earlier: Column, later: Column) -> Column:
    """The map of two lines in a row."""
    of = lambda m, s: F.call_function("shiftright", m, s).bitwiseAND(F.lit(7))
    return sum((F.call_function("shiftleft", of(later, of(earlier, F.lit(3 * s)) * 3), F.lit(3 * s)) for s in range(6)), F.lit(0))


def lexical_spans_of(text: Column, mode: str = "universal") -> Column:
    """Array of (kind, line, c0, c1) of the comments and strings of a text, in code points, lines from 1; none for null.

    ``kind`` is comment or string; a string has its quotes, without the letters
    before them, and an entry for every line that it reaches.  Equal to what
    Python's tokenizer finds in what it accepts, but for f-strings that hold
    quotes of their own kind.
    """

    def spans(lines: Column) -> Column:
        def pick(maps: Column) -> Column:
            entered = lambda i: F.when(i == 0, NORMAL).otherwise(F.get(maps, i - 1).bitwiseAND(F.lit(7)))
            at = F.flatten(F.transform(lines, lambda x, i: bound(entered(i), lambda s: _tokens_of(x["masked"], s, i + 1))))
            whole = F.try_element_at(maps, F.lit(-1)).bitwiseAND(F.lit(7)) == NORMAL
            return F.when(whole, at)

        return bound(running(F.transform(lines, lambda x: x["map"]), _then), pick)

    return F.coalesce(bound(F.transform(split_lines(text, mode), _line), spans), F.array().cast(SPANS))


def comment_spans_of(text: Column, mode: str = "universal") -> Column:
    """Array of (line, c0, c1) of the comments alone, see :func:`lexical_spans_of`."""
    comments = F.filter(lexical_spans_of(text, mode), lambda s: s["kind"] == "comment")
    return F.transform(comments, lambda s: F.struct(s["line"].alias("line"), s["c0"].alias("c0"), s["c1"].alias("c1")))
