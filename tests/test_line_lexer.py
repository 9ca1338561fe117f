"""Comments from composed line states against Python's tokenizer."""

import glob
import io
import os
import tokenize

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.columns import running
from tidemark.functions.line_lexer import comment_spans_of, lexical_spans_of
from tidemark.functions.source_code import comment_spans
from tidemark.operators import prefilter

SOURCES = {
    "plain": "x = 1  # one\n# two\ny = '#no' # yes\n",
    "triple": 's = """a # no\n# no\n""" # yes\nt = \'\'\'x\n\'\'\'  # yes\n"""one line""" # yes\n',
    "escapes": "a = 'it\\'s # no' # yes\nb = \"\\\\\" # yes\nc = '''\\''' # no\n''' # yes\n",
    "continued": "a = 'one \\\n two # no' # yes\nb = \"one \\\n# no\" # yes\n",
    "mixed": "a = '\"' # yes\nb = \"'\" # yes\nc = '''\"''' # yes\nd = \"\"\"'''\"\"\" # yes\n",
    "prefixes": "a = rb'#' # yes\nb = Rf'''#\n''' # yes\nc = u'' # yes\n",
    "empty strings": "a = '' # yes\nb = \"\" # yes\nc = '' '' # yes\n",
    "wide": "a = '💩é' # é💩\n# 💩💩\n",
    "no end": "a = 1 # last line",
    "crlf": "a = 1 # one\r\nb = '#' # two\r\n",
    "escaped in comment": "a = 1 # back\\\\slash \\' quote\nb = 2 # x\n",
}
BROKEN = {"open triple": 'a = 1 # x\ns = """open\n# no\n', "open single": "a = 'x # no\nb = 1 # x\n", "open at end": "# x\na = 'y \\\n"}


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", comment_spans_of(F.col("t")).alias("s")).collect()
    return [[tuple(x) for x in r.s] for r in sorted(rows)]


def test_comments_are_those_of_the_tokenizer(spark):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = sorted(p for d in ("tests", "tidemark/operators", "tidemark/sources", "tidemark/functions") for p in glob.glob(f"{here}/{d}/*.py"))
    files = [open(p, encoding="utf-8").read() for p in paths]
    texts = [*SOURCES.values(), *(t for t in files if not any(ord(c) in (0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029, 0x0B, 0x0C) for c in t))]
    for got, text in zip(found(spark, texts), texts):
        assert got == sorted(comment_spans(text)), text[:200]


def plain_strings(text):
    """(line, c0, c1) of the parts of STRING tokens, without their letters; None where there is an f-string."""
    lines, out = text.splitlines(), []
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type in (tokenize.FSTRING_START, tokenize.FSTRING_END):
            return None
        if t.type == tokenize.STRING:
            (a, x), (b, y) = t.start, t.end
            x += min(t.string.index("'") if "'" in t.string else 9, t.string.index('"') if '"' in t.string else 9)
            out += [(k, x if k == a else 0, y if k == b else len(lines[k - 1])) for k in range(a, b + 1)]
    return [s for s in out if s[2] > s[1]]


def test_strings_are_those_of_the_tokenizer(spark):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = [open(p, encoding="utf-8").read() for d in ("tests", "tests/llm", "tidemark/llm", "tidemark/plans") for p in sorted(glob.glob(f"{here}/{d}/*.py"))]
    texts = [t for t in [*SOURCES.values(), *files] if not any(ord(c) in (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029) for c in t)]
    pairs = [(t, want) for t in texts if (want := plain_strings(t)) is not None]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, t string").select("i", lexical_spans_of(F.col("t")).alias("s")).collect()
    got = {r.i: sorted((x.line, x.c0, x.c1) for x in r.s if x.kind == "string") for r in rows}
    assert len(pairs) > 12
    for i, (t, want) in enumerate(pairs):
        assert got[i] == want, t[:300]


def test_what_does_not_end_has_no_comments(spark):
    assert found(spark, [*BROKEN.values(), None, "", "\n\n"]) == [[]] * 6


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("'\"#\\\n a"), max_size=24), min_size=40, max_size=40))
def test_random_texts_agree_where_python_tokenizes(spark, texts):
    for got, text in zip(found(spark, texts), texts):
        try:
            want = sorted(comment_spans(text))
        except Exception:
            continue  # what Python refuses for other reasons may still have comments here
        assert got == want, text


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 1000])
def test_running_combines_in_order(spark, n):
    items = [chr(97 + i % 26) for i in range(n)]
    got = spark.createDataFrame([(items,)], "a array<string>").select(running(F.col("a"), lambda x, y: F.concat(x, y)).alias("r")).first().r
    assert got == ["".join(items[: i + 1]) for i in range(n)]


def test_stage_b_with_the_line_lexer(spark):
    files = spark.createDataFrame([("a.py", "x = Gadget() # Gadget\ny = 1 # Gadget\nz = '# Gadget'\n")], "file string, text string")
    candidates = spark.createDataFrame([("a.py", 1, "x = Gadget() # Gadget", "g"), ("a.py", 2, "y = 1 # Gadget", "g"), ("a.py", 3, "z = '# Gadget'", "g")], "file string, line int, snippet string, pattern string")
    for lexer in (prefilter.line_lexer(), prefilter.python_lexer):
        got = {r.line: r.rule for r in prefilter.lexical_verdicts(candidates, files, "Gadget", lexer).collect()}
        assert got == {1: None, 2: "comment", 3: None}
