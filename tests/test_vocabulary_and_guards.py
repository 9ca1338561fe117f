import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import guards, scan
from tidemark.operators.dialect import to_java
from tidemark.operators.patterns import Pattern, VocabularyError, bare_generic_calls, check_vocabulary, relevance_regex, top_level_alternatives


def one(spark, expression, *values):
    schema = ", ".join(f"{c} string" for c in "abc"[: len(values)])
    return spark.createDataFrame([values], schema).select(expression).first()[0]


@pytest.mark.parametrize("text", ["a\nb\n", "a\r\nb", "", "\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "x\n\n"])
def test_lines_are_those_of_splitlines(spark, text):
    assert one(spark, T.split_lines(F.col("a")), text) == text.splitlines()


def test_text_functions(spark):
    assert one(spark, T.strip(F.col("a")), " \t x y \n") == "x y"
    assert one(spark, T.is_blank(F.col("a")), " ") and not one(spark, T.is_blank(F.col("a")), "x")
    assert one(spark, T.normalize_path(F.col("a")), " ./host/host/a.py") == "host/a.py"
    assert one(spark, T.normalize_line(F.col("a")), '  f( "x",   1) ') == "f( 'x', 1)"
    assert one(spark, T.code_spans(F.col("a")), "`x` and ` y ` and `x` and `no\nspan`") == ["x", "y"]
    spans = one(spark, T.identifier_spans(F.col("a")), "`TS.GET` gives `[(k, v)]`, was `None`, see `old_name`")
    assert [(s.span, s.tokens) for s in spans] == [("TS.GET", ["ts", "get"]), ("old_name", ["old_name"])]
    assert one(spark, T.is_import_line(F.col("a")), "  from x import y") and not one(spark, T.is_import_line(F.col("a")), "x = 1")


def test_alternatives_and_generic_calls():
    assert top_level_alternatives(r"a|(b|c)|d\|e") == ["a", "(b|c)", r"d\|e"]
    assert bare_generic_calls(r"HybridQuery|\.load\s*\(") == ["load"]
    assert bare_generic_calls(r"\.(get|fetch_all)\(") == ["get"]
    assert bare_generic_calls(r"client\.get\(|\.very_special\(") == []


@pytest.mark.parametrize("regex", [r"\.get\(", r"\.GET\(", "(?i)x", "(", " ", "a*", r"(a)(?(1)b|c)"])
def test_bad_vocabulary(spark, regex):
    with pytest.raises(VocabularyError):
        check_vocabulary([Pattern("p", regex)])


def test_good_vocabulary():
    check_vocabulary([Pattern("a", "(?i:x)"), Pattern("b", r"Thing\.get\(")])
    for bad in ([], [Pattern("a", "x"), Pattern("a", "y")]):
        with pytest.raises(VocabularyError):
            check_vocabulary(bad)


def test_dialect(spark):
    for regex, text in ((r"\bFoo\b", "éFoo"), (r"\bFoo\b", "a Foo"), (r"(?P<n>x)y\Z", "xy"), (r"(?P<q>['\"])x(?P=q)", "'x'"), (r"(?P<q>['\"])x(?P=q)", "'x\""), (r"\w+é", "ééé")):
        assert one(spark, F.col("a").rlike(to_java(regex)), text) == bool(re.search(regex, text))
    for text in ("import widget", "from widget.a import b", "widget.run", 'sys.modules["widget"]', "importlib.import_module('widget')", "patch('widget.run')"):
        assert one(spark, F.col("a").rlike(to_java(relevance_regex("widget"))), text) and re.search(relevance_regex("widget"), text)
    assert not re.search(relevance_regex("widget"), "widgets = 1")
    with pytest.raises(ValueError):
        relevance_regex("a.b")


PATTERNS = [Pattern("a", "aa"), Pattern("b", "b"), Pattern("c", "cc")]


def candidates(spark, counts):
    return spark.createDataFrame([("f", i, "s", p) for p, n in counts.items() for i in range(n)], "file string, line int, snippet string, pattern string")


@pytest.mark.parametrize("counts,ok", [({"a": 1000, "b": 1001}, False), ({"a": 500, "b": 2, "c": 1}, False), ({"a": 20, "b": 20, "c": 20}, True), ({}, True), ({"a": 24}, True)])
def test_yield_guard(spark, counts, ok):
    assert guards.check_yield(candidates(spark, counts), PATTERNS).ok == ok


def test_first_pattern_wins_a_tie(spark):
    row = guards.yield_summary(scan.count_per_pattern(candidates(spark, {"b": 30, "a": 30}), PATTERNS)).first()
    assert (row.top_pattern, row.total, row.top_share) == ("a", 60, 0.5)


def test_fact_coverage(spark):
    guide = spark.createDataFrame([("`a` `b` `c` `d`",)], "text string")
    facts = lambda *t: spark.createDataFrame(list(enumerate(t)), "number int, text string")
    assert not guards.check_fact_coverage(guide, facts("only `a`")).ok
    assert not guards.check_fact_coverage(guide, facts()).ok
    assert guards.check_fact_coverage(guide, facts("`a` and `b`", "`c`")).ok
    assert guards.check_fact_coverage(spark.createDataFrame([("plain",)], "text string"), facts("x")).ok


def test_vocabulary_coverage(spark):
    facts = spark.createDataFrame([(1, "`MEMORY STATS` moved"), (2, "`gone_call` is removed"), (3, "`other` is confirmed unchanged"), (4, "returns `[x]` now")], "number int, text string")
    patterns = spark.createDataFrame([("m", r"\bmemory_stats\b")], "name string, regex string")
    got = {r.number: r.status for r in guards.vocabulary_coverage(facts, patterns).collect()}
    assert got == {1: "covered", 2: "uncovered"}
    assert not guards.check_vocabulary_coverage(facts, patterns).ok


def test_covering_pairs_are_all_pairs_that_contain_each_other(spark):
    tokens = ["memory_stats", "stats", "st", "_a", "__", "a", "call", "recall", "abcabd", "x_y", None]
    words = ["memorystats", "s_t", "a", "_", "all", "abd", "xyz", "call", "", None]
    of = lambda name, values: spark.createDataFrame([(v,) for v in [*values, *values]], f"{name} string")
    got = sorted(map(tuple, guards.covering_pairs(of("token", tokens), of("word", words)).collect()))
    plain = lambda x: x.replace("_", "")
    held = lambda a, b: plain(a) in plain(b) or plain(b) in plain(a)
    assert got == sorted((t, w) for t in tokens for w in words if t is not None and w is not None and held(t, w))
    assert guards.covering_pairs(of("token", []), of("word", words)).count() == 0
