"""Python's regular expressions on the executors, spans of matches, and containment of intervals, against plain Python."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.dialect import can_be_empty, fold, needed_literals, to_java
from tidemark.operators.intervals import contained_pairs, mark_contained
from tidemark.operators.patterns import Pattern, VocabularyError, check_vocabulary, match_spans

TEXTS = ["", "a", "abc", "a&&b]c", "&c", "x[y]z", "a\rb\nc", "line\r\n", "line\n", "tab\tend", "é_ü 1²½Ⅷ", "\x1c\x1f\x85\xa0 ", "éx", "a‿b", "ſK İı", "AbC aBc", "foo.bar(baz)", "💩 x", "{x}", "a{2}", "x" * 40, "aa bb aa", "ﬁ‍z"]

ATOMS = st.sampled_from(["a", "b", "c", "x", r"\.", r"\w", r"\W", r"\d", r"\D", r"\s", r"\S", ".", r"\b", r"\B", "^", "$", r"\A", r"\Z", "[a&&b]", "[a[x]", "[^ab]", r"[^\W]", r"[\S-]", r"[^\s\S]", "[]x]", "[^]x]", "é", "ü", "{", "}", r"\t", r"\x41", r"é", "&", "(?:ab|a)", "💩", "[a-c]", "[à-ÿ]", r"[\w.]", r"\]", "-", "~", "#", " "])


def wrap(inner):
    return st.one_of(
        st.tuples(inner, inner).map("".join), st.tuples(inner, inner).map("|".join), inner.map("({})".format), inner.map("(?:{})*".format), inner.map("(?:{})+?".format),
        inner.map("(?:{}){{1,3}}".format), inner.map("(?:{}){{,2}}".format), inner.map("(?i:{})".format), inner.map("(?s:{})".format), inner.map("(?m:{})".format), inner.map("(?={})".format), inner.map("(?!{})".format),
        inner.map("(?P<my_name>{})(?P=my_name)".format), inner.map("(?>{})".format), inner.map("(?:{})?+".format),
    )


REGEXES = st.recursive(ATOMS, wrap, max_leaves=6)


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(REGEXES, st.booleans())
def test_java_finds_what_python_finds(spark, regex, unicode):
    try:
        ours = re.compile(regex, 0 if unicode else re.ASCII)
    except re.error:
        return
    try:
        java = to_java(regex, unicode)
    except ValueError as error:
        assert "back reference" in str(error)
        return
    theirs = spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    for text in TEXTS:
        m, found = ours.search(text), theirs.matcher(text)
        assert bool(m) == found.find(), (regex, text)
        if m:
            assert m.group() == found.group(), (regex, text)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(REGEXES)
def test_every_match_holds_the_needed_literals(spark, regex):
    try:
        pattern = re.compile(regex)
    except re.error:
        return
    needs = needed_literals(regex)
    for text in [*TEXTS, "ABC", "aab", "a.b", "axc"]:
        if pattern.search(text):
            assert any(all(x in fold(text) for x in need) for need in needs), (regex, text)


def test_needed_literals_of_typical_patterns():
    assert needed_literals("(?i:License|copyright)") == [frozenset({"license"}), frozenset({"copyright"})]
    assert needed_literals(r"foo\.bar\s*\(x+") == [frozenset({"foo.bar", "(", "x"})]
    assert needed_literals(r"[Ff]oo(?:bar)?") == [frozenset({"foo"})]
    assert needed_literals(r"\w+") == [frozenset()]


def test_vocabularies_are_refused_by_name():
    for regex in ("a*", "(?=x)", r"\b", "a|", "(?(1)a|b)x", "(", "(?P<n>a)(?(n)b|c)"):
        with pytest.raises(VocabularyError):
            check_vocabulary([Pattern("p", regex)])
    check_vocabulary([Pattern("p", "[a&&b]c"), Pattern("q", "(?P<my_name>x)y")])
    with pytest.raises(VocabularyError):
        match_spans(F.lit("x"), "a*")


@pytest.mark.parametrize("regex", ["a+", "[0-9]+|b", r"\w+", "💩", "é|x"])
def test_spans_are_those_of_python(spark, regex):
    texts = [*TEXTS, None, "a1b22 💩a é💩x", "💩💩 a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", match_spans(F.col("t"), regex, unicode=True).alias("s")).collect()
    assert {r.i: [tuple(x) for x in r.s] for r in rows} == {i: [m.span() for m in re.finditer(regex, t or "")] for i, t in enumerate(texts)}


def test_spans_of_a_line_with_many_matches(spark):
    line = "ab1 " * 8000
    frame = spark.createDataFrame([(line,)], "t string").cache()
    spans = frame.select(match_spans(F.col("t"), "[0-9]").alias("s"))
    frame.count(), spans.count()
    began = time.time()
    found = spans.first().s
    assert time.time() - began < 3  # a machine under load; alone it is well under one
    assert [tuple(x) for x in found] == [m.span() for m in re.finditer("[0-9]", line)]


# --- intervals -----------------------------------------------------------------


def random_intervals(seed, n, size, wide):
    chance = random.Random(seed)
    out = []
    for _ in range(n):
        s = chance.randrange(size)
        out.append((chance.choice(["f", "g", None]), chance.choice([1, 2, None]), s, s + chance.randrange(wide)))
    return [*out, ("f", 1, None, 3), ("f", 1, 4, None), ("g", 2, 9, 3)]


def holds(span, cover):
    return None not in (span[2], span[3], cover[2], cover[3]) and span[:2] == cover[:2] and cover[2] <= span[2] <= span[3] <= cover[3]


@pytest.mark.parametrize("segment", [4, 1 << 16])
def test_contained_spans_equal_brute_force(spark, segment):
    spans, covers = random_intervals(1, 300, 60, 12), random_intervals(2, 60, 60, 20)
    schema = "file string, line int, a long, b long"
    got = mark_contained(spark.createDataFrame(spans, schema), spark.createDataFrame(covers, schema), ["file", "line"], "a", "b", "a", "b", segment=segment).collect()
    by = sorted((tuple(r) for r in got), key=str)
    assert by == sorted(((*s, any(holds(s, c) for c in covers)) for s in spans), key=str)


@pytest.mark.parametrize("levels", [7, 40])
def test_contained_pairs_equal_brute_force(spark, levels):
    spans, covers = random_intervals(3, 200, 60, 12), random_intervals(4, 50, 60, 40)
    schema = "file string, line int, a long, b long"
    got = contained_pairs(spark.createDataFrame(spans, schema), spark.createDataFrame(covers, schema), ["file", "line"], "a", "b", "a", "b", levels).collect()
    want = {(*s, c[2], c[3]) for s in spans for c in covers if holds(s, c)}
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_sides_and_clashing_columns(spark):
    some = spark.createDataFrame([("f", 1, 2, "x")], "file string, start long, end long, _hit string").withColumnRenamed("_hit", "extra")
    none = some.limit(0)
    assert [r.contained for r in mark_contained(some, none, ["file"]).collect()] == [False]
    assert mark_contained(none, some, ["file"]).collect() == [] and contained_pairs(some, none, ["file"]).collect() == []
    assert [r.inside for r in mark_contained(some, some, ["file"], name="inside").collect()] == [True]


def test_many_spans_of_one_group_are_swept_in_order(spark):
    n = 100_000
    spans = spark.range(n).select(F.lit("f").alias("file"), F.lit(1).alias("line"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 2).alias("end"))
    covers = spark.range(n // 2).select(F.lit("f").alias("file"), F.lit(1).alias("line"), (F.col("id") * 6).alias("start"), (F.col("id") * 6 + 2).alias("end"))
    began = time.time()
    assert mark_contained(spans, covers, ["file", "line"]).where("contained").count() == n // 2
    assert time.time() - began < 40  # brute force would compare 5e9 pairs
