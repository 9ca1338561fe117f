"""Threshold checks that stop a run before it gets expensive."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import code_spans, identifier_spans, identifier_tokens, is_non_breaking
from tidemark.operators.patterns import Pattern
from tidemark.operators.scan import count_per_pattern


@dataclass(frozen=True)
class GuardResult:
    """Whether the check passed, why not, and its report."""

    ok: bool
    reason: str
    report: str


def yield_summary(per_pattern: DataFrame, max_total: int = 2000, max_share: float = 0.35, floor: int = 25) -> DataFrame:
    """One row from (ord, pattern, n): total, top pattern, its count and share, ok.

    The first pattern in order wins a tie for the top.  A run fails above
    ``max_total`` candidates, or if one pattern has ``floor`` or more and at
    least ``max_share`` of them.
    """
    top = F.max(F.struct(F.col("n"), (-F.col("ord")).alias("o"), F.col("pattern")))
    row = per_pattern.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), top.alias("top"))
    share = F.when(F.col("total") > 0, F.col("top.n") / F.col("total")).otherwise(0.0)
    row = row.select("total", F.col("top.pattern").alias("top_pattern"), F.col("top.n").alias("top_n"), share.alias("top_share"))
    return row.withColumn("ok", ~((F.col("total") > max_total) | ((F.col("top_n") >= floor) & (F.col("top_share") >= max_share))))


def check_yield(candidates: DataFrame, patterns: Sequence[Pattern], max_total: int = 2000, max_share: float = 0.35, floor: int = 25) -> GuardResult:
    """Too many candidates, or one pattern that swamps the rest."""
    counts = count_per_pattern(candidates, patterns)
    row = yield_summary(counts, max_total, max_share, floor).first()
    listed = counts.orderBy(F.desc("n"), "ord").collect()
    report = "\n".join([f"candidates: {row.total} (at most {max_total})", *(f"{r.n:6d}  {r.pattern}" for r in listed)])
    if row.ok:
        return GuardResult(True, "", report)
    if row.total > max_total:
        return GuardResult(False, f"{row.total} candidates are more than {max_total}", report)
    return GuardResult(False, f"pattern {row.top_pattern} has {row.top_n} of {row.total} candidates", report)


def span_overlap(guide: DataFrame, facts: DataFrame, spans_of: Callable[[Column], Column] = code_spans) -> DataFrame:
    """One row: distinct code spans of the guide, those that facts repeat, and their ratio (1 if the guide has none)."""
    spans = lambda d: d.select(F.explode(spans_of(F.col("text"))).alias("span")).distinct()
    both = spans(guide).join(spans(facts).withColumn("held", F.lit(True)), "span", "left")
    row = both.agg(F.count("*").alias("guide_spans"), F.count("held").alias("shared"))
    return row.withColumn("ratio", F.when(F.col("guide_spans") == 0, 1.0).otherwise(F.col("shared") / F.col("guide_spans")))


def check_fact_coverage(guide: DataFrame, facts: DataFrame, min_ratio: float = 0.30) -> GuardResult:
    """Facts that repeat too few of the guide's code spans, or no facts at all."""
    n = facts.count()
    row = span_overlap(guide, facts).first()
    report = f"facts: {n}; guide spans: {row.guide_spans}; shared: {row.shared} ({row.ratio:.0%})"
    if n == 0:
        return GuardResult(False, "there are no facts", report)
    return GuardResult(row.ratio >= min_ratio, "" if row.ratio >= min_ratio else f"facts cover {row.ratio:.0%} of the guide's code spans", report)


def _plain(name: str) -> Column:
    return F.translate(name, "_", "")


def _pieces(text: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct pieces of these sizes, without the shorter ones at the end."""
    of = lambda n: F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def containing_pairs(inner: DataFrame, outer: DataFrame, gram: int = 3) -> DataFrame:
    """Distinct (inner, outer) of which the second contains the first; both tables have one column ``text`` of distinct strings.

    What contains a text has all of its grams, so a pair meets on the gram of
    the inner text that the fewest outer texts have, and is compared whole
    there.  A gram that many outer texts have is a key only for inner texts
    without any rarer one; a text with a gram that no outer text has meets
    nothing.  Texts shorter than a gram meet what has them as a piece.
    """
    size = F.char_length("text")
    pieces = outer.select(F.col("text").alias("outer"), F.explode(_pieces(F.col("text"), (gram,))).alias("gram"))
    counts = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    grams = inner.where(size >= gram).select(F.col("text").alias("inner"), F.explode(_pieces(F.col("text"), (gram,))).alias("gram"))
    ranked = grams.join(counts, "gram", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    chosen = ranked.where("rarest.n > 0").select("inner", F.col("rarest.gram").alias("gram"))
    long = chosen.join(pieces, "gram").where(F.contains("outer", F.col("inner"))).select("inner", "outer")
    short = inner.where((size > 0) & (size < gram)).select(F.col("text").alias("inner"))
    parts = outer.select(F.col("text").alias("outer"), F.explode(_pieces(F.col("text"), tuple(range(1, gram)))).alias("inner"))
    empty = inner.where(size == 0).select(F.col("text").alias("inner"))  # one row at most, in everything
    return long.unionByName(parts.join(short, "inner").select("inner", "outer")).unionByName(F.broadcast(empty).crossJoin(outer.select(F.col("text").alias("outer"))))


def covering_pairs(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (token, word) of which either contains the other, underscores aside.

    ``tokens`` has token and ``words`` word; nulls cover nothing, and without
    rows on either side there are no pairs.
    """
    t = tokens.select("token", _plain("token").alias("text")).where(F.col("token").isNotNull()).distinct()
    w = words.select("word", _plain("word").alias("text")).where(F.col("word").isNotNull()).distinct()
    a, b = t.select("text").distinct(), w.select("text").distinct()
    there = containing_pairs(b, a).select(F.col("outer").alias("a"), F.col("inner").alias("b"))
    back = containing_pairs(a, b).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
    both = there.unionByName(back).distinct()
    return both.join(t.withColumnRenamed("text", "a"), "a").join(w.withColumnRenamed("text", "b"), "b").select("token", "word")


def vocabulary_coverage(facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(number, status): per fact that names code and breaks something: covered, partial or uncovered.

    ``facts`` has (number, text) and ``patterns`` (name, regex).  A span is
    covered if any of its tokens and any word of a pattern's source contain
    each other, underscores aside.
    """
    words = patterns.select(F.explode(identifier_tokens(F.col("regex"))).alias("word"))
    spans = facts.where(~is_non_breaking(F.col("text"))).select("number", F.posexplode(identifier_spans(F.col("text"))).alias("k", "s"))
    tokens = spans.select("number", "k", F.explode_outer("s.tokens").alias("token"))
    known = covering_pairs(tokens, words).select("token").distinct().withColumn("held", F.lit(True))
    per_span = tokens.join(known, "token", "left").groupBy("number", "k").agg(F.coalesce(F.bool_or("held"), F.lit(False)).alias("hit"))
    status = F.when(F.bool_and("hit"), "covered").when(F.bool_or("hit"), "partial").otherwise("uncovered")
    return per_span.groupBy("number").agg(status.alias("status"))


def check_vocabulary_coverage(facts: DataFrame, patterns: DataFrame) -> GuardResult:
    """Facts for which no pattern searches."""
    rows = vocabulary_coverage(facts, patterns).join(facts, "number").orderBy("number").collect()
    missing = [r for r in rows if r.status == "uncovered"]
    report = "\n".join(f"{r.status:9s} {r.number}. {r.text[:90]}" for r in rows)
    return GuardResult(not missing, "" if not missing else f"{len(missing)} facts have no pattern", report)
