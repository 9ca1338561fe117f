"""From texts to lines to candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import raw_lines, without_last_empty
from tidemark.operators.patterns import Pattern, all_matches, first_match, line_local, matches_any


def lines_of(texts: DataFrame, key: str = "file", mode: str = "universal") -> DataFrame:
    """(key, line, text): 1-based lines; a null text (an unreadable file) has none."""
    # split once, below the generator; an outer one, as the filter that explode implies would split again
    parts = texts.select(key, raw_lines(F.col("text"), mode).alias("_parts"))
    at = F.posexplode_outer(without_last_empty(F.col("_parts"))).alias("pos", "text")
    return parts.select(key, at).where(F.col("pos").isNotNull()).select(key, (F.col("pos") + 1).alias("line"), "text")


def candidates_of(texts: DataFrame, patterns: Sequence[Pattern], key: str = "file", mode: str = "universal", unicode: bool = True) -> DataFrame:
    """The candidates of whole texts; texts without a match are dropped before they are split, where that is sure."""
    if line_local(patterns):
        texts = texts.where(matches_any(F.col("text"), patterns, unicode))
    return find_candidates(lines_of(texts, key, mode), patterns, key, unicode)


def find_candidates(lines: DataFrame, patterns: Sequence[Pattern], key: str = "file", unicode: bool = True) -> DataFrame:
    """(key, line, snippet, pattern): lines that match, under the first pattern in order.

    Without a shuffle: the alternation drops most lines before the patterns
    are tried one by one.
    """
    hits = lines.where(matches_any(F.col("text"), patterns, unicode))
    return hits.select(key, "line", F.col("text").alias("snippet"), first_match(F.col("text"), patterns, unicode).alias("pattern"))


def tag_lines(lines: DataFrame, patterns: Sequence[Pattern], key: str = "file", unicode: bool = True) -> DataFrame:
    """(key, line, snippet, tags): lines that match, with the names of all patterns that do."""
    hits = lines.where(matches_any(F.col("text"), patterns, unicode))
    return hits.select(key, "line", F.col("text").alias("snippet"), all_matches(F.col("text"), patterns, unicode).alias("tags"))


def merge_sites(tagged: DataFrame, key: str = "file") -> DataFrame:
    """One row per (key, line): the union of its tags, sorted, and its first snippet."""
    return tagged.groupBy(key, "line").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.min("snippet").alias("snippet"))


def under_prefix(texts: DataFrame, prefixes: Sequence[str], key: str = "file") -> DataFrame:
    """Rows whose path is one of ``prefixes`` or below it."""
    test = F.lit(False)
    for p in prefixes:
        test = test | (F.col(key) == p) | F.col(key).startswith(p.rstrip("/") + "/")
    return texts.where(test)


def count_per_pattern(candidates: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """(ord, pattern, n): candidates per pattern, in order, zeros included."""
    names = candidates.sparkSession.createDataFrame([(i, p.name) for i, p in enumerate(patterns)], "ord int, pattern string")
    counts = candidates.groupBy("pattern").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "pattern", "left").select("ord", "pattern", F.coalesce("n", F.lit(0)).alias("n"))
