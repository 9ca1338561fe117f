"""Removing candidates only on provable grounds, with a log of every removal.

Stage A keeps candidates of relevant files.  Stage B drops matches that lie in
comments or docstrings.  Stage C drops nothing: it groups equal lines of a file
behind one representative and keeps what is needed to expand them again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.line_lexer import comment_spans_of
from tidemark.functions.source_code import LexicalSpans
from tidemark.functions.text import strip
from tidemark.operators.intervals import mark_contained
from tidemark.operators.patterns import match_spans
from tidemark.operators.relevance import relevant_files
from tidemark.sources.tables import stage, stage_counted

SPANS = "array<struct<start:int,end:int>>"


def keep_relevant(candidates: DataFrame, relevant: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by whether the candidate's file is relevant."""
    return candidates.join(relevant.select(key), key, "left_semi"), candidates.join(relevant.select(key), key, "left_anti")


def _dropped(rows: DataFrame, stage_name: str, rule, reason: str, spans=None, key: str = "file") -> DataFrame:
    spans = F.lit(None).cast(SPANS) if spans is None else spans
    return rows.select(F.lit(stage_name).alias("stage"), rule.alias("rule"), key, "line", "snippet", spans.alias("matched_span"), F.lit(reason).alias("reason"))


def python_lexer(files: DataFrame) -> DataFrame:
    """(file, kind, line, c0, c1) of comments and docstring lines, by Python's tokenizer and parser."""
    return files.lateralJoin(LexicalSpans(F.col("text").outer())).select("file", "kind", "line", "c0", "c1")


def line_lexer(mode: str = "universal") -> Callable[[DataFrame], DataFrame]:
    """A lexer of comments alone, for any text in which ``#`` starts one outside of quotes; nothing leaves the JVM."""

    def lex(files: DataFrame) -> DataFrame:
        spans = files.select("file", F.explode(comment_spans_of(F.col("text"), mode)).alias("s"))
        return spans.select("file", F.lit("comment").alias("kind"), "s.line", "s.c0", "s.c1")

    return lex


def lexical_verdicts(candidates: DataFrame, files: DataFrame, regex: str, lexer: Callable[[DataFrame], DataFrame] = python_lexer) -> DataFrame:
    """Candidates with ``rule`` (docstring, comment, or null for keep) and ``matched_span``.

    Files are analysed once each, and only those that have candidates.  Every
    match of a line must lie in a comment of that line; which do is found by
    sweeping both, so a line with very many of either is no quadratic case.  A
    candidate without a match span on its line, or whose file cannot be
    analysed, is kept: a missing row never means drop.
    """
    used = files.join(candidates.select("file").distinct(), "file", "left_semi").where(F.col("text").isNotNull())
    spans = stage(lexer(used), "lexical")
    doc = spans.where("kind = 'docstring'").select("file", "line", F.lit(True).alias("in_doc")).distinct()
    comment = spans.where("kind = 'comment'").select("file", "line", "c0", "c1")
    found = F.explode(match_spans(F.col("snippet"), regex, unicode=True)).alias("m")
    matches = candidates.select("file", "line", "snippet").distinct().select("file", "line", found).select("file", "line", F.col("m.start").alias("c0"), F.col("m.end").alias("c1")).distinct()
    marked = mark_contained(stage(matches, "matches"), comment, ["file", "line"], "c0", "c1", "c0", "c1", "inside")
    listed = F.array_sort(F.collect_list(F.struct(F.col("c0").alias("start"), F.col("c1").alias("end"))))
    # only lines that are dropped list their spans, which one line bounds
    covered = marked.groupBy("file", "line").agg(F.bool_and("inside").alias("in_comment"), listed.alias("matched_span"))
    joined = candidates.join(doc, ["file", "line"], "left").join(covered, ["file", "line"], "left")
    rule = F.when(F.coalesce("in_doc", F.lit(False)), "docstring").when(F.coalesce("in_comment", F.lit(False)), "comment")
    return joined.withColumn("rule", rule).drop("in_doc", "in_comment")


def collapse_duplicates(candidates: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """(representatives, expansion): equal stripped snippets of a file, under their lowest line.

    A representative has duplicate_count and duplicate_lines if its group has
    more than one line.  The expansion lists every line of every group.
    """
    body = strip(F.col("snippet"))
    rest = [F.col(c) for c in candidates.columns if c not in (key, "line")]
    groups = candidates.groupBy(key, body.alias("body")).agg(
        F.min(F.struct("line", *rest)).alias("first"), F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("line", "snippet"))).alias("members"),
    )
    many = F.col("n") > 1
    first = [F.col(f"first.{c}").alias(c) for c in candidates.columns if c != key]
    reps = groups.select(key, *first, F.when(many, F.col("n")).alias("duplicate_count"), F.when(many, F.transform("members", lambda m: m["line"])).alias("duplicate_lines"))
    members = groups.select(key, F.col("first.line").alias("rep_line"), F.explode("members").alias("m"))
    return reps, members.select(key, "rep_line", "m.line", "m.snippet")


def expand_duplicates(verdicts: DataFrame, expansion: DataFrame, key: str = "file") -> DataFrame:
    """Verdicts on representatives, repeated for every line they stand for; others pass unchanged."""
    lines = expansion.select(F.col(key).alias("_key"), "rep_line", F.col("line").alias("_line"), F.col("snippet").alias("_snippet"))
    joined = verdicts.join(lines, (F.col(key) == F.col("_key")) & (F.col("line") == F.col("rep_line")), "left")
    out = {"line": F.coalesce("_line", "line")}
    if "snippet" in verdicts.columns:
        out["snippet"] = F.coalesce("_snippet", "snippet")
    return joined.withColumns(out).select(*verdicts.columns)


@dataclass(frozen=True)
class Prefiltered:
    """What the prefilter leaves behind."""

    candidates: DataFrame
    expansion: DataFrame
    droplog: DataFrame
    stats: DataFrame


def run_prefilter(
    candidates: DataFrame, files: DataFrame, target_regex: str, vocabulary_regex: str | None = None, stages: tuple[str, ...] = ("A", "B", "C"), transitive: bool = True,
    strict_failsafe: bool = False, lexer: Callable[[DataFrame], DataFrame] = python_lexer,
) -> Prefiltered:
    """Apply the chosen stages, cheapest and most selective first.

    Every stage's rows are written once and counted while they are written, so
    the statistics cost no job, and the log, the expansion and the candidates
    read what is written.
    """
    if "B" in stages and not vocabulary_regex:
        raise ValueError("stage B needs the vocabulary's combined regex")
    spark = candidates.sparkSession
    start, n = stage_counted(candidates, "candidates", {"start": F.count("*")})
    now, logs, counts = start, [], dict(n)
    if "A" in stages:
        relevant = stage(relevant_files(files, target_regex, transitive, strict_failsafe), "relevant")
        kept, gone = keep_relevant(start, relevant)
        logs.append(_dropped(gone, "A", F.lit("file_relevance"), "the file neither refers to the package nor imports a file that does"))
        now, n = stage_counted(kept, "after-a", {"after_A": F.count("*")})
        counts |= n
    if "B" in stages:
        judged, n = stage_counted(lexical_verdicts(now, files, vocabulary_regex, lexer), "judged", {"after_B": F.count_if(F.col("rule").isNull())})
        counts |= n
        gone = judged.where("rule IS NOT NULL")
        logs.append(_dropped(gone, "B", F.col("rule"), "every match on the line is inside a comment or docstring", F.when(F.col("rule") == "comment", F.col("matched_span"))))
        now = judged.where("rule IS NULL").select(*candidates.columns)
    if "C" in stages:
        reps, expansion = collapse_duplicates(now)
        now, n = stage_counted(reps, "after-c", {"after_C": F.count("*")})
        counts |= n
        expansion = stage(expansion, "expansion")
        folded = expansion.where("line <> rep_line")
        logs.append(_dropped(folded, "C", F.lit("collapsed_duplicate"), "the same line as its representative"))
    else:
        expansion = now.select("file", F.col("line").alias("rep_line"), "line", "snippet")
    droplog = start.limit(0).transform(lambda d: _dropped(d, "", F.lit(""), ""))
    for log in logs:
        droplog = droplog.unionByName(log)
    final = list(counts.values())[-1]
    row = {**counts, "final": final, "reduction_percent": (1 - final / counts["start"]) * 100 if counts["start"] else 0.0}
    stats = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if k == 'reduction_percent' else 'long'}" for k in row))
    return Prefiltered(now, expansion, droplog, stats)
