"""Runs of an audit: chunk tables, recordings, prompts, truth tables, candidate rules, ablations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import is_import_line, strip
from tidemark.operators.patterns import Pattern, VocabularyError, all_matches, check_vocabulary
from tidemark.operators.prefilter import lexical_verdicts, python_lexer
from tidemark.operators.relevance import relevant_files
from tidemark.operators.usage import COUNTERS
from tidemark.operators.verdicts import read_verdicts
from tidemark.sources.tables import stage


def parse_patterns(text: str) -> list[Pattern]:
    """A vocabulary from JSON: [{name, regex}], or that under ``patterns``; checked, never executed.

    Whatever else the text holds raises :class:`VocabularyError`.
    """
    try:
        data = json.loads(text)
    except ValueError as error:
        raise VocabularyError(f"the vocabulary is not JSON: {error}") from error
    rows = data.get("patterns") if isinstance(data, dict) else data
    if not isinstance(rows, list):
        raise VocabularyError("the vocabulary is neither a list nor an object with patterns")
    for i, r in enumerate(rows):
        if not isinstance(r, dict):
            raise VocabularyError(f"pattern {i}: not an object")
        for name in ("name", "regex"):
            if not isinstance(r.get(name), str):
                raise VocabularyError(f"pattern {i}: {name} is missing or not text")
    patterns = [Pattern(r["name"], r["regex"]) for r in rows]
    check_vocabulary(patterns)
    return patterns


def patterns_table(spark: SparkSession, patterns: Sequence[Pattern]) -> DataFrame:
    """(ord, name, regex)."""
    return spark.createDataFrame([(i, p.name, p.regex) for i, p in enumerate(patterns)], "ord int, name string, regex string")


def truth_table(spark: SparkSession, sites: Iterable[tuple], expected: int, prefix: str = "") -> DataFrame:
    """(file, line, class) of labelled sites, re-rooted under ``prefix``; their number is asserted."""
    rows = [(prefix + file, line, kind) for file, line, kind in sites]
    if len({r[:2] for r in rows}) != expected:
        raise ValueError(f"{len({r[:2] for r in rows})} distinct sites, expected {expected}")
    return spark.createDataFrame(rows, "file string, line int, class string")


def record_calls(calls: DataFrame, path: str) -> None:
    """Append judged requests (key, stage, system_excerpt, user_excerpt, response) to a recording."""
    calls.select("key", "stage", F.substring("system_excerpt", 1, 200).alias("system_excerpt"), F.substring("user_excerpt", 1, 200).alias("user_excerpt"), "response").write.mode("append").parquet(path)


def chunk_prompts(chunks: DataFrame, template: str, facts: str) -> DataFrame:
    """(chunk_id, prompt): the template with its slots {FACTS} and {CANDIDATES} filled; candidates as a JSON list."""
    item = F.struct("file", "line", "snippet")
    listed = F.to_json(F.array_sort(F.collect_list(item)))
    filled = F.replace(F.replace(F.lit(template), F.lit("{FACTS}"), F.lit(facts)), F.lit("{CANDIDATES}"), F.col("candidates"))
    return chunks.groupBy("chunk_id").agg(listed.alias("candidates")).select("chunk_id", filled.alias("prompt"))


def tagged_sites(spark: SparkSession, paths: str | list[str], vocabularies: dict[str, Sequence[Pattern]]) -> DataFrame:
    """(target, repo, file, line, snippet, reason, tags): proposed sites of run files, the last run's where several have one.

    ``tags`` are the patterns of the target's vocabulary that the snippet matches now.
    """
    sites = read_verdicts(spark, paths, run_files=True).where("bucket = 'proposed'")
    last = latest_sites(sites.select("target", "repo", "file", "line", "run", "snippet", "reason"), ["target", "repo", "file", "line"])
    tags = F.array().cast("array<string>")
    for target, patterns in vocabularies.items():
        tags = F.when(F.col("target") == target, all_matches(F.col("snippet"), patterns)).otherwise(tags)
    return last.withColumn("tags", tags).drop("run")


def summarise_checks(fixes: DataFrame, parses: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: whether all fixes agreed with the source, all files parse and all imports resolve, and how many of each there are.

    The tables have one boolean column ``ok``.
    """
    one = lambda d, name: d.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias(f"all_{name}_ok"), F.count("*").alias(f"n_{name}"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias(f"any_{name}_ok"))
    return one(fixes, "fixes").crossJoin(one(parses, "parses")).crossJoin(one(imports, "imports"))  # one row each


def latest_sites(runs: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per site of several runs: the one of the last run."""
    rest = [c for c in runs.columns if c not in on]
    return runs.groupBy(*on).agg(F.max_by(F.struct(*rest), "run").alias("r")).select(*on, *[f"r.{c}" for c in rest])


def count_by_folder(sites: DataFrame) -> DataFrame:
    """Sites per top-level folder."""
    return sites.groupBy(F.split("file", "/")[0].alias("folder")).agg(F.count("*").alias("n"))


def keep_strict(tags: Column, snippet: Column, anchors: Sequence[str], renamed: Sequence[str], moved_only: Sequence[str]) -> Column:
    """Drop only lines whose every tag names a symbol that moved under its old name; imports and anchors stay."""
    among = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    only_moved = F.arrays_overlap(tags, among(moved_only)) & (F.size(F.array_except(tags, among(moved_only))) == 0)
    return F.arrays_overlap(tags, among([*anchors, *renamed])) | is_import_line(snippet) | ~only_moved


def keep_imports(tags: Column, snippet: Column, import_tags: Sequence[str]) -> Column:
    """Keep import lines alone, by tag or by form."""
    return F.arrays_overlap(tags, F.array(*[F.lit(n) for n in import_tags]).cast("array<string>")) | is_import_line(snippet)


def mark_stages(candidates: DataFrame, files: DataFrame, vocabulary_regex: str, truth: DataFrame, direct: DataFrame, reached: DataFrame, lexer: Callable[[DataFrame], DataFrame] = python_lexer) -> DataFrame:
    """Candidates (file, line, snippet) with one bit per stage: direct, transitive, code (stage B keeps it), and is_true.

    ``direct`` and ``reached`` hold the files that stage A keeps.  Every stage
    looks at the same written candidates once; none is run again for a
    combination of stages.
    """
    judged = stage(lexical_verdicts(stage(candidates, "candidates"), files, vocabulary_regex, lexer), "judged")
    has = lambda d, name: d.select("file").distinct().withColumn(name, F.lit(True))
    marked = judged.join(has(direct, "direct"), "file", "left").join(has(reached, "transitive"), "file", "left")
    marked = marked.join(truth.select("file", "line").distinct().withColumn("is_true", F.lit(True)), ["file", "line"], "left")
    no = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return marked.select("file", "line", "snippet", no("direct"), no("transitive"), F.col("rule").isNull().alias("code"), no("is_true"))


def stage_lattice(marked: DataFrame, bits: Sequence[str] = ("direct", "transitive", "code")) -> DataFrame:
    """The cube over ``bits`` (null where a bit is summed over): n, n_true and groups.

    ``n`` counts candidates and ``n_true`` those of the truth; ``groups`` counts
    the groups of equal stripped snippets of a file, which is what stage C leaves.
    """
    lines = marked.groupBy("file", strip(F.col("snippet")).alias("body"), *bits).agg(F.count("*").alias("n"), F.count_if("is_true").alias("n_true"))
    return lines.cube(*bits).agg(F.sum("n").alias("n"), F.sum("n_true").alias("n_true"), F.count_distinct("file", "body").alias("groups"))


def ablate(candidates: DataFrame, files: DataFrame, target_regex: str, vocabulary_regex: str, truth: DataFrame, lexer: Callable[[DataFrame], DataFrame] = python_lexer) -> DataFrame:
    """:func:`ablation_table` of a source tree's candidates under file-local and under transitive relevance."""
    direct = stage(relevant_files(files, target_regex, transitive=False), "direct")
    reached = stage(relevant_files(files, target_regex), "reached")
    return ablation_table(mark_stages(candidates, files, vocabulary_regex, truth, direct, reached, lexer))


def ablation_table(marked: DataFrame) -> DataFrame:
    """(stages, transitive, start, final, reduction_percent, truth_kept) for A, A+B and A+B+C, direct and transitive.

    All six rows are read from the cube over the stages' bits of one marked
    table.  Truth counts as kept if a representative stands for its line.
    """
    cube = stage(stage_lattice(marked), "lattice")
    start = cube.where("direct IS NULL AND transitive IS NULL AND code IS NULL").select(F.col("n").alias("start"))
    found = None
    for transitive, bit, other in ((False, "direct", "transitive"), (True, "transitive", "direct")):
        for stages, code, size in (("A", "code IS NULL", "n"), ("AB", "code", "n"), ("ABC", "code", "groups")):
            row = cube.where(f"{bit} AND {other} IS NULL AND {code}").agg(F.coalesce(F.max(size), F.lit(0)).alias("final"), F.coalesce(F.max("n_true"), F.lit(0)).alias("truth_kept"))
            row = row.select(F.lit(stages).alias("stages"), F.lit(transitive).alias("transitive"), "final", "truth_kept")
            found = row if found is None else found.unionByName(row)
    every = found.crossJoin(F.broadcast(start.agg(F.coalesce(F.max("start"), F.lit(0)).alias("start"))))  # one row
    percent = F.when(F.col("start") > 0, (1 - F.col("final") / F.col("start")) * 100).otherwise(0.0)
    return every.select("stages", "transitive", "start", "final", percent.alias("reduction_percent"), "truth_kept")


def usage_text(usage: DataFrame) -> str:
    """Totals of a run, one line per counter, then the cost or that the price is unknown."""
    lines = []
    for r in usage.orderBy("model").collect():
        lines += [f"{r.model}:", *(f"  {c}: {r[c]}" for c in COUNTERS), "  cost: " + ("price unknown" if r.cost is None else f"${r.cost:.4f}")]
    return "\n".join(lines)
