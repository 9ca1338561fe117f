"""The whole audit of a source tree: scan, guard, prefilter, judge, expand, report."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import guards, prefilter, verdicts
from tidemark.operators.judge import Judge, adjudicate
from tidemark.operators.patterns import Pattern, check_vocabulary, relevance_regex
from tidemark.operators.runs import patterns_table
from tidemark.operators.scan import candidates_of
from tidemark.sources.artifacts import check_factblock, render_facts, report, write_json, write_text
from tidemark.sources.repository import check_inputs, read_tree
from tidemark.sources.tables import stage


class GuardFailure(RuntimeError):
    """A guard stopped the run; its report says why."""

    def __init__(self, result: guards.GuardResult):
        super().__init__(f"{result.reason}\n{result.report}")


@dataclass(frozen=True)
class Audit:
    """What an audit leaves: verdicts on all lines, the prefilter's tables, and the report's path."""

    verdicts: DataFrame
    prefiltered: prefilter.Prefiltered
    report_path: str


def shared_store(spark: SparkSession, workdir: str, store: str | None) -> str:
    """The URI of the folder for what executors write: ``store``, or in local mode the work directory."""
    if store is not None or "://" in workdir:
        return (store or workdir).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("give a store: the URI of a folder that all executors share")
    return "file://" + os.path.abspath(workdir)


def run_audit(
    spark: SparkSession, repo: str, guide: str, workdir: str, factblock: dict, patterns: Sequence[Pattern], judge: Judge, chunk_size: int = 40, force: bool = False,
    strict_failsafe: bool = False, say: Callable[[str], None] = print, store: str | None = None,
) -> Audit:
    """Audit the tree ``repo``; writes under ``workdir`` and ``store`` only.

    The driver writes its small artifacts to ``workdir``.  Executors write
    candidates, the drop log, judged chunks and calls to ``store``, the URI of a
    folder that all of them share; only in local mode is that the work directory.

    ``force`` lets guards fail without stopping; validation always stops.
    Chunks judged before are kept where nothing changed that their answers
    depend on, and every chunk is kept as soon as it is judged.  Candidates and
    the drop log are Parquet tables, which may be of any size.
    """
    check_inputs(repo, guide, workdir)
    check_factblock(factblock)
    check_vocabulary(patterns)
    at = lambda name: os.path.join(workdir, name)
    shared = shared_store(spark, workdir, store)
    uri = lambda name: f"{shared}/{name}"
    with open(guide, encoding="utf-8") as f:
        guide_text = f.read()

    def guard(result: guards.GuardResult) -> None:
        if not result.ok and not force:
            raise GuardFailure(result)
        if not result.ok:
            say(f"guard bypassed: {result.reason}")

    write_json(at("factblock.json"), factblock)
    write_json(at("vocabulary.json"), {"patterns": [vars(p) for p in patterns]})
    facts = spark.createDataFrame([(f["number"], f["text"]) for f in factblock["facts"]], "number int, text string")
    guard(guards.check_fact_coverage(spark.createDataFrame([(guide_text,)], "text string"), facts))
    coverage = guards.check_vocabulary_coverage(facts, patterns_table(spark, patterns))
    write_text(at("vocabulary_coverage.txt"), coverage.report)
    guard(coverage)

    files = stage(read_tree(spark, repo), "files")
    candidates = stage(candidates_of(files, patterns), "candidates")
    guard(guards.check_yield(candidates, patterns))
    say(f"candidates: {candidates.count()}")

    combined = "|".join(f"(?:{p.regex})" for p in patterns)
    done = prefilter.run_prefilter(candidates, files, relevance_regex(factblock["package_name"]), combined, strict_failsafe=strict_failsafe)
    kept = stage(done.candidates, "kept")
    candidates.write.mode("overwrite").parquet(uri("candidates"))
    done.droplog.write.mode("overwrite").parquet(uri("droplog"))

    chunks = verdicts.assign_chunks(kept.select("file", "line", "snippet", "pattern"), chunk_size)
    chunks = stage(chunks, "chunks")
    judged = stage(adjudicate(chunks, judge, facts=render_facts(factblock), store=uri("chunks"), calls=uri("calls")), "judged")
    verdicts.require_cover(kept, judged)

    faked = verdicts.stand_ins(files).withColumn("_faked", F.lit(True))
    floor = verdicts.is_test_path(F.col("file")) | verdicts.impersonates(F.col("snippet")) | F.coalesce(F.col("_faked"), F.lit(False))
    floored = verdicts.apply_floor(judged.join(faked, ["file", "line"], "left"), floor)
    expanded = stage(prefilter.expand_duplicates(floored.select("bucket", "file", "line", "pattern", "snippet", "reason"), done.expansion), "expanded")
    document = verdicts.to_document(expanded)
    if bad := verdicts.violations(document):
        raise verdicts.VerdictError("merged verdicts: " + "; ".join(bad[:20]))
    write_json(at("merged.json"), document)
    write_text(at("report.md"), report(document, done.stats.first().asDict(), len(factblock["facts"]), len(patterns)))
    return Audit(expanded, done, at("report.md"))
