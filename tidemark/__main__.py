"""Command line: ``python -m tidemark run --repo DIR --guide FILE --facts FILE --vocabulary FILE --judge MODULE:NAME``."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tidemark.operators.judge import Judge, JudgeError, ReplayJudge, read_calls
from tidemark.operators.runs import parse_patterns, usage_text
from tidemark.operators.usage import COUNTERS, estimate_cost, total_usage
from tidemark.plans.audit import GuardFailure, run_audit, shared_store
from tidemark.sources.chunk_store import Folder


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark")
    run = parser.add_subparsers(dest="command", required=True).add_parser("run", help="audit a source tree for lines that a change affects")
    run.add_argument("--repo", required=True, help="source tree, read only")
    run.add_argument("--guide", required=True, help="text that describes the change")
    run.add_argument("--facts", required=True, help="JSON: package_name and numbered facts")
    run.add_argument("--vocabulary", required=True, help="JSON: named regular expressions in order")
    run.add_argument("--package", help="import name of the package, instead of that of the facts")
    run.add_argument("--workdir", help="where results go; by default .tidemark-run/<time>")
    run.add_argument("--store", help="URI of a folder that all executors share, for candidates, judged chunks and calls; in local mode the work directory")
    run.add_argument("--chunk-size", type=int, default=40)
    run.add_argument("--force", action="store_true", help="go on where a guard fails")
    judge = run.add_mutually_exclusive_group(required=True)
    judge.add_argument("--judge", help="module:callable that returns a judge")
    judge.add_argument("--replay", help="folder of recorded calls to answer from")
    run.add_argument("--prices", help="JSON: model to prices per million tokens, by counter")
    return parser.parse_args(argv)


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def _json(path: str, what: str):
    with open(path, encoding="utf-8") as f:
        try:
            return json.load(f)
        except ValueError as error:
            raise ValueError(f"{what} {path} is not JSON: {error}") from error


def _judge(spark: SparkSession, args: argparse.Namespace) -> Judge:
    if args.replay:
        return ReplayJudge.load(read_calls(spark, _uri(args.replay)))
    module, _, name = args.judge.partition(":")
    try:
        made = getattr(importlib.import_module(module), name)()
    except (ImportError, AttributeError, TypeError) as error:
        raise ValueError(f"no judge {args.judge}: {error}") from error
    if not isinstance(made, Judge):
        raise ValueError(f"{args.judge} gives no judge but {type(made).__name__}")
    return made


def _usage(spark: SparkSession, calls: str, prices: str | None) -> str:
    """What the calls of a run used, also of one that stopped."""
    if not Folder(calls).exists():
        return ""
    table = _json(prices, "the price file") if prices else {}
    rows = [(m, *(float(p.get(c, 0)) for c in COUNTERS)) for m, p in table.items()]
    priced = spark.createDataFrame(rows, "model string, " + ", ".join(f"{c}_price double" for c in COUNTERS))
    return usage_text(estimate_cost(total_usage(read_calls(spark, calls), ["model"]), priced))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run the command; 1 after a stop, whose reason is printed without a trace."""
    args = arguments(argv)
    workdir = args.workdir or os.path.join(".tidemark-run", f"{datetime.datetime.now():%j-%y.%H%M%S}")
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        facts = _json(args.facts, "the fact file")
        if args.package and isinstance(facts, dict):
            facts["package_name"] = args.package
        with open(args.vocabulary, encoding="utf-8") as f:
            patterns = parse_patterns(f.read())
        done = run_audit(spark, args.repo, args.guide, workdir, facts, patterns, _judge(spark, args), args.chunk_size, args.force, store=args.store)
        print(f"report: {done.report_path}")
        return 0
    except GuardFailure as error:
        print(f"STOPPED: {error}\n--force continues past a failed guard.", file=sys.stderr)
    except (JudgeError, ValueError, OSError) as error:
        print(f"STOPPED: {error}", file=sys.stderr)
    except PySparkException as error:
        # an error of the judge inside a task: its last line names it
        lines = [x.strip() for x in str(error).splitlines() if "tidemark.operators" in x and ": " in x] or str(error).splitlines()
        print(f"STOPPED: {lines[-1]}", file=sys.stderr)
    finally:
        try:
            if text := _usage(spark, shared_store(spark, workdir, args.store) + "/calls", args.prices):
                print(text)
        except (ValueError, OSError) as error:
            print(f"no usage: {error}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
