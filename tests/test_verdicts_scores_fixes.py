import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fixes, judge, relevance, scoring, usage, verdicts

SITE = {"file": "a.py", "line": 1, "reason": "r"}
GOOD = {"proposed_sites": [{**SITE, "pattern": "p", "snippet": "s"}], "flag_uncertain": [], "considered_and_rejected": [{**SITE, "line": 2}]}


def test_violations():
    assert verdicts.violations(GOOD) == []
    assert verdicts.violations({**GOOD, "flag_uncertain": [{**SITE, "line": "1"}]}) == ["flag_uncertain[0]: line is not an integer"]
    assert verdicts.violations({**GOOD, "flag_uncertain": [{**SITE, "line": True, "reason": " "}]}) == ["flag_uncertain[0]: line is not an integer", "flag_uncertain[0]: blank reason"]
    assert verdicts.violations({k: v for k, v in GOOD.items() if k != "flag_uncertain"}) == ["flag_uncertain: missing or not a list"]
    assert verdicts.violations({**GOOD, "proposed_sites": [SITE]}) == ["proposed_sites[0]: blank pattern", "proposed_sites[0]: blank snippet"]


def test_reading_verdict_files(spark, tmp_path):
    (tmp_path / "run1.json").write_text(json.dumps({**GOOD, "target": "t", "repo": "r", "run": 1}))
    rows = verdicts.read_verdicts(spark, f"{tmp_path}/run*.json", run_files=True).collect()
    assert sorted((r.run, r.bucket, r.line) for r in rows) == [(1, "proposed", 1), (1, "rejected", 2)]
    for bad in ("", "{", json.dumps({**GOOD, "target": "t", "repo": "r", "run": "1"})):
        (tmp_path / "run2.json").write_text(bad)
        with pytest.raises(verdicts.VerdictError):
            verdicts.read_verdicts(spark, f"{tmp_path}/run*.json", run_files=True)


def test_cover(spark):
    sites = lambda *x: spark.createDataFrame(list(x), "file string, line int")
    want = sites(("a", 1), ("a", 2))
    verdicts.require_cover(want, sites(("a", 2), ("a", 1)))
    for given in (sites(("a", 1)), sites(("a", 1), ("a", 2), ("b", 1)), sites(("a", 1), ("a", 2), ("a", 2))):
        with pytest.raises(verdicts.VerdictError):
            verdicts.require_cover(want, given)


def test_floor_and_hedges(spark):
    rows = spark.createDataFrame([("rejected", "x/tests/a.py", "sure"), ("rejected", "a.py", "It might be"), ("rejected", "a.py", "sure"), ("proposed", "test_a.py", "")], "bucket string, file string, reason string")
    got = verdicts.split_hedged(verdicts.apply_floor(rows, verdicts.is_test_path(F.col("file"))), "might|maybe")
    assert [r.bucket for r in got.collect()] == ["flagged", "flagged", "rejected", "proposed"]


def test_chunks_are_judged_once(spark):
    rows = [(f"f{i % 3}", i, f"s{i}", "p" if i % 2 else "q") for i in range(90)]
    candidates = spark.createDataFrame(rows, "file string, line int, snippet string, pattern string")
    chunks = verdicts.assign_chunks(candidates, 40)
    assert sorted(r["count"] for r in chunks.groupBy("chunk_id").count().collect()) == [10, 40, 40]
    done = judge.adjudicate(chunks, judge.RuleJudge({"p"}))
    verdicts.require_cover(candidates, done)
    part = done.where("chunk_id <> 1")
    marked = part.withColumn("reason", F.lit("kept"))
    again = {(r.chunk_id, r.reason == "kept") for r in judge.adjudicate(chunks, judge.RuleJudge({"p"}), marked).collect()}
    assert again == {(0, True), (1, False), (2, True)}
    other = judge.adjudicate(chunks, judge.RuleJudge({"q"}), marked)
    assert {(r.pattern, r.bucket) for r in other.collect()} == {("p", "rejected"), ("q", "proposed")}
    first = [r.asDict() for r in chunks.where("chunk_id = 2").orderBy("file", "line").collect()]
    answers = {judge.call_key(first, judge.TEMPLATE.replace("{FACTS}", "f")): judge.RuleJudge({"p"}).decide(first).text}
    assert judge.adjudicate(chunks.where("chunk_id = 2"), judge.ReplayJudge(answers), facts="f").count() == 10
    with pytest.raises(Exception, match="no recorded answer"):
        judge.adjudicate(chunks, judge.ReplayJudge(answers)).collect()


def test_scores(spark):
    given = spark.createDataFrame([("a", 1, "proposed"), ("a", 2, "proposed"), ("a", 3, "flagged"), ("a", 4, "rejected"), ("a", 1, "rejected")], "file string, line int, bucket string")
    truth = spark.createDataFrame([("a", 1), ("a", 3), ("a", 4), ("a", 9)], "file string, line int")
    row = scoring.score(scoring.match_truth(given, truth, ["file", "line"])).first()
    assert (row.tp, row.fp, row.fn, row.fn_flagged, row.fn_rejected, row.fn_invisible) == (1, 1, 3, 1, 1, 1)
    assert (row.precision, row.recall, row.surfaced_recall) == (0.5, 0.25, 0.5)
    nothing = scoring.match_truth(given.limit(0), truth, ["file", "line"])
    assert math.isnan(scoring.score(nothing).first().precision) and scoring.acceptance(nothing).first().precision == 1.0
    raw, kept = given.where("line <> 4").select("file", "line"), given.where("line < 3").select("file", "line")
    assert {r.line: r.route for r in scoring.attribute_losses(truth, raw, kept, ["file", "line"]).collect()} == {1: "reachable", 3: "prefilter_dropped", 4: "scan_missed", 9: "scan_missed"}
    assert scoring.symmetric_difference(truth, truth).first()[0] == 0
    routes = scoring.attribute_losses(truth, raw, kept.unionByName(spark.createDataFrame([("a", 3)], "file string, line int")), ["file", "line"], given)
    assert {r.line: r.route for r in routes.collect()} == {1: "proposed", 3: "flagged", 4: "scan_missed", 9: "scan_missed"}


def test_classes_follow_the_rules_in_order(spark):
    rows = [("a/latest.py", ["add"], "x", "test/mock"), ("clients/a.py", ["add"], "x", "client-side"), ("a.py", ["add", "b"], "getattr(x)", "decorator/registration"), ("a.py", ["b"], "getattr(x, 'y')", "dynamic/reflection"), ("a.py", None, "register(x)", "literal")]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file string, tags array<string>, snippet string, want string, line int")
    kind = scoring.site_class(F.col("file"), F.col("tags"), F.col("snippet"), ["clients"], ["add"])
    assert all(r.got == r.want for r in d.withColumn("got", kind).collect())
    truth = spark.createDataFrame([("a.py", 3, "helper")], "file string, line int, class string")
    assert {r.line: r["class"] for r in scoring.with_class(d, truth, ["file", "line"], kind).collect()} == {**{i: r[3] for i, r in enumerate(rows)}, 3: "helper"}


def test_fixes(spark):
    lines = spark.createDataFrame([("a.py", 1, "import x"), ("a.py", 2, "y = 'a'"), ("b.py", 1, "z = 1")], "file string, line int, text string")
    given = spark.createDataFrame(
        [("1", 0, "a.py", 1, "import x ", "FIX", "import pkg.new"), ("2", 0, "a.py", 2, "other", "FIX", 'y = "b"'), ("3", 0, "b.py", 7, "z", "SKIP", None), ("4", 0, "b.py", 1, "z = 1", "FIX", "z = ("), ("4", 1, "b.py", 1, "z = 1", "FLAG-FOR-HUMAN", None)],
        "id string, seq int, file string, line int, original_line string, verdict string, proposed_line string",
    )
    key = spark.createDataFrame([("1", "import pkg.new", False, True), ("2", "y  = 'b'", False, True), ("3", "q", False, True), ("4", None, True, False), ("5", "q", False, True)], "id string, required_line string, hedge_ok boolean, has_single_line_fix boolean")
    assert {r.id: r["class"] for r in fixes.score_fixes(given, key).collect()} == {"1": "exact", "2": "semantic", "3": "wrong-skip", "4": "hedge-legitimate", "5": "missing"}
    assert sorted(r.id for r in fixes.disagreements(given, lines).collect()) == ["2", "3"]
    whole = {r.file: r.text for r in fixes.apply_fixes(lines, given).collect()}
    assert whole["a.py"] == 'import pkg.new\ny = "b"'
    assert [r.file for r in fixes.check_parses(fixes.apply_fixes(lines, given)).collect()] == ["b.py"]
    stub = spark.createDataFrame([("pkg",)], "name string")
    assert [tuple(r) for r in fixes.unknown_imports(given, stub, "pkg").collect()] == [("1", "pkg.new")]
    tests = lambda *x: spark.createDataFrame(list(x), "test string, outcome string")
    assert fixes.same_failures(tests(("a", "failed"), ("b", "passed")), tests(("a", "failed"))) and not fixes.same_failures(tests(("a", "failed")), tests(("b", "failed")))


def test_cost(spark):
    calls = spark.createDataFrame([("m", 1_000_000, 0, 0, 0), ("m", 0, 500_000, 0, 0), ("new", 1, 1, 1, 1)], ["model", *usage.COUNTERS])
    prices = spark.createDataFrame([("m", 3.0, 10.0, 0.0, 0.0)], ["model", *[f"{c}_price" for c in usage.COUNTERS]])
    assert {r.model: r.cost for r in usage.estimate_cost(usage.total_usage(calls, ["model"]), prices).collect()} == {"m": 8.0, "new": None}


def test_fix_runs_that_are_missing_or_broken_stop(spark, tmp_path):
    fix = {"id": "a", "file": "a.py", "line": 3, "original_line": "x", "verdict": "FIX", "proposed_line": "y", "spec_facts": [1], "reason": "r"}
    path = lambda name: f"file://{tmp_path}/{name}.json"
    (tmp_path / "run1.json").write_text(json.dumps([fix, {**fix, "verdict": "SKIP", "proposed_line": None}], indent=1))
    (tmp_path / "run2.json").write_text("[]")
    got = fixes.read_fixes(spark, [path("run1"), path("run2")]).collect()
    assert [(r.seq, r.id, r.line, r.verdict, r.proposed_line) for r in sorted(got)] == [(0, "a", 3, "FIX", "y"), (1, "a", 3, "SKIP", None)]
    key = spark.createDataFrame([("a", "y", False, True), ("b", "z", False, True)], "id string, required_line string, hedge_ok boolean, has_single_line_fix boolean")
    assert {r.id: r["class"] for r in fixes.score_fixes(fixes.read_fixes(spark, [path("run1")]), key).collect()} == {"a": "wrong-skip", "b": "missing"}
    with pytest.raises(fixes.FixRunError, match="run3"):
        fixes.read_fixes(spark, [path("run1"), path("run3")])
    for text in ("{}", "", "nothing", '[{"id": "a"}]', json.dumps([{**fix, "line": "3"}]), json.dumps([{**fix, "verdict": "maybe"}])):
        (tmp_path / "run4.json").write_text(text)
        with pytest.raises(fixes.FixRunError):
            fixes.read_fixes(spark, [path("run1"), path("run4")])
    with pytest.raises(fixes.FixRunError):
        fixes.read_fixes(spark, [])


def test_closure_through_groups_of_any_text(spark):
    rows = [(1, "a" * 5000), (2, "a" * 5000), (2, "b"), (3, "b"), (3, "b"), (4, "alone"), (5, None), (6, None), (None, "b"), (7, "c"), (8, "c")]
    found = relevance.closure_through(spark.createDataFrame([(1,)], "m long"), spark.createDataFrame(rows, "m long, g string"), "m", "g")
    assert {r.m: r["round"] for r in found.collect()} == {1: 0, 2: 1, 3: 2}
