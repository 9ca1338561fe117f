import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.operators import runs, verdicts
from tidemark.operators.judge import Answer, Judge, RuleJudge, adjudicate, chunk_status, read_calls, read_chunks
from tidemark.operators.patterns import Pattern, relevance_regex
from tidemark.plans.audit import GuardFailure, run_audit

FACTS = {"package_name": "widget", "facts": [{"number": 1, "text": "`Gadget` is renamed to `Device`."}, {"number": 2, "text": "`old_call` is removed."}]}
PATTERNS = [Pattern("gadget", r"\bGadget\b"), Pattern("old_call", r"\bold_call\s*\(")]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for path, text in {
        "app.py": "import widget\n\nGadget()\nold_call(1)\nGadget()\n# Gadget\n",
        "helper.py": "from app import x\nGadget()\n",
        "tests/test_app.py": "import widget\nold_call(2)\n",
        "apart.py": "Gadget()\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (tmp_path / "guide.md").write_text("`Gadget` becomes `Device`, and `old_call` goes away.")
    return tmp_path


def test_audit_and_resume(spark, tree):
    args = (spark, str(tree / "repo"), str(tree / "guide.md"), str(tree / "work"), FACTS, PATTERNS)
    got = run_audit(*args, RuleJudge({"gadget"}), chunk_size=2, say=lambda x: None)
    assert sorted((r.file, r.line, r.bucket) for r in got.verdicts.collect()) == [
        ("app.py", 3, "proposed"), ("app.py", 4, "rejected"), ("app.py", 5, "proposed"), ("helper.py", 2, "proposed"), ("tests/test_app.py", 2, "flagged"),
    ]
    assert "app.py:5" in open(got.report_path).read()
    assert {r.rule for r in spark.read.parquet(str(tree / "work/droplog")).collect()} == {"file_relevance", "comment", "collapsed_duplicate"}
    written = lambda: {f.name: f.stat().st_mtime_ns for f in (tree / "work/chunks").glob("*.json")}
    first = written()
    # everything was judged, so the same judge is not asked again
    again = run_audit(*args, RuleJudge({"gadget"}), chunk_size=2, say=lambda x: None)
    assert sorted(again.verdicts.collect()) == sorted(got.verdicts.collect()) and written() == first
    # about a changed line it is, and another judge is asked about all
    (tree / "repo/helper.py").write_text("from app import x\ny = Gadget()\n")
    third = run_audit(*args, RuleJudge({"gadget"}), chunk_size=2, say=lambda x: None)
    assert len(written()) == len(first) + 1 and first.items() <= written().items() and {r.file for r in third.verdicts.collect()} >= {"helper.py"}
    other = run_audit(*args, RuleJudge(set()), chunk_size=2, say=lambda x: None)
    assert {r.file: r.bucket for r in other.verdicts.collect()} == {"app.py": "rejected", "helper.py": "rejected", "tests/test_app.py": "flagged"}


class Failing(Judge):
    """A rule judge whose answer on one line is cut off or not JSON."""

    def __init__(self, kind):
        self.kind = kind

    def decide(self, candidates, system=""):
        assert "`Gadget` is renamed" in system
        text = RuleJudge({"gadget"}).decide(candidates).text
        bad = any(c["file"].startswith("tests/") for c in candidates)
        return Answer(text[:20] if bad else text, {"input_tokens": 100, "output_tokens": 7}, bad and self.kind == "cut", "m1")


class Counting(Judge):
    """Notes every question in a folder, and fails once at one chunk."""

    def __init__(self, folder, fails_at):
        self.folder, self.fails_at = folder, fails_at

    def identity(self):
        return "counting"

    def decide(self, candidates, system=""):
        line = candidates[0]["line"]
        n = len([f for f in os.listdir(self.folder) if f.startswith(f"{line}-")])
        open(os.path.join(self.folder, f"{line}-{n}"), "w").close()
        if line == self.fails_at and n == 0:
            raise RuntimeError("lost executor")
        return RuleJudge({"p"}).decide(candidates)


def test_a_task_that_fails_asks_nothing_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", os.pathsep.join([os.path.dirname(__file__), os.environ["PYTHONPATH"]]))
    asked = tmp_path / "asked"
    asked.mkdir()
    rows = spark.createDataFrame([(i, "a.py", i, f"s{i}", "p") for i in range(6)], "chunk_id int, file string, line int, snippet string, pattern string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        store, judge = f"file://{tmp_path}/store", Counting(str(asked), 2)
        with pytest.raises(Exception, match="lost executor"):
            adjudicate(rows, judge, store=store, calls=f"file://{tmp_path}/calls")
        published = {r.line for r in read_chunks(spark, store).collect()}
        assert 2 not in published and not list((tmp_path / "store").glob("*.partial"))
        got = adjudicate(rows, judge, store=store, calls=f"file://{tmp_path}/calls")
        assert sorted((r.chunk_id, r.line, r.bucket) for r in got.collect()) == [(i, i, "proposed") for i in range(6)]
        # all were asked once, the one that failed twice
        assert sorted(os.listdir(asked)) == sorted([*(f"{i}-0" for i in range(6)), "2-1"])
        runs_made = [json.loads(f.read_text()) for f in (tmp_path / "store").glob("_run-*")]
        assert runs_made == [{"chunks": 6, "asked": 6 - len(published)}]
        # under another number a chunk is the same chunk
        moved = adjudicate(rows.withColumn("chunk_id", F.col("chunk_id") + 10), judge, store=store)
        assert sorted(r.chunk_id for r in moved.collect()) == list(range(10, 16)) and len(os.listdir(asked)) == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")


@pytest.mark.parametrize(
    "file,text,says",
    [
        ("vocabulary", '[{"name": "a"}]', "regex is missing"), ("vocabulary", "[1]", "not an object"), ("vocabulary", '[{"name": 1, "regex": "x"}]', "name is missing or not text"), ("vocabulary", "{", "not JSON"),
        ("vocabulary", '{"patterns": 3}', "neither a list"), ("vocabulary", "[]", "empty"), ("facts", "{", "not JSON"), ("facts", "[]", "not an object"), ("facts", '{"package_name": "a b", "facts": []}', "bare package name"),
    ],
)
def test_malformed_files_stop_in_one_line(spark, tree, capsys, file, text, says):
    command = write_inputs(tree)
    (tree / f"{file}.json").write_text(text)
    assert main([*command, "--workdir", str(tree / "work"), "--judge", f"{__name__}:good"], spark) == 1
    said = capsys.readouterr().err.strip()
    assert said.startswith("STOPPED") and says in said and "\n" not in said


@pytest.mark.parametrize("judge", ["no_such_module:x", f"{__name__}:no_such_name", "json:loads", "builtins:dict"])
def test_a_judge_that_is_none_stops_in_one_line(spark, tree, capsys, judge):
    assert main([*write_inputs(tree), "--workdir", str(tree / "work"), "--judge", judge], spark) == 1
    said = capsys.readouterr().err.strip()
    assert said.startswith("STOPPED: ") and "\n" not in said


def write_inputs(tree):
    (tree / "facts.json").write_text(json.dumps(FACTS))
    (tree / "vocabulary.json").write_text(json.dumps([vars(p) for p in PATTERNS]))
    return ["run", "--repo", str(tree / "repo"), "--guide", str(tree / "guide.md"), "--facts", str(tree / "facts.json"), "--vocabulary", str(tree / "vocabulary.json"), "--chunk-size", "1"]


def cut():
    return Failing("cut")


def malformed():
    return Failing("malformed")


def good():
    return RuleJudge({"gadget"})


@pytest.mark.parametrize("name,says", [("cut", "cut off"), ("malformed", "not JSON")])
def test_a_failed_run_keeps_what_was_judged(spark, tree, capsys, name, says, monkeypatch):
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", os.pathsep.join([os.path.dirname(__file__), os.environ["PYTHONPATH"]]))
    command = [*write_inputs(tree), "--workdir", str(tree / "work")]
    (tree / "prices.json").write_text(json.dumps({"m1": {"input_tokens": 1000, "output_tokens": 0}}))
    assert main([*command, "--judge", f"{__name__}:{name}", "--prices", str(tree / "prices.json")], spark) == 1
    said = capsys.readouterr()
    assert "STOPPED" in said.err and says in said.err and "Traceback" not in said.err
    calls = read_calls(spark, f"file://{tree}/work/calls").count()
    # the call with the bad answer counts as well
    assert f"input_tokens: {100 * calls}" in said.out and f"cost: ${0.1 * calls:.4f}" in said.out
    kept = {r.chunk_id for r in read_chunks(spark, f"file://{tree}/work/chunks").collect()}
    assert len(kept) == calls - 1 > 0


def test_a_recording_replays_the_whole_run(spark, tree, capsys):
    command = write_inputs(tree)
    got = run_audit(spark, str(tree / "repo"), str(tree / "guide.md"), str(tree / "work"), FACTS, PATTERNS, good(), 1, say=lambda x: None)
    assert main([*command, "--workdir", str(tree / "again"), "--replay", str(tree / "work/calls")], spark) == 0
    assert json.load(open(tree / "again/merged.json")) == json.load(open(tree / "work/merged.json")) and got.verdicts.count() == 5
    # a request that was not recorded, here for other facts, stops the run
    (tree / "facts.json").write_text(json.dumps({**FACTS, "facts": [*FACTS["facts"], {"number": 3, "text": "`Gadget` is not breaking elsewhere."}]}))
    assert main([*command, "--workdir", str(tree / "third"), "--replay", str(tree / "work/calls")], spark) == 1
    assert "no recorded answer" in capsys.readouterr().err


def test_chunk_states_and_new_chunks(spark):
    rows = spark.createDataFrame([("a.py", i, f"s{i}", "p") for i in range(6)], "file string, line int, snippet string, pattern string")
    chunks = verdicts.assign_chunks(rows, 2)
    done = adjudicate(chunks.where("chunk_id < 2"), RuleJudge({"p"}))
    changed = chunks.withColumn("snippet", F.when(F.col("line") == 3, "other").otherwise(F.col("snippet")))
    assert {r.chunk_id: r.status for r in chunk_status(changed, RuleJudge({"p"}), done).collect()} == {0: "done", 1: "stale", 2: "pending"}
    again = verdicts.rechunk(done, verdicts.assign_chunks(rows.where("line < 4"), 3))
    assert sorted((r.chunk_id, r.line, r.bucket) for r in again.collect()) == [(0, 0, "proposed"), (0, 1, "proposed"), (0, 2, "proposed"), (1, 3, "proposed")]
    with pytest.raises(verdicts.VerdictError):
        verdicts.rechunk(done, chunks)


def test_guards_stop_unless_forced(spark, tree):
    args = (spark, str(tree / "repo"), str(tree / "guide.md"), str(tree / "work"), FACTS, PATTERNS[:1], RuleJudge({"gadget"}))
    with pytest.raises(GuardFailure):
        run_audit(*args, say=lambda x: None)
    said = []
    run_audit(*args, force=True, say=said.append)
    assert any("bypassed" in s for s in said)


def test_run_tables(spark, tmp_path):
    assert [p.name for p in runs.parse_patterns('{"patterns": [{"name": "a", "regex": "x"}]}')] == ["a"]
    assert runs.truth_table(spark, [("a.py", 1, "literal")], 1, "host/").first().file == "host/a.py"
    with pytest.raises(ValueError):
        runs.truth_table(spark, [("a.py", 1, "literal")] * 2, 2)
    rows = spark.createDataFrame([(["m"], "m()", False), (["m", "r"], "m()", True), (["m"], "from p import m", True), (["o"], "o", True)], "tags array<string>, snippet string, want boolean")
    strict = rows.withColumn("got", runs.keep_strict(F.col("tags"), F.col("snippet"), ["anchor"], ["r"], ["m"])).collect()
    assert all(r.got == r.want for r in strict)
    assert [r[0] for r in rows.select(runs.keep_imports(F.col("tags"), F.col("snippet"), ["o"])).collect()] == [False, False, True, True]
    prompt = runs.chunk_prompts(spark.createDataFrame([(0, "b.py", 2, "y"), (0, "a.py", 1, "x")], "chunk_id int, file string, line int, snippet string"), "F:{FACTS} C:{CANDIDATES}", "1. f").first().prompt
    assert prompt == 'F:1. f C:[{"file":"a.py","line":1,"snippet":"x"},{"file":"b.py","line":2,"snippet":"y"}]'
    sites = spark.createDataFrame([("a/x.py", 1, 1, "p"), ("a/x.py", 1, 2, "q"), ("b.py", 1, 1, "p")], "file string, line int, run int, bucket string")
    assert sorted((r.file, r.bucket) for r in runs.latest_sites(sites, ["file", "line"]).collect()) == [("a/x.py", "q"), ("b.py", "p")]
    assert {r.folder: r.n for r in runs.count_by_folder(sites).collect()} == {"a": 2, "b.py": 1}
    files = spark.createDataFrame([("a.py", "import widget\nGadget\n# Gadget\n", None)], "file string, text string, error string")
    found = spark.createDataFrame([("a.py", 2, "Gadget", "g"), ("a.py", 3, "# Gadget", "g")], "file string, line int, snippet string, pattern string")
    table = {(r.stages, r.transitive): (r.start, r.final, r.truth_kept) for r in runs.ablate(found, files, relevance_regex("widget"), r"\bGadget\b", found.where("line = 2")).collect()}
    assert table[("A", True)] == (2, 2, 1) and table[("ABC", False)] == (2, 1, 1)


def test_tagged_sites_and_checks(spark, tmp_path):
    site = {"file": "a.py", "line": 1, "pattern": "x", "snippet": "Gadget(); old_call(1)", "reason": "r"}
    for run, reason in ((1, "early"), (2, "late")):
        (tmp_path / f"run{run}.json").write_text(json.dumps({"target": "T", "repo": "r", "run": run, "proposed_sites": [{**site, "reason": reason}], "flag_uncertain": [], "considered_and_rejected": []}))
    got = runs.tagged_sites(spark, f"{tmp_path}/run*.json", {"T": PATTERNS}).collect()
    assert [(r.tags, r.reason) for r in got] == [(["gadget", "old_call"], "late")]
    ok = lambda *x: spark.createDataFrame([(v,) for v in x], "ok boolean")
    row = runs.summarise_checks(ok(True, False), ok(True), ok()).first()
    assert (row.all_fixes_ok, row.any_fixes_ok, row.n_fixes, row.all_parses_ok, row.all_imports_ok, row.n_imports) == (False, True, 2, True, True, 0)


def test_stand_ins_are_found(spark):
    source = "import sys, types\nm = types.ModuleType('p.q')\nm.Thing = object\nother.Thing = 1\nsys.modules['p.q'] = m\nsys.modules['p'].x = 2\nsetattr(m, 'y', 3)\n"
    files = spark.createDataFrame([("a.py", source), ("b.py", "x.y = 1"), ("c.py", "types.ModuleType("), ("d.py", None)], "file string, text string")
    assert sorted((r.file, r.line) for r in verdicts.stand_ins(files).collect()) == [("a.py", 3), ("a.py", 6), ("a.py", 7)]
