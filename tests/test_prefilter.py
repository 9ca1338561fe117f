import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import prefilter, relevance, scan
from tidemark.operators.patterns import Pattern, match_spans, relevance_regex

FILES = "file string, text string, error string"
VOCABULARY = [Pattern("name", r"\bGadget\b"), Pattern("call", r"gadget\(")]


def run(spark, sources, stages=("A", "B", "C"), errors=(), **options):
    files = spark.createDataFrame([(f, t, None) for f, t in sources.items()] + [(f, None, "OSError") for f in errors], FILES)
    candidates = scan.find_candidates(scan.lines_of(files), VOCABULARY)
    regex = "|".join(f"(?:{p.regex})" for p in VOCABULARY)
    return prefilter.run_prefilter(candidates, files, relevance_regex("widget"), regex, stages, **options)


def kept(result):
    return sorted((r.file, r.line) for r in result.candidates.collect())


def drops(result):
    return sorted((r.stage, r.rule, r.file, r.line) for r in result.droplog.collect())


def test_a_direct_transitive_and_unrelated(spark):
    sources = {
        "used.py": "import widget\nGadget()\n",
        "wrapper.py": "from widget import Gadget as g\n",
        "user.py": "import wrapper\nx = wrapper.Gadget\n",
        "unrelated.py": "Gadget = 1\n",
    }
    got = run(spark, sources, ("A",))
    assert kept(got) == [("used.py", 2), ("user.py", 2), ("wrapper.py", 1)]
    assert drops(got) == [("A", "file_relevance", "unrelated.py", 1)]
    assert kept(run(spark, sources, ("A",), transitive=False)) == [("used.py", 2), ("wrapper.py", 1)]


def test_b_comments_docstrings_and_strings(spark):
    got = run(
        spark,
        {
            "a.py": '"""Docs on Gadget."""\nimport widget\nx = 1  # Gadget here\ny = Gadget()  # a Gadget\nlog("Gadget")\n\n\nasync def f():\n    """Gadget\n    Gadget\n    """\n',
            "open.py": 'import widget\ns = """Gadget\n# Gadget\n',
            "broken.py": "import widget\ndef (:\n    Gadget  # x\n",
        },
    )
    assert kept(got) == [("a.py", 4), ("a.py", 5), ("broken.py", 3), ("open.py", 2), ("open.py", 3)]
    assert drops(got) == [("B", "comment", "a.py", 3), ("B", "docstring", "a.py", 1), ("B", "docstring", "a.py", 9), ("B", "docstring", "a.py", 10)]
    span = [r.matched_span for r in got.droplog.where("rule = 'comment'").collect()]
    assert [(s.start, s.end) for s in span[0]] == [(9, 15)]


def test_c_collapses_and_expands(spark):
    body = "import widget\n" + "\n".join("  Gadget()" if i in (5, 19, 33) else "pass" for i in range(2, 40))
    got = run(spark, {"a.py": body, "b.py": "import widget\nGadget()\n"})
    reps = {(r.file, r.line): (r.duplicate_count, r.duplicate_lines) for r in got.candidates.collect()}
    assert reps == {("a.py", 5): (3, [5, 19, 33]), ("b.py", 2): (None, None)}
    back = prefilter.expand_duplicates(got.candidates.select("file", "line", "snippet"), got.expansion)
    assert sorted((r.file, r.line) for r in back.collect()) == [("a.py", 5), ("a.py", 19), ("a.py", 33), ("b.py", 2)]
    stats = got.stats.first().asDict()
    assert (stats["start"], stats["after_A"], stats["after_B"], stats["after_C"], stats["final"], stats["reduction_percent"]) == (4, 4, 4, 2, 2, 50.0)
    stray = spark.createDataFrame([("z.py", 1, "s")], "file string, line int, snippet string")
    assert [tuple(r) for r in prefilter.expand_duplicates(stray, got.expansion).collect()] == [("z.py", 1, "s")]


def test_nothing_found(spark):
    got = run(spark, {"a.py": "pass\n"})
    assert kept(got) == [] and drops(got) == [] and got.stats.first().final == 0
    with pytest.raises(ValueError):
        prefilter.run_prefilter(got.candidates, got.candidates, "x", None, ("B",))


def test_import_graph(spark):
    sources = {
        "top/__init__.py": "from . import core\n",
        "top/core.py": "import widget\n",
        "top/sub/__init__.py": "",
        "top/sub/leaf.py": "from ..core import thing\nfrom .sibling import x\n",
        "top/sub/sibling.py": "from .. import core\n",
        "one/main.py": "import two\n",
        "two/main.py": "import main\n",
        "user.py": "import top\n",
        "cycle_a.py": "import cycle_b\n",
        "cycle_b.py": "import cycle_a\nimport top.core\n",
        "syntax.py": "def (\n",
    }
    files = spark.createDataFrame([(f, t, None) for f, t in sources.items()] + [("lost.py", None, "OSError")], FILES)
    names = {r.file: r.dotted for r in relevance.dotted_names(files).collect()}
    assert names["top/sub/leaf.py"] == "top.sub.leaf" and names["top/__init__.py"] == "top" and names["one/main.py"] == "main" and names["user.py"] == "user"
    edges = {(r.src, r.dst) for r in relevance.import_edges(files).collect()}
    assert {("top/__init__.py", "top/core.py"), ("top/sub/leaf.py", "top/core.py"), ("top/sub/leaf.py", "top/sub/sibling.py"), ("user.py", "top/__init__.py")} <= edges
    assert ("two/main.py", "two/main.py") not in edges and not any(s == "syntax.py" for s, _ in edges)
    assert ("two/main.py", "one/main.py") in {(r.src, r.dst) for r in relevance.import_edges(files, keep_all_targets=True).collect()}
    regex = relevance_regex("widget")
    direct = {r.file for r in relevance.direct_relevance(files, regex).collect()}
    assert direct == {"top/core.py", "lost.py"}
    found = {r.file for r in relevance.relevant_files(files, regex).collect()}
    assert found == {"top/core.py", "lost.py", "top/__init__.py", "top/sub/leaf.py", "top/sub/sibling.py", "user.py", "cycle_a.py", "cycle_b.py"}
    assert "syntax.py" in {r.file for r in relevance.relevant_files(files, regex, strict_failsafe=True).collect()}


def test_closure_says_when_it_is_not_complete(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(5)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert relevance.closure(seeds, edges).count() == relevance.closure(seeds, edges, 5).count() == 6
    with pytest.raises(RuntimeError):
        relevance.closure(seeds, edges, 4)


def test_spans_are_those_of_python(spark):
    regex, texts = r"(?i:ab+)|c\d", ["", "ab xABB c1c2", "c1", "nothing", None, "äab c9"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", match_spans(F.col("t"), regex).alias("s"))
    for r in d.collect():
        assert [(s.start, s.end) for s in r.s] == [m.span() for m in re.finditer(regex, r.t or "")]


def test_texts_are_split_once_and_dropped_first(spark):
    texts = spark.createDataFrame([(1, "a b\nfoo\n"), (2, "none")], "doc_id long, text string")
    found = scan.candidates_of(texts, [Pattern("p", "foo")], "doc_id", "lf")
    assert [tuple(r) for r in found.collect()] == [(1, 2, "foo", "p")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.index("Generate") < plan.index("split(")
    assert [r.line for r in scan.candidates_of(texts, [Pattern("p", "^foo$")], "doc_id", "lf").collect()] == [2]
