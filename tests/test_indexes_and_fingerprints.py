"""Gram index, rarest-gram containment, multiset fingerprints, pushed source filters, and variant validation."""

import collections
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import fingerprints, gram_index, guards, scan, verdicts
from tidemark.operators.patterns import Pattern
from tidemark.sources import repository

# --- fingerprints -------------------------------------------------------------

ROWS = "a int, b string, c double"


def plain_differences(a, b):
    x, y = collections.Counter(a), collections.Counter(b)
    return {("first" if n > 0 else "second", *k, abs(n)) for k in {*x, *y} if (n := x[k] - y[k])}


@pytest.mark.parametrize("buckets,fanout", [(1, 2), (8, 2), (4096, 16)])
def test_differences_are_those_of_multisets(spark, buckets, fanout):
    chance = random.Random(buckets)
    a = [(chance.choice([1, 2, None]), chance.choice(["x", None, ""]), chance.choice([0.0, 1.5, None])) for _ in range(300)] + [(9, "equal", 1.0)] * 50
    b = [*a[:120], *a[130:], (None, "1", None), (1, None, None), (9, "equal", 1.0), (7, "new", 2.0), (7, "new", 2.0)]
    one, two = (spark.createDataFrame(x, ROWS).repartition(n) for x, n in ((a, 3), (b, 5)))
    assert {tuple(r) for r in fingerprints.differences(one, two, buckets=buckets, fanout=fanout).collect()} == plain_differences(a, b)
    assert fingerprints.differences(one, one.repartition(7), buckets=buckets, fanout=fanout).collect() == []
    assert {tuple(r) for r in fingerprints.differences(one, one.limit(0), buckets=buckets, fanout=fanout).collect()} == plain_differences(a, [])


def test_nulls_of_different_columns_differ(spark):
    a, b = (spark.createDataFrame([r], "a string, b string") for r in (("x", None), (None, "x")))
    assert len(fingerprints.differences(a, b).collect()) == 2


def test_only_differing_buckets_are_found(spark):
    a = spark.range(10_000).select("id", (F.col("id") % 7).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v")))
    prints = [fingerprints.fingerprints(d, ["id", "v"]) for d in (a, b)]
    assert 1 <= fingerprints.differing_buckets(*prints).count() <= 2
    assert {tuple(r) for r in fingerprints.differences(a, b).collect()} == {("first", 77, 0, 1), ("second", 77, -1, 1)}


# --- containment of strings -----------------------------------------------------


def frames(spark, a, b):
    return spark.createDataFrame([(x,) for x in a], "text string"), spark.createDataFrame([(x,) for x in b], "text string")


def test_containing_pairs_equal_brute_force(spark):
    chance = random.Random(1)
    word = lambda n: "".join(chance.choice("abé💩") for _ in range(n))
    a, b = {word(chance.randrange(0, 7)) for _ in range(60)}, {word(chance.randrange(0, 9)) for _ in range(80)}
    got = guards.containing_pairs(*frames(spark, a, b)).collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x in a for y in b if x in y)


def test_a_common_gram_is_no_key_for_texts_with_a_rarer_one(spark):
    outer = [f"common{i:05d}" for i in range(3000)]
    inner = [f"common{i:05d}" for i in range(0, 3000, 3)]
    assert guards.containing_pairs(*frames(spark, inner, outer)).count() == 1000
    # what meets is near what is found: not every inner text with every outer one
    pieces = [{t[i : i + 3] for i in range(len(t) - 2)} for t in outer]
    counts = collections.Counter(g for p in pieces for g in p)
    met = sum(min(counts[t[i : i + 3]] for i in range(len(t) - 2)) for t in inner)
    assert met < 1000 * 3000 / 50


def test_covering_pairs_keep_their_spelling(spark):
    tokens = spark.createDataFrame([("old_call",), ("x",), (None,), ("__",)], "token string")
    words = spark.createDataFrame([("oldcall",), ("call",), ("callback",), (None,), ("_",)], "word string")
    got = {tuple(r) for r in guards.covering_pairs(tokens, words).collect()}
    assert got == {("old_call", "oldcall"), ("old_call", "call")} | {(t, "_") for t in ("old_call", "x", "__")} | {("__", w) for w in ("oldcall", "call", "callback", "_")}


# --- gram index -------------------------------------------------------------------

TEXTS = [("a.py", "import widget\nGadget()\n"), ("b.py", "nothing here\n"), ("c.py", None), ("d.py", ""), ("e.py", "ſtrange GADGET and widgeT\n"), ("f.py", "wid\nget"), ("g.py", "é" * 50 + "Gadget"), ("a.py", "again Gadget\n"), ("h.py", "x" * 5000)]
VOCABULARIES = [
    [Pattern("name", r"\bGadget\b")], [Pattern("any", "(?i:gadget|widget)")], [Pattern("both", r"import\s+widget"), Pattern("rest", "strange")], [Pattern("blind", "(?i:strange)")], [Pattern("none", "zzzz")],
    [Pattern("short", "x+")], [Pattern("wide", r"\w{30}")],
]


@pytest.mark.parametrize("vocabulary", VOCABULARIES)
def test_the_index_changes_no_candidate(spark, tmp_path, vocabulary):
    texts = spark.createDataFrame(TEXTS, "file string, text string").repartition(3)
    index = gram_index.build_index(texts, f"file://{tmp_path}/index")
    plain = scan.candidates_of(texts, vocabulary)
    assert sorted(gram_index.indexed_candidates(texts, index, vocabulary).collect()) == sorted(plain.collect())
    report = gram_index.reading_report(index, vocabulary).first()
    assert report.n_files == len(TEXTS) and report.n_bytes == sum(len((t or "").encode()) for _, t in TEXTS)
    assert report.read_bytes < report.n_bytes or gram_index.needed_grams(vocabulary) is None


def test_only_wanted_postings_are_read(spark, tmp_path):
    texts = spark.range(500).select(F.concat(F.lit("f"), "id").alias("file"), F.concat(F.lit("some words of text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    index = gram_index.build_index(texts, f"file://{tmp_path}/index")
    wanted = [Pattern("p", "[0-9]+some words")]
    plan = gram_index.possible_files(index, wanted)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(gram), In(gram" in plan or "In(gram, [" in plan
    assert gram_index.possible_files(index, [Pattern("p", "words of text ")]).count() == 500
    assert gram_index.possible_files(index, [Pattern("p", "words of tent")]).count() == 0
    postings = index.postings.groupBy("gram").agg(F.sum(F.size("deltas")).alias("n")).collect()
    assert {r.gram: r.n for r in postings}[int.from_bytes(b"som", "big")] == 500
    empty = gram_index.build_index(texts.limit(0), f"file://{tmp_path}/none")
    assert gram_index.possible_files(empty, wanted).count() == 0


# --- the source -----------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    for path, size in {"a/one.py": 10, "a/two.py": 900, "b/three.py": 500, "b/__init__.py": 0, "b/deep/four.py": 700, ".hidden/no.py": 5, "c.txt": 5, "five.py": 300}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * size)
    return tmp_path


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_path_filters_reach_the_listing(spark, tree, scheme):
    files = repository.read_tree(spark, f"{scheme}{tree}")
    assert sorted(r.file for r in files.collect()) == ["a/one.py", "a/two.py", "b/__init__.py", "b/deep/four.py", "b/three.py", "five.py"]
    for condition, want in [
        (F.col("file").startswith("b/"), ["b/__init__.py", "b/deep/four.py", "b/three.py"]), (F.col("file").endswith("ee.py"), ["b/three.py"]), (F.col("file") == "five.py", ["five.py"]),
        (F.col("file").isin("a/one.py", "none.py", "five.py"), ["a/one.py", "five.py"]), (F.col("file").startswith("b/") & (F.length("text") > 600), ["b/deep/four.py"]), (~F.col("file").startswith("b/"), ["a/one.py", "a/two.py", "five.py"]),
    ]:
        assert sorted(r.file for r in files.where(condition).collect()) == want
    plan = files.where(F.col("file").startswith("b/"))._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith(file" not in plan.replace("PushedFilters", "").split("Filter")[-1] or "Filter" not in plan


def test_excluded_files_are_not_opened(spark, tree):
    reader = repository.SourceTreeReader({"path": str(tree)})
    from pyspark.sql.datasource import GreaterThan, StringStartsWith

    kept = list(reader.pushFilters([StringStartsWith(("file",), "b/"), GreaterThan(("file",), "x"), StringStartsWith(("text",), "b/")]))
    assert len(kept) == 2 and [f for f, _ in reader.listed()] == ["b/__init__.py", "b/deep/four.py", "b/three.py"]
    assert sorted(f for p in reader.partitions() for f in p.paths) == ["b/__init__.py", "b/deep/four.py", "b/three.py"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 2000))
def test_parts_are_even(sizes, target):
    files = [(f"f{i:03d}", n) for i, n in enumerate(sizes)]
    parts = repository.even_parts(files, target)
    assert sorted(f for p in parts for f in p) == [f for f, _ in files]
    held = [sum(dict(files)[f] for f in p) for p in parts]
    assert max(held) <= sum(held) / len(held) + max(sizes, default=0)


# --- validation ---------------------------------------------------------------------------

SITE = {"file": "a.py", "line": 1, "pattern": "x", "snippet": "s", "reason": "r"}
VALUES = st.one_of(st.none(), st.booleans(), st.integers(-5, 1 << 40), st.floats(0, 2).map(lambda x: round(x, 2)), st.sampled_from(["", " ", "\t ", "r", "1", "é"]), st.just([]), st.just({}))
ENTRIES = st.one_of(VALUES, st.just(SITE), st.dictionaries(st.sampled_from(list(SITE)), VALUES), st.tuples(st.sampled_from(list(SITE)), VALUES).map(lambda kv: {**SITE, kv[0]: kv[1]}))
DOCUMENTS = st.one_of(VALUES, st.dictionaries(st.sampled_from(list(verdicts.BUCKETS)), st.one_of(VALUES, st.lists(ENTRIES, max_size=3))), st.fixed_dictionaries({b: st.lists(ENTRIES, max_size=3) for b in verdicts.BUCKETS}))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(DOCUMENTS, min_size=25, max_size=25))
def test_variants_say_what_plain_python_says(spark, documents):
    raw = spark.createDataFrame([(str(i), json.dumps(d, ensure_ascii=False)) for i, d in enumerate(documents)], "path string, value string")
    got = collections.defaultdict(list)
    for r in verdicts.document_violations(raw).orderBy("place").collect():
        got[int(r.path)].append(r.violation)
    for i, d in enumerate(documents):
        assert got[i] == verdicts.violations(d), d


def test_run_fields_and_broken_text(spark):
    whole = {b: [] for b in verdicts.BUCKETS}
    docs = ["{", "", "[]", json.dumps(whole), json.dumps({**whole, "target": "t", "repo": " ", "run": "1"}), json.dumps({**whole, "target": "t", "repo": "r", "run": 1})]
    raw = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "path string, value string")
    got = collections.defaultdict(list)
    for r in verdicts.document_violations(raw, run_files=True).orderBy("place").collect():
        got[r.path].append(r.violation)
    assert dict(got) == {"0": ["not JSON"], "1": ["not JSON"], "2": ["not an object"], "3": ["blank target", "blank repo", "run is not an integer"], "4": ["blank repo", "run is not an integer"]}
    plan = verdicts.document_violations(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
