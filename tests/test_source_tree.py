import os

import pytest

from tidemark.sources.artifacts import FactError, check_factblock, render_facts, report, write_json
from tidemark.sources.repository import SourceTree, SourceTreeReader, check_apart, check_inputs, list_sources, read_tree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for path, data in {
        "pkg/__init__.py": b"",
        "pkg/mod.py": b"x = 1\r\ny = 2\n",
        "pkg/_private.py": b"caf\xe9 = 1\n",
        ".git/hook.py": b"",
        "notes.txt": b"",
        "other/a.py": b"",
        "otherwise.py": b"",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    os.symlink(root / "pkg", root / "other" / "linked")
    return root


def test_listing(tree):
    linked = ["other/linked/__init__.py", "other/linked/_private.py", "other/linked/mod.py"]
    own = ["pkg/__init__.py", "pkg/_private.py", "pkg/mod.py"]
    assert list_sources(str(tree)) == ["other/a.py", *linked, "otherwise.py", *own]
    assert list_sources(str(tree), prefixes=("other", "pkg/mod.py")) == ["other/a.py", *linked, "pkg/mod.py"]
    os.symlink(tree, tree / "other" / "loop")
    assert list_sources(str(tree)) == ["other/a.py", *linked, "otherwise.py", *own]


def test_rows(spark, tree):
    rows = {r.file: r for r in read_tree(spark, str(tree), files_per_task=2).collect()}
    assert rows["pkg/__init__.py"].text == "" and rows["pkg/mod.py"].text == "x = 1\ny = 2\n"
    assert rows["pkg/_private.py"].text == "caf\ufffd = 1\n"
    assert ".git/hook.py" not in rows and "notes.txt" not in rows


def test_unreadable_file_is_a_row(tree):
    os.symlink(tree / "nowhere", tree / "gone.py")
    reader = SourceTreeReader({"path": str(tree)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r for r in rows if r[0] == "gone.py"] == [("gone.py", None, "FileNotFoundError: No such file or directory")]


def test_source_cannot_write():
    assert not [m for m in dir(SourceTree) if "writ" in m and m in vars(SourceTree)]


def test_overlap_and_inputs(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "c").mkdir()
    for x, y in (("a", "a/b"), ("a/b", "a"), ("a", "a")):
        with pytest.raises(ValueError):
            check_apart(str(tmp_path / x), str(tmp_path / y))
    check_apart(str(tmp_path / "a"), str(tmp_path / "c"))
    guide = tmp_path / "guide.md"
    for text in (None, "  \n"):
        if text is not None:
            guide.write_text(text)
        with pytest.raises(ValueError):
            check_inputs(str(tmp_path / "a"), str(guide), str(tmp_path / "c"))
    guide.write_text("use x")
    check_inputs(str(tmp_path / "a"), str(guide), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        check_inputs(str(tmp_path / "none"), str(guide), str(tmp_path / "c"))


def test_artifacts(tmp_path):
    write_json(str(tmp_path / "x/y.json"), {"a": 1})
    assert os.listdir(tmp_path / "x") == ["y.json"]
    facts = {"package_name": "widget", "facts": [{"number": 1, "text": "`a` is `b`"}, {"number": 2, "text": "more"}]}
    check_factblock(facts)
    assert render_facts(facts) == "1. `a` is `b`\n\n2. more"
    for bad in ({}, {"package_name": "a.b", "facts": facts["facts"]}, {"package_name": "a", "facts": []}, {"package_name": "a", "facts": [{"number": "1", "text": "x"}]}, {"package_name": "a", "facts": facts["facts"][:1] * 2}):
        with pytest.raises(FactError):
            check_factblock(bad)
    site = {"file": "b.py", "line": 2, "reason": "r", "pattern": "p", "snippet": "  s"}
    text = report({"proposed_sites": [site, {**site, "file": "a.py"}], "flag_uncertain": [], "considered_and_rejected": [site]}, {"start": 3}, 2, 1)
    assert text.index("a.py:2") < text.index("b.py:2") and "Rejected: 1" in text
