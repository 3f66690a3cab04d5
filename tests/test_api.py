"""Operations by name, trees, stores and budgets."""

import pytest
from pyspark.sql import functions as F

from loamworks.api import Repository, invoke
from loamworks.functions import checks
from loamworks.sources import store, trees

TEXT = {
    "src/a.py": "def fold():\n    return run()\n\ndef run():\n    raise ValueError\n", "src/b.py": "from a import fold\n\ndef main():\n    fold()\n", "src-other/c.py": "def fold():\n    pass\n", "docs/fold.md": "# Fold\nHow to fold a branch.", "docs/branch.md": "# Branch\nWhat else there is.", "docs/index.md": "fold",
}


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame([(p, t, str(len(t)), "failed" if p == "src/b.py" else "parsed") for p, t in TEXT.items()], "path string, text string, digest string, status string")
    symbols = spark.createDataFrame([("src/a.py", "fold", "function", 1, 2), ("src/a.py", "run", "function", 4, 5), ("src/b.py", "main", "function", 3, 4), ("src-other/c.py", "fold", "function", 1, 2)], "path string, qualname string, kind string, start_line int, end_line int")
    edges = spark.createDataFrame([("src/b.py::main", "src/a.py::fold", "high"), ("src/a.py::fold", "src/a.py::run", "high"), ("src/a.py::run", "ValueError", "unresolved")], "source string, target string, confidence string")
    links = spark.createDataFrame([("docs/fold.md", "docs/branch.md")], "source string, target string")
    titles = spark.createDataFrame([("docs/branch.md", "Branch"), ("docs/fold.md", "Fold")], "path string, title string")
    return Repository(files, symbols, edges, links, titles)


def paths(df):
    return [r.path for r in df.orderBy("position").collect()]


def test_search(repo):
    assert set(paths(invoke(repo, "search", {"query": "fold", "scopes": ["src"]}))) == {"src/a.py", "src/b.py"}
    assert set(paths(invoke(repo, "search", {"query": "fold", "source_only": True}))) == {"src/a.py", "src/b.py", "src-other/c.py"}
    assert paths(repo.search("fold", documentation_only=True))[0] == "docs/fold.md" and "docs/index.md" not in paths(repo.search("fold", documentation_only=True))
    assert paths(repo.search("Branch"))[0] == "docs/branch.md"
    linked = {r.path: r.reason for r in repo.search("how").collect()}
    assert linked == {"docs/fold.md": "match", "docs/branch.md": "linked-from:docs/fold.md"}
    assert repo.search("zzz").collect() == []


def test_traces_and_impact(repo):
    assert {(r.source, r.target, r.depth) for r in invoke(repo, "trace", {"symbol": "main", "depth": 3}).collect()} == {("src/b.py::main", "src/a.py::fold", 1), ("src/a.py::fold", "src/a.py::run", 2), ("src/a.py::run", "ValueError", 3)}
    assert {(r.source, r.target) for r in repo.trace("src/a.py::run", "callers", 1).collect()} == {("src/a.py::fold", "src/a.py::run")}
    assert {(r.seed, r.node) for r in repo.change_impact(["src/a.py"]).collect()} == {("src/a.py::fold", "src/b.py::main"), ("src/a.py::run", "src/a.py::fold"), ("src/a.py::run", "src/b.py::main")}
    spark = repo.files.sparkSession
    diff = spark.createDataFrame([("src/a.py", "@@ -5 +5 @@\n-x\n+y\n"), ("src-other/c.py", "@@ -9,0 +9,2 @@\n+y\n+z\n")], "path string, diff string")
    assert {(r.seed, r.node, r.depth) for r in repo.diff_impact(diff, 1).collect()} == {("src/a.py::run", "src/a.py::run", 0), ("src/a.py::run", "src/a.py::fold", 1), ("src-other/c.py::fold", "src-other/c.py::fold", 0)}


def test_maps_and_lines(repo):
    rows = {r.directory: r for r in invoke(repo, "repository_map", {}).collect()}
    assert rows["src"].files == 2 and rows["src"].symbols == 3 and rows["src"].languages == ".py" and rows["docs"].symbols == 0
    assert [(r.path, r.line, r.symbol, r.callers) for r in invoke(repo, "find_all", {"pattern": "RAISE"}).collect()] == [("src/a.py", 5, "src/a.py::run", 1)]
    assert repo.index_coverage(["src"]).first().asDict() == {"total": 2, "unavailable": 1, "complete": False}
    assert [r.qualname for r in repo.file_api("src/a.py").collect()] == ["fold", "run"] and repo.file_identities(["src/a.py"]).count() == 1
    nodes = repo.files.where("path like 'docs/%'").select(F.col("path").alias("node"))
    assert {(r.node, r.degree) for r in repo.check_knowledge(nodes).collect()} == {("docs/fold.md", 1), ("docs/branch.md", 1), ("docs/index.md", 0)}
    assert {(r.directory, r.files) for r in repo.areas(["src/a.py"]).collect()} == {("src", 2)}


@pytest.mark.parametrize("given", [{}, {"query": ""}, {"query": 1}, {"query": "x", "limit": -1}, {"query": "x", "limit": True}, {"query": "x", "more": 1}])
def test_refused_arguments(repo, given):
    with pytest.raises(ValueError):
        invoke(repo, "search", given)


def test_refused_names(repo):
    for operation, given in (("none", {}), ("trace", {"symbol": "x", "direction": "up"}), ("search", {"query": "x", "scopes": ["../x"]})):
        with pytest.raises(ValueError):
            invoke(repo, operation, given)
    assert checks.scope("./a//b/") == "a/b"


def test_checks_and_budgets(spark):
    one = spark.createDataFrame([("a" * 64, "ab-1"), ("A" * 64, "-x"), (None, None)], "d string, a string").select(checks.is_digest(F.col("d")).alias("d"), checks.is_alias(F.col("a")).alias("a")).collect()
    assert [tuple(r) for r in one] == [(True, True), (False, False), (None, None)]
    out = checks.fit_budget({"rows": ["x" * 50] * 100, "more": ["y"] * 10, "note": "n"}, 256, ["rows", "more"])
    assert out["truncated"] and len(out["more"]) == 10 and len(out["rows"]) + out["omitted_items"] == 100 and out["note"] == "n"
    assert not checks.fit_budget({"rows": []}, 256, ["rows"])["truncated"]


def test_trees(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"src/a.py": b"x = 1\n", "src/b c.md": "é".encode(), "bin/x": b"a\0b", "bad.txt": b"\xff\xfe", "key.txt": b"AKIA" + b"A" * 16, "node_modules/z.js": b"1"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    rows = {r.path: r for r in trees.read_tree(spark, str(root), F.col("path").startswith("node_modules/")).collect()}
    assert {p: r.gate for p, r in rows.items()} == {"src/a.py": None, "src/b c.md": None, "bin/x": "binary", "bad.txt": "encoding", "key.txt": "sensitive"}
    assert rows["src/b c.md"].text == "é" and rows["bin/x"].text is None and rows["src/a.py"].language == ".py" and rows["src/a.py"].size == 6


def test_status_and_front_matter(spark):
    text = "# branch.oid abc123\n1 .M N... 100644 100644 100644 aa bb src/a b.py\n2 R. N... 100644 100644 100644 aa bb R100 new.py\told.py\n? u.py\n! i.py\nu UU N... 1 2 3 4 a b c m.py\n"
    rows = trees.worktree_status(spark.createDataFrame([("r", text), ("s", None)], "root string, text string")).collect()
    assert {(r.path, r.state) for r in rows} == {("abc123", "head"), ("src/a b.py", "dirty"), ("new.py", "dirty"), ("old.py", "dirty"), ("u.py", "untracked"), ("i.py", "ignored"), ("m.py", "dirty")}
    files = spark.createDataFrame([("a.md", "---\ntitle: T\n---\nx"), ("b.md", "x"), ("c.md", None), ("d.md", "---\n: [\n---\n")], "path string, text string")
    found = {r.path: r.metadata for r in trees.front_matter(files).collect()}
    assert found["a.md"] == '{"title": "T"}' and set(found) == {"a.md", "d.md"}


def test_stores(spark, tmp_path):
    s = store.FileStore(spark, str(tmp_path / "t"), "path string, name string")
    assert s.revision() == 0 and s.read().collect() == []
    df = lambda rows: spark.createDataFrame(rows, "path string, name string")
    assert s.replace(df([("a", "f"), ("a", "g"), ("b", "h")])) == 1
    assert s.replace(df([("a", "x")]), removed=df([("b", None)]), expected=1) == 2
    assert [tuple(r) for r in s.read().collect()] == [("a", "x")] and s.read(1).count() == 3
    with pytest.raises(store.StaleRevision):
        s.replace(df([]), expected=1)
    s.forget(2)
    assert s.read().count() == 1
    old, new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, digest string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("d", None)], "path string, digest string")
    assert {tuple(r) for r in store.drift(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
