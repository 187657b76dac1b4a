"""Listing on executors, ignore rules as a relation, late reads, part files, pre-order places."""

import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import format as shape
from textloom.operators import parts, tree
from textloom.plans import pack
from textloom.schema import PackOptions
from textloom.sources import listing
from textloom.sources.listing import Walk, list_tree, list_trees, start, walk, with_contents
from textloom.sources.repo_tree import read_tree

from test_pack import relation


def planted(root, files):
    for path, body in files.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)


@pytest.fixture
def nested(tmp_path):
    planted(tmp_path, {
        ".git/info/exclude": "secret*\n", ".gitignore": "*.log\n/sub/top\nbuild/\n", "sub/.gitignore": "!keep.log\nlocal\n", "sub/.ignore": "plain.*\n", "sub/deep/.packignore": "!plain.txt\n*.own\n", "sub/a.log": "1", "sub/keep.log": "22", "sub/top": "3", "sub/deep/local": "",
        "sub/secret1": "", "sub/x.py": "x", "sub/deep/plain.txt": "p", "sub/deep/plain.md": "", "sub/deep/y.own": "", "build/out.c": "", "other/build": "a file", "other/.hid/z.c": "", "m/n/o/p/q/r.rs": "fn f() {}", "m/n/s.rs": "",
    })
    return tmp_path


OPTIONS = [Walk(), Walk(hidden=True), Walk(gitignore=False), Walk(max_depth=2), Walk(ignore_names=(".packignore",)), Walk(3, True, False, (".packignore", "x.py"))]


def test_listing_is_the_walk(spark, nested):
    for options in OPTIONS:
        for root in (nested, nested / "sub"):
            want = sorted(walk([start(str(root), options)], options))
            got = list_tree(spark, str(root), options).collect()
            assert sorted((r["path"], r["size_bytes"]) for r in got) == want
            assert all(os.path.samefile(r["abs_path"], root / r["path"]) and r["path_parts"] == r["path"].split("/") and r["repo_id"] == root.name for r in got)
    assert [p for p, _ in sorted(walk([start(str(nested / "sub"), Walk())], Walk()))] == ["deep/y.own", "keep.log", "x.py"]
    # a file of a stronger kind decides, wherever it stands
    assert "sub/deep/plain.txt" in [p for p, _ in walk([start(str(nested), OPTIONS[4])], OPTIONS[4])]


def test_listing_of_many_roots(spark, nested):
    roots = spark.createDataFrame([("a", str(nested / "sub")), ("b", str(nested / "m")), ("c", str(nested / "none")), ("f", str(nested / "sub/x.py"))], "repo_id string, root string")
    got = sorted((r["repo_id"], r["path"]) for r in list_trees(roots).collect())
    assert got == [("a", "deep/y.own"), ("a", "keep.log"), ("a", "x.py"), ("b", "n/o/p/q/r.rs"), ("b", "n/s.rs"), ("f", "x.py")]
    for most in (1, 2, 3):  # however few folders a round scans
        assert sorted((r["repo_id"], r["path"]) for r in list_trees(roots, most=most).collect()) == got
    with pytest.raises(ValueError, match="no such source tree"):
        list_tree(spark, str(nested / "none"))


def test_driver_lists_no_files(spark, nested, monkeypatch):
    """Nothing is scanned in the driver's process; the data source scans folders until there are enough."""
    mine = os.getpid()
    seen = []
    scan = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (seen.append(str(p)), scan(p))[1] if os.getpid() == mine else scan(p))
    assert list_tree(spark, str(nested)).count() == 6
    assert seen == []
    assert read_tree(spark, str(nested), folders=2).count() == 6
    assert all(os.path.relpath(p, nested).count("/") == 0 for p in seen)


def test_source_reads_branches(spark, nested):
    want = sorted(p for p, _ in walk([start(str(nested), Walk())], Walk()))
    for folders in (1, 2, 3, 1000):
        assert sorted(r["path"] for r in read_tree(spark, str(nested), folders=folders).collect()) == want


def test_only_kept_files_are_opened(spark, nested, tmp_path_factory):
    log = tmp_path_factory.mktemp("opened")

    def noted(path):
        (log / path.replace("/", "|")).write_text("")
        return listing._read(path)

    meta = list_tree(spark, str(nested), Walk(gitignore=False)).filter("size_bytes > 0").filter(F.endswith("path", F.lit(".py")) | F.endswith("path", F.lit(".rs")))
    for push in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
        try:
            assert with_contents(meta, noted).filter("content IS NOT NULL").count() == 2
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(n.rsplit("|", 1)[1] for n in os.listdir(log)) == ["r.rs", "x.py"]
    changed = spark.createDataFrame([("m/n/s.rs",), ("m/n/o/p/q/r.rs",)], "path string")
    assert [r["path"] for r in pack.tree_files(spark, str(nested), PackOptions(include=("*r.rs",)), changed=changed).collect()] == ["m/n/o/p/q/r.rs"]


@pytest.mark.parametrize("kind", ["xml", "markdown", "tool-call"])
def test_parts_make_the_document(spark, tmp_path, kind):
    rng = random.Random(1)
    one = relation(spark, {f"d{rng.randrange(5)}/s{rng.randrange(4)}/f{k}.{rng.choice(['rs', 'py'])}": "line\n" * rng.randrange(4) + rng.choice(["", "é```", "\n\n"]) for k in range(80)})
    files = one.union(relation(spark, {"a.rs": "x", "b/c": ""}, "q")).union(relation(spark, {"n.rs": "null"}, None)).union(relation(spark, {"a.rs": "y"}, "q"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few, and should still make several parts
    try:
        manifest = parts.write_parts(files, str(tmp_path / "out"), kind)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r["repo_id"]: r["document"] for r in shape.documents(files, kind).collect()}
    got = {}
    for r in sorted(parts.read_parts(spark, str(tmp_path / "out")).collect(), key=lambda r: r["at"]):
        assert len(got.get(r["repo_id"], b"")) == r["at"]
        got[r["repo_id"]] = got.get(r["repo_id"], b"") + bytes(r["body"])
    assert {k: v.decode() for k, v in got.items()} == want
    assert manifest.filter("repo_id = 'r'").count() > 1
    sizes = {f.parent.name: f.stat().st_size for f in (tmp_path / "out" / "parts").rglob("*.txt")}
    assert {f"range_no={r['range_no']}": r["n"] for r in manifest.groupBy("range_no").agg(F.sum("length").alias("n")).collect()} == sizes


def flat_by_walk(paths):
    """Places by walking the tree in one process."""
    children = {}
    for p in paths:
        parts_ = tuple(p.split("/"))
        for k in range(len(parts_)):
            children.setdefault(parts_[:k], set()).add(parts_[: k + 1])
    files = {tuple(p.split("/")) for p in paths}
    out, count = {}, 0

    def visit(node, parent):
        nonlocal count
        mine, count = count, count + 1
        for c in sorted(children.get(node, ()), key=lambda c: (c in files, c)):
            visit(c, mine)
        out[node] = (mine, count, parent)

    for top in sorted(children.get((), ()), key=lambda c: (c in files, c)):
        visit(top, None)
    return out


def test_places_are_those_of_a_walk(spark):
    rng = random.Random(8)
    paths = sorted({"/".join(rng.choice("abcAé") for _ in range(rng.randint(1, 5))) + ".f" for _ in range(150)})
    for repo in ("r", None):
        got = tree.flat(tree.nodes(relation(spark, dict.fromkeys(paths, ""), repo)))
        assert {tuple(r["node"]): (r["idx"], r["subtree_end"], r["parent"]) for r in got.collect()} == flat_by_walk(paths)
        assert tree.render(relation(spark, dict.fromkeys(paths, ""), repo)).first()["tree"] == tree.drawing([p.split("/") for p in sorted(paths, key=lambda p: p.split("/"))])


def test_no_window_over_a_repository(spark, sf_dir):
    from textloom.plans import catalogue

    for query in (catalogue.tree_flat, catalogue.tree_lines):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("range_no" in line for line in windows), windows


LINES = ["*.rs", "!a*", "/b", "c/", "a/**/b.rs", "**/c/a", "b/**", "!*.py", "[ab].rs", "?.py", "# no", "", "a b", "c.rs", "\\!x", "!b/a.rs", "a\\ b"]


def test_rules_as_a_relation(spark, tmp_path):
    """Random trees with ignore files at any depth: the same files as the walk."""
    from textloom.operators import ignore_rules

    rng = random.Random(4)
    for k in range(6):
        root = tmp_path / f"t{k}"
        files = {}
        for _ in range(60):
            folder = "/".join(rng.choice("abc") + rng.choice(["", "", ".d"]) for _ in range(rng.randint(0, 3)))
            name = rng.choice([rng.choice(["a", "b", "c", "a b", "!x"]) + rng.choice([".rs", ".py", "", ".RS"])] * 3 + [".ignore", ".packignore"])
            path = f"{folder}/{name}" if folder else name
            if not (root / path).exists() and not any((root / p).is_file() for p in [os.path.dirname(path)] if p):
                try:
                    planted(root, {path: "\n".join(rng.sample(LINES, 3)) if name.endswith("ignore") else "x"})
                    files[path] = (root / path).read_text()
                except OSError:
                    continue
        options = Walk(hidden=True, ignore_names=(".packignore",))
        want = sorted(p for p, _ in walk([start(str(root), options)], options))
        for repo in ("r", None):
            every = relation(spark, files, repo)
            rules = ignore_rules.rules_of(every)
            assert sorted(r["path"] for r in ignore_rules.kept_by_rules(every, rules).collect()) == want, (k, files)


def test_rules_of_nothing(spark):
    from textloom.operators import ignore_rules

    files = relation(spark, {"a.rs": "", "b/c.rs": ""})
    none = ignore_rules.rules_of(files)
    assert none.count() == 0 and ignore_rules.kept_by_rules(files, none).count() == 2
    assert ignore_rules.kept_by_rules(files.limit(0), ignore_rules.rules_of(relation(spark, {".ignore": "*"}))).count() == 0
    assert ignore_rules.kept_by_rules(files.union(files), ignore_rules.rules_of(relation(spark, {".ignore": "*\n!a.rs"}))).count() == 2
