"""Source trees, packs, budgets and streams."""

import random
import subprocess

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import outline
from textloom.operators import budget, files, selection, tree
from textloom.operators import format as shape
from textloom.plans import pack
from textloom.schema import FILE, PackOptions
from textloom.sources.ignore import OWN, Rule, Rules, pattern_of
from textloom.sources.listing import Walk, start, walk
from textloom.sources.repo_tree import read_tree


def relation(spark, rows, repo="r"):
    """FILE relation from {path: content}."""
    made = [(repo, p, p.split("/"), len(c.encode()), c, None, False) for p, c in rows.items()]
    return spark.createDataFrame(made, FILE)


@pytest.fixture
def repo(tmp_path):
    for path, data in {
        "src/main.rs": b"fn main() {\n    go();\n}\n", "Cargo.lock": b'[[package]]\nname = "a"\nversion = "1"\n', "logo.svg": b"<svg/>", ".env.production": b"K=1", "data.dat": b"x\x00y", "bad.txt": b"\xff\xfe",
        "ignored_dir/a.rs": b"x", "keep/ignored_dir2/b.rs": b"y", ".packignore": b"ignored_dir/\n*.tmp\n!keep.tmp\n", "a.tmp": b"t", "keep.tmp": b"k", "pkg/__init__.py": b"", "big.txt": b"z" * 5000, "wf.json": b'{"1": {"class_type": "A"}}',
    }.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    return tmp_path


def names(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_scan(spark, repo):
    options = PackOptions(max_file_size=1000)
    kept = pack.packed_files(pack.tree_files(spark, str(repo), options), options)
    assert names(kept) == ["keep.tmp", "keep/ignored_dir2/b.rs", "pkg/__init__.py", "src/main.rs", "wf.json"]
    locks = PackOptions(summary_locks=True, outline=True, max_file_size=1000)
    found = {r["path"]: r for r in pack.packed_files(pack.tree_files(spark, str(repo), locks), locks).collect()}
    assert found["Cargo.deps.txt"]["content"] == "a @ 1\n" and not found["Cargo.deps.txt"]["is_outlined"]
    assert found["wf.workflow.txt"]["content"].startswith("# ComfyUI Workflow Manifest (1 nodes")
    assert found["src/main.rs"]["content"] == "fn main() { /* ... */ }\n" and found["src/main.rs"]["is_outlined"]
    shallow = PackOptions(max_depth=1, include=("*.tmp",))
    assert names(pack.packed_files(pack.tree_files(spark, str(repo), shallow), shallow)) == ["keep.tmp"]


def test_source_pushes_filters(spark, repo):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_tree(spark, str(repo), hidden=True).filter("size_bytes > 4000")
        assert names(df) == ["big.txt"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert names(read_tree(spark, str(repo / "big.txt"))) == ["big.txt"]
    with pytest.raises(Exception, match="no such source tree"):
        read_tree(spark, str(repo / "none")).collect()


def test_git(spark, repo):
    run = lambda *a: subprocess.run(["git", "-C", str(repo), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src/main.rs")
    assert names(pack.changed_files(spark, str(repo), staged=True)) == ["src/main.rs"]
    assert "keep.tmp" in names(pack.changed_files(spark, str(repo)))
    options = PackOptions()
    assert names(pack.packed_files(pack.tree_files(spark, str(repo), options), options, pack.changed_files(spark, str(repo), True))) == ["src/main.rs"]


def test_git_lines(spark):
    lines = [" M a.rs", "M  b.rs", "?? c.rs", "!! d.rs", " D e.rs", "D  f.rs", "R  old.rs -> new.rs", 'A  "sp ace.rs"', "AM g.rs", "x", "MD h.rs"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert names(files.git_changes(df)) == ["a.rs", "b.rs", "c.rs", "g.rs", "new.rs", "sp ace.rs"]
    assert names(files.git_changes(df, staged=True)) == ["b.rs", "g.rs", "new.rs", "sp ace.rs"]


def test_ignore_rules():
    rules = Rules(tuple(Rule(OWN, "", *pattern_of(p)) for p in ["*.log", "!keep.log", "/top", "dir/", "a/**/z", "b/*.c"]))
    hit = [("x/y.log", False), ("top", False), ("q/dir", True), ("a/z", False), ("a/m/n/z", False), ("b/k.c", False)]
    miss = [("keep.log", False), ("q/top", False), ("q/dir", False), ("b/k/l.c", False), ("c", False)]
    assert all(rules.ignored(*x) for x in hit) and not any(rules.ignored(*x) for x in miss)
    assert pattern_of("# c") is None and pattern_of("") is None


def test_ignore_files_from_above(tmp_path):
    for path, body in {".git/info/exclude": "secret*\n", ".gitignore": "*.log\n/sub/top\n", "sub/.gitignore": "!keep.log\nlocal\n", "sub/a.log": "", "sub/keep.log": "", "sub/top": "", "sub/deep/local": "", "sub/secret1": "", "sub/x.py": ""}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    plain = Walk(gitignore=False)
    assert sorted(p for p, _ in walk([start(str(tmp_path / "sub"), Walk())], Walk())) == ["keep.log", "x.py"]
    assert sorted(p for p, _ in walk([start(str(tmp_path / "sub"), plain)], plain)) == ["a.log", "deep/local", "keep.log", "secret1", "top", "x.py"]
    assert sorted(p for p, _ in walk([start(str(tmp_path), Walk())], Walk())) == ["sub/keep.log", "sub/x.py"]


def test_tree_text(spark):
    got = tree.render(relation(spark, {"src/main.rs": "", "src/lib.rs": "", "Cargo.toml": "", "docs/a/b.md": ""})).first()["tree"]
    assert got == ".\n├── Cargo.toml\n├── docs\n│   └── a\n│       └── b.md\n└── src\n    ├── lib.rs\n    └── main.rs\n"


def test_drawing_is_the_relation(spark):
    """The walk over sorted paths draws what the joins on prefixes draw."""
    rng = random.Random(3)
    for _ in range(3):
        files = {"/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): "" for _ in range(25)}
        own = relation(spark, files)
        assert tree.drawing(sorted(p.split("/") for p in files)) == tree.render(own).first()["tree"]
    assert tree.drawing([]) == ".\n"


def test_visible_rows(spark):
    """Directories of the first `expand_depth` levels are open: depth 0 shows the top, depth 2 three components."""
    n = tree.nodes(relation(spark, {"a/b/c.rs": "", "a/d.rs": "", "e.rs": "", "a/b/x/y.rs": ""}))
    shown = lambda **kw: {"/".join(r["node"]) for r in tree.visible(n, **kw).collect()}
    assert shown(expand_depth=0) == {"a", "e.rs"} and shown(expand_depth=1) == {"a", "a/b", "a/d.rs", "e.rs"}
    assert shown(expand_depth=2) == {"a", "a/b", "a/b/c.rs", "a/b/x", "a/d.rs", "e.rs"}
    assert shown(collapsed=n.filter(F.array_join("node", "/") == "a/b"), expand_depth=2) == {"a", "a/b", "a/d.rs", "e.rs"}


def test_affected_counts_a_file_once(spark):
    own = relation(spark, {"tests/t.rs": engine(50)})
    fitted = budget.fit_budget(own, 3, outline.outline(F.col("content"), F.col("path")))
    assert fitted.filter("outlined and not kept").count() == 1 and budget.affected(fitted).first()["affected"] == 1


def test_real_encoder_counts(spark):
    """An encoder passed in decides counts and the budget."""
    words = lambda: lambda t: len(t.split())
    own = relation(spark, {"a.rs": "one two three four", "b.rs": "x" * 4000})
    kept = lambda options: {r["path"]: r["token_count"] for r in pack.packed_files(own, options).collect()}
    assert kept(PackOptions(budget=5, encoder=words)) == {"a.rs": 4, "b.rs": 1}
    assert kept(PackOptions(budget=4, encoder=words)) == {"b.rs": 1} and kept(PackOptions(count_tokens=True, encoder=words, token_profile="claude")) == {"a.rs": 4, "b.rs": 1}
    assert set(kept(PackOptions(budget=5))) == {"a.rs"}


def test_budget_scans_once(spark, sf_dir):
    """The final plan of a budgeted pack: one scan of documents, no content in a sort or window."""
    from textloom.plans import catalogue

    text = catalogue.pack_budget_code(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert text.count("documents.parquet") <= 1 and "Window [" not in text and "Sort [" not in text
    assert text.count("[_outline(") == 1 and text.count("[draw(") == 1


def test_sql_names(spark):
    from textloom.registry import register

    names = register(spark)
    row = spark.sql("""SELECT token_estimate('12345') AS e, token_count(repeat('x', 400), 'claude') AS c, is_lockfile('a/yarn.lock') AS l, file_name('a/b') AS f, path_depth('a/b') AS d, expand_tabs('\tx') AS t,
        outline_text('fn f() {\n 1\n}\n', 'rust') AS o, highlight_line('let x', 'rust')[0].kind AS h, lock_dependencies('yarn.lock', 'a@1:\n  version 2\n')[0].name AS n""").first()
    assert tuple(row) == (2, 108, True, "b", 2, "    x", "fn f() { /* ... */ }\n", "keyword", "a") and {"pgm_frames", "repo_tree"} <= set(names)


def test_chosen_files_are_in_path_order(spark):
    own = relation(spark, {"b": "", "a/x": "", "a-b/y": "", "c": ""}).withColumn("selected", F.col("path") != "c")
    assert [r["path"] for r in selection.chosen(own).collect()] == ["a/x", "a-b/y", "b"]


def test_node_totals(spark):
    n = {"/".join(r["node"]): r for r in tree.nodes(relation(spark, {"a/x": "1" * 41, "a/y": "22", "z": "333"})).collect()}
    assert (n["a/x"]["tokens"], n["a"]["files"], n["a"]["bytes"], n["a"]["tokens"]) == (11, 2, 43, 12) and n["z"]["is_file"] and not n["a"]["is_file"]


def test_selection(spark):
    own = relation(spark, {"a/x": "", "a/y": "", "b": ""}).withColumn("selected", F.col("path") == "a/x")
    on = lambda df: {r["path"] for r in df.filter("selected").collect()}
    once = selection.toggle(own, selection.under(F.col("path_parts"), ["a"]))
    assert on(once) == {"a/x", "a/y"}
    assert on(selection.toggle(once, selection.under(F.col("path_parts"), ["a"]))) == set()
    assert on(selection.toggle_all(own)) == {"a/x", "a/y", "b"} and on(selection.invert(own)) == {"a/y", "b"}


def test_formats(spark):
    own = relation(spark, {"b.md": "```\ncode\n```", "a.rs": 'say "hi"\n'})
    doc = lambda kind: shape.documents(own, kind).first()["document"]
    assert doc("xml").endswith('<file path="a.rs">\nsay "hi"\n</file>\n\n<file path="b.md">\n```\ncode\n```\n</file>\n')
    assert "## File: b.md\n\n````markdown\n```\ncode\n```\n````\n" in doc("markdown")
    import json

    calls = json.loads(doc("tool-call"))
    assert [c["path"] for c in calls] == ["a.rs", "b.md"] and calls[0]["tool_call_id"] == "call_read_file_1" and calls[0]["content"] == 'say "hi"\n'
    assert shape.documents(own.limit(0)).count() == 0


def engine(n):
    return "pub struct E;\nimpl E {\n    pub fn run(&self) {\n" + "".join(f"        let v{k} = {k};\n" for k in range(n)) + "    }\n}\n"


def test_budget_phases(spark):
    own = relation(spark, {"src/engine.rs": engine(200), "src/main.rs": "fn main() {}\n", "tests/t.rs": engine(50)})
    lined = outline.outline(F.col("content"), F.col("path"))
    fit = lambda b: {r["path"]: (r["outlined"], r["kept"]) for r in budget.fit_budget(own, b, lined).collect()}
    assert set(fit(100_000).values()) == {(False, True)}
    some = fit(1200)
    assert some["tests/t.rs"] == (True, True) and some["src/main.rs"] == (False, True)
    assert fit(20)["src/main.rs"][1] and not fit(20)["tests/t.rs"][1]
    assert budget.affected(budget.fit_budget(own, 20, lined)).first()["affected"] >= 2


def sequential(rows, limit):
    """The two phases as loops over [tier, path, content tokens, outline tokens or None, content bytes, outline bytes]."""
    state = {p: [t, tok, size, False] for t, p, tok, _, size, _ in rows}
    extra = {p: (otok, osize) for _, p, _, otok, _, osize in rows}
    order = lambda: sorted(state, key=lambda p: (state[p][0], -state[p][1], -state[p][2], [-ord(c) for c in p]))
    total = sum(s[1] for s in state.values())
    for p in order():
        if total <= limit:
            break
        otok, osize = extra[p]
        if otok is not None and osize < state[p][2] and otok < state[p][1]:
            total -= state[p][1] - otok
            state[p][1:] = [otok, osize, True]
    outlined = {p for p in state if state[p][3]}
    dropped = set()
    for p in order():
        if total <= limit:
            break
        total -= state[p][1]
        dropped.add(p)
    return outlined, dropped


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["tests/", "docs/", "m/", "c/"]), st.integers(0, 400), st.integers(0, 400)), min_size=1, max_size=12), st.integers(0, 400))
def test_budget_is_the_loop(spark, made, limit):
    rows = {f"{d}f{k:02d}.{'json' if d == 'c/' else 'rs'}": ("x" * a, "y" * b) for k, (d, a, b) in enumerate(made)}
    tier = {"t": 0, "d": 1, "m": 3, "c": 2}
    up = lambda n: -(-n // 4)
    want = sequential([[tier[p[0]], p, up(len(a)), up(len(b)), len(a), len(b)] for p, (a, b) in rows.items()], limit)
    own = relation(spark, {p: a for p, (a, _) in rows.items()}).join(spark.createDataFrame([(p, b) for p, (_, b) in rows.items()], "path string, short string"), "path")
    got = budget.fit_budget(own.select("repo_id", *[c for c in own.columns if c != "repo_id"]), limit, F.col("short")).collect()
    assert ({r["path"] for r in got if r["outlined"]}, {r["path"] for r in got if not r["kept"]}) == want


@pytest.mark.parametrize("outlines", [True, False])
def test_windows_and_ranges_agree(spark, monkeypatch, outlines):
    """However large a repository is held to be, and with repeated rows, the same files are outlined and dropped."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), f"{rng.choice(['tests/', 'docs/', 'm/'])}f{rng.randrange(60):02d}.rs", "x" * rng.randrange(300)) for _ in range(200)]
    own = spark.createDataFrame([(r, p, p.split("/"), len(c), c, None, False) for r, p, c in rows + rows[:20]], FILE)
    lined = F.concat(F.lit("y"), F.substring("content", 1, 40)) if outlines else None
    for limit in (10, 700, 3000, 10**6):
        fit = lambda: sorted(map(str, budget.fit_budget(own, limit, lined).collect()))
        want = fit()
        monkeypatch.setattr(budget, "FEW", 10)
        monkeypatch.setattr(budget, "SMALL", 1)
        assert fit() == want
        monkeypatch.undo()


def test_stream(spark, tmp_path):
    from textloom.streaming.rows import pack_stream, transform_stream

    relation(spark, {"a.rs": "fn f() {\n  1\n}\n", "b.svg": "x"}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FILE).parquet(str(tmp_path / "in"))
    got = []
    pack_stream(stream, PackOptions(budget=1000), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert len(got) == 1 and "a.rs" in got[0]["document"] and "b.svg" not in got[0]["document"]
    assert transform_stream(stream, PackOptions(outline=True)).isStreaming
    with pytest.raises(ValueError):
        transform_stream(stream, PackOptions(budget=5))


def test_cli(spark, repo, capsys, tmp_path):
    from textloom import cli

    out = tmp_path / "pack.xml"
    assert cli.main([str(repo), "-o", str(out), "-t", "--max-file-size", "1KB", "-I", "*.rs"]) == 0
    assert out.read_text().count("<file path=") == 2 and "2 files (" in capsys.readouterr().err
    assert cli.main([str(repo), "-o", str(out), "-q", "--no-packignore", "-I", "ignored_dir/*"]) == 0 and "ignored_dir/a.rs" in out.read_text()
    assert cli.main([str(repo), "-I", "*.none"]) == 0 and "no files" in capsys.readouterr().err
    assert cli.main([str(repo), "--parts", str(tmp_path / "parts"), "-I", "*.rs"]) == 0 and "2 files (" in capsys.readouterr().err
    assert b"".join(f.read_bytes() for f in sorted((tmp_path / "parts" / "parts").rglob("*.txt"))).count(b"<file path=") == 2
    assert cli.main([str(repo), "--parts", str(tmp_path / "none"), "-I", "*.none"]) == 0 and "no files" in capsys.readouterr().err
    assert cli.main(["--video-prompt", "show me a video of a fox"]) == 0 and "subject: a fox" in capsys.readouterr().out


def test_cli_counts_on_the_way(spark, repo, monkeypatch, tmp_path, capsys):
    """Files are read once: their counts come with the text."""
    from textloom import cli
    from textloom.sources import listing

    opened = tmp_path / "opened"
    opened.mkdir()

    def noted(path):
        with open(opened / path.replace("/", "|"), "a") as f:
            f.write("x")
        return listing._read(path)

    monkeypatch.setattr(pack, "with_contents", lambda meta: listing.with_contents(meta, noted))
    assert cli.main([str(repo), "-o", str(tmp_path / "p.xml"), "-I", "*.rs"]) == 0 and "2 files (" in capsys.readouterr().err
    assert {f.name.rsplit("|", 1)[1]: f.read_text() for f in opened.iterdir()} == {"main.rs": "x", "b.rs": "x"}


def test_plans_stay_narrow(spark, sf_dir):
    """Rules prune columns and don't shuffle; the change set is broadcast."""
    from textloom.plans import catalogue

    plan = lambda q: q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(catalogue.skip_filter) and "text" not in plan(catalogue.skip_filter).split("ReadSchema")[1]
    assert "BroadcastHashJoin" in plan(catalogue.changed_semi_join) and "CartesianProduct" not in plan(catalogue.tree_lines)
