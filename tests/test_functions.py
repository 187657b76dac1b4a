"""Text functions against hand-made cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import frames, highlight, lockfiles, outline, paths, prompts, redact, text, workflow
from textloom.schema import format_name, profile_name


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


SK = "sk-" + "abcDEF1234" * 2
TEXTS = [
    (f"a {SK} b sk-proj-{'x1' * 12} c sk-ant-{'q_7-' * 8} d sk-short", 3),
    (f"ghp_{'a' * 20} github_pat_{'b' * 22} AKIA{'Z9' * 8} ghs_{'c' * 25} akia{'z9' * 8} AKIA{'Z9' * 8}x", 4),
    ("-----BEGIN OPENSSH PRIVATE KEY-----\nabc\n-----END OPENSSH PRIVATE KEY-----\n-----BEGIN PRIVATE KEY-----", 2),
    (f"nothing here x{SK} my_{SK}", 0),
    ("", 0),
]


def test_redaction(spark):
    df = spark.createDataFrame([(t, n) for t, n in TEXTS] + [(None, None)], "t string, n int")
    got = df.select("t", "n", redact.count_secrets(F.col("t")).alias("c"), redact.redact_secrets(F.col("t")).alias("r")).collect()
    for r in got:
        assert r["c"] == r["n"]
        assert (r["r"] or "").count("[REDACTED_SECRET]") == (r["n"] or 0)
    again = df.select(redact.redact_secrets(redact.redact_secrets(F.col("t"))).alias("a"), redact.redact_secrets(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in again)


def test_rust_outline():
    src = "use a;\npub struct U {\n    x: u8,\n}\nimpl U {\n    /// doc\n    pub fn new(\n        x: u8,\n    ) -> Self {\n        if x > 1 {\n            g();\n        }\n        U { x }\n    }\n    fn t(&self);\n    fn one() { 1 }\n}\n"
    got = outline.outline_text(src, "rust")
    assert got == "use a;\npub struct U {\n    x: u8,\n}\nimpl U {\n    /// doc\n    pub fn new(\n        x: u8,\n    ) -> Self { /* ... */ }\n    fn t(&self);\n    fn one() { /* ... */ }\n}\n"


def test_python_outline():
    src = "import os\n\n@deco\ndef f(a,\n      b):\n    '''doc'''\n    return a\n\nclass C:\n    x = 1\n    async def m(self):\n        pass\n    y = 2\n"
    assert outline.outline_text(src, "python") == "import os\n\n@deco\ndef f(a,\n      b):\n    ...\nclass C:\n    x = 1\n    async def m(self):\n        ...\n    y = 2\n"
    # a one-line function takes in what follows up to a line that ends in a colon
    assert outline.outline_text("def f(): return 1\nx = 2\nif x:\n    y\nz\n", "python") == "def f(): return 1\nx = 2\nif x:\n    ...\nz\n"


def test_brace_outline():
    go = "package p\r\n\r\nfunc F(a int) int {\r\n\treturn a\r\n}\r\ntype T struct {\r\n\tx int\r\n}"
    assert outline.outline_text(go, "go") == "package p\n\nfunc F(a int) int { /* ... */ }\ntype T struct {\n\tx int\n}\n"
    ts = "export const f = (a) => {\n  return a;\n};\ninterface I {\n  a: string;\n}\nclass C {\n  constructor(x) {\n    this.x = x;\n  }\n}\n"
    assert outline.outline_text(ts, "typescript") == "export const f = (a) => { /* ... */ }\ninterface I {\n  a: string;\n}\nclass C {\n  constructor(x) { /* ... */ }\n}\n"
    assert outline.outline_text("a: 1\n", "yaml") == "a: 1\n"
    assert outline.outline_text(None, "go") is None


CARGO = '[[package]]\nname = "b"\nversion = "2"\n\n[[package]]\nname = "a"\nversion = "1"\nsource = "r"\n\n[[package]]\nname = "a"\nversion = "1"\n[metadata]\nname = "z"\nversion = "0"\n'
LOCKS = [
    ("Cargo.lock", CARGO, [("a", "1"), ("b", "2")]),
    ("poetry.lock", CARGO.replace("\n", "\r\n"), [("a", "1"), ("b", "2")]),
    ("package-lock.json", '{"packages": {"node_modules/a": {"version": "1.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0"}}}', [("@s/b", "2.0"), ("a", "1.0")]),
    ("package-lock.json", '{\n"dependencies": {\n  "q": {\n    "version": "3.1",\n    "requires": {\n      "z": "1"\n    }\n  }\n}\n}', [("q", "3.1")]),
    ("pnpm-lock.yaml", "packages:\n  '@babel/core@7.1.0':\n    x: 1\n  /lodash@4.1.0_h:\n  react@18.0.0(p@1.0.0):\n", [("@babel/core", "7.1.0"), ("lodash", "4.1.0"), ("react", "18.0.0")]),
    ("go.sum", "m/a v1 h1:x\nm/a v1/go.mod h1:y\nm/b v2 h1:z\n\n# c\n", [("m/a", "v1"), ("m/b", "v2")]),
    ("yarn.lock", '# y\n"@s/p@^1", "@s/p@^2":\n  version "1.5"\n\nlodash@^4:\n  version "4.2"\n', [("@s/p", "1.5"), ("lodash", "4.2")]),
    ("composer.lock", "{}", None),
    ("go.sum", "", []),
]


def test_lockfiles(spark):
    df = spark.createDataFrame([(k, f"x/{n}", c) for k, (n, c, _) in enumerate(LOCKS)], "k int, path string, content string")
    got = {r["k"]: r["d"] for r in df.select("k", lockfiles.dependencies(F.col("path"), F.col("content")).alias("d")).collect()}
    for k, (_, _, want) in enumerate(LOCKS):
        assert (None if got[k] is None else [tuple(d) for d in got[k]]) == want, LOCKS[k][0]


API = '{"3": {"class_type": "KSampler", "inputs": {"seed": 42, "steps": 20, "cfg": 7.5, "sampler_name": "euler", "model": ["4", 0]}}, "4": {"class_type": "CheckpointLoaderSimple", "inputs": {"ckpt_name": "m.safetensors"}}, "6": {"class_type": "CLIPTextEncode", "inputs": {"text": "a \\"red\\" fox"}}, "5": {"class_type": "EmptyLatentImage", "inputs": {"width": 512, "height": 768}}}'
UI = '{"nodes": [{"id": 1, "type": "KSampler", "widgets_values": [7, "fixed", 30, 6.0, "dpmpp_2m", "karras", 1.0]}, {"id": 2, "type": "EmptyLatentVideo", "widgets_values": [832, 480, 81]}, {"id": 3, "type": "CLIPTextEncode", "widgets_values": ["fox"]}, {"id": 4, "type": "LoraLoader", "widgets_values": ["s.safetensors", 0.8]}], "links": []}'


def test_workflows():
    assert workflow.workflow_manifest(API) == (
        "# ComfyUI Workflow Manifest (4 nodes, 4 unique types)\n## Nodes\n- CLIPTextEncode x1\n- CheckpointLoaderSimple x1\n- EmptyLatentImage x1\n- KSampler x1\n"
        "## Models & Checkpoints\n- ckpt_name: m.safetensors\n## Resolution & Video Length\n- height: 768\n- width: 512\n"
        '## Prompts\n- "a "red" fox"\n## Sampler & Latent Config\n- cfg: 7.5\n- sampler_name: euler\n- seed: 42\n- steps: 20\n'
    )
    ui = workflow.workflow_manifest(UI)
    for line in ("- KSampler x1", "- s.safetensors", "- length: 81", '- "fox"', "- steps: 30", "- scheduler: karras", "- dpmpp_2m"):
        assert line in ui.split("\n"), line
    assert workflow.workflow_manifest('{"a": 1}') is None
    assert workflow.workflow_manifest(None) is None


def test_frames(spark):
    flat, checks = bytes([9] * 256), bytes((x // 4 + y // 4) % 2 * 255 for y in range(16) for x in range(16))
    assert frames.sharpness(flat, 16, 16) == 0
    assert frames.sharpness(checks, 16, 16) > 1000
    assert frames.sharpness(checks, 16, 17) == 0 == frames.sharpness(checks, 2, 2)
    border = bytes(255 if x in (0, 15) or y in (0, 15) else 9 for y in range(16) for x in range(16))
    assert frames.sharpness(border, 16, 16) == 0
    stream = b"P5\n# note\n4 3\n255\n" + bytes(range(12)) + b" P5 2 2 255\n" + b"\n \t#" + b"P5 2 2 300\n...."
    assert [(k, w, h, p) for k, w, h, p in frames.pgm_frames(stream)] == [(0, 4, 3, bytes(range(12))), (1, 2, 2, b"\n \t#")]
    df = spark.createDataFrame([("c", 0, 1.0), ("c", 2, 5.0), ("c", 1, 5.0)], "clip_id string, frame_idx int, sharpness double")
    assert tuple(frames.sharpest(df).first()) == ("c", 1, 5.0)


def test_prompt(spark):
    raw = "Please generate a video of a courier in a red coat, shot on 85mm Cooke at golden hour. She just walks slowly; neon-lit street, f/1.4, please."
    out = one(spark, prompts.compiled(F.col("t"), F.lit(5), F.lit("k.png")), t=raw)
    assert "    subject: a courier in a red coat, shot on 85mm Cooke at golden hour\n    lens: 85mm, cooke, f/1.4\n    lighting: golden hour, neon-lit\n" in out
    assert out.count("<shot index=") == 3 and 'duration="5s"' in out and "[Continuity: anchor=k.png, lock=character_lock]" in out and "just" not in out
    bare = one(spark, prompts.compiled(F.col("t")), t="a cooked meal")
    assert "lens" not in bare and "Camera" not in bare and bare.endswith("Shot 1: a cooked meal")
    assert one(spark, prompts.shots(F.col("t")), t="") == ["cinematic establishing shot"]
    assert one(spark, prompts.shots(F.col("t")), t="Wan 2.1 look. Shot 2: b cut to c.") == ["Wan 2.1 look", "b", "c"]


def test_literals():
    assert text.parse_size("500KB") == 512_000 and text.parse_size("1.5MB") == 1_572_864 and text.parse_size("1024") == 1024
    assert text.parse_budget("50k") == 50_000 and text.parse_budget("1m") == 1_000_000
    for bad in ("", "x", "5 parsecs", "-1"):
        with pytest.raises(ValueError):
            text.parse_size(bad)
    for bad in ("0", "5kb", "-1k"):
        with pytest.raises(ValueError):
            text.parse_budget(bad)
    assert profile_name("GPT-4o") == "o200k" and format_name("JSON") == "tool-call"
    with pytest.raises(ValueError):
        profile_name("abacus")


def test_globs(spark):
    df = spark.createDataFrame([("src/a.rs",), ("a.rs",), ("docs/x/y.md",), ("x/docs/z",), ("a-b/c",)], "p string")
    match = lambda *g: {r["p"] for r in df.filter(paths.matches_any(F.col("p"), list(g))).collect()}
    assert match("*.rs") == {"src/a.rs", "a.rs"}
    assert match("**/docs/**") == {"docs/x/y.md", "x/docs/z"}
    assert match("{a,x}*") == {"a.rs", "x/docs/z", "a-b/c"}
    assert match("[!a]?c/*") == {"src/a.rs"} and match() == set()
    for bad in ("[a", "{a", ""):
        with pytest.raises(ValueError):
            paths.glob_regex(bad)


def test_names(spark):
    names = [".gitignore", "a.tar.gz", "Dockerfile", "x.", "src/lib.RS", "__init__.py"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(paths.extension(F.col("p"))).collect()] == ["", "gz", "", "", "RS", "py"]
    assert [r[0] for r in df.select(paths.language_hint(F.col("p"))).collect()] == ["", "", "", "", "", "python"]
    order = spark.createDataFrame([("a.rs",), ("a-b/x",), ("a/x",)], "p string").orderBy(paths.parts(F.col("p")))
    assert [r[0] for r in order.collect()] == ["a/x", "a-b/x", "a.rs"]


def test_numbers(spark):
    df = spark.createDataFrame([(245,), (1234,), (18_420,), (999_999,), (1_250_000,)], "n bigint")
    assert [r[0] for r in df.select(text.compact(F.col("n"))).collect()] == ["245", "1.2k", "18k", "999k", "1.2M"]
    assert [r[0] for r in df.select(text.grouped(F.col("n"))).collect()][2] == "18,420"
    assert one(spark, text.size_short(F.lit(127_488))) == "124.5 KB"
    assert one(spark, text.size_short(F.lit(9_472))) == "9.2 KB"


def test_preview_keeps_characters(spark):
    df = spark.createDataFrame([(t,) for t in ("abcdefgh", "abc", "ab😀cd", "a😀😀", "éééé", "abcdeé", None)], "t string")
    got = [tuple(r["p"]) for r in df.select(text.preview(F.col("t"), 6).alias("p")).collect()]
    assert got == [("abcdef", True), ("abc", False), ("ab😀", True), ("a😀", True), ("ééé", True), ("abcde", True), (None, None)]


def test_anchor_with_stand_in_tools(spark, tmp_path, monkeypatch):
    """Stand-ins for the video tools: two soft frames in the short tail, a sharp one in the wider."""
    from textloom.sources import video

    flat, checks = bytes([9] * 256), bytes((x // 4 + y // 4) % 2 * 255 for y in range(16) for x in range(16))
    head = b"P5 16 16 255\n"
    (tmp_path / "soft").write_bytes((head + flat) * 2)
    (tmp_path / "wide").write_bytes(head + flat + head + checks + head + flat)
    tool = tmp_path / "ffmpeg"
    tool.write_text(f"#!/bin/sh\nfor last; do :; done\ncase \"$*\" in *-0.500*image2pipe*) cat {tmp_path}/soft;; *image2pipe*) cat {tmp_path}/wide;; *) echo \"$*\" > \"$last\";; esac\n")
    probe = tmp_path / "ffprobe"
    probe.write_text("#!/bin/sh\necho 10.0\n")
    for f in (tool, probe):
        f.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/bin:/usr/bin")
    clip = tmp_path / "clip.mp4"
    clip.write_bytes(b"x")
    still, idx, score = video.anchor(str(clip))
    assert still.endswith("clip.anchor.png") and idx == 1 and score > 12 and "-sseof -1.000" in (tmp_path / "clip.anchor.png").read_text()
    with pytest.raises(FileNotFoundError):
        video.anchor(str(tmp_path / "none.mp4"))
    monkeypatch.setenv("PATH", str(tmp_path / "nowhere"))
    with pytest.raises(video.ToolMissing):
        video.anchor(str(clip))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab_ 1\"'`\\/#.(){}é=", max_size=40), st.sampled_from(["rust", "python", "go", ""]))
def test_highlight_keeps_the_line(line, lang):
    assert "".join(t for t, _ in highlight.spans(line, lang)) == line


def test_highlight_kinds():
    assert highlight.spans("  let x: u8 = 0x1f; // n", "rust") == [("  ", "blank"), ("let", "keyword"), (" ", "punct"), ("x", "name"), (": ", "punct"), ("u8", "type"), (" = ", "punct"), ("0x1f", "number"), ("; ", "punct"), ("// n", "comment")]
