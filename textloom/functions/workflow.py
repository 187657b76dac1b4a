"""Manifests of node-graph workflow files (JSON of a diffusion UI or of its API).

The compatible reading is lexical: keys are looked for in the text, not in a parsed tree, so it
also works on files with trailing rubbish. A token pattern for strings drives everything.
`histogram` is the semantic counterpart on parsed JSON.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING = r'"((?:[^"\\]|\\.)*)"'
LITERAL = re.compile(STRING, re.S)
# Fixed lists.
LINK_TYPES = frozenset("MODEL CLIP VAE LATENT IMAGE MASK CONDITIONING STRING INT FLOAT CONTROL_NET".split())
MODEL_FILE = re.compile(r"\.(safetensors|ckpt|pt|pth|bin|gguf)$", re.I)
SAMPLERS = frozenset("euler euler_ancestral dpmpp_2m dpmpp_2m_sde dpmpp_sde uni_pc ddim karras normal sgm_uniform simple beta".split())
MODEL_KEYS = "ckpt_name unet_name vae_name clip_name lora_name".split()
SIZE_KEYS = "width height length frame_count frames batch_size fps frame_rate".split()
SAMPLER_KEYS = "steps cfg sampler_name sampler scheduler denoise seed noise_seed".split()
#: Places of a sampler node's widgets.
SAMPLER_WIDGETS = {"seed": 0, "steps": 2, "cfg": 3, "sampler_name": 4, "scheduler": 5, "denoise": 6}
SECTIONS = ("Models & Checkpoints", "Resolution & Video Length", "Prompts", "Sampler & Latent Config")


def _plain(raw: str) -> str:
    """A JSON string's body with each escape standing for the character behind the backslash."""
    return re.sub(r"\\(.)", r"\1", raw, flags=re.S)


def _strings(text: str, key: str) -> list[str]:
    """String values of every occurrence of a key."""
    return [_plain(m[1]) for m in re.finditer(rf'"{key}"\s*:\s*{STRING}', text, re.S)]


def _scalars(text: str, key: str) -> list[str]:
    """String or plain number values of a key."""
    found = []
    for m in re.finditer(rf'"{key}"\s*:\s*(?:{STRING}|([^\[\{{",\}}\]\s][^,\}}\]\s]*))', text, re.S):
        if m[1] is not None:
            found.append(_plain(m[1]))
        elif re.fullmatch(r"[0-9.-]+", m[2]):
            found.append(m[2])
    return found


def _enclosed(text: str, at: int, opening: str, closing: str) -> tuple[int, int] | None:
    """Inside of the first bracket pair from `at` on; brackets in strings don't count."""
    start = text.find(opening, at)
    depth = 0
    for m in re.compile(rf"{STRING}|[{re.escape(opening + closing)}]", re.S).finditer(text, start) if start >= 0 else ():
        if m[0] == opening:
            depth += 1
        elif m[0] == closing:
            depth -= 1
            if not depth:
                return start + 1, m.start()
    return None


def _widgets(body: str) -> list[str]:
    """Comma-separated scalars of an array; empty ones are left out."""
    cells = re.findall(rf'((?:{STRING}|[^",])*)(?:,|\Z)', body, re.S)
    shown = [LITERAL.sub(lambda m: _plain(m[1]), c[0]).strip() for c in cells]
    return [c for c in shown if c]


class Summary:
    def __init__(self) -> None:
        self.nodes: Counter[str] = Counter()
        self.groups: dict[str, set[str]] = {s: set() for s in SECTIONS}

    def node(self, body: str) -> None:
        kind = next(iter(_strings(body, "type")), None)
        if kind is not None and kind not in LINK_TYPES:
            self.nodes[kind] += 1
        at = body.find('"widgets_values"')
        inner = _enclosed(body, at + 16, "[", "]") if at >= 0 else None
        if inner:
            self.values((kind or "").lower(), body[slice(*inner)])

    def values(self, kind: str, body: str) -> None:
        models, sizes, prompts, sampler = self.groups.values()
        cells = _widgets(body)
        if "ksampler" in kind and len(cells) >= 7:
            sampler.update(f"{k}: {cells[i]}" for k, i in SAMPLER_WIDGETS.items())
        elif ("latent" in kind or "empty" in kind) and len(cells) >= 3 and all(re.fullmatch("[0-9]+", c) for c in cells[:3]):
            sizes.update(f"{k}: {c}" for k, c in zip(("width", "height", "length"), cells, strict=False))
        encodes = "textencode" in kind or "prompt" in kind
        for m in LITERAL.finditer(body):
            value = _plain(m[1]).strip()
            if not value:
                continue
            if MODEL_FILE.search(value):
                models.add(value)
            elif value in SAMPLERS:
                sampler.add(value)
            elif encodes or len(value.encode()) >= 10 and " " in value:
                prompts.add(value)

    def api(self, text: str) -> None:
        models, sizes, prompts, sampler = self.groups.values()
        self.nodes.update(_strings(text, "class_type"))
        prompts.update(v.strip() for v in _strings(text, "text") if v.strip())
        prompts.update(v.strip() for v in _strings(text, "prompt") if len(v.strip().encode()) >= 4)
        for keys, target in ((MODEL_KEYS, models), (SIZE_KEYS, sizes), (SAMPLER_KEYS, sampler)):
            read = _strings if keys is MODEL_KEYS else _scalars
            target.update(f"{k}: {v.strip() if keys is MODEL_KEYS else v}" for k in keys for v in read(text, k) if v.strip() or keys is not MODEL_KEYS)


def workflow_manifest(content: str | None) -> str | None:
    """The manifest text; None for what isn't a workflow or has no nodes."""
    text = (content or "").strip()
    graph = '"nodes"' in text and '"links"' in text
    if not (text.startswith("{") and text.endswith("}") and (graph or '"class_type"' in text)):
        return None
    found = Summary()
    if graph and (inner := _enclosed(text, text.find('"nodes"') + 7, "[", "]")):
        at, end = inner
        while (one := _enclosed(text[:end], at, "{", "}")) is not None:
            found.node(text[slice(*one)])
            at = one[1] + 1
    if '"class_type"' in text:
        found.api(text)
    if not found.nodes:
        return None
    by_bytes = lambda values: sorted(values, key=str.encode)
    out = [f"# ComfyUI Workflow Manifest ({found.nodes.total()} nodes, {len(found.nodes)} unique types)", "## Nodes", *(f"- {k} x{found.nodes[k]}" for k in by_bytes(found.nodes))]
    for title, values in found.groups.items():
        if values:
            shown = '- "{}"' if title == "Prompts" else "- {}"
            out += [f"## {title}", *(shown.format(v) for v in by_bytes(values))]
    return "\n".join(out) + "\n"


@F.pandas_udf(T.StringType())
def manifest(content: pd.Series) -> pd.Series:
    return content.map(workflow_manifest)


def is_workflow(content: Column) -> Column:
    """Cheap native test, so that other JSON never reaches Python."""
    has = lambda s: F.contains(content, F.lit(s))
    return (has('"nodes"') & has('"links"')) | has('"class_type"')


def histogram(workflows: DataFrame, content: str = "content") -> DataFrame:
    """(node_type, n): node types over all workflows by parsing. API form: each top-level value's class_type; UI form: the type of each of `nodes`, but for link types."""
    api = F.transform(F.map_values(F.from_json(F.col(content), "map<string,struct<class_type:string>>")), lambda v: v["class_type"])
    ui = F.filter(F.transform(F.from_json(F.col(content), "nodes array<struct<type:string>>")["nodes"], lambda v: v["type"]), lambda t: ~t.isin(*LINK_TYPES))
    empty = F.array().cast("array<string>")
    parsed = workflows.select(F.explode(F.concat(F.coalesce(api, empty), F.coalesce(ui, empty))).alias("node_type"))
    return parsed.filter("node_type is not null").groupBy("node_type").agg(F.count("*").alias("n"))


def number_setting(content: Column, key: str) -> Column:
    """A numeric field of a flat JSON object, as a native expression."""
    return F.get_json_object(content, f"$.{key}").try_cast("bigint")
