"""Details of prompts against plain versions, each read from a text once."""

import random
import re

from pyspark.sql import functions as F

from textloom.functions import prompts
from textloom.plans import catalogue
from textloom.registry import sql_of

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def seen(text, known):
    low = text.translate(LOWER)
    return [k for k in known if re.search(rf"(?<![A-Za-z0-9]){re.escape(k)}(?![A-Za-z0-9])", low)]


def locked(text, known):
    found = seen(text, known)
    return ", ".join(k for n, k in enumerate(found) if not any(seen(o, [k]) for o in found[:n])) or None


def texts():
    rng = random.Random(5)
    pieces = [*prompts.LENS, *prompts.CAMERA, *prompts.LIGHTING, "x", "2", "é", "just", "(Kind)", "Kind", "shot 2:", "neon", "wide", "natural", "rim light", "cyberpunk neon lighting", "Please create"]
    signs = [" ", " ", " ", ", ", "-", "", "; ", ".\n", ". ", "\t", "\x1f", " ", "İ"]
    made = ["".join(rng.choice([str.lower, str.upper, str.title])(rng.choice(pieces)) + rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    return [*made, "", " .. ", "a\x1f", "35mm", "neon-lit neon, NEON-LIT", "natural lighting", "wide-angle wide angle close-up extreme close-up", None]


def test_specs_equal_the_plain_version(spark):
    # the last list isn't ordered by length: what contains an earlier detail doesn't hide it
    lists = [prompts.LENS, prompts.LIGHTING, prompts.CAMERA_OR_LENS, ["neon", "neon lighting", "lighting", "cyberpunk neon", "rim light"]]
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    for r in df.select("t", *[prompts.specs(F.col("t"), known).alias(f"s{n}") for n, known in enumerate(lists)]).collect():
        for n, known in enumerate(lists):
            assert r[f"s{n}"] == (None if r["t"] is None else locked(r["t"], known)), r["t"]


def test_a_text_is_scanned_once_for_a_list():
    assert sql_of(prompts.specs(F.col("t"), prompts.LENS)).count("regexp") == 1


def test_turns_of_one_row_group_are_dealt_over_the_cores(spark, tmp_path):
    spark.createDataFrame([(k, 0, "user", f"{k} a 50mm lens") for k in range(400)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("prompt_specs", "prompt_condense", "prompt_shots", "prompt_strip_filler"):
        assert catalogue.queries()[name](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def assemble(info, seconds, anchor):
    who, lens, light = info["subject"], locked(info["clean"], prompts.LENS), locked(info["clean"], prompts.LIGHTING)
    brief = ["# 1. Prompt-Writer Brief (XML for LLM planning)", "<video_brief>", "  <character_lock>", f"    subject: {who}"]
    brief += [f"    {name}: {value}" for name, value in (("lens", lens), ("lighting", light)) if value is not None]
    brief.append("  </character_lock>")
    identity = ", ".join([who, *(v for v in (lens, light) if v is not None and v.lower() not in who.lower())])
    paste = ["", "# 2. Paste-Ready Video Model Prompts (No XML tags — repeat identity per clip)"]
    for n, shot in enumerate(info["shots"], 1):
        cam = ", ".join(seen(shot, prompts.CAMERA_OR_LENS)) or lens
        brief.append(f'  <shot index="{n}"' + (f' duration="{seconds}s">' if seconds is not None else ">"))
        brief += [f"    [Camera: {cam}]"] if cam is not None else []
        brief += [f"    [Motion: {shot or 'natural subject motion'}]", f"    [Continuity: anchor={(anchor or 'initial_keyframe') if n == 1 else 'sharpest_tail_frame'}, lock=character_lock]", "  </shot>"]
        tail = shot[len(who) :].lstrip(" \t\n\r\f\v,;") if shot.startswith(who) else shot
        paste.append(f"Shot {n}: {identity}" + (f", {tail}" if tail else "") + (f" ({seconds}s)" if seconds is not None else "") + (f" [Conditioning Image: {anchor}]" if anchor is not None else ""))
    return "\n".join([*brief, "</video_brief>", *paste]).rstrip()


def test_compiled_equals_the_plain_version(spark):
    rows = [(t, s, a) for k, t in enumerate(texts()) for s, a in [((None, 5)[k % 2], (None, "", "k.png")[k % 3])]]
    clean = prompts.strip_fillers(F.col("t"))
    df = spark.createDataFrame(rows, "t string, seconds int, anchor string").withColumn("clean", clean).withColumn("cut", prompts.shots(F.col("clean")))
    parts = df.select("t", "seconds", "anchor", "clean", prompts.subject(F.col("cut")).alias("subject"), F.transform("cut", prompts.condense).alias("shots"), prompts.compiled(F.col("t"), F.col("seconds"), F.col("anchor")).alias("got"), prompts.compiled(F.col("t")).alias("bare"))
    for r in parts.collect():
        assert r["got"] == (None if r["t"] is None else assemble(r, r["seconds"], r["anchor"])), r["t"]
        assert r["bare"] == (None if r["t"] is None else assemble(r, None, None)), r["t"]


def test_compiling_keeps_no_batches_in_python(spark, sf_dir):
    plan = catalogue.queries()["prompt_compile"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "conversations" in plan and "Python" not in plan
