"""Command line: `python -m textloom.cli [PATH] ...` packs a source tree."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .functions import prompts
from .functions.text import parse_budget, parse_size
from .operators import format as shape
from .operators.parts import write_parts
from .plans.pack import changed_files, packed_files, tree_files
from .schema import PackOptions, format_name, profile_name
from .session import session
from .sources.video import anchor
from .staging import clear


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-f", "--format", default="xml", type=format_name)
    p.add_argument("-o", "--output")
    p.add_argument("--parts", help="a new folder for part files and their manifest, for packs of any size")
    p.add_argument("-t", "--tokens", action="store_true")
    p.add_argument("-p", "--token-profile", default="cl100k", type=profile_name)
    p.add_argument("--max-file-size", type=parse_size, default=1 << 20)
    p.add_argument("-d", "--max-depth", type=int)
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("--no-packignore", action="store_true", help="don't read .packignore files")
    p.add_argument("--include-hidden", action="store_true")
    p.add_argument("--threads", type=int, help="cores of a session that this call starts; default: all")
    p.add_argument("-v", "--verbose", action="store_true", help="show the session's messages and the options")
    p.add_argument("-e", "--exclude", action="append", default=[])
    p.add_argument("-I", "--include", action="append", default=[])
    p.add_argument("--outline", action="store_true")
    p.add_argument("--summary-locks", action="store_true")
    p.add_argument("-m", "--modified", action="store_true")
    p.add_argument("--staged", action="store_true")
    p.add_argument("--budget", "--max-tokens", type=parse_budget)
    p.add_argument("--redact-secrets", action="store_true")
    p.add_argument("--video-prompt")
    p.add_argument("--shot-duration", type=int)
    p.add_argument("--video-anchor", help="a video whose sharpest tail frame becomes the conditioning image")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def options_of(a: argparse.Namespace) -> PackOptions:
    return PackOptions(a.format, a.max_file_size, a.max_depth, a.include_hidden, tuple(a.include), tuple(a.exclude), a.outline, a.summary_locks, a.redact_secrets, a.tokens, a.token_profile, a.budget)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.video_anchor is not None:
        args.video_anchor, idx, score = anchor(args.video_anchor)
        if args.video_prompt is None:
            print(f"{args.video_anchor} (frame #{idx}, sharpness={score:.2f})")
            return 0
    spark = session("textloom-cli", master=f"local[{args.threads or '*'}]" if args.threads else None)
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    if args.video_prompt is not None:
        row = spark.createDataFrame([(args.video_prompt, args.shot_duration, args.video_anchor)], "text string, seconds int, anchor string")
        text = row.select(prompts.compiled(F.col("text"), F.col("seconds"), F.col("anchor"))).first()[0] + "\n"
        stats = None
    else:
        options = options_of(args)
        if args.verbose:
            print(options, file=sys.stderr)
        changed = changed_files(spark, args.path, args.staged) if args.modified or args.staged else None
        kept = packed_files(tree_files(spark, args.path, options, ignore_file="" if args.no_packignore else ".packignore", gitignore=not args.no_gitignore, changed=changed), options)
        # the files are counted on their way into the text
        seen = Observation("pack")
        kept = kept.observe(seen, F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.sum("token_count").alias("total_tokens"))
        if args.parts:
            found = write_parts(kept, args.parts, args.format).head()
        else:
            found = shape.documents(kept, args.format).select("document").head()
        if found is None:
            print("no files left to pack", file=sys.stderr)
            return 0
        text = None if args.parts else found[0]
        counted = spark.createDataFrame([tuple(seen.get[c] for c in ("file_count", "total_bytes", "total_tokens"))], "n long, size long, tokens long")
        stats = counted.select(shape.stats_line(F.col("n"), F.col("size"), F.col("tokens"))).first()[0]
    if text is None:
        pass
    elif args.output:
        with open(args.output, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        sys.stdout.write(text)
    if stats and not args.quiet:
        print(stats, file=sys.stderr)
    clear(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
