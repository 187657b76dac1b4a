"""Column expressions on relative paths: names, extensions, rules that skip files, language, tier."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed lists.
LOCKFILES = ["Cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "composer.lock", "Gemfile.lock", "Pipfile.lock", "flake.lock", "mix.lock", "pubspec.lock", "bun.lockb", "bun.lock", "go.sum"]
PARSED_LOCKFILES = ["Cargo.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock", "go.sum"]
MINIFIED = r"(\.min\.(js|css|mjs|cjs)|(^|\.)bundle\.(js|css)|\.map)$"
SENSITIVE = r"^\.env|\.(pem|key|keystore|p12|pfx|cert|crt)$|id_(rsa|ecdsa|ed25519|dsa)|^(credentials\.json|secrets\.json|secrets\.yaml|secrets\.yml|service-account\.json)$"
BINARY_EXTENSIONS = (
    "png jpg jpeg gif ico webp bmp tiff heic mp3 wav ogg flac mp4 mkv avi mov webm exe dll so dylib bin wasm o a lib obj "
    "zip tar gz tgz bz2 xz 7z rar zst pyc pyo class jar war ear db sqlite sqlite3 ttf otf woff woff2 eot pdf docx xlsx pptx"
).split()
LANGUAGES = {
    "rust": "rs", "toml": "toml", "yaml": "yaml yml", "json": "json", "markdown": "md markdown", "javascript": "js mjs cjs", "typescript": "ts mts cts", "tsx": "tsx", "jsx": "jsx",
    "python": "py pyi", "go": "go", "c": "c h", "cpp": "cpp hpp cc cxx", "java": "java", "kotlin": "kt kts", "scala": "scala", "swift": "swift", "ruby": "rb", "php": "php",
    "bash": "sh bash zsh", "sql": "sql", "html": "html htm", "css": "css scss sass", "lua": "lua", "zig": "zig", "csharp": "cs", "dart": "dart", "elixir": "ex exs", "gleam": "gleam",
    "nix": "nix", "vue": "vue", "svelte": "svelte", "graphql": "graphql gql", "dockerfile": "dockerfile Dockerfile", "protobuf": "proto",
}
TEST_PATH = r"^(tests?|bench(es)?|examples?)/|/(tests?|benches|examples)/"
TEST_NAME = r"(_test\.rs|_tests\.rs|_test\.go|_test\.py)$|^test_|\.test\.|\.spec\."
DOC_PATH = r"^docs?/|/docs/"
DOC_NAME = r"\.(md|markdown|txt|rst)$"
ENTRY_POINTS = ["lib.rs", "main.rs", "mod.rs", "index.ts", "index.js", "app.py", "main.go"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """Lower-case A-Z only, as the path rules do."""
    return F.translate(s, UPPER, LOWER)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parts(path: Column) -> Column:
    """Components; ordering by this array is ordering by component, unlike ordering by the string."""
    return F.split(path, "/")


def extension(path: Column) -> Column:
    """After the last dot; '' for a name without a dot or with a leading dot only."""
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)


def is_lockfile(path: Column) -> Column:
    return file_name(path).isin(LOCKFILES)


def is_svg(path: Column) -> Column:
    return ascii_lower(extension(path)) == "svg"


def is_minified(path: Column) -> Column:
    return F.regexp_like(ascii_lower(file_name(path)), F.lit(MINIFIED))


def is_sensitive(path: Column) -> Column:
    return F.regexp_like(ascii_lower(file_name(path)), F.lit(SENSITIVE))


def has_binary_extension(path: Column) -> Column:
    return ascii_lower(extension(path)).isin(BINARY_EXTENSIONS)


def is_hidden(path: Column) -> Column:
    return F.exists(parts(path), lambda p: F.startswith(p, F.lit(".")))


def depth(path: Column) -> Column:
    return F.size(parts(path))


def should_skip(path: Column, summary_locks: bool = False) -> Column:
    """Any of the five rules; with `summary_locks` lockfiles pass all of them."""
    rules = is_lockfile(path) | is_svg(path) | is_minified(path) | is_sensitive(path) | has_binary_extension(path)
    return ~is_lockfile(path) & rules if summary_locks else rules


def language_hint(path: Column) -> Column:
    """Fence language by extension, case-sensitive; '' when unknown."""
    table = F.create_map(*[F.lit(x) for lang, exts in LANGUAGES.items() for ext in exts.split() for x in (ext, lang)])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))


def compression_tier(path: Column) -> Column:
    """0 tests, 1 documents, 4 entry points, 2 configuration, 3 other sources; the first that fits, in this order."""
    low, name = ascii_lower(path), ascii_lower(file_name(path))
    return (
        F.when(F.regexp_like(low, F.lit(TEST_PATH)) | F.regexp_like(name, F.lit(TEST_NAME)), 0)
        .when(F.regexp_like(low, F.lit(DOC_PATH)) | F.regexp_like(name, F.lit(DOC_NAME)), 1)
        .when(name.isin(ENTRY_POINTS), 4)
        .when(language_hint(path).isin("json", "yaml", "toml", "dockerfile"), 2)
        .otherwise(3)
    )


def glob_regex(pattern: str) -> str:
    """Anchored Java regular expression of a glob: * and ? cross slashes, ** is a run of directories, [..] and {a,b} as usual."""
    out, at, depth = [], 0, 0
    if not pattern.strip():
        raise ValueError("empty glob")
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            end = at
            while end < len(pattern) and pattern[end] == "*":
                end += 1
            whole = end - at >= 2 and (at == 0 or pattern[at - 1] == "/") and (end == len(pattern) or pattern[end] == "/")
            if whole and end < len(pattern):  # "**/": nothing or directories
                out.append("(?:.*/)?")
                end += 1
            else:
                out.append(".*")
            at = end
            continue
        if c == "[":
            end = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] in ("!", "^")))
            if end < 0:
                raise ValueError(f"unclosed class in glob {pattern!r}")
            body = pattern[at + 1 : end]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' * negated}{body}]")
            at = end + 1
            continue
        if c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "?":
            out.append(".")
        elif c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append(re.escape(c))
        at += 1
    if depth:
        raise ValueError(f"unclosed braces in glob {pattern!r}")
    return "(?s)^" + "".join(out) + "$"


def matches_any(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    if not globs:
        return F.lit(False)
    return F.regexp_like(path, F.lit("|".join(f"(?:{glob_regex(g)})" for g in globs)))
