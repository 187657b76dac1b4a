"""Relations of the engine and the token profile dimension."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: One row per file; path_parts is the ordering key wherever order is visible.
FILE = "repo_id string, path string, path_parts array<string>, size_bytes bigint, content string, token_count bigint, is_outlined boolean"
NODE = "repo_id string, node array<string>, depth int, is_file boolean, files bigint, tokens bigint, bytes bigint"
DEPENDENCIES = T.ArrayType(T.StructType().add("name", "string").add("version", "string"))

# Profile, encoding, factor on the encoding's count, context window, display name.
PROFILES = [
    ("cl100k", "cl100k_base", 1.0, 128_000, "GPT-4 Turbo"),
    ("o200k", "o200k_base", 1.0, 200_000, "GPT-4o / o1 / o3"),
    ("claude", "cl100k_base", 1.08, 200_000, "Claude 3.7 / 3.5 Sonnet"),
    ("deepseek", "o200k_base", 1.02, 128_000, "DeepSeek V3 / R1"),
    ("gemini", "o200k_base", 1.05, 1_000_000, "Gemini 3 / 2.5 (1M)"),
    ("fable", "cl100k_base", 1.08, 1_000_000, "Claude Fable 5.1 (1M)"),
    ("luna", "o200k_base", 1.0, 1_050_000, "GPT-6 Luna (1.05M)"),
    ("llama", "o200k_base", 1.0, 128_000, "Llama 4 / 3.3 (128k)"),
]
# Other names of the profiles.
PROFILE_ALIASES = {
    "cl100k": ("cl100k", "cl100k_base", "gpt4", "gpt-4"),
    "o200k": ("o200k", "o200k_base", "gpt4o", "gpt-4o", "o1", "o3", "o3-mini"),
    "claude": ("claude", "claude37", "claude-3.7", "claude35", "claude-3.5", "anthropic"),
    "fable": ("fable", "fable5", "fable-5", "fable51", "claude-fable", "mythos"),
    "luna": ("luna", "gpt-luna", "gpt6", "gpt-6", "gpt6-luna", "gpt5-luna", "sol", "terra"),
    "deepseek": ("deepseek", "r1", "v3", "deepseek-r1", "deepseek-v3"),
    "gemini": ("gemini", "gemini3", "gemini-3", "gemini-3.8", "gemini38", "gemini2", "gemini-2.0", "gemini-2.5", "google"),
    "llama": ("llama", "llama4", "llama-4", "llama3", "llama-3", "meta"),
}
FORMAT_ALIASES = {"xml": ("xml",), "markdown": ("markdown", "md"), "tool-call": ("tool-call", "toolcall", "tool", "tools", "json")}


def _named(name: str, aliases: dict[str, tuple[str, ...]], what: str) -> str:
    for key, names in aliases.items():
        if name.lower() in names:
            return key
    raise ValueError(f"unknown {what} {name!r}; known: {', '.join(aliases)}")


def profile_name(name: str) -> str:
    return _named(name, PROFILE_ALIASES, "token profile")


def format_name(name: str) -> str:
    return _named(name, FORMAT_ALIASES, "format")


def profile(name: str) -> tuple[str, str, float, int, str]:
    key = profile_name(name)
    return next(p for p in PROFILES if p[0] == key)


def profiles(spark: SparkSession) -> DataFrame:
    """The eight profiles as a table; fixed, so it may always be broadcast."""
    return spark.createDataFrame(PROFILES, "profile string, encoding string, factor double, context_window bigint, display_name string")


@dataclass(frozen=True)
class PackOptions:
    """Parameters of a pack; defaults keep every file of at most 1 MiB that no rule skips."""

    format: str = "xml"
    max_file_size: int | None = 1 << 20
    max_depth: int | None = None
    include_hidden: bool = False
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())
    outline: bool = False
    summary_locks: bool = False
    redact_secrets: bool = False
    count_tokens: bool = False
    token_profile: str = "cl100k"
    budget: int | None = None
    #: Makes a counting function in a Python worker (see tokens.counted); None counts by the estimate.
    encoder: Callable[[], Callable[[str], int]] | None = None
