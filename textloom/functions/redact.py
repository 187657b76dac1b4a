"""Redaction of inline secrets with one regular expression, left to right in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns. A PEM key stands anywhere (its header alone if the footer is missing); tokens only start after a character that can't belong to one.
PEM = r"-----BEGIN [^\S\n]*(?:[A-Z0-9](?:[A-Z0-9 ]{0,30}[A-Z0-9])?)?[^\S\n]*PRIVATE KEY-----(?:[\s\S]*?-----END [^\n]*?PRIVATE KEY-----)?"
VENDOR_KEY = r"sk-(?:ant-(?=(?:[_-]*[A-Za-z0-9]){16})[A-Za-z0-9_-]{20,}|(?:proj-|(?!ant-|proj-))(?=(?:[_-]*[A-Za-z0-9]){20})[A-Za-z0-9_-]{20,})"
FORGE_TOKEN = r"(?:github_pat_|gh[pousr]_)[A-Za-z0-9_]{20,}"
CLOUD_KEY = r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9_])"
SECRET = rf"(?U){PEM}|(?<![A-Za-z0-9_-])(?:{VENDOR_KEY}|{FORGE_TOKEN}|{CLOUD_KEY})"
MASK = "[REDACTED_SECRET]"
#: A text without any of these can't hold a secret; the cheap test keeps the expression off most rows.
HINTS = ("-----BEGIN", "sk-", "github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA")


def _may_hold(text: Column) -> Column:
    found = F.contains(text, F.lit(HINTS[0]))
    for hint in HINTS[1:]:
        found = found | F.contains(text, F.lit(hint))
    return found


def redact_secrets(text: Column) -> Column:
    return F.when(_may_hold(text), F.regexp_replace(text, SECRET, MASK)).otherwise(text)


def count_secrets(text: Column) -> Column:
    return F.when(_may_hold(text), F.regexp_count(text, F.lit(SECRET))).otherwise(F.when(text.isNotNull(), 0))
