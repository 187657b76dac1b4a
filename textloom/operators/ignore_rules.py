"""Ignore rules as a relation: for any table of files, wherever it comes from.

A file and each folder above it is a node; a rule holds below the folder that its file stands in. Nodes
meet rules by equality of (repository, folder), after exploding each node's folders, and the rule that
ranks highest decides: kind of ignore file, then depth of the folder, then line. A file goes if it or any
folder above it is ignored, so a rule that takes a file back can't bring it back into an ignored folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..sources.ignore import GIT, OWN, PLAIN, pattern_of
from ..staging import SMALL
from .order import same_keys
from .tree import prefixes

NAMES = {".gitignore": GIT, ".ignore": PLAIN, ".packignore": OWN}


@F.pandas_udf(T.ArrayType(T.StructType().add("line_no", "integer").add("regex", "string").add("negated", "boolean").add("folders", "boolean")))
def _patterns(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The patterns of ignore files: a small reader for lines, of which there are few."""
    for series in contents:
        yield pd.Series([[{"line_no": k, **p._asdict()} for k, line in enumerate((text or "").splitlines()) if (p := pattern_of(line))] for text in series])


def rules_of(files: DataFrame, names: dict[str, int] | None = None, repo: str = "repo_id") -> DataFrame:
    """(repo, folder, kind, line_no, regex, negated, folders) of the ignore files in a FILE relation, a row per pattern.

    `names` are the ignore files' names and kinds. `folder` is an array of components, empty for the top.
    """
    kinds = names or NAMES
    name = F.element_at("path_parts", -1)
    kind = F.coalesce(*[F.when(name == n, F.lit(k)) for n, k in kinds.items()])
    own = files.withColumn("kind", kind).filter("kind IS NOT NULL")
    made = own.select(repo, F.slice("path_parts", 1, F.size("path_parts") - 1).alias("folder"), "kind", F.explode(_patterns(F.col("content"))).alias("p"))
    return made.select(repo, "folder", "kind", "p.line_no", "p.regex", "p.negated", "p.folders")


def _fits(rule: Column, rest: Column) -> Column:
    """Plain names and endings are compared; only what is left is a pattern to be compiled."""
    return F.when(rule["literal"].isNotNull(), F.element_at(F.split(rest, "/"), -1) == rule["literal"]).when(rule["suffix"].isNotNull(), F.endswith(rest, rule["suffix"])).otherwise(F.regexp_like(rest, F.concat(F.lit("(?s)^(?:"), rule["regex"], F.lit(r")\z"))))


def verdicts(files: DataFrame, rules: DataFrame, repo: str = "repo_id") -> DataFrame:
    """(repo, node, ignored): files and folders that a rule fits, with the deciding rule's word; `files` needs repo and path_parts.

    A folder's rules travel as one array. Folders near the top have many nodes; they are split by the adaptive planner's skew join where
    the rules are too many to be broadcast.
    """
    word = r"[A-Za-z0-9_]|\\[ -]"
    literal = F.regexp_extract("regex", rf"^\(\?:\.\*/\)\?((?:{word}|\\\.)+)$", 1)
    suffix = F.regexp_extract("regex", rf"^\(\?:\.\*/\)\?\[\^/\]\*((?:{word}|\\\.)+)$", 1)
    bare = lambda c: F.nullif(F.regexp_replace(c, r"\\(.)", "$1"), F.lit(""))
    own = rules.select(repo, "folder", F.struct("kind", "line_no", "negated", "folders", bare(literal).alias("literal"), bare(suffix).alias("suffix"), "regex").alias("rule"))
    held = own.groupBy(repo, "folder").agg(F.collect_list("rule").alias("rules"))
    held = F.broadcast(held) if rules.limit(SMALL + 1).count() <= SMALL else held
    nodes = files.select(repo, F.col("path_parts").alias("file"), F.explode(prefixes(F.col("path_parts"))).alias("node")).groupBy(repo, "node").agg(F.bool_and(F.col("node") != F.col("file")).alias("is_folder"))
    above = F.transform(F.sequence(F.lit(0), F.size("node") - 1), lambda k: F.slice("node", 1, k))
    met = same_keys(nodes.select(repo, "node", "is_folder", F.explode(above).alias("folder")), held, [repo, "folder"])
    rest = F.array_join(F.slice("node", F.size("folder") + 1, F.size("node")), "/")
    fit = F.filter("rules", lambda r: (F.col("is_folder") | ~r["folders"]) & _fits(r, F.col("rest")))
    ranked = F.transform(fit, lambda r: F.struct(r["kind"].alias("kind"), F.size("folder").alias("depth"), r["line_no"].alias("line_no"), r["negated"].alias("negated")))
    last = met.withColumn("rest", rest).select(repo, "node", F.array_max(ranked).alias("last")).filter("last IS NOT NULL")
    return last.groupBy(repo, "node").agg((~F.max("last")["negated"]).alias("ignored"))


def kept_by_rules(files: DataFrame, rules: DataFrame, repo: str = "repo_id") -> DataFrame:
    """The files that no rule ignores, themselves or by a folder above them. Rows that repeat a path are decided alike; a missing repository is one."""
    gone = verdicts(files, rules, repo).filter("ignored").select(repo, "node")
    hit = same_keys(files.select(repo, "path_parts", F.explode(prefixes(F.col("path_parts"))).alias("node")), gone, [repo, "node"], "left_semi").select(repo, "path_parts").distinct()
    return same_keys(files, hit, [repo, "path_parts"], "left_anti")
