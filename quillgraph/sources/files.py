"""File listings as sources: discovery, ignore rules, text and log readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X

# Path segments that are never read.
IGNORED = (".git", "bin", "obj", ".vs", ".idea", "node_modules", "testresults")
CONFIG_NAMES = ("global.json", ".editorconfig")
IGNORED_TS = (*IGNORED, "dist", "build", "coverage", ".next")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, bytes) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cut = len(root.rstrip("/")) + 1
    path = F.regexp_replace(F.col("path"), r"^file:(//)?", "")
    return files.select(F.substring(path, cut + 1, 1 << 20).alias("relative_path"), F.col("length").alias("bytes"))


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(relative_path, text): whole files."""
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:(//)?", "")
    return read.select(F.substring(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), len(root.rstrip("/")) + 2, 1 << 20).alias("relative_path"), F.col("value").alias("text"))


def ignored_segment(path: Column, segments=IGNORED) -> Column:
    return F.exists(F.split(F.lower(path), "/"), lambda s: s.isin(*segments))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ``**/`` any folders, ``*`` and ``?`` within
    one segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def ignore_predicate(path: Column, rules: list[str]) -> Column:
    """Rules of a root ignore file: later ones win, ``!`` takes back, a trailing
    slash is a folder, a slash inside anchors at the root."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        folder = rule.endswith("/")
        bare = rule.strip("/")
        head = "^" if "/" in rule.rstrip("/") else "^(?:.*/)?"
        hit = path.rlike(head + glob_regex(bare)[1:-1] + ("/.*$" if folder else "(?:/.*)?$"))
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out


def discover(files: DataFrame, globs: list[str], rules: list[str] = ()) -> DataFrame:
    """Allowed files: by glob, not ignored, one row a path, the least one where a
    path repeats; sort by ``relative_path`` where the order matters."""
    path = X.normal_path(F.col("relative_path"))
    kept = files.withColumn("relative_path", path).filter(~ignored_segment(path) & ~ignore_predicate(path, list(rules)))
    if globs:
        kept = kept.filter(path.rlike("|".join(glob_regex(g) for g in globs)))
    rest = [c for c in kept.columns if c != "relative_path"]
    if not rest:
        return kept.distinct()
    return kept.groupBy("relative_path").agg(F.min(F.struct(*rest)).alias("_r")).select("relative_path", *[F.col("_r")[c].alias(c) for c in rest])


def is_typescript(path: Column) -> Column:
    """A source file outside the folders that hold built ones."""
    return X.extension(path).isin(".ts", ".tsx") & ~ignored_segment(path, IGNORED_TS)


def is_project(path: Column) -> Column:
    """A C# solution or project."""
    return X.extension(path).isin(*X.PROJECT)


def is_project_config(path: Column) -> Column:
    """A file that changes how C# projects are built."""
    return is_project(path) | X.extension(path).isin(".props", ".targets") | F.lower(X.file_name(path)).isin(*CONFIG_NAMES)


def sources(files: DataFrame) -> DataFrame:
    """Candidates in a listing: (kind, path): project files, tsconfig files and
    one glob for each folder that holds Markdown."""
    path = F.col("relative_path")
    ext, name = X.extension(path), X.file_name(path)
    kept = files.filter(~ignored_segment(path))
    projects = kept.filter(ext.isin(*X.PROJECT)).select(F.lit("CSharp").alias("kind"), path.alias("path"))
    scripts = kept.filter(name.rlike(r"^tsconfig.*\.json$")).select(F.lit("TypeScript").alias("kind"), path.alias("path"))
    folders = kept.filter(ext.isin(*X.MARKDOWN)).select(F.lit("Markdown").alias("kind"), F.concat_ws("/", F.nullif(X.parent_path(path), F.lit("")), F.lit("*.md")).alias("path")).distinct()
    return projects.unionByName(scripts).unionByName(folders)
