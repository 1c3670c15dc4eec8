"""Listings of files by rules, and the small documents that configure a run: ignore rules, module specifications, tag hierarchies, captured pages."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.shared import cut
from sparkloom.sources.files import BUILD_FOLDERS

# Parts of names of corpus files that are no documents.
NO_DOCUMENTS = ("INDEX", "symlink", "README", "references", "SKILL", "isolation-trap", "downloads-import")
#: Bytes and edges of a tag hierarchy.
HIERARCHY_BYTES, HIERARCHY_EDGES = 64 * 1024, 1000


def rule_regex(rule: str) -> str:
    """Regular expression, on a path from the root, of one ignore rule: it names a file, or a folder with all that is in it."""
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored = "/" in rule
    out = "".join({"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, t if t.startswith("[") else re.escape(t)) for t in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|.", rule.lstrip("/")))
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*" if folder else "(?:/.*)?") + "$"


def kept(files: DataFrame, rules: tuple[str, ...] = (), hidden: bool = False, skip: tuple[str, ...] = BUILD_FOLDERS) -> DataFrame:
    """Files (path from the root, ...) that ignore rules leave: the last rule that matches decides, `!` takes back, blank lines and comments say nothing. Hidden names and build folders go too."""
    steps = F.split("path", "/")
    out = files.where(~F.exists(F.slice(steps, 1, F.size(steps) - 1), lambda x: x.isin(*skip)))
    if not hidden:
        out = out.where(~F.exists(steps, lambda x: x.startswith(".")))
    gone = F.lit(False)
    for rule in (r.rstrip() for r in rules):
        if rule and not rule.startswith("#"):
            back = rule.startswith("!")
            gone = F.when(F.col("path").rlike(rule_regex(rule.lstrip("!"))), not back).otherwise(gone)
    return out.where(~gone)


def with_endings(files: DataFrame, endings: tuple[str, ...], skip: tuple[str, ...]) -> DataFrame:
    """Files (path) with one of the endings, outside of skipped folders."""
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*endings) & ~F.exists(F.split("path", "/"), lambda x: x.isin(*skip)))


def glob_regex(pattern: str) -> str:
    if pattern.startswith("/") or ".." in pattern.split("/"):
        raise ValueError(f"pattern {pattern!r} leaves the root")
    return rule_regex("/" + pattern).replace("(?:/.*)?$", "$")


def globbed(files: DataFrame, pattern: str, exclude: str | None = None, min_bytes: int = 0, max_bytes: int | None = None) -> DataFrame:
    """Files (path, bytes) that a pattern names, by size."""
    out = files.where(F.col("path").rlike(glob_regex(pattern)) & (F.col("bytes") >= min_bytes))
    out = out if max_bytes is None else out.where(F.col("bytes") <= max_bytes)
    return out.where(~F.col("path").rlike(rule_regex(exclude))) if exclude else out


def corpus_files(files: DataFrame) -> DataFrame:
    """Markdown files (path) that are documents."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.endswith(".md") & ~F.exists(F.array(*map(F.lit, NO_DOCUMENTS)), lambda p: name.contains(p)))


def skill_files(files: DataFrame, deepest: int = 10) -> DataFrame:
    """Skill files (path) down to a depth, with the first folder as their category."""
    steps = F.split("path", "/")
    return files.where((F.element_at(steps, -1) == "SKILL.md") & (F.size(steps).between(2, deepest))).withColumn("category", F.get(steps, 0))


def modules_toml(text: str) -> list[tuple[str, str, list[str], list[str], list[str]]]:
    """(name, description, seeds, include, exclude) of the [modules.name] tables of a specification, by name."""
    found = tomllib.loads(text).get("modules", {})
    return [(name, m.get("description", ""), m.get("seeds", []), m.get("include", []), m.get("exclude", [])) for name, m in sorted(found.items())]


def module_specs(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(modules_toml(text), "name string, description string, seeds array<string>, include array<string>, exclude array<string>")


def members(labels: DataFrame, specs: DataFrame) -> DataFrame:
    """(node, module) of labels (node) by specifications: a seed or an included pattern that no excluded one takes back; of several modules the last by name. Specifications are a small table by nature."""
    as_regex = lambda p: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(p, r"([.+()\[\]{}|^$\\])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    matches = lambda patterns: F.exists(patterns, lambda p: F.regexp_like("node", as_regex(p)))
    chosen = labels.join(specs, (F.array_contains("seeds", F.col("node")) | matches(F.col("include"))) & ~matches(F.col("exclude")))
    return chosen.groupBy("node").agg(F.max("name").alias("module"))


def hierarchy(text: str) -> list[tuple[str, str]]:
    """(child, parent) edges of a tag hierarchy: `parent:` with a list of children below, or items `- child: x` with `parent: y`.

    More than HIERARCHY_BYTES or HIERARCHY_EDGES and a tag that is its own parent are errors.
    """
    if len(text.encode()) > HIERARCHY_BYTES:
        raise ValueError("hierarchy is too large")
    edges: list[tuple[str, str]] = []
    parent = child = ""
    for line in text.split("\n"):
        line = line.split("#")[0].rstrip()
        if m := re.match(r"^\s*-?\s*child:\s*(\S+)$", line):
            child = m[1]
        elif (m := re.match(r"^\s*parent:\s*(\S+)$", line)) and child:
            edges.append((child, m[1]))
            child = ""
        elif m := re.match(r"^(\S+):\s*(?:\[(.*)\])?$", line):
            parent = m[1]
            edges += [(x.strip(), parent) for x in (m[2] or "").split(",") if x.strip()]
        elif (m := re.match(r"^\s+-\s*(\S+)$", line)) and parent:
            edges.append((m[1], parent))
    edges = [(a.strip("'\""), b.strip("'\"")) for a, b in edges]
    if len(edges) > HIERARCHY_EDGES:
        raise ValueError("hierarchy has too many edges")
    if any(a == b for a, b in edges):
        raise ValueError("a tag is its own parent")
    return edges


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def crawl(pages: DataFrame, links: DataFrame, starts: DataFrame, depth: int = 2, most: int = 20) -> DataFrame:
    """Captured pages (url) that a crawl of each start (url) visits: (start, url, depth), by links (url, target) of the same host, to a depth, `most` pages a start, nearer ones and then by address."""
    known = cut(pages.select("url").distinct())
    seen = cut(starts.select(F.col("url").alias("start"), "url", F.lit(0).alias("depth")).join(known, "url", "left_semi").select("start", "url", "depth"))
    frontier = seen
    for step in range(1, depth + 1):
        ahead = frontier.join(links, "url").where(host(F.col("target")) == host(F.col("start"))).select("start", F.col("target").alias("url")).distinct()
        frontier = cut(ahead.join(known, "url", "left_semi").join(seen, ["start", "url"], "left_anti").select("start", "url", F.lit(step).alias("depth")))
        seen = cut(seen.unionByName(frontier))
    rank = F.row_number().over(Window.partitionBy("start").orderBy("depth", "url"))
    return seen.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def search_results(answers: DataFrame, limit: int) -> DataFrame:
    """Results (query, place, title, url) of JSON answers (query, body) of a search service, in order, 1 to 50 of them."""
    rows = F.from_json("body", "results array<struct<title:string,url:string,content:string>>")["results"]
    listed = answers.select("query", F.posexplode(F.slice(rows, 1, max(1, min(50, limit)))).alias("place", "r"))
    return listed.select("query", "place", "r.title", "r.url")
