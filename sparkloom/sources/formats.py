"""Line formats read into tables: coverage, edge lists, lock files, edges of graph files, captured version-control output."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sparkloom.functions.text import first_group


def so_far() -> WindowSpec:
    """The lines of a document up to each line."""
    return Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)



def coverage(lines: DataFrame) -> DataFrame:
    """(doc, file, found, hit, functions) of coverage records; the last value of a file counts."""
    file = F.last(first_group(F.col("line"), r"^SF:(.+)\z"), ignorenulls=True).over(so_far())
    rows = lines.withColumn("file", file).where("file is not null")
    last = lambda tag: F.max_by(first_group(F.col("line"), rf"^{tag}:([0-9]+)\z").cast("bigint"), F.when(F.col("line").startswith(tag + ":"), F.col("line_no")))
    return rows.groupBy("doc", "file").agg(last("LF").alias("found"), last("LH").alias("hit"), F.count_if(F.col("line").rlike(r"^FN:[0-9]+,")).alias("functions"))


def dot_edges(lines: DataFrame) -> DataFrame:
    """Edges of a graph description, without those of a node to itself."""
    form = r"""^\s*"?([^"\s;\[]+)"?\s*->\s*"?([^"\s;\[]+)"?"""
    found = lines.where(F.col("line").rlike(form)).select("doc", F.regexp_extract("line", form, 1).alias("src"), F.regexp_extract("line", form, 2).alias("dst"), F.lit(1.0).alias("weight"))
    return found.where("src <> dst")


def edge_list(lines: DataFrame) -> DataFrame:
    """Edges by line, `source target [weight]`; # and // begin comments, the weight is 1 unless given."""
    form = r"^\s*(\S+)\s+(\S+)(?:\s+([0-9.]+))?\s*\z"
    plain = lines.where(~F.col("line").rlike(r"^\s*(#|//)") & F.col("line").rlike(form))
    found = plain.select("doc", F.regexp_extract("line", form, 1).alias("src"), F.regexp_extract("line", form, 2).alias("dst"), F.coalesce(first_group(F.col("line"), form, 3).try_cast("double"), F.lit(1.0)).alias("weight"))
    return found.where("src <> dst")


def go_sum(lines: DataFrame) -> DataFrame:
    """Distinct (name, version) of a Go checksum file."""
    form = r"^(\S+) (v\S+?)(?:/go\.mod)? h1:"
    return lines.where(F.col("line").rlike(form)).select("doc", F.lit("go").alias("ecosystem"), F.regexp_extract("line", form, 1).alias("name"), F.regexp_extract("line", form, 2).alias("version")).distinct()


def requirements(lines: DataFrame) -> DataFrame:
    """Pinned Python requirements."""
    form = r"^\s*([A-Za-z0-9_.\-]+)\s*==\s*([^\s;#]+)"
    return lines.where(F.col("line").rlike(form)).select("doc", F.lit("python").alias("ecosystem"), F.lower(F.regexp_extract("line", form, 1)).alias("name"), F.regexp_extract("line", form, 2).alias("version"))


def mix_lock(lines: DataFrame) -> DataFrame:
    form = r"""^\s*"([a-z0-9_]+)":\s*\{:hex,\s*:[a-z0-9_]+,\s*"([^"]+)\""""
    return lines.where(F.col("line").rlike(form)).select("doc", F.lit("elixir").alias("ecosystem"), F.regexp_extract("line", form, 1).alias("name"), F.regexp_extract("line", form, 2).alias("version"))


def nuget_lock(texts: DataFrame) -> DataFrame:
    """Distinct packages of a NuGet lock file, over its frameworks."""
    kinds = "map<string,map<string,struct<resolved:string>>>"
    rows = texts.select("doc", F.explode(F.from_json(F.get_json_object("text", "$.dependencies"), kinds)).alias("framework", "p"))
    return rows.select("doc", F.explode("p").alias("name", "v")).where("v.resolved is not null").select("doc", F.lit("dotnet").alias("ecosystem"), "name", F.col("v.resolved").alias("version")).distinct()


def json_edges(texts: DataFrame) -> DataFrame:
    """Edges of a JSON array of {source, target[, weight]}, without those of a node to itself; the weight is 1 unless given."""
    rows = texts.select("doc", F.explode(F.from_json("text", "array<struct<source:string,target:string,weight:double>>")).alias("e"))
    return rows.select("doc", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.coalesce("e.weight", F.lit(1.0)).alias("weight")).where("src <> dst")


def package_lock(texts: DataFrame) -> DataFrame:
    """Packages of an npm lock file of version 2 or 3, by their path below node_modules."""
    rows = texts.select("doc", F.explode(F.from_json(F.get_json_object("text", "$.packages"), "map<string,struct<version:string>>")).alias("path", "p")).where("path <> '' and p.version is not null")
    return rows.select("doc", F.lit("node").alias("ecosystem"), F.regexp_extract("path", r"^(?:.*/)?node_modules/(.+)\z", 1).alias("name"), F.col("p.version").alias("version"))


def toml_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, "rust", p.get("name"), p.get("version")) for doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1))) for p in tomllib.loads(text or "").get("package", [])]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["doc", "ecosystem", "name", "version"])


def cargo_lock(texts: DataFrame) -> DataFrame:
    """Packages of a Cargo lock file."""
    return texts.select(F.col("doc").cast("long").alias("doc"), "text").mapInArrow(toml_batches, "doc long, ecosystem string, name string, version string")


def git_log(lines: DataFrame) -> DataFrame:
    """Commits of lines `%H|%h|%an|%ar|%s`; the subject may hold bars."""
    parts = F.split("line", r"\|", 5)
    return lines.where(F.size(parts) == 5).select("doc", "line_no", *(F.get(parts, k).alias(n) for k, n in enumerate(("hash", "short", "author", "age", "subject"))))


def git_status(lines: DataFrame) -> DataFrame:
    """(staged, unstaged, file) of short status lines."""
    return lines.where(F.length("line") > 3).select("doc", F.substring("line", 1, 1).alias("staged"), F.substring("line", 2, 1).alias("unstaged"), F.substring("line", F.lit(4), F.length("line")).alias("file"))


def paper_source(text: Column) -> Column:
    """Where a reference to a paper points."""
    return (
        F.when(text.rlike(r"(?i)arxiv\.org/|^arxiv:|^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?\z"), "arxiv")
        .when(text.rlike(r"(?i)semanticscholar\.org"), "semantic_scholar")
        .when(text.rlike(r"(?i)ieeexplore\.ieee\.org"), "ieee")
        .when(text.rlike(r"(?i)dl\.acm\.org"), "acm")
        .when(text.rlike(r"(?i)(bio|med)rxiv\.org"), "biorxiv")
        .when(text.rlike(r"(?i)pubmed|ncbi\.nlm\.nih\.gov"), "pubmed")
        .when(text.rlike(r"(?i)doi\.org/|^10\.[0-9]{4,}/"), "doi")
        .when(text.rlike(r"(?i)\.pdf\z") & ~text.rlike(r"(?i)^https?://"), "local_pdf")
        .when(text.rlike(r"(?i)^https?://"), "url")
    )
