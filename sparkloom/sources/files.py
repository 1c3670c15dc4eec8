"""Files as rows: walks, globs, single reads with hash, and a binary sniff. Contents are read last, after metadata filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold what builds make, and those that dependency trees leave out.
BUILD_FOLDERS = ("target", "node_modules", "dist", "build", "out", "_build", "__pycache__", "venv")
SKIPPED_FOLDERS = ("_build", "deps", "node_modules", ".git", "target", "vendor", "__pycache__", ".venv")
#: Bytes from which only the hash of a file is kept.
CAP = 128 * 1024


def walk(spark: SparkSession, root: str, pattern: str = "*", skip: tuple[str, ...] = BUILD_FOLDERS) -> DataFrame:
    """(path, length, modificationTime, content) of files below `root` whose names match, without those below skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.where(~F.exists(F.split("path", "/"), lambda x: x.isin(*skip)))


def glob(spark: SparkSession, root: str, pattern: str, exclude: str | None = None, min_bytes: int = 0, max_bytes: int | None = None, needle: str | None = None) -> DataFrame:
    """Statistics of files that a pattern below `root` names: bytes, lines, and hits of a string.

    The part of the pattern before its first wildcard is the folder that is listed. Absolute patterns and those that leave
    the root are refused.
    """
    if pattern.startswith("/") or ".." in pattern.split("/"):
        raise ValueError(f"pattern {pattern!r} leaves the root")
    steps = pattern.split("/")
    fixed = next((k for k, s in enumerate(steps[:-1]) if set(s) & set("*?[")), len(steps) - 1)
    files = walk(spark, "/".join([root, *steps[:fixed]]), steps[-1])
    if exclude:
        files = files.where(~F.col("path").like(exclude.replace("*", "%")))
    files = files.where(F.col("length") >= min_bytes)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    text = F.decode("content", "UTF-8")
    hits = F.lit(0) if needle is None else ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")
    return files.where(~is_binary(F.col("content"))).select("path", "length", n_lines(text).alias("lines"), hits.alias("hits"))


def is_binary(content: Column) -> Column:
    """Whether there is a zero byte among the first 1024."""
    return F.locate("\0", F.decode(F.substring(content, 1, 1024), "ISO-8859-1")) > 0


def n_lines(text: Column) -> Column:
    """Lines, the last one whether it ends or not; none in an empty text."""
    feeds = F.length(text) - F.length(F.translate(text, "\n", ""))
    return feeds + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)


def buffers(files: DataFrame, cap: int = CAP) -> DataFrame:
    """(path, bytes, sha256, text, truncated, lines): files over the cap keep only their hash."""
    large = F.col("length") > cap
    text = F.decode("content", "UTF-8")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(~large, text).alias("text"), large.alias("truncated"), F.when(~large, n_lines(text)).alias("lines"))
