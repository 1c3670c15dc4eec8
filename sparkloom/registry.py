"""All queries of the engine by name, with the SQL that states their results."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import explode_lines
from sparkloom.operators import logs

FAMILIES = ("usage", "logs", "scan", "graph", "web", "texts", "sources", "streams", "code", "documents", "misc", "diagrams", "extract", "collected", "workspaces")
QUERIES: dict = {}
ORACLES: dict = {}
for _name in FAMILIES:
    _family = import_module(f"sparkloom.plans.{_name}")
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents of each language hold: lines that repeat in a document, and hits of three rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "lang", "text")
    repeated = logs.repeated(explode_lines(docs, "doc"), 2).join(docs.select("doc", "lang"), "doc").select("lang", F.lit("repeated_line").alias("rule"), "n")
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "address": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "assignment": r"(?i)(token|secret|password)\s*[:=]"}
    counts = F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*(F.regexp_count("text", F.lit(p)) for p in rules.values())))
    hits = docs.select("lang", F.explode(counts).alias("rule", "n")).where("n > 0")
    return repeated.unionByName(hits).groupBy("lang", "rule").agg(F.count("*").alias("documents"), F.sum("n").alias("hits"))
