"""Document, routing and project queries on texts made from parts and conversations, with SQL for what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import documents as D
from sparkloom.operators import routing as R
from sparkloom.plans.sources import texts

MARKDOWN = """CASE WHEN p_partkey % 3 = 0 THEN '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'no title' ELSE '# ' || p_name END || chr(10) || '**Author:** A' || p_size || chr(10) || '**Year:** ' || (1990 + p_size)
 || chr(10) || '## First' || chr(10) || 'text ' || p_brand || chr(10) || '## ' || CASE WHEN p_size % 2 = 0 THEN 'The Core Thesis' ELSE 'Other' END || chr(10) || 'more ' || p_partkey || chr(10) || '## Last'"""
COMMAND = """CASE p_partkey % 10 WHEN 0 THEN 'cd x && cargo test --release 2>&1' WHEN 1 THEN 'git commit -m "fix cargo test"' WHEN 2 THEN 'cargo test | grep FAIL' WHEN 3 THEN 'cargo test --no-run' WHEN 4 THEN 'ruff check .; git diff HEAD'
 WHEN 5 THEN 'cargo clippy' WHEN 6 THEN 'elixir run the test' WHEN 7 THEN 'pytest -k "a | grep"' WHEN 8 THEN 'echo ''make''' ELSE 'ls' END"""
ROUTE = "CASE p_partkey % 10 WHEN 0 THEN 'test-summary' WHEN 4 THEN 'diff-filter' WHEN 5 THEN 'lint-dedup' WHEN 6 THEN 'test-summary' WHEN 7 THEN 'log-distill' ELSE 'log-distill' END"
NAME = "CASE WHEN p_partkey % 2 = 0 THEN 'Last' || p_size || ', First' ELSE ' Plain Name ' END"
DESCRIPTION = "CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'Max 60 words please' WHEN 2 THEN 'a' || chr(9) || chr(10) || ' b' || chr(7) || 'c  d' ELSE repeat('w ', p_size) END"
FACTS = "CASE p_partkey % 3 WHEN 0 THEN 'In ' || (1950 + p_size) || ' see 10.1234/abc.' || p_size WHEN 1 THEN 'arXiv: 2101.0' || (1000 + p_size) ELSE 'x' END"
FILES = "CASE p_partkey % 9 WHEN 0 THEN 'Cargo.toml' WHEN 1 THEN 'setup.py' WHEN 2 THEN 'package.json' WHEN 3 THEN 'tsconfig.json' WHEN 4 THEN 'go.mod' ELSE 'readme' END"


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return D.body(texts(spark, sf, MARKDOWN))


def rows(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return texts(spark, sf, text)


def edge_chunks(items: DataFrame) -> DataFrame:
    """Edges of line items by chunk; every end that occurs is placed."""
    edges = items.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst")).distinct()
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return D.edge_chunks(edges, ids.select("id", (F.col("id") % 7).alias("chunk")))


QUERIES = {
    "k8_metadata": lambda s, d: D.metadata(markdown(s, d)),
    "k8_sections": lambda s, d: D.sections(markdown(s, d)),
    "k8_summary": lambda s, d: D.summary(D.sections(markdown(s, d))),
    "k8_chain": lambda s, d: D.chain(D.sections(markdown(s, d))).groupBy("edge_type", "src", "dst").agg(F.count("*").alias("n")),
    "k13_mentions": lambda s, d: D.mentions(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), F.lit(1).alias("pos"), F.col("text").alias("content")), s.createDataFrame([("that",), ("erst",), ("with",), ("the",)], "name string")).groupBy("name").agg(F.count("*").alias("n")),
    "b22_descriptions": lambda s, d: rows(s, d, DESCRIPTION).select("doc", D.description(F.col("text"), 20).alias("text")),
    "u8_authors": lambda s, d: rows(s, d, NAME).select("doc", D.author(F.col("text")).alias("name")),
    "k7_paper_facts": lambda s, d: rows(s, d, FACTS).select("doc", *(v.alias(k) for k, v in D.paper_facts(F.col("text")).items())),
    "k9_chunks": lambda s, d: D.chunks(s.read.parquet(f"{d}/orders.parquet").select(F.floor(F.col("o_orderkey") / 1000).alias("batch"), F.col("o_orderkey").alias("pos"), F.floor(F.col("o_totalprice")).alias("bytes"))).groupBy("batch", "chunk").agg(F.count("*").alias("n")),
    "k9_edge_chunks": lambda s, d: edge_chunks(s.read.parquet(f"{d}/lineitem.parquet")),
    "k21_remapped": lambda s, d: D.remapped(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(), s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 100000).alias("new")).where("old % 2 = 0")),
    "a27_routes": lambda s, d: rows(s, d, COMMAND).select("doc", R.route(F.col("text")).alias("filter")),
    "c13_languages": lambda s, d: R.languages(s.read.parquet(f"{d}/part.parquet").selectExpr("p_size AS project", f"{FILES} AS name")),
}

SECTIONS = "SELECT p_partkey AS doc, 1 AS pos, 'First' AS heading, 'text ' || p_brand AS content FROM part UNION ALL SELECT p_partkey, 2, CASE WHEN p_size % 2 = 0 THEN 'The Core Thesis' ELSE 'Other' END, 'more ' || p_partkey FROM part UNION ALL SELECT p_partkey, 3, 'Last', '' FROM part"
SUITE = "(SELECT p_size AS project, p_partkey % 9 AS k FROM part)"

ORACLES = {
    "k8_metadata": "SELECT p_partkey AS doc, p_name AS title, 'A' || p_size AS author, CAST(1990 + p_size AS VARCHAR) AS year, '' AS publisher FROM part WHERE p_partkey % 7 <> 0",
    "k8_sections": SECTIONS,
    "k8_summary": f"SELECT doc, arg_min(heading, r) AS heading, arg_min(content, r) AS content FROM (SELECT *, pos + CASE WHEN heading = 'The Core Thesis' THEN 0 ELSE 10 END AS r FROM ({SECTIONS})) GROUP BY doc",
    "k8_chain": "SELECT 'contains' AS edge_type, 0 AS src, pos AS dst, (SELECT count(*) FROM part) AS n FROM (VALUES (1), (2), (3)) t(pos) UNION ALL SELECT 'related_to', pos, pos + 1, (SELECT count(*) FROM part) FROM (VALUES (1), (2)) t(pos)",
    "k13_mentions": "SELECT name, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS name FROM documents) WHERE name IN ('that', 'erst', 'with') GROUP BY name",
    "b22_descriptions": "SELECT p_partkey AS doc, CASE p_partkey % 4 WHEN 2 THEN 'a bc d' WHEN 3 THEN rtrim(repeat('w ', least(20, p_size))) END AS text FROM part",
    "u8_authors": "SELECT p_partkey AS doc, CASE WHEN p_partkey % 2 = 0 THEN 'First Last' || p_size ELSE 'Plain Name' END AS name FROM part",
    "k7_paper_facts": "SELECT p_partkey AS doc, CASE WHEN p_partkey % 3 = 0 THEN 1950 + p_size END AS year, CASE WHEN p_partkey % 3 = 0 THEN '10.1234/abc.' || p_size END AS doi, CASE WHEN p_partkey % 3 = 1 THEN '2101.0' || (1000 + p_size) END AS arxiv FROM part",
    "k9_edge_chunks": "SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst, greatest(l_suppkey % 7, l_partkey % 100 % 7) AS chunk FROM lineitem",
    "k21_remapped": "SELECT CASE WHEN src % 2 = 0 AND src IN (SELECT p_partkey FROM part) THEN src + 100000 ELSE src END AS src, CASE WHEN dst % 2 = 0 AND dst IN (SELECT p_partkey FROM part) THEN dst + 100000 ELSE dst END AS dst FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)",
    "a27_routes": f"SELECT p_partkey AS doc, {ROUTE.replace(chr(39) + 'log-distill' + chr(39) + ' ELSE', chr(39) + 'test-summary' + chr(39) + ' ELSE')} AS filter FROM part",
    "c13_languages": f"""SELECT project, list_sort(list(DISTINCT l)) AS languages, coalesce(list_sort(list(DISTINCT b) FILTER (b IS NOT NULL)), []) AS builds, coalesce(list_sort(list(DISTINCT r) FILTER (r IS NOT NULL)), []) AS runners FROM (
        SELECT project, CASE k WHEN 0 THEN 'Rust' WHEN 1 THEN 'Python' WHEN 2 THEN CASE WHEN EXISTS (SELECT 1 FROM {SUITE} y WHERE y.project = x.project AND y.k = 3) THEN 'TypeScript' ELSE 'JavaScript' END WHEN 3 THEN 'TypeScript' ELSE 'Go' END AS l,
        CASE k WHEN 0 THEN 'Cargo' WHEN 2 THEN 'npm/yarn' WHEN 3 THEN 'npm/yarn' END AS b, CASE k WHEN 0 THEN 'cargo test' WHEN 4 THEN 'go test' END AS r FROM {SUITE} x WHERE k < 5) GROUP BY project""",
}
