"""Source queries: documents as files, and line formats written from parts; the SQL states what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.shared import spread
from sparkloom.sources import files as S
from sparkloom.sources import formats as R


def part(spark: SparkSession, sf: str, line: str) -> DataFrame:
    """Lines (doc, line_no, line) of parts; 20 make a document."""
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr("CAST(floor(p_partkey / 20) AS BIGINT) AS doc", "p_partkey AS line_no", f"{line} AS line")


def contents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))


COVERAGE = "CASE p_partkey % 5 WHEN 0 THEN 'SF:src/f' || p_size % 3 || '.rs' WHEN 1 THEN 'FN:' || p_partkey || ',go' WHEN 2 THEN 'LF:' || p_size WHEN 3 THEN 'LH:' || (p_size % 7) ELSE 'end_of_record' END"
DOT = "CASE p_partkey % 4 WHEN 0 THEN '  \"a' || p_size || '\" -> \"b' || (p_partkey % 9) || '\";' WHEN 1 THEN 'a' || p_size || ' -> a' || p_size WHEN 2 THEN 'digraph {' ELSE 'x' || p_size || '->y [w=1]' END"
EDGES = "CASE p_partkey % 4 WHEN 0 THEN 'a' || p_size || ' b' || p_partkey WHEN 1 THEN 'a' || p_size || ' c ' || p_size || '.5' WHEN 2 THEN '# a b' ELSE 'z z' END"
GO = "CASE p_partkey % 3 WHEN 0 THEN 'example.com/m' || p_size || ' v1.' || (p_partkey % 4) || '.0 h1:x=' WHEN 1 THEN 'example.com/m' || p_size || ' v1.' || (p_partkey % 4) || '.0/go.mod h1:y=' ELSE 'nothing' END"
PIP = "CASE p_partkey % 3 WHEN 0 THEN 'Pkg_' || p_size || '==1.' || p_partkey WHEN 1 THEN 'other>=' || p_size ELSE '  x.y == 2.0 ; python_version' END"
LOG = "sha1(CAST(p_partkey AS STRING)) || '|' || p_partkey || '|A B|2 days ago|fix | ' || p_name"
STATUS = "CASE p_partkey % 3 WHEN 0 THEN 'M  src/' WHEN 1 THEN '?? new/' ELSE ' D old/' END || p_partkey"
LOCK = "'{\"packages\": {\"\": {\"name\": \"root\"}, \"node_modules/a' || p_partkey || '\": {\"version\": \"1.' || p_size || '.0\"}, \"node_modules/b/node_modules/@s/c\": {\"version\": \"2.0.0\"}}}'"
CARGO = "'version = 3' || chr(10) || '[[package]]' || chr(10) || 'name = \"p' || p_partkey || '\"' || chr(10) || 'version = \"0.' || p_size || '.1\"'"
PAPER = "CASE p_partkey % 8 WHEN 0 THEN 'https://arxiv.org/abs/1' WHEN 1 THEN '2301.12345' WHEN 2 THEN '10.1000/xyz' WHEN 3 THEN 'https://doi.org/10.1/x' WHEN 4 THEN 'papers/a.pdf' WHEN 5 THEN 'https://x.org/a' WHEN 6 THEN 'https://dl.acm.org/doi/1' ELSE 'nothing' END"


def texts(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/part.parquet")).selectExpr("p_partkey AS doc", f"{text} AS text")


QUERIES = {
    "s7_buffers": lambda s, d: S.buffers(contents(s, d), 4096).select("path", "bytes", "sha256", "truncated", F.length("text").alias("chars"), "lines"),
    "s8_binary": lambda s, d: contents(s, d).select("path", S.is_binary(F.concat("content", F.encode(F.when(F.col("length") % 2 == 0, "\0").otherwise("x"), "UTF-8"))).alias("binary")),
    "s9_go_sum": lambda s, d: R.go_sum(part(s, d, GO)),
    "s9_requirements": lambda s, d: R.requirements(part(s, d, PIP)),
    "s9_package_lock": lambda s, d: R.package_lock(texts(s, d, LOCK)),
    "s9_cargo_lock": lambda s, d: R.cargo_lock(texts(s, d, CARGO)),
    "s10_coverage": lambda s, d: R.coverage(part(s, d, COVERAGE)),
    "s11_dot_edges": lambda s, d: R.dot_edges(part(s, d, DOT)),
    "s11_edge_list": lambda s, d: R.edge_list(part(s, d, EDGES)),
    "s16_paper_source": lambda s, d: texts(s, d, PAPER).select("doc", R.paper_source(F.col("text")).alias("source")),
    "s22_git_log": lambda s, d: R.git_log(part(s, d, LOG)),
    "s22_git_status": lambda s, d: R.git_status(part(s, d, STATUS)),
}

ORACLES = {
    "s7_buffers": "SELECT 'd/' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, strlen(text) > 4096 AS truncated, CASE WHEN strlen(text) <= 4096 THEN CAST(length(text) AS INT) END AS chars, CASE WHEN strlen(text) <= 4096 THEN CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS INT) END AS lines FROM documents",
    "s8_binary": "SELECT 'd/' || doc_id AS path, strlen(text) % 2 = 0 AND strlen(text) < 1024 AS binary FROM documents",
    "s9_go_sum": "SELECT DISTINCT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, 'go' AS ecosystem, 'example.com/m' || p_size AS name, 'v1.' || (p_partkey % 4) || '.0' AS version FROM part WHERE p_partkey % 3 < 2",
    "s9_requirements": "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, 'python' AS ecosystem, CASE p_partkey % 3 WHEN 0 THEN 'pkg_' || p_size ELSE 'x.y' END AS name, CASE p_partkey % 3 WHEN 0 THEN '1.' || p_partkey ELSE '2.0' END AS version FROM part WHERE p_partkey % 3 <> 1",
    "s9_package_lock": "SELECT p_partkey AS doc, 'node' AS ecosystem, 'a' || p_partkey AS name, '1.' || p_size || '.0' AS version FROM part UNION ALL SELECT p_partkey, 'node', '@s/c', '2.0.0' FROM part",
    "s9_cargo_lock": "SELECT p_partkey AS doc, 'rust' AS ecosystem, 'p' || p_partkey AS name, '0.' || p_size || '.1' AS version FROM part",
    "s10_coverage": f"""WITH l AS (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, p_partkey AS k, p_size, {COVERAGE} AS line FROM part),
        f AS (SELECT *, last_value(CASE WHEN starts_with(line, 'SF:') THEN substr(line, 4) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY k) AS file FROM l)
        SELECT doc, file, arg_max(CASE WHEN k % 5 = 2 THEN CAST(p_size AS BIGINT) END, CASE WHEN k % 5 = 2 THEN k END) AS found, arg_max(CASE WHEN k % 5 = 3 THEN CAST(p_size % 7 AS BIGINT) END, CASE WHEN k % 5 = 3 THEN k END) AS hit, count(*) FILTER (k % 5 = 1) AS functions FROM f WHERE file IS NOT NULL GROUP BY doc, file""",
    "s11_dot_edges": "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, CASE p_partkey % 4 WHEN 0 THEN 'a' || p_size ELSE 'x' || p_size END AS src, CASE p_partkey % 4 WHEN 0 THEN 'b' || (p_partkey % 9) ELSE 'y' END AS dst, 1.0::DOUBLE AS weight FROM part WHERE p_partkey % 4 IN (0, 3)",
    "s11_edge_list": "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, 'a' || p_size AS src, CASE p_partkey % 4 WHEN 0 THEN 'b' || p_partkey ELSE 'c' END AS dst, CASE p_partkey % 4 WHEN 0 THEN 1.0 ELSE p_size + 0.5 END::DOUBLE AS weight FROM part WHERE p_partkey % 4 < 2",
    "s16_paper_source": "SELECT p_partkey AS doc, CASE p_partkey % 8 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'doi' WHEN 3 THEN 'doi' WHEN 4 THEN 'local_pdf' WHEN 5 THEN 'url' WHEN 6 THEN 'acm' END AS source FROM part",
    "s22_git_log": "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, p_partkey AS line_no, sha1(CAST(p_partkey AS VARCHAR)) AS hash, CAST(p_partkey AS VARCHAR) AS short, 'A B' AS author, '2 days ago' AS age, 'fix | ' || p_name AS subject FROM part",
    "s22_git_status": "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, CASE p_partkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN '?' ELSE ' ' END AS staged, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '?' ELSE 'D' END AS unstaged, CASE p_partkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'new/' ELSE 'old/' END || p_partkey AS file FROM part",
}
