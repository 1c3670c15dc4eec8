r"""Queries on listings of files, handlers of errors, reports and loads; the SQL applies the rules to the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import fail_loud as L
from sparkloom.operators import graph as G
from sparkloom.operators import web as W
from sparkloom.plans import graph as PG
from sparkloom.sources import collect as C
from sparkloom.sources import sinks as S

PATHS = "CASE p_partkey % 12 WHEN 0 THEN 'src/a' || p_size || '.rs' WHEN 1 THEN 'logs/x' || p_size || '.log' WHEN 2 THEN 'logs/keep.log' WHEN 3 THEN 'target/b' || p_size || '.rs' WHEN 4 THEN '.hidden/c.md' WHEN 5 THEN 'docs/d' || p_size || '.md' WHEN 6 THEN 'docs/README.md' WHEN 7 THEN 'tools/s' || p_size || '/SKILL.md' WHEN 8 THEN 'top/e' || p_size || '.tmp' WHEN 9 THEN 'deep/top/e.tmp' WHEN 10 THEN 'x/private/f' || p_size || '.py' ELSE 'g' || p_size || '.PY' END"
RULES = ("# comment", "", "*.log", "!keep.log", "private/", "/top/*.tmp")
SPECS = """
[modules.core]
description = "the core"
seeds = ["m0.p1.n1"]
include = ["m0.*"]
exclude = ["*.p3.*"]

[modules.edge]
include = ["m1.p2*", "m2.*"]
"""
CODE = "CASE p_partkey % 8 WHEN 0 THEN 'try:' || chr(10) || '    go(' || p_size || ')' || chr(10) || 'except ValueError:' || chr(10) || '    return []' WHEN 1 THEN 'try:' || chr(10) || '    go()' || chr(10) || 'except E:' || chr(10) || '    raise NotImplementedError' WHEN 2 THEN 'match x {' || chr(10) || '  Err(e) => Ok(vec![]),' || chr(10) || '}' WHEN 3 THEN 'let _ = tx.send(' || p_size || ');' WHEN 4 THEN 'if err != nil {' || chr(10) || '  return nil' || chr(10) || '}' WHEN 5 THEN 'try { a() } catch (e) {' || chr(10) || '  return null;' || chr(10) || '}' WHEN 6 THEN 'let v = db.save(x).ok();' ELSE 'load().catch(() => [])' END"
ENDING = "CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' WHEN 3 THEN '.rs' WHEN 4 THEN '.go' WHEN 5 THEN '.ts' WHEN 6 THEN '.rs' ELSE '.js' END"
COMMENTS = "CASE p_partkey % 5 WHEN 0 THEN '// TODO: later ' || p_size WHEN 1 THEN '# todos are many' WHEN 2 THEN 'let mockData = [' || p_size || '];' WHEN 3 THEN 'x = 1 // stub' ELSE '-- temporary' END"
ANSWER = "'{\"results\": [' || repeat('{\"title\": \"T' || p_size || '\", \"url\": \"https://h/' || p_partkey || '\", \"content\": \"c\"}, ', p_size % 4) || '{\"title\": \"last\", \"url\": \"u\"}]}'"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", f"{PATHS} AS path", "p_size * 100 AS bytes")


def part(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(*columns)


def links(spark: SparkSession, sf: str) -> DataFrame:
    found = W.links(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"))
    return found.select("url", W.resolve(F.col("url"), F.col("href")).alias("target")).where("target is not null").distinct()


def crawled(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return C.crawl(pages, links(spark, sf), pages.select("url"))


def loads(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("CAST(floor(l_orderkey / 25) AS BIGINT) AS chunk", "l_linenumber AS n")

    def send(chunk: int, items: list) -> tuple[int, int, int]:
        """A store that takes no row with the number 7."""
        if any(i["n"] == 7 for i in items):
            raise ValueError("7")
        return len(items), 0, 0

    return S.load_chunks(rows, send)


QUERIES = {
    "s4_kept": lambda s, d: C.kept(files(s, d), RULES).select("id", "path"),
    "s5_with_endings": lambda s, d: C.with_endings(files(s, d), ("rs", "py"), ("target", "deps")).select("id", "path"),
    "s6_globbed": lambda s, d: C.globbed(files(s, d), "docs/**/*.md", "README.md", 500, 4000).select("id", "path"),
    "s12_members": lambda s, d: C.members(G.nodes(PG.edges(s, d)), C.module_specs(s, SPECS)),
    "s14_crawl": crawled,
    "s15_search": lambda s, d: C.search_results(part(s, d, "p_partkey AS query", f"{ANSWER} AS body"), 3),
    "s17_corpus_files": lambda s, d: C.corpus_files(files(s, d)).select("id", "path"),
    "s18_skill_files": lambda s, d: C.skill_files(files(s, d)).select("id", "category"),
    "b19_findings": lambda s, d: L.findings(part(s, d, f"'f' || p_partkey || {ENDING} AS path", f"{CODE} AS text")),
    "b19_placeholders": lambda s, d: L.placeholder_lines(part(s, d, "p_brand AS path", "p_partkey AS line_no", f"{COMMENTS} AS line")),
    "w3_metrics_csv": lambda s, d: S.csv_lines(G.degrees(PG.edges(s, d)), "node"),
    "w4_rules": lambda s, d: S.enforcement_rules(part(s, d, "substr(p_type, 1, 3) AS module", "substr(p_brand, 1, 7) AS other").distinct(), part(s, d, "substr(p_type, 1, 3) AS module").distinct()),
    "w6_loads": loads,
}

FILES = f"WITH f AS (SELECT p_partkey AS id, {PATHS} AS path, p_size * 100 AS bytes FROM part) "
BLOCK = f"WITH c AS (SELECT p_partkey AS k, 'f' || p_partkey || {ENDING} AS path, {CODE} AS text FROM part) "
ORACLES = {
    "s4_kept": FILES + "SELECT id, path FROM f WHERE NOT regexp_matches(path, '(^|/)(target|node_modules|dist|build|out|_build|__pycache__|venv)/') AND NOT regexp_matches(path, '(^|/)\\.') AND NOT (path LIKE '%.log' AND path NOT LIKE '%/keep.log') AND path NOT LIKE '%private/%' AND NOT regexp_matches(path, '^top/[^/]*\\.tmp$')",
    "s5_with_endings": FILES + "SELECT id, path FROM f WHERE regexp_matches(lower(path), '\\.(rs|py)$') AND NOT regexp_matches(path, '(^|/)(target|deps)/')",
    "s6_globbed": FILES + "SELECT id, path FROM f WHERE path LIKE 'docs/%.md' AND path NOT LIKE '%README.md' AND bytes BETWEEN 500 AND 4000",
    "s12_members": PG.E + PG.END + "SELECT node, CASE WHEN regexp_matches(node, '^m1\\.p2') OR node LIKE 'm2.%' THEN 'edge' ELSE 'core' END AS module FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE (node LIKE 'm0.%' AND NOT regexp_matches(node, '\\.p3\\.')) OR regexp_matches(node, '^m1\\.p2') OR node LIKE 'm2.%'",
    "s15_search": f"WITH a AS (SELECT p_partkey AS query, json_extract({ANSWER}, '$.results[*]') AS r FROM part), u AS (SELECT query, unnest(r[:3]) AS x, CAST(generate_subscripts(r[:3], 1) - 1 AS INT) AS place FROM a) SELECT query, place, json_extract_string(x, '$.title') AS title, json_extract_string(x, '$.url') AS url FROM u",
    "s17_corpus_files": FILES + "SELECT id, path FROM f WHERE path LIKE '%.md' AND NOT regexp_matches(list_last(string_split(path, '/')), 'INDEX|symlink|README|references|SKILL|isolation-trap|downloads-import')",
    "s18_skill_files": FILES + "SELECT id, split_part(path, '/', 1) AS category FROM f WHERE path LIKE '%/SKILL.md' AND len(string_split(path, '/')) BETWEEN 2 AND 10",
    "b19_findings": BLOCK + """SELECT path, CAST(CASE WHEN path LIKE '%.py' THEN 3 WHEN contains(text, 'Err(e) =>') THEN 2 ELSE 1 END AS INT) AS line,
        CASE WHEN path LIKE '%.py' THEN 'python_except_default' WHEN contains(text, 'Err(e) =>') THEN 'rust_err_ok_default' WHEN contains(text, 'let _ =') THEN 'rust_ignored_fallible' WHEN contains(text, '.ok()') THEN 'rust_result_erasure' WHEN path LIKE '%.go' THEN 'go_err_nil_success' WHEN contains(text, '.catch(') THEN 'js_promise_catch_default' ELSE 'js_catch_default' END AS finding FROM c WHERE NOT contains(lower(text), 'notimplemented')""",
    "b19_placeholders": f"WITH l AS (SELECT p_brand AS path, p_partkey AS line_no, trim({COMMENTS}) AS line FROM part), k AS (SELECT *, CASE WHEN regexp_matches(line, '^(//|#|--)') AND regexp_matches(lower(line), '(^|[^a-z0-9_])(todo|fixme|stub|placeholder|temporary)([^a-z0-9_]|$)') THEN 'placeholder_comment' WHEN regexp_matches(lower(line), 'mock_?data') AND contains(line, '[') THEN 'mock_leak_runtime' END AS finding FROM l) SELECT path, line_no, finding FROM k WHERE finding IS NOT NULL",
    "w3_metrics_csv": PG.E + PG.DEG + PG.END + "SELECT node AS n, node || ',' || fan_in || ',' || fan_out || ',' || printf('%.3f', instability) AS value FROM deg",
    "w4_rules": "WITH m AS (SELECT DISTINCT substr(p_type, 1, 3) AS module FROM part) SELECT a.module, b.module AS other, 'no_dependency(from = \"' || a.module || '..\", to = \"' || b.module || '..\")' AS rule FROM m a JOIN m b ON a.module <> b.module",
    "w6_loads": "SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS chunk, count(*) AS sent, count(*) FILTER (l_linenumber <> 7) AS inserted, 0::BIGINT AS updated, 0::BIGINT AS skipped, count(*) FILTER (l_linenumber = 7) AS failed FROM lineitem GROUP BY 1",
}
