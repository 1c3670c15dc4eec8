"""Workspace, digest, routing and checklist queries on lines written from parts; the SQL applies the same line forms to the same lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import routing as R
from sparkloom.operators import runners as U
from sparkloom.operators import workspace as K
from sparkloom.sources import formats as T

CARGO = "CASE p_partkey % 4 WHEN 0 THEN '[dependencies]' WHEN 1 THEN 'ws-brand-' || (p_size % 30) || ' = { path = 1 }' WHEN 2 THEN 'serde = 1' ELSE '[features]' END"
RUST = "CASE p_partkey % 8 WHEN 0 THEN 'use ws_brand_' || (p_size % 30) || '::x;' WHEN 1 THEN 'use crate::m' || (p_size % 5) || '::y;' WHEN 2 THEN '/// says ' || p_size WHEN 3 THEN 'pub fn go' || p_size || '(a: u8) -> u8 {' WHEN 4 THEN 'pub const N' || p_size || ': u8 = 1;' WHEN 5 THEN '#[cfg(test)]' WHEN 6 THEN 'pub(crate) struct S' || p_size || ' {' ELSE 'impl X for S {' END"
ELIXIR = "CASE p_partkey % 5 WHEN 0 THEN 'defmodule M' || (p_size % 9) || '.A do' WHEN 1 THEN '  alias M' || (p_size % 9) || '.A' WHEN 2 THEN '  use GenServer' WHEN 3 THEN '  {:brand' || (p_size % 30) || ', in_umbrella: true},' ELSE 'end' END"
CSHARP = "CASE p_partkey % 5 WHEN 0 THEN 'namespace N' || (p_size % 9) || '.A;' WHEN 1 THEN 'using N' || (p_size % 9) || '.A;' WHEN 2 THEN '<ProjectReference Include=\"..\\\\x\\\\Brand#' || (p_size % 30) || '.csproj\" />' WHEN 3 THEN 'using System;' ELSE '}' END"
PYTHON = "CASE p_partkey % 7 WHEN 0 THEN 'import a' || (p_size % 3) WHEN 1 THEN '# about ' || p_size WHEN 2 THEN 'def go' || p_size || '(x: int) -> int:' WHEN 3 THEN '    def _own(self):' WHEN 4 THEN 'LIMIT = ' || p_size WHEN 5 THEN 'class C' || p_size || ':' ELSE 'class TestX:' END"
COMMAND = "CASE p_partkey % 4 WHEN 0 THEN 'cargo test' WHEN 1 THEN 'pytest -q' WHEN 2 THEN 'git diff' ELSE 'ls' END"
OUTPUT = "CASE WHEN p_size % 2 = 0 THEN 'running 3 tests' || chr(10) || 'test result: ok. 3 passed; 0 failed; 0 ignored; finished in 0.1s' ELSE 'all failed' END"
TOP = "CASE p_partkey % 9 WHEN 0 THEN 'Cargo.toml' WHEN 1 THEN 'config' WHEN 2 THEN 'mix.exs' WHEN 3 THEN 'package.json' WHEN 4 THEN 'jest.config.ts' WHEN 5 THEN '.github/workflows' WHEN 6 THEN 'Makefile' WHEN 7 THEN 'ruff.toml' ELSE 'next.config.js' END"
NUGET = "'{\"version\": 1, \"dependencies\": {\"net8.0\": {\"A' || p_size || '\": {\"type\": \"Direct\", \"resolved\": \"1.' || p_partkey || '.0\"}}, \"net9.0\": {\"B\": {\"resolved\": \"2.0\"}, \"C\": {\"type\": \"Project\"}}}}'"
MIX = "CASE p_partkey % 3 WHEN 0 THEN '  \"plug' || p_size || '\": {:hex, :plug, \"1.' || p_size || '.0\", \"h\"},' WHEN 1 THEN '  \"x\": {:git, \"u\"},' ELSE '}' END"
EDGES = "'[{\"source\": \"a\", \"target\": \"b' || p_size || '\"}, {\"source\": \"c\", \"target\": \"c\"}, {\"source\": \"d\", \"target\": \"e\", \"weight\": ' || p_size || '.5}]'"


def rows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(*columns)


def lines(spark: SparkSession, sf: str, line: str, of: str = "path") -> DataFrame:
    return rows(spark, sf, f"{of}", "p_partkey AS line_no", f"{line} AS line")


NAME = "'ws-' || lower(replace(p_brand, '#', '-'))"
PATH = "'src/m' || (p_size % 5) || '.rs'"


def items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    found = rows(spark, sf, "p_partkey AS id", "p_size AS place", "CASE p_partkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' ELSE 'in_progress' END AS status", "CASE WHEN p_partkey % 3 = 2 THEN 'a' || (p_partkey % 4) END AS claimed_by", "CAST(NULL AS TIMESTAMP) AS lease")
    return found, rows(spark, sf, "p_partkey AS id", "CAST(floor(p_partkey / 2) AS BIGINT) AS needs").where("id > 1")


def workspace(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return K.rust_workspace(rows(spark, sf, f"{NAME} AS crate", "p_partkey AS line_no", f"{CARGO} AS line"), rows(spark, sf, f"{NAME} AS crate", f"{PATH} AS path", "p_partkey AS line_no", f"{RUST} AS line"), "ws-")


def elixir(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return K.elixir_project(rows(spark, sf, "lower(replace(p_brand, '#', '')) AS app", "'lib/f' || (p_size % 4) AS path", "p_partkey AS line_no", f"{ELIXIR} AS line"))


def csharp(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return K.csharp_project(rows(spark, sf, "p_brand AS project", "CASE WHEN p_size % 6 = 0 THEN 'obj/x.cs' ELSE 'f' || (p_size % 4) END AS path", "p_partkey AS line_no", f"{CSHARP} AS line"))


def described(spark: SparkSession, sf: str) -> DataFrame:
    def provider(name: str, body: str) -> tuple[str, float]:
        """A stand-in: it fails for names with a z and is the surer the longer the body."""
        if "z" in name:
            raise ValueError(name)
        return f"About {name}", len(body) / 100

    return K.describe(rows(spark, sf, "p_partkey AS id", "p_name AS name", "p_type AS doc", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE repeat('x', p_size * 2) END AS body"), provider, most=None)


QUERIES = {
    "k11_entities": lambda s, d: workspace(s, d)[0],
    "k11_edges": lambda s, d: workspace(s, d)[1],
    "k12_elixir_edges": lambda s, d: elixir(s, d)[1],
    "k12_csharp_edges": lambda s, d: csharp(s, d)[1],
    "c2_digest_rust": lambda s, d: K.digest(lines(s, d, RUST, "p_brand AS path"), "rust"),
    "c2_digest_python": lambda s, d: K.digest(lines(s, d, PYTHON, "p_brand AS path"), "python"),
    "a28_filters": lambda s, d: R.filtered(rows(s, d, "p_partkey AS doc", f"{COMMAND} AS command", f"{OUTPUT} AS output"), U.runner(F.col("output"))).select("doc", "filter", "fell_back"),
    "c13_traits": lambda s, d: R.traits(rows(s, d, "p_size AS project", f"{TOP} AS name")),
    "s9_nuget": lambda s, d: T.nuget_lock(rows(s, d, "p_partkey AS doc", f"{NUGET} AS text")),
    "s9_mix_lock": lambda s, d: T.mix_lock(lines(s, d, MIX, "p_size AS doc")),
    "s11_json_edges": lambda s, d: T.json_edges(rows(s, d, "p_partkey AS doc", f"{EDGES} AS text")),
    "d25_claimed": lambda s, d: K.claim(*items(s, d), "me", 10**6, F.lit("2020-01-01").cast("timestamp"), 30).select("id", "status", "claimed_by", "lease"),
    "d25_released": lambda s, d: K.release(items(s, d)[0], rows(s, d, "p_partkey AS id", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'a' || (p_size % 4) END AS agent")).select("id", "status", "claimed_by"),
    "k22_descriptions": described,
}

FILE = "regexp_replace(regexp_replace(path, '^src/', ''), '\\.rs$', '')"
WORKSPACE = f"""WITH man AS (SELECT {NAME} AS crate, p_partkey AS line_no, {CARGO} AS line FROM part), src AS (SELECT {NAME} AS crate, {PATH} AS path, {RUST} AS line FROM part),
 sec AS (SELECT *, last_value(CASE WHEN line LIKE '[%' THEN line END IGNORE NULLS) OVER (PARTITION BY crate ORDER BY line_no) AS section FROM man), mo AS (SELECT *, 'module:' || crate || '::crate::' || {FILE} AS module FROM src),
 ent AS (SELECT DISTINCT 'crate:' || crate AS key, 'crate' AS kind FROM man UNION SELECT module, 'module' FROM mo),
 ed AS (SELECT 'crate:' || crate AS src, 'crate:' || regexp_extract(line, '^([\\w-]+)', 1) AS dst, 'depends_on' AS kind, 1.0::DOUBLE AS weight FROM sec WHERE section = '[dependencies]' AND line LIKE 'ws-%' UNION SELECT 'crate:' || crate, module, 'contains', 0.9 FROM mo
 UNION SELECT module, 'crate:' || replace(regexp_extract(line, '^use (\\w+)', 1), '_', '-'), 'calls', 0.7 FROM mo WHERE line LIKE 'use ws\\_%' ESCAPE '\\' UNION SELECT module, 'module:' || crate || '::crate::' || regexp_extract(line, 'use crate::(\\w+)', 1), 'calls', 0.7 FROM mo WHERE line LIKE 'use crate::%') """
BOTH = "SELECT src, dst, kind, weight FROM ed WHERE src <> dst AND src IN (SELECT key FROM ent) AND dst IN (SELECT key FROM ent)"
FORMS = lambda language: "CASE " + " ".join(f"WHEN regexp_matches(line, '{form}') THEN '{kind}'" for kind, form in K.ELEMENTS[language]) + " END"
DIGEST = lambda line, language, doc: f"""WITH l AS (SELECT p_brand AS path, p_partkey AS line_no, {line} AS line FROM part), k AS (SELECT *, {FORMS(language)} AS kind, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS before FROM l),
 e AS (SELECT path, line_no, kind, CASE kind WHEN 'function' THEN trim(regexp_extract(trim(line), '^[^{{:]*')) WHEN 'test_block' THEN '[tests]' ELSE trim(line) END AS text, CASE WHEN regexp_matches(before, '{doc}') THEN regexp_extract(before, '{doc}', 1) END AS doc FROM k WHERE kind IS NOT NULL)
 SELECT path, line_no, kind, text, doc FROM e QUALIFY kind <> 'import' OR row_number() OVER (PARTITION BY path, kind, text ORDER BY line_no) = 1"""  # noqa: E731

ORACLES = {
    "k11_entities": WORKSPACE + "SELECT * FROM ent",
    "k11_edges": WORKSPACE + BOTH,
    "k12_elixir_edges": f"""WITH l AS (SELECT lower(replace(p_brand, '#', '')) AS app, 'lib/f' || (p_size % 4) AS path, p_partkey AS line_no, {ELIXIR} AS line FROM part), n AS (SELECT *, regexp_extract(line, '^\\s*defmodule\\s+([\\w.]+)', 1) AS module FROM l WHERE line LIKE 'defmodule%'), f AS (SELECT app, path, arg_min(module, line_no) AS first FROM n GROUP BY ALL),
        ent AS (SELECT 'app:' || app AS key FROM l UNION SELECT 'module:' || module FROM n), ed AS (SELECT 'app:' || app AS src, 'app:' || regexp_extract(line, '\\{{:(\\w+), in_umbrella', 1) AS dst, 'depends_on' AS kind, 1.0::DOUBLE AS weight FROM l WHERE contains(line, 'in_umbrella') UNION SELECT 'app:' || app, 'module:' || module, 'contains', 0.9 FROM n
        UNION SELECT 'module:' || first, 'module:' || regexp_extract(line, 'alias\\s+([\\w.]+)', 1), 'calls', 0.7 FROM l JOIN f USING (app, path) WHERE contains(line, 'alias')) """ + BOTH,
    "k12_csharp_edges": f"""WITH l AS (SELECT p_brand AS project, 'f' || (p_size % 4) AS path, p_partkey AS line_no, {CSHARP.replace(chr(92) * 2, chr(92))} AS line FROM part WHERE p_size % 6 <> 0), n AS (SELECT *, regexp_extract(line, '^namespace\\s+([\\w.]+)', 1) AS space FROM l WHERE line LIKE 'namespace%'), f AS (SELECT project, path, arg_min(space, line_no) AS first FROM n GROUP BY ALL),
        ent AS (SELECT 'project:' || project AS key FROM l UNION SELECT 'module:' || space FROM n), ed AS (SELECT 'project:' || project AS src, 'project:' || regexp_extract(line, '(Brand#[0-9]+)\\.csproj', 1) AS dst, 'depends_on' AS kind, 1.0::DOUBLE AS weight FROM l WHERE contains(line, '.csproj') UNION SELECT 'project:' || project, 'module:' || space, 'contains', 0.9 FROM n
        UNION SELECT 'module:' || first, 'module:' || regexp_extract(line, 'using\\s+([\\w.]+);', 1), 'calls', 0.7 FROM l JOIN f USING (project, path) WHERE line LIKE 'using N%') """ + BOTH,
    "c2_digest_rust": DIGEST(RUST, "rust", "^\\s*///\\s?(.*)$"),
    "c2_digest_python": DIGEST(PYTHON, "python", "^\\s*#\\s?(.*)$"),
    "a28_filters": "SELECT p_partkey AS doc, CASE WHEN p_partkey % 4 = 2 THEN 'diff-filter' WHEN p_partkey % 4 < 2 AND p_size % 2 = 0 THEN 'test-summary' ELSE 'log-distill' END AS filter, p_partkey % 4 < 2 AND p_size % 2 = 1 AS fell_back FROM part",
    "c13_traits": f"WITH f AS (SELECT DISTINCT p_size AS project, {TOP} AS name FROM part), m(marker, trait, value, lang) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in R.MORE_MARKERS) + """), s AS (SELECT DISTINCT project, CASE name WHEN 'mix.exs' THEN 'Elixir' WHEN 'package.json' THEN 'JavaScript' WHEN 'Cargo.toml' THEN 'Rust' END AS lang FROM f)
        SELECT DISTINCT project, trait, value AS name FROM f JOIN m ON name = marker WHERE m.lang IS NULL OR EXISTS (SELECT 1 FROM s WHERE s.project = f.project AND s.lang = m.lang)""",
    "s9_nuget": "SELECT p_partkey AS doc, 'dotnet' AS ecosystem, 'A' || p_size AS name, '1.' || p_partkey || '.0' AS version FROM part UNION ALL SELECT p_partkey, 'dotnet', 'B', '2.0' FROM part",
    "s9_mix_lock": f"WITH l AS (SELECT p_size AS doc, {MIX} AS line FROM part)" + r""" SELECT doc, 'elixir' AS ecosystem, regexp_extract(line, '"([a-z0-9_]+)"', 1) AS name, regexp_extract(line, ':hex, :\w+, "([^"]+)"', 1) AS version FROM l WHERE contains(line, ':hex')""",
    "s11_json_edges": "SELECT p_partkey AS doc, 'a' AS src, 'b' || p_size AS dst, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT p_partkey, 'd', 'e', p_size + 0.5 FROM part",
    "d25_claimed": """WITH i AS (SELECT p_partkey AS id, p_partkey % 3 AS k, CASE WHEN p_partkey > 1 THEN CAST(floor(p_partkey / 2) AS BIGINT) END AS needs FROM part), r AS (SELECT id FROM i WHERE k = 1 AND (needs IS NULL OR needs % 3 = 0 OR needs NOT IN (SELECT id FROM i)))
        SELECT id, CASE WHEN id IN (SELECT id FROM r) THEN 'in_progress' ELSE ['completed', 'pending', 'in_progress'][k + 1] END AS status, CASE WHEN id IN (SELECT id FROM r) THEN 'me' WHEN k = 2 THEN 'a' || (id % 4) END AS claimed_by, CASE WHEN id IN (SELECT id FROM r) THEN TIMESTAMP '2020-01-01 00:30:00' END AS lease FROM i""",
    "d25_released": "SELECT p_partkey AS id, CASE WHEN back THEN 'pending' ELSE ['completed', 'pending', 'in_progress'][k + 1] END AS status, CASE WHEN NOT back AND k = 2 THEN 'a' || (p_partkey % 4) END AS claimed_by FROM (SELECT *, p_partkey % 3 AS k, p_size % 3 = 0 OR (p_partkey % 3 = 2 AND p_partkey % 4 = p_size % 4) AS back FROM part)",
    "k22_descriptions": "SELECT p_partkey AS id, CASE WHEN NOT contains(p_name, 'z') AND p_size * 2 >= 70 THEN 'About ' || p_name END AS description, CASE WHEN NOT contains(p_name, 'z') THEN p_size * 2 / 100::DOUBLE END AS confidence, CASE WHEN contains(p_name, 'z') THEN 'failed' WHEN p_size * 2 >= 70 THEN 'described' ELSE 'low_confidence' END AS outcome FROM part WHERE p_size % 5 <> 0",
}
