"""Projects as graphs, digests of source files, and checklists: entities and edges of workspaces, elements of files, claims on items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.extract import rust_module
from sparkloom.operators.graph import ready
from sparkloom.operators.knowledge import trivial

# Beginnings of modules of the standard library that are no dependencies.
ELIXIR_STANDARD = ("Enum", "String", "Map", "List", "Logger", "GenServer", "Supervisor", "Agent", "Task", "Application")


def upto(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def resolved(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, kind, weight) both ends of which are entities (key)."""
    keys = entities.select("key").distinct()
    return edges.where("src <> dst").join(keys.select(F.col("key").alias("src")), "src", "left_semi").join(keys.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst", "kind", "weight").distinct()


def rust_workspace(manifests: DataFrame, lines: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Entities (key, kind) and edges of a workspace: manifests (crate, line_no, line), sources (crate, path, line_no, line).

    A crate depends (1.0) on those of its dependencies that begin with the prefix and are in the workspace, contains (0.9)
    the modules of its files, and a module calls (0.7) the crates and the modules of its own crate that it uses.
    """
    section = F.last(F.when(F.trim("line").rlike(r"^\["), F.trim("line")), ignorenulls=True).over(upto("crate"))
    needs = manifests.withColumn("section", section).where("section = '[dependencies]'").select("crate", F.regexp_extract("line", r"^\s*([\w][\w-]*)\s*[=.]", 1).alias("dep")).where(F.col("dep").startswith(prefix))
    module = F.concat(F.lit("module:"), "crate", F.lit("::"), rust_module(F.col("path")))
    crate = lambda c: F.concat(F.lit("crate:"), c)
    held = lines.select("crate", module.alias("module")).distinct()
    entities = manifests.select(crate(F.col("crate")).alias("key"), F.lit("crate").alias("kind")).unionByName(held.select(F.col("module").alias("key"), F.lit("module").alias("kind"))).distinct()
    edge = lambda df, src, dst, kind, weight: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    out = edge(needs, crate(F.col("crate")), crate(F.col("dep")), "depends_on", 1.0)
    out = out.unionByName(edge(held, crate(F.col("crate")), F.col("module"), "contains", 0.9))
    used = F.regexp_extract("line", r"^\s*(?:pub\s+)?use\s+(\w+)", 1)
    inner = F.regexp_extract("line", r"^\s*(?:pub\s+)?use\s+crate::([a-z_]\w*)", 1)
    calls = lines.withColumn("module", module)
    across = calls.where(F.replace(used, F.lit("_"), F.lit("-")).startswith(prefix))
    out = out.unionByName(edge(across, F.col("module"), crate(F.replace(used, F.lit("_"), F.lit("-"))), "calls", 0.7))
    out = out.unionByName(edge(calls.where(inner != ""), F.col("module"), F.concat(F.lit("module:"), "crate", F.lit("::crate::"), inner), "calls", 0.7))
    return entities, resolved(out, entities)


def elixir_project(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of umbrella applications (app, path, line_no, line): siblings depend (1.0) on each other, applications contain (0.9) modules, and the first module of a file calls (0.7) what the file aliases, imports and uses, standard modules aside."""
    app = lambda c: F.concat(F.lit("app:"), c)
    module = lambda c: F.concat(F.lit("module:"), c)
    named = lines.withColumn("module", F.regexp_extract("line", r"^\s*defmodule\s+([A-Z][\w.]*\w)", 1)).where("module <> ''")
    first = named.groupBy("app", "path").agg(F.min_by("module", "line_no").alias("first"))
    entities = lines.select(app(F.col("app")).alias("key"), F.lit("app").alias("kind")).unionByName(named.select(module(F.col("module")).alias("key"), F.lit("module").alias("kind"))).distinct()
    edge = lambda df, src, dst, kind, weight: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    sibling = lines.withColumn("dep", F.regexp_extract("line", r"\{:(\w+),\s*in_umbrella:\s*true", 1)).where("dep <> ''")
    to = F.regexp_extract("line", r"^\s*(?:alias|import|use)\s+([A-Z][\w.]*\w)", 1)
    calls = lines.withColumn("to", to).where((F.col("to") != "") & ~F.split_part("to", F.lit("."), F.lit(1)).isin(*ELIXIR_STANDARD)).join(first, ["app", "path"])
    out = edge(sibling, app(F.col("app")), app(F.col("dep")), "depends_on", 1.0).unionByName(edge(named, app(F.col("app")), module(F.col("module")), "contains", 0.9)).unionByName(edge(calls, module(F.col("first")), module(F.col("to")), "calls", 0.7))
    return entities, resolved(out, entities)


def csharp_project(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of C# projects (project, path, line_no, line): references between projects (1.0), namespaces they contain (0.9), and the namespaces a file's first one uses (0.7); build folders aside."""
    rows = lines.where(~F.col("path").rlike(r"(^|/)(obj|bin)/"))
    project = lambda c: F.concat(F.lit("project:"), c)
    space = lambda c: F.concat(F.lit("module:"), c)
    named = rows.withColumn("space", F.regexp_extract("line", r"^\s*namespace\s+([\w.]+)", 1)).where("space <> ''")
    first = named.groupBy("project", "path").agg(F.min_by("space", "line_no").alias("first"))
    entities = rows.select(project(F.col("project")).alias("key"), F.lit("project").alias("kind")).unionByName(named.select(space(F.col("space")).alias("key"), F.lit("module").alias("kind"))).distinct()
    edge = lambda df, src, dst, kind, weight: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    needs = rows.withColumn("dep", F.regexp_extract("line", r'<ProjectReference\s+Include="(?:[^"]*[\\/])?([^"\\/]+)\.csproj"', 1)).where("dep <> ''")
    uses = rows.withColumn("to", F.regexp_extract("line", r"^\s*(?:global\s+)?using\s+(?:static\s+)?([A-Z][\w.]*)\s*;", 1)).where("to <> ''").join(first, ["project", "path"])
    out = edge(needs, project(F.col("project")), project(F.col("dep")), "depends_on", 1.0).unionByName(edge(named, project(F.col("project")), space(F.col("space")), "contains", 0.9)).unionByName(edge(uses, space(F.col("first")), space(F.col("to")), "calls", 0.7))
    return entities, resolved(out, entities)


# Forms of elements of a digest, in the order in which they are tried.
ELEMENTS = {
    "rust": (
        ("import", r"^\s*(?:pub\s+)?use\s+"), ("test_block", r"^\s*#\[cfg\(test\)\]"), ("constant", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:const|static)\s+[A-Z]"), ("type_alias", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?type\s+\w+"),
        ("module", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?mod\s+\w+"), ("struct", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?struct\s+\w+"), ("enum", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?enum\s+\w+"), ("trait", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+\w+"),
        ("impl", r"^\s*impl\b"), ("function", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:const\s+)?(?:async\s+)?fn\s+\w+"),
    ),
    "python": (("import", r"^\s*(?:import|from)\s+\w"), ("test_block", r"^class\s+Test\w*"), ("constant", r"^[A-Z][A-Z0-9_]+\s*="), ("type_alias", r"^\w+\s*=\s*(?:Union|Optional|TypeVar|NewType)\b"), ("class", r"^\s*class\s+\w+"), ("function", r"^\s*def\s+(?:[^_]|__)\w*")),
}
DOC = {"rust": r"^\s*///\s?(.*)$", "python": r"^\s*#\s?(.*)$"}


def digest(lines: DataFrame, language: str) -> DataFrame:
    """Elements (path, line_no, kind, text, doc) of files (path, line_no, line): the first form that fits; functions up to their first brace and first colon; equal imports of a file once; with the comment on the line before."""
    kind = F.lit(None).cast("string")
    for name, form in reversed(ELEMENTS[language]):
        kind = F.when(F.col("line").rlike(form), name).otherwise(kind)
    before = F.lag("line").over(Window.partitionBy("path").orderBy("line_no"))
    text = F.trim("line")
    cut = F.trim(F.regexp_extract(text, r"^[^{:]*", 0))
    rows = lines.withColumns({"kind": kind, "before": before}).where("kind is not null")
    rows = rows.select("path", "line_no", "kind", F.when(F.col("kind") == "function", cut).when(F.col("kind") == "test_block", "[tests]").otherwise(text).alias("text"), F.when(F.col("before").rlike(DOC[language]), F.regexp_extract("before", DOC[language], 1)).alias("doc"))
    first = F.row_number().over(Window.partitionBy("path", "text").orderBy("line_no"))
    imports = rows.where("kind = 'import'").withColumn("r", first).where("r = 1").drop("r")
    return rows.where("kind <> 'import'").unionByName(imports)


def describe(entities: DataFrame, provider: Callable[[str, str], tuple[str, float]], tries: int = 3, least: float = 0.7, most: int | None = 5000) -> DataFrame:
    """Descriptions (id, description, confidence, outcome) of entities (id, name, doc, body), trivial ones aside.

    `provider` is called for the first `most` entities by id, a limit on what a run may ask (None: all); a failing call is tried again up to
    `tries` times; answers below the least confidence are dropped. Outcomes: described, low_confidence, failed.
    """

    def ask(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for id_, name, body in zip(pdf["id"], pdf["name"], pdf["body"]):
                answer = None
                for _ in range(tries):
                    try:
                        answer = provider(name, body)
                        break
                    except Exception:  # whatever a provider raises counts as one failed try
                        continue
                if answer is None:
                    rows.append((id_, None, None, "failed"))
                elif answer[1] < least:
                    rows.append((id_, None, answer[1], "low_confidence"))
                else:
                    rows.append((id_, *answer, "described"))
            yield pd.DataFrame(rows, columns=["id", "description", "confidence", "outcome"])

    wanted = entities.where(~trivial(F.col("doc"), F.col("body")))
    wanted = wanted if most is None else wanted.orderBy("id").limit(most)
    return wanted.select("id", "name", "body").mapInPandas(ask, "id long, description string, confidence double, outcome string")


def claim(items: DataFrame, dependencies: DataFrame, agent: str, limit: int, now: Column, minutes: int) -> DataFrame:
    """Items (id, place, status, claimed_by, lease) after an agent takes the first `limit` ready ones by place: in progress, claimed, with a lease."""
    taken = ready(items, dependencies).orderBy("place").limit(limit).select("id", F.lit(True).alias("taken"))
    rows = items.join(taken, "id", "left")
    until = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return rows.select("id", "place", F.when(F.col("taken"), "in_progress").otherwise(F.col("status")).alias("status"), F.when(F.col("taken"), agent).otherwise(F.col("claimed_by")).alias("claimed_by"), F.when(F.col("taken"), until).otherwise(F.col("lease")).alias("lease"))


def release(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Items after requests (id, agent) to give them back: pending without claim and lease; a request of another agent than the one that claimed changes nothing, one without an agent always counts."""
    asked = requests.groupBy("id").agg(F.collect_set("agent").alias("agents"), F.bool_or(F.col("agent").isNull()).alias("any"))
    rows = items.join(asked, "id", "left")
    back = F.coalesce(F.col("any") | F.array_contains("agents", F.col("claimed_by")), F.lit(False))
    return rows.select("id", "place", F.when(back, "pending").otherwise(F.col("status")).alias("status"), F.when(~back, F.col("claimed_by")).alias("claimed_by"), F.when(~back, F.col("lease")).alias("lease"))
