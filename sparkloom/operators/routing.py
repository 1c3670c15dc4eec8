"""Which filter a command's output goes to, and which languages a project has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What commands of each filter hold, what excludes them, and programs that cut output short.
ROUTES = (
    ("test-summary", ("cargo test", "cargo nextest", "pytest", "uv run pytest", "jest", "vitest", "go test", "mix test", "swift test", "dotnet test", "elixir.*test", "rebar3.*proper"), ("--no-run", "--list", "--list-tests")),
    ("lint-dedup", ("clippy", "ruff", "eslint", "biome", "golangci-lint", "mypy", "oxlint", "dotnet format", "roslyn"), ()),
    ("diff-filter", ("git diff",), ()),
    ("log-distill", ("cargo build", "cargo check", "npm run build", "dotnet build", "dotnet publish", "msbuild", "make", "gcc", "g++", "tsc"), ()),
)
FALLBACK = "log-distill"
CUTTERS = ("grep", "tail", "head", "awk", "sed", "wc", "cut", "sort", "uniq")
# Marker files of projects.
MARKERS = (
    ("Cargo.toml", "Rust", "Cargo", "cargo test"),
    ("pyproject.toml", "Python", None, "pytest"),
    ("setup.py", "Python", None, None),
    ("requirements.txt", "Python", None, None),
    ("mix.exs", "Elixir", "Mix", "ExUnit"),
    ("go.mod", "Go", None, "go test"),
    ("tsconfig.json", "TypeScript", "npm/yarn", None),
    ("package.json", "JavaScript", "npm/yarn", None),
    ("Package.swift", "Swift", "SwiftPM", "swift test"),
)


def blanked(command: Column) -> Column:
    """A command whose quoted parts are blank; an open quote runs to the end."""
    return F.regexp_replace(command, r"""(?s)"(?:\\.|[^"\\])*(?:"|\z)|'[^']*(?:'|\z)""", "  ")


def normal(command: Column) -> Column:
    """The last command of a chain, up to a pipe, without redirections, in lower case."""
    last = F.trim(F.element_at(F.split(blanked(command), "&&|;"), -1))
    return F.lower(F.regexp_replace(F.regexp_extract(last, r"^[^|]*", 0), r"[0-9]*>&?[0-9]+|[0-9]*>\s*/dev/null", " "))


def is_cut(command: Column) -> Column:
    """Whether a command is piped into a program that cuts output short."""
    after = F.lower(F.trim(F.regexp_extract(command, r"(?s)^[^|]*\|(.*)\z", 1)))
    out = F.lit(False)
    for c in CUTTERS:
        out = out | after.startswith(c)
    return blanked(command).contains("|") & out


def route(command: Column) -> Column:
    """The filter of a command: the first whose words it holds and none that exclude it; the fallback if it is cut short or nothing fits."""
    plain = normal(command)
    out = F.when(is_cut(command), FALLBACK)
    for name, words, without in ROUTES:
        hit, off = F.lit(False), F.lit(False)
        for w in words:
            hit = hit | (plain.rlike(w) if ".*" in w else plain.contains(w))
        for w in without:
            off = off | plain.contains(w)
        out = out.when(hit & ~off, name)
    return out.otherwise(FALLBACK)


def languages(files: DataFrame) -> DataFrame:
    """Languages, build tools and runners of projects by the marker files (project, name) at their top; TypeScript hides JavaScript."""
    rows = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in m) + ")" for m in MARKERS)
    known = files.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(marker, language, build, runner)")
    found = files.join(F.broadcast(known), files.name == known.marker)
    sets = found.groupBy("project").agg(F.collect_set("language").alias("languages"), F.array_sort(F.collect_set("build")).alias("builds"), F.array_sort(F.collect_set("runner")).alias("runners"))
    return sets.withColumn("languages", F.array_sort(F.when(F.array_contains("languages", "TypeScript"), F.array_remove("languages", "JavaScript")).otherwise(F.col("languages"))))


def filtered(runs: DataFrame, recognised: Column) -> DataFrame:
    """Runs (command, output) with the filter that takes their output and whether it fell back: a test summary needs a runner that is recognised in it, every other route takes any output."""
    wanted = route(F.col("command"))
    rows = runs.withColumns({"wanted": wanted, "known": recognised})
    fails = (F.col("wanted") == "test-summary") & F.col("known").isNull()
    return rows.select("*", F.when(fails, FALLBACK).otherwise(F.col("wanted")).alias("filter"), fails.alias("fell_back")).drop("wanted", "known")


# Files at the top of a project that tell more about it: what they tell, and its name.
MORE_MARKERS = (
    ("config", "frameworks", "Phoenix (possible)", "Elixir"), ("next.config.js", "frameworks", "Next.js", "JavaScript"), ("next.config.mjs", "frameworks", "Next.js", "JavaScript"), ("jest.config.js", "runners", "Jest", "JavaScript"), ("jest.config.ts", "runners", "Jest", "JavaScript"),
    ("jest.config.cjs", "runners", "Jest", "JavaScript"), ("vitest.config.ts", "runners", "Vitest", "JavaScript"), ("vitest.config.js", "runners", "Vitest", "JavaScript"), ("pytest.ini", "runners", "pytest", "Python"), ("tests", "runners", "pytest", "Python"),
    ("CMakeLists.txt", "builds", "CMake", None), ("meson.build", "builds", "Meson", None), ("configure.ac", "builds", "Autotools", None), ("configure", "builds", "Autotools", None), ("Makefile", "builds", "Make", None), ("makefile", "builds", "Make", None),
    ("Dockerfile", "builds", "Docker", None), ("docker-compose.yml", "builds", "Docker", None), ("fly.toml", "builds", "Fly.io", None), (".github/workflows", "ci", "GitHub Actions", None), (".gitlab-ci.yml", "ci", "GitLab CI", None), ("Cargo.toml", "linters", "clippy", None),
    (".eslintrc.js", "linters", "ESLint", None), (".eslintrc.json", "linters", "ESLint", None), ("eslint.config.js", "linters", "ESLint", None), ("ruff.toml", "linters", "Ruff", None), (".ruff.toml", "linters", "Ruff", None), (".pre-commit-config.yaml", "linters", "pre-commit", None),
)


def traits(files: DataFrame) -> DataFrame:
    """(project, trait, name) of projects by the files (project, name) at their top: frameworks and runners of a language only where a marker of it is there too."""
    known = F.explode(F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("marker", "trait", "value", "of"), row))) for row in MORE_MARKERS)))
    found = files.select("project", "name", known.alias("m")).where("name = m.marker")
    spoken = F.explode(F.array(*(F.struct(F.lit(m).alias("marker"), F.lit("JavaScript" if lang == "TypeScript" else lang).alias("lang")) for m, lang, *_ in MARKERS if m != "tsconfig.json")))
    spoken = files.select("project", "name", spoken.alias("l")).where("name = l.marker").select("project", F.col("l.lang").alias("lang")).distinct()
    free = found.where("m.of is null").select("project", F.col("m.trait").alias("trait"), F.col("m.value").alias("name"))
    bound = found.select("project", F.col("m.trait").alias("trait"), F.col("m.value").alias("name"), F.col("m.of").alias("lang")).join(spoken, ["project", "lang"], "left_semi").select("project", "trait", "name")
    return free.unionByName(bound).distinct()
