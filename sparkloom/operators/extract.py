"""What source lines depend on and declare, by tables of line forms: (path, line_no, line) in, edges, declarations and references out.

All native: one pass over the lines; only Rust entry points look at the three lines above, in a window by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of a line that imports something; the last group is the target.
IMPORTS = {
    "rust": (r"^\s*use\s+(?:crate|super|self)?::?([\w:]+)",),
    "python": (r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"),
    "java": (r"import\s+(?:static\s+)?([a-zA-Z][\w.]*)",),
    "go": (r'^\s*(?:import\s+)?"([^"]+)"',),
    "typescript": (r"""(?:import|export)\s+(?:.*?\s+from\s+)?['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
    "csharp": (r"^\s*(?:global\s+)?using\s+(?:static\s+)?([A-Z][\w.]*)\s*;",),
    "elixir": (r"alias\s+([A-Z][\w.]+)", r"import\s+([A-Z][\w.]+)", r"use\s+([A-Z][\w.]+)"),
    "erlang": (r"\b([a-z_][a-z_0-9]*):[a-z_][a-z_0-9]*\s*\(", r"-behaviou?r\(\s*(\w+)\s*\)", r'-include\(\s*"([^"]+)"\s*\)', r'-include_lib\(\s*"([^"]+)"\s*\)'),
}
# Forms of a line by which a file calls another language, and the node it then depends on.
FOREIGN = (
    ("rust", r'#\[link\(name\s*=\s*"([^"]+)"', "native:{}"),
    ("rust", r'(extern\s+"C")', "native:c"),
    ("python", r"(ctypes\.(?:cdll|CDLL|windll|WinDLL))", "native:ctypes"),
    ("python", r"(cffi\.FFI\(\))", "native:cffi"),
    ("java", r'System\.load(?:Library)?\s*\(\s*"([^"]+)"', "native:{}"),
    ("java", r"(com\.sun\.jna\.Library)", "native:jna"),
    ("go", r'(import\s+"C")', "native:cgo"),
    ("typescript", r"""(WebAssembly\.instantiate|\.wasm['"])""", "native:wasm"),
    ("elixir", r"(:erlang\.load_nif|@on_load)", "native:nif"),
    ("elixir", r"(Port\.open|System\.cmd)", "native:port"),
)
# Forms of a declaration, by kind: the visibility or modifier group, then the name.
DECLARATIONS = {
    "rust": (
        ("function", r"^[ \t]*(pub(?:\(crate\)|\(super\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
        ("type", r"^[ \t]*(pub(?:\(crate\)|\(super\))?\s+)?(?:struct|enum|union|type)\s+(\w+)"),
        ("trait", r"^[ \t]*(pub(?:\(crate\)|\(super\))?\s+)?trait\s+(\w+)"),
        ("constant", r"^[ \t]*(pub(?:\(crate\)|\(super\))?\s+)?(?:const|static)\s+(\w+)"),
        ("module", r"^[ \t]*(pub(?:\(crate\)|\(super\))?\s+)?mod\s+(\w+)"),
    ),
    "java": (
        ("class", r"^[ \t]*(public|protected|private)?\s*(?:abstract\s+|final\s+)?class\s+(\w+)"),
        ("interface", r"^[ \t]*(public|protected|private)?\s*interface\s+(\w+)"),
        ("enum", r"^[ \t]*(public|protected|private)?\s*enum\s+(\w+)"),
    ),
    "typescript": (
        ("function", r"^[ \t]*(export\s+)?(?:async\s+)?function\s+(\w+)"),
        ("class", r"^[ \t]*(export\s+)?class\s+(\w+)"),
        ("type", r"^[ \t]*(export\s+)?type\s+(\w+)"),
        ("interface", r"^[ \t]*(export\s+)?interface\s+(\w+)"),
        ("constant", r"^[ \t]*(export\s+)?(?:const|let|var)\s+(\w+)"),
        ("enum", r"^[ \t]*(export\s+)?enum\s+(\w+)"),
        ("module", r"^[ \t]*(export\s+)?namespace\s+(\w+)"),
    ),
    "elixir": (("module", r"^\s*(defmodule)\s+([A-Z][\w.]+)"), ("function", r"^\s*(def|defp|defmacro|defmacrop)\s+(\w+[?!]?)"), ("type", r"^\s*@(type|typep|opaque)\s+(\w+)")),
}
# Attributes above a Rust function that make it an entry point, the first that holds counts.
ENTRIES = ((r"#\[(tokio::)?test", "test function"), (r"#\[(tokio|actix_web)::main\]", "async main"), (r"#\[no_mangle\]", "FFI export"), (r"#\[wasm_bindgen", "WASM export"))
# Names before a parenthesis that are no calls.
NO_CALLS = ("if", "match", "while", "for", "return", "let", "use", "mod", "pub", "fn", "impl", "struct")


def rust_module(path: Column) -> Column:
    """Module path of a file: without a leading src, the ending, and a last mod or lib."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.rs\z", "")
    inner = F.regexp_replace(plain, r"(^|/)(mod|lib)\z", "")
    return F.when(inner == "", "crate").otherwise(F.concat(F.lit("crate::"), F.replace(inner, F.lit("/"), F.lit("::"))))


def owner(lines: DataFrame, language: str) -> Column:
    """The node that a file's imports start from."""
    if language == "rust":
        return rust_module(F.col("path"))
    plain = F.regexp_replace("path", r"\.[A-Za-z]+\z", "")
    return F.translate(plain, "/", ".") if language == "python" else plain


def first_form(line: Column, forms: tuple[str, ...]) -> Column:
    """What the first matching form names, or null."""
    found = [F.when(line.rlike(f), F.regexp_extract(line, f, 1)) for f in forms]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def imports(lines: DataFrame, language: str) -> DataFrame:
    """Edges (src, dst, weight, kind) of imports: equal ones summed, none of a node to itself."""
    target = first_form(F.col("line"), IMPORTS[language])
    if language == "rust":
        target = F.concat(F.lit("crate::"), F.regexp_replace(target, r":+\z", ""))
    rows = lines.select(owner(lines, language).alias("src"), target.alias("dst")).where("dst is not null and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("kind", F.lit("import"))


def foreign_calls(lines: DataFrame, language: str) -> DataFrame:
    """Edges (src, dst, kind) of a file to what it calls in other languages: one of each."""
    found = []
    for known, form, to in FOREIGN:
        if known == language:
            name = F.regexp_extract("line", form, 1)
            found.append(F.when(F.col("line").rlike(form), F.concat(F.lit("native:"), name) if "{}" in to else F.lit(to)))
    rows = lines.select(owner(lines, language).alias("src"), F.explode(F.array_compact(F.array(*found))).alias("dst"))
    return rows.distinct().withColumn("kind", F.lit("ffi"))


def bridges(stubs: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) between every two languages that have stubs (service, language) of one service; languages of a service are few."""
    plain = stubs.select("service", "language").distinct()
    other = plain.select("service", F.col("language").alias("other"))
    named = lambda c: F.concat(c, F.lit(":"), "service")
    return plain.join(other, "service").where("language < other").select(named(F.col("language")).alias("src"), named(F.col("other")).alias("dst"), F.lit("ipc").alias("kind"))


def declarations(lines: DataFrame, language: str) -> DataFrame:
    """Declarations (name, kind, visibility, path, line_no, entry_reason)."""
    line = F.col("line")
    forms = F.array_compact(F.array(*(F.when(line.rlike(f), F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_extract(line, f, 1)).alias("mark"), F.regexp_extract(line, f, 2).alias("name"))) for kind, f in DECLARATIONS[language])))
    rows = lines
    reason = F.lit(None).cast("string")
    if language == "rust":
        above = F.concat_ws("\n", F.collect_list("line").over(Window.partitionBy("path").orderBy("line_no").rowsBetween(-3, 0)))
        rows = lines.withColumn("above", above)
        for form, why in reversed(ENTRIES):
            reason = F.when(F.col("above").rlike(form), why).otherwise(reason)
        reason = F.when(reason.isNull() & (F.col("d.name") == "main"), "main function").when(reason.isNull() & (F.col("d.name") == "new"), "constructor").otherwise(reason)
        reason = F.when(F.col("d.kind") == "function", reason)
    found = rows.select("*", F.explode(forms).alias("d"))
    mark = F.col("d.mark")
    if language == "rust":
        visible = F.when(mark == "", "private").when(mark.startswith("pub(crate)"), "pub_crate").when(mark.startswith("pub(super)"), "pub_super").otherwise("public")
        name = F.concat(rust_module(F.col("path")), F.lit("::"), "d.name")
    elif language == "java":
        visible, name = F.when(mark == "", "internal").otherwise(mark), F.col("d.name")
    elif language == "typescript":
        visible, name = F.when(mark == "", "private").otherwise("public"), F.col("d.name")
    else:
        visible, name = F.when(mark.isin("defp", "defmacrop", "typep", "opaque"), "private").otherwise("public"), F.col("d.name")
    return found.select(name.alias("name"), F.col("d.kind").alias("kind"), visible.alias("visibility"), "path", "line_no", reason.alias("entry_reason"))


def references(lines: DataFrame) -> DataFrame:
    """References (path, symbol, line_no) of Rust lines: paths of two parts and their last part, a type on their left, calls and methods, once a line."""
    line = F.col("line")
    pairs = F.regexp_extract_all(line, F.lit(r"\w+::\w+"), F.lit(0))
    last = F.transform(pairs, lambda p: F.regexp_extract(p, r"::(\w+)", 1))
    types = F.filter(F.transform(pairs, lambda p: F.regexp_extract(p, r"^(\w+)::", 1)), lambda t: t.rlike("^[A-Z]"))
    calls = F.filter(F.regexp_extract_all(line, F.lit(r"\b(\w+)\("), F.lit(1)), lambda c: ~c.isin(*NO_CALLS))
    return lines.select("path", "line_no", F.explode(F.array_distinct(F.concat(pairs, last, types, calls))).alias("symbol"))


def excerpt(elements: DataFrame, symbol: Column) -> DataFrame:
    """Of elements (path, line_no, kind, text) the best of each file for a symbol: the first that has it as a whole name, else the first that has it at all; imports and test blocks never."""
    rows = elements.where(~F.col("kind").isin("import", "test_block")).withColumn("symbol", symbol).where(F.col("text").contains(F.col("symbol")))
    whole = F.regexp_like("text", F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), "symbol", F.lit(r"\E(?![A-Za-z0-9_])")))
    best = F.min(F.struct((~whole).alias("partly"), "line_no", "kind", "text"))
    return rows.groupBy("path", "symbol").agg(best.alias("b")).select("path", "symbol", "b.line_no", "b.kind", (~F.col("b.partly")).alias("whole_name"))


# Forms of modules and dependencies in files of a project, by its manifest.
MODULES = {
    "mix.exs": r"defmodule\s+(\S+)",
    "Cargo.toml": r"(?:pub\s+)?mod\s+(\w+)",
    "go.mod": r"^package\s+(\w+)",
    "package.json": r"export\s+(?:class|function)\s+(\w+)",
    "pom.xml": r"(?:class|interface)\s+(\w+)",
    "pyproject.toml": r"^(?:class|def)\s+(\w+)",
}
# What a marker file offers: command, filter, savings.
OFFERS = (
    ("Cargo.toml", "cargo test", "test-summary", "90-95%"), ("pyproject.toml", "pytest", "test-summary", "90-95%"), ("setup.py", "pytest", "test-summary", "90-95%"), ("package.json", "jest/vitest", "test-summary", "90-95%"),
    ("mix.exs", "mix test", "test-summary", "90-95%"), ("go.mod", "go test ./...", "test-summary", "90-95%"), ("Cargo.toml", "cargo clippy", "lint-dedup", "80-85%"), ("pyproject.toml", "ruff check .", "lint-dedup", "80-85%"),
    (".eslintrc.json", "eslint src/", "lint-dedup", "80-85%"), (".eslintrc.js", "eslint src/", "lint-dedup", "80-85%"), ("biome.json", "biome check", "lint-dedup", "80-85%"), (".git", "git diff", "diff-filter", "40-80%"),
    ("Cargo.toml", "cargo build", "log-distill", "60-90%"), ("package.json", "npm run build", "log-distill", "60-90%"), ("Makefile", "make", "log-distill", "60-90%"),
)


def modules(lines: DataFrame, manifest: str, most: int = 50) -> DataFrame:
    """The first `most` module names (project, module) in the order of path and line of each project (project, path, line_no, line)."""
    form = MODULES[manifest]
    rows = lines.select("project", "path", "line_no", F.regexp_extract("line", form, 1).alias("module")).where("module <> ''")
    if manifest == "go.mod":
        # Packages, of which several files tell, are listed once, by name.
        rows = rows.select("project", F.col("module").alias("path"), F.lit(0).alias("line_no"), "module").distinct()
    rank = F.row_number().over(Window.partitionBy("project").orderBy("path", "line_no"))
    return rows.withColumn("r", rank).where(F.col("r") <= most).select("project", "module", "r")


def cargo_dependencies(lines: DataFrame) -> DataFrame:
    """Distinct names (project, name) in the [dependencies] section of manifests (project, line_no, line)."""
    line = F.trim("line")
    upto = Window.partitionBy("project").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(line.rlike(r"^\[([^\]]+)\]"), F.trim(F.regexp_extract(line, r"^\[([^\]]+)\]", 1))), ignorenulls=True).over(upto)
    rows = lines.withColumn("section", section).where(F.col("section") == "dependencies")
    return rows.select("project", F.regexp_extract(line, r"^([\w][\w-]*)\s*[=.]", 1).alias("name")).where("name <> ''").distinct()


def offers(markers: DataFrame) -> DataFrame:
    """What the marker files (project, file) of a project offer: (project, command, filter, savings)."""
    known = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("marker", "command", "filter", "savings"), row))) for row in OFFERS)))
    return markers.select("project", "file", known.alias("o")).where("file = o.marker").select("project", "o.command", "o.filter", "o.savings")
