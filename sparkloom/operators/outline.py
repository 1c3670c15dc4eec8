"""Outlines of source files by line forms, the first form of a language that fits a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms by language, in the order they are tried: kind, visibility, form; its group is the name.
FORMS = {
    "rust": (
        ("import", "", r"^\s*use\s+(.+);"),
        ("constant", "", r"^\s*(?:pub\s+)?(?:const|static)\s+(\w+)"),
        ("function", "public", r"^\s*pub\s+(?:async\s+)?fn\s+(\w+)"),
        ("function", "private", r"^\s*fn\s+(\w+)"),
        ("type", "", r"^\s*(?:pub\s+)?(?:struct|enum|trait|type)\s+(\w+)"),
        ("module", "", r"^\s*(?:pub\s+)?mod\s+(\w+)"),
    ),
    "elixir": (
        ("module", "", r"^\s*defmodule\s+([\w.]+)"),
        ("function", "public", r"^\s*def\s+(\w+)"),
        ("function", "private", r"^\s*defp\s+(\w+)"),
        ("type", "", r"^\s*@(?:type|typep|opaque)\s+(\w+)"),
        ("callback", "", r"^\s*@callback\s+(\w+)"),
        ("spec", "", r"^\s*@spec\s+(\w+)"),
        ("import", "", r"^\s*(?:use|import|alias)\s+(.+)"),
        ("constant", "", r"^\s*@(?!(?:doc|moduledoc|spec|type|typep|callback|impl|behaviour|derive|enforce_keys|typedoc|opaque)\b)(\w+)"),
    ),
    "python": (
        ("module", "", r"^\s*class\s+(\w+)"),
        ("function", "private", r"^\s*def\s+(_\w*)\s*\("),
        ("function", "public", r"^\s*def\s+(\w+)\s*\("),
        ("import", "", r"^\s*(import\s+\S+|from\s+\S+\s+import\s+.+)"),
        ("constant", "", r"^\s*([A-Z][A-Z0-9_]+)\s*="),
    ),
    "go": (
        ("module", "", r"^\s*package\s+(\w+)"),
        ("function", "public", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)\s*\("),
        ("function", "private", r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("),
        ("type", "", r"^\s*type\s+(\w+)\s+(?:struct|interface)"),
        ("import", "", r"""^\s*(?:import\s+)?"([^"]+)\""""),
        ("constant", "", r"^\s*(?:const|var)\s+(\w+)"),
    ),
    "typescript": (
        ("module", "", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("type", "", r"^\s*(?:export\s+)?interface\s+(\w+)"),
        ("function", "public", r"^\s*export\s+(?:async\s+)?function\s+(\w+)\s*\("),
        ("function", "private", r"^\s*(?:async\s+)?function\s+(\w+)\s*\("),
        ("type", "", r"^\s*export\s+type\s+(\w+)"),
        ("import", "", r"""^\s*import\s+.*from\s+['"]([^'"]+)['"]"""),
        ("constant", "", r"^\s*(?:export\s+)?const\s+(\w+)"),
    ),
    "java": (
        ("module", "", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+)*(?:class|interface|enum)\s+(\w+)"),
        ("import", "", r"^\s*import\s+(?:static\s+)?(.+);"),
        ("constant", "", r"^\s*(?:public\s+|private\s+|protected\s+)?static\s+final\s+\w+\s+(\w+)"),
        ("function", "public", r"^\s*public\s+(?:(?:static|final|abstract|synchronized)\s+)*(?:\w[\w<>\[\],\s]*\s+)?(\w+)\s*\("),
        ("function", "private", r"^\s*private\s+(?:(?:static|final|abstract|synchronized)\s+)*(?:\w[\w<>\[\],\s]*\s+)?(\w+)\s*\("),
    ),
    "csharp": (
        ("module", "", r"^\s*namespace\s+([\w.]+)"),
        ("import", "", r"^\s*using\s+(?:static\s+)?(.+);"),
        ("type", "", r"^\s*(?:public|private|internal|protected)\s+(?:(?:static|sealed|abstract|partial)\s+)*(?:class|struct|interface|record|enum)\s+(\w+)"),
        ("constant", "", r"^\s*(?:public\s+|private\s+|internal\s+|protected\s+)?(?:const|static\s+readonly)\s+\w+\s+(\w+)"),
        ("function", "public", r"^\s*public\s+(?:(?:static|virtual|override|abstract|async|sealed|new)\s+)*(?:[\w<>\[\]?,\s]+\s+)(\w+)\s*\("),
        ("function", "private", r"^\s*(?:private|internal|protected)\s+(?:(?:static|virtual|override|abstract|async|sealed|new)\s+)*(?:[\w<>\[\]?,\s]+\s+)(\w+)\s*\("),
    ),
    "c": (
        ("import", "", r"""^\s*#include\s+[<"]([^>"]+)[>"]"""),
        ("type", "", r"^\s*(?:class|struct)\s+(\w+)"),
        ("type", "", r"^\s*enum\s+(?:class\s+)?(\w+)"),
        ("module", "", r"^\s*namespace\s+(\w+)"),
        ("constant", "", r"^\s*(?:constexpr|const|static\s+const(?:expr)?)\s+\w+\s+(\w+)"),
        ("function", "public", r"^\s*(?:(?:inline|static|virtual|explicit|constexpr|override)\s+)*(?:[\w:*&<>\[\]]+\s+)+(\w+)\s*\("),
    ),
}


def element(line: Column, language: str) -> Column:
    """(kind, visibility, name) of a line; null if no form fits."""
    out = None
    for kind, visibility, form in FORMS[language]:
        found = F.struct(F.lit(kind).alias("kind"), F.lit(visibility).alias("visibility"), F.regexp_extract(line, form, 1).alias("name"))
        out = F.when(line.rlike(form), found) if out is None else out.when(line.rlike(form), found)
    return out


def outline(lines: DataFrame, language: str) -> DataFrame:
    """(doc, line_no, kind, visibility, name) of numbered lines of one language."""
    return lines.withColumn("e", element(F.col("line"), language)).where("e is not null").select("doc", "line_no", "e.*")


def matching(elements: DataFrame, pattern: str) -> DataFrame:
    """Elements whose name fits a pattern."""
    return elements.where(F.col("name").rlike(pattern))


def lookup(elements: DataFrame, symbol: str) -> DataFrame:
    """Elements that are no imports and hold a symbol; whole words come first."""
    whole = F.col("name").rlike(rf"\b{symbol}\b")
    return elements.where((F.col("kind") != "import") & F.col("name").contains(symbol)).withColumn("rank", F.when(whole, 0).otherwise(1))
