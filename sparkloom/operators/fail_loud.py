"""Code that hides failures: blocks of source that handle an error, and what they answer instead of it.

Python handlers come from the syntax tree; in other languages a block begins at a form of line and ends with its braces,
an approximation. A Python worker cuts blocks (Arrow batches in and out); what they say is judged natively.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.code import end_of_block

BLOCKS = "path string, ext string, kind string, line int, text string"
# How a block begins, by kind and file ending.
STARTS = {
    "rs": (("match_arm", r"^\s*Err\b.*=>"), ("if", r"\bif\b.*\bErr\b"), ("let", r"^\s*let\s+_\w*\s*="), ("call", r"\.ok\(\)|\.unwrap_or_default\(\)")),
    "js": (("catch", r"\bcatch\b\s*(\(|\{)"), ("promise", r"\.catch\s*\(")),
    "go": (("if", r"\bif\b.*(err != nil|nil != err)"),),
    "ex": (("error", r"\{:error\b.*->"), ("rescue", r"^\s*rescue\b")),
    "java": (("catch", r"\bcatch\b\s*(\(|\{)"),),
}
SAME_AS = {"ts": "js", "tsx": "js", "jsx": "js", "exs": "ex", "cs": "java", "kt": "java"}
# What blocks answer.
LOUD = ("notimplemented", "not implemented", "unsupportedoperation", "todo!()", "unimplemented!()", "raise notimplementederror", "throw new error(\"not implemented", "throw new notimplemented", "errors.new(\"not implemented", "{:error, :not_implemented}")
DEFAULTS = ("return []", "return {}", "return none", "return null", "return true", "return {\"success\": true", "return {'success': true", "return { success: true", "return promise.resolve([]", "return promise.resolve({", "pass")
RUST_OK = ("Ok(())", "Ok(vec![])", "Ok(Vec::new())", "Ok(Default::default())", "Ok(None)", "Ok([])", "Ok(true)", "return Ok(")
RUST_CUES = ("err", "error", "vec![]", "vec::new", "default::default", "none", "ok(())")
FALLIBLE = (".send(", ".write", ".flush", ".sync", ".commit", ".rollback", ".execute", ".request", ".call", ".save", ".delete", ".remove", ".insert", ".update")
ERASED = (".send(", ".write", ".flush", ".sync", ".commit", ".execute", ".request", ".call", ".save", ".delete", ".insert", ".update")
GO_OK = ("return nil", "return nil, nil", "return []", "return true, nil", "return false, nil", "return \"\", nil", "return 0, nil")
ELIXIR_OK = ("{:ok, []}", "{:ok, %{}}", "{:ok, nil}", "{:ok, true}", "{:ok, \"\"}")
JAVA_OK = ("return ok(", "return new list", "return collections.emptylist", "return enumerable.empty", "return task.completedtask", "return null", "return true", "return false")
MOCKS = ("mock", "fake", "sample", "dummy", "placeholder", "stub", "demo")
JS_CATCH = ("=> []", "=> ({", "=> null", "=> true")


def python_blocks(text: str) -> list[tuple[str, int, str]]:
    """Handlers of exceptions, from the syntax tree; none where a text is no Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = text.split("\n")
    return [("except", n.lineno, "\n".join(lines[n.lineno - 1 : n.end_lineno])) for n in ast.walk(tree) if isinstance(n, ast.ExceptHandler)]


def brace_blocks(text: str, ext: str) -> list[tuple[str, int, str]]:
    lines, found = text.split("\n"), []
    for k, line in enumerate(lines):
        for kind, form in STARTS[ext]:
            if m := re.search(form, line):
                # Braces before the block on its line are not its own.
                own = [line[m.start() :], *lines[k + 1 :]]
                last = k + end_of_block(own, 0) if "{" in own[0] and kind not in ("let", "call") else k
                if ext == "ex":
                    last = min(k + 4, len(lines) - 1) if kind == "rescue" else k
                found.append((kind, k + 1, "\n".join(lines[k : last + 1])))
    return found


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ext = (path or "").rsplit(".", 1)[-1]
            ext = SAME_AS.get(ext, ext)
            blocks = python_blocks(text or "") if ext == "py" else brace_blocks(text or "", ext) if ext in STARTS else []
            rows += [(path, ext, *b) for b in blocks]
        kinds = [pa.string()] * 3 + [pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "ext", "kind", "line", "text"])


def has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def findings(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """(path, line, finding) of files (path, text); tests and fixtures are left out unless asked for."""
    rows = files if include_tests else files.where(~F.col("path").rlike(r"(^|/)(tests?|fixtures?|__tests__)/|_test\.|\.test\.|\.spec\.|(^|/)test_"))
    blocks = rows.select("path", "text").mapInArrow(block_batches, BLOCKS)
    text, low = F.col("text"), F.lower("text")
    of = lambda ext, kind: (F.col("ext") == ext) & (F.col("kind") == kind)
    rust_ok = has(text, RUST_OK) & has(low, RUST_CUES)
    mock = low.contains("return") & has(low, MOCKS)
    rules = (
        ("rust_err_ok_default", of("rs", "match_arm") & rust_ok),
        ("rust_iferr_ok_default", of("rs", "if") & rust_ok),
        ("rust_ignored_fallible", of("rs", "let") & text.contains("(") & has(low, FALLIBLE)),
        ("rust_result_erasure", of("rs", "call") & has(low, ERASED)),
        ("python_except_default", of("py", "except") & has(low, DEFAULTS)),
        ("js_catch_default", of("js", "catch") & (has(low, DEFAULTS) | mock)),
        ("js_promise_catch_default", of("js", "promise") & (has(low, DEFAULTS) | has(text, JS_CATCH))),
        ("go_err_nil_success", of("go", "if") & has(low, GO_OK)),
        ("elixir_error_ok_default", of("ex", "error") & has(text, ELIXIR_OK)),
        ("elixir_rescue_ok_default", of("ex", "rescue") & has(text, ELIXIR_OK)),
        ("jvm_dotnet_catch_default", of("java", "catch") & (has(low, JAVA_OK) | mock)),
    )
    found = F.array_compact(F.array(*(F.when(rule & ~has(low, LOUD), F.lit(name)) for name, rule in rules)))
    return blocks.select("path", "line", F.explode(found).alias("finding"))


def placeholder_lines(lines: DataFrame) -> DataFrame:
    """Lines (path, line_no, line) that are comments with a word for unfinished work, or declare made-up data."""
    line = F.trim("line")
    comment = line.rlike(r"^(//|#|/\*|\*|--)") & F.lower(line).rlike(r"(^|[^a-z0-9_])(todo|fixme|stub|placeholder|temporary)([^a-z0-9_]|$)")
    mock = F.lower(line).rlike("mock_?data|fake_?users|sample_?orders|dummy_?data|placeholder_?data") & line.rlike(r"[\[{]|vec!\[|new List")
    kind = F.when(comment, "placeholder_comment").when(mock, "mock_leak_runtime")
    return lines.withColumn("finding", kind).where("finding is not null").select("path", "line_no", "finding")
