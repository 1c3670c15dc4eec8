"""Small operators: settings in code, coverage gates, text scrubbing, checklists, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import trim
from sparkloom.operators.web import decode

# Settings that belong outside the code, and mail domains that do not count.
MODEL = r"""["'](?:claude|gpt|gemini|o[1-4]|codex)[-\w]*?-[0-9]{8}["']"""
EMAIL = r"""["'][a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}["']"""
KEY = r"""["'](?:sk-|pk_|sk_|rk_|whsec_|xoxb-|xoxp-|ghp_|gho_|glpat-|AKIA)[A-Za-z0-9_-]{10,}["']"""
URL = r"""["'](https?://[^\s"']+|wss?://[^\s"']+)"""
KNOWN_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "example.com", "example.org", "schema.org", "w3.org", "www.w3.org", "json-schema.org", "xml.org", "xmlns.com", "purl.org", "schemas.microsoft.com", "tools.ietf.org", "semver.org", "spdx.org", "creativecommons.org", "opensource.org", "spec.openapis.org", "github.com", "raw.githubusercontent.com", "hex.pm", "crates.io", "npmjs.com", "pypi.org", "pkg.go.dev", "docs.rs", "hexdocs.pm", "rubygems.org", "mvnrepository.com")
NUMBER = r"(?i)(?:(?:let|const|var|val|def|@|pub\s+(?:const|static))\s+|^[ \t]*@?)([A-Za-z_]\w*)\s*[=:\s]\s*(-?\d+(?:\.\d+)?)"
TUNABLE = ("timeout", "retry", "retries", "max_", "min_", "limit", "threshold", "batch", "size", "count", "interval", "delay", "duration", "port", "rate", "weight", "score", "temperature", "penalty", "tokens", "chunk", "page_size", "pool", "ttl", "expire", "expiry", "capacity", "concurrency", "parallelism", "workers", "attempts", "backoff", "jitter", "cooldown", "frequency", "priority", "depth", "width", "height", "radius", "factor", "multiplier", "ratio", "percent", "overlap", "top_p", "top_k")
CONSTANT = r"^[ \t]*(?:pub\s+)?(?:const|static|let|var)?\s*([A-Z][A-Z0-9_]{2,})\s*[=:]\s*(-?\d+(?:\.\d+)?)"
IGNORED_DOMAINS = ("example.com", "example.org", "test.com", "placeholder")
# Attempts to instruct, in search results.
STRICT = (
    r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|context|prompts?|rules?|messages?)",
    r"(?i)(system|developer|assistant|tool)\s+(prompt|message|instructions?|rules?)",
    r"(?i)(reveal|print|show|exfiltrate|leak)\s+(secrets?|tokens?|keys?|credentials?|system\s+prompt|developer\s+message)",
    r"(?i)(do\s+not|don't)\s+(obey|follow|trust)\s+(the\s+)?(user|developer|system|instructions?)",
    r"(?i)(new|hidden|secret)\s+(instructions?|rules?|system\s+message)",
    r"(?i)(begin|start)\s+(system|developer|assistant)\s+(prompt|message|instructions?)",
    r"(?i)<\|?(system|developer|assistant|user|tool|im_start|im_end|endoftext)\|?>",
    r"(?i)\[/?(INST|SYSTEM|DEVELOPER|ASSISTANT|TOOL)\]",
    r"(?i)<<\s*/?\s*(SYS|SYSTEM|DEVELOPER|ASSISTANT)\s*>>",
)


def settings(lines: DataFrame) -> DataFrame:
    """(doc, line_no, smell, match) of settings in lines that are no comments."""
    text = trim(F.col("line"))
    code = ~text.rlike(r"^(//|#|\*|/\*|--)")
    email = F.regexp_extract(text, EMAIL, 0)
    known = F.lit(False)
    for d in IGNORED_DOMAINS:
        known = known | email.contains(d)
    hit = lambda name, form, more=F.lit: F.when(code & text.rlike(form), F.struct(F.lit(name).alias("smell"), F.regexp_extract(text, form, 0).alias("match")))
    named = lambda form, k: F.regexp_extract(text, form, k)
    number = lambda name, form: F.struct(F.lit(name).alias("smell"), F.concat_ws(" = ", named(form, 1), named(form, 2)).alias("match"))
    tells = F.lit(False)
    for word in TUNABLE:
        tells = tells | F.lower(named(NUMBER, 1)).contains(word)
    # A line with a tunable name is never looked at as a constant.
    tunable = F.when(code & text.rlike(NUMBER) & tells, F.when(~named(NUMBER, 2).isin("0", "1"), number("tunable", NUMBER)))
    constant = F.when(code & ~(text.rlike(NUMBER) & tells) & text.rlike(CONSTANT) & ~named(CONSTANT, 2).isin("0", "1") & ~F.lower(named(CONSTANT, 1)).rlike("exit|version"), number("constant", CONSTANT))
    urls = F.filter(F.regexp_extract_all(text, F.lit(URL), F.lit(1)), lambda u: ~F.exists(F.array(*map(F.lit, KNOWN_HOSTS)), lambda h: u.contains(h)))
    urls = F.when(code, F.transform(urls, lambda u: F.struct(F.lit("url").alias("smell"), u.alias("match")))).otherwise(F.slice(F.transform(urls, lambda u: F.struct(F.lit("url").alias("smell"), u.alias("match"))), 1, 0))
    found = F.concat(F.array_compact(F.array(hit("model_id", MODEL), F.when(~known, hit("email", EMAIL)), hit("key", KEY), tunable, constant)), urls)
    return lines.select("doc", "line_no", F.explode(found).alias("s")).select("doc", "line_no", "s.*")


def coverage_gate(files: DataFrame, functions: DataFrame, baseline: float = 80.0) -> DataFrame:
    """Violations of files (file, found, hit) and their functions (file, name, cc, documented).

    Very complex functions always violate; complex ones need 90 % coverage and documentation; files the baseline.
    """
    pct = F.when(F.col("found") > 0, F.col("hit") / F.col("found") * 100).otherwise(100.0)
    rated = files.select("file", pct.alias("coverage"))
    joined = functions.join(rated, "file")
    row = lambda df, rule, need: df.select("file", "name", F.lit(rule).alias("rule"), F.lit(need).alias("required"))
    complex_ = joined.where("cc >= 15 and cc < 25")
    out = row(joined.where("cc >= 25"), "refactor", 95.0).unionByName(row(complex_.where("coverage < 90"), "coverage", 90.0)).unionByName(row(complex_.where("not documented"), "documentation", 90.0))
    return out.unionByName(row(rated.where(F.col("coverage") < baseline).withColumn("name", F.lit(None).cast("string")), "baseline", baseline))


def scrub(text: Column, limit: int = 240) -> Column:
    """Search text without markup and control characters, with single blanks, cut to `limit` characters and an ellipsis; null if it tries to instruct."""
    for tag in ("script", "style", "noscript"):
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?is)<!--.*?-->", " "), r"(?is)<[^>]*>", " ")
    text = trim(F.regexp_replace(decode(text), r"[\x00-\x1F\x7F-\x9F\s]+", " "))
    blocked = F.lit(False)
    for pattern in STRICT:
        blocked = blocked | text.rlike(pattern)
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
    return F.when(~blocked, cut)


def for_terminal(text: Column) -> Column:
    """Text with line ends and tabs spelled out, escape sequences dropped, other control characters as question marks."""
    for char, spelled in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(spelled))
    text = F.regexp_replace(text, "\x1b[^A-Za-z]*[A-Za-z]?", "")
    return F.regexp_replace(text, r"[\x00-\x1F]", "?")


def seconds(duration: Column) -> Column:
    """Seconds of durations like 7d, 2h, 30m, 90s; null for others."""
    unit = F.regexp_extract(F.trim(duration), r"^[0-9]+([smhd])\z", 1)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.regexp_extract(F.trim(duration), r"^([0-9]+)", 1).try_cast("bigint") * factor


def generated(path: Column, head: Column) -> Column:
    """Whether a file is generated, by its name or its first line with text among five."""
    name = F.element_at(F.split(path, "/"), -1)
    first = F.get(F.filter(F.slice(F.split(head, "\n"), 1, 5), lambda x: trim(x) != ""), 0)
    return name.contains(".generated.") | F.coalesce(first.contains("@generated"), F.lit(False))


def transition(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items (id, status, claimed_by, completed_at) after changes (id, status, at): a change clears the claim and sets the time only when it completes. Of changes at one time the greatest status counts."""
    last = changes.groupBy("id").agg(F.max(F.struct("at", F.col("status").alias("to"))).alias("c"))
    moved = items.join(last, "id", "left")
    return moved.select("id", F.coalesce("c.to", "status").alias("status"), F.when(F.col("c").isNull(), F.col("claimed_by")).alias("claimed_by"), F.when(F.col("c").isNull(), F.col("completed_at")).when(F.col("c.to") == "completed", F.col("c.at")).alias("completed_at"))


def newest(outputs: DataFrame, keep: int = 20, tie: str = "command") -> DataFrame:
    """The newest outputs (command, ts, ...) of each command; of those of one time, the greatest `tie` first."""
    return outputs.withColumn("r", F.row_number().over(Window.partitionBy("command").orderBy(F.desc("ts"), F.desc(tie)))).where(F.col("r") <= keep).drop("r")


def upsert(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of the same key replaced and new ones added."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows)


def reconcile(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk, sent, inserted, updated, skipped, failed) whose counts do not add up."""
    return chunks.where("sent <> inserted + updated + skipped + failed")


def render(edges: DataFrame, form: str, limit: int = 50) -> str:
    """A small graph (src, dst, weight) as mermaid or csv text; over `limit` edges only their number."""
    rows = edges.orderBy("src", "dst").limit(limit + 1).collect()
    if len(rows) > limit:
        return f"{edges.count()} edges"
    if form == "csv":
        return "src,dst,weight\n" + "".join(f"{r.src},{r.dst},{r.weight}\n" for r in rows)
    return "graph TD\n" + "".join(f'  "{r.src}" --> "{r.dst}"\n' for r in rows)
