"""Scalar text functions as native column expressions.

Expressions match on explicit ASCII classes where results are compared with another engine; `(?U)` is used where the
meaning is Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 4.0


def lines(text: Column) -> Column:
    """Array of lines: cut at line feeds, one trailing carriage return dropped, no empty line after a final line feed."""
    cut = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    return F.when((text == "") | text.isNull(), F.array().cast("array<string>")).otherwise(F.transform(cut, lambda x: F.regexp_replace(x, r"\r\z", "")))


def explode_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line), numbered from 1."""
    return df.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def trim(text: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def strip_ansi(text: Column) -> Column:
    """Without terminal colour and cursor sequences."""
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[a-zA-Z]", "")


def tokens(n_bytes: Column) -> Column:
    """Estimated tokens of a number of bytes, towards zero."""
    return (n_bytes / F.lit(BYTES_PER_TOKEN)).cast("bigint")


def dash(text: Column) -> Column:
    """Lower-case words of letters and digits, joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) in a namespace given as 32 hexadecimal digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def truncate_utf8(text: Column, n: int) -> Column:
    """The longest prefix of at most n UTF-8 bytes that ends between characters."""
    return F.when(F.octet_length(text) <= n, text).otherwise(_fitting(text, n))


def _fitting(text: Column, n: int) -> Column:
    # A character has at most four bytes, so n // 4 characters always fit and more than n never do.
    chars = F.length(text)
    least = F.greatest(F.lit(0), F.floor(F.lit(n) / 4)).cast("int")
    return F.aggregate(F.sequence(least, F.least(chars, F.lit(n))), F.lit(""), lambda best, k: F.when(F.octet_length(F.substring(text, F.lit(1), k)) <= n, F.substring(text, F.lit(1), k)).otherwise(best))


def mask(secret: Column) -> Column:
    """All stars up to eight characters; else the first and last four stay."""
    n = F.length(secret)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(secret, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(secret, F.lit(4))))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def complexity(source: Column) -> Column:
    """One plus the number of branching words and operators."""
    return F.lit(1) + F.regexp_count(source, F.lit(r"\b(if|elif|while|for|case|catch|except|rescue)\b|\?\?|&&|\|\|"))


def semver(version: Column) -> Column:
    """(major, minor, patch) of a version, null if it has none: a leading v dropped, cut at the first - or +, missing parts zero, what follows the digits of the patch ignored."""
    form = r"^\s*v?([0-9]{1,9})(?:\.([0-9]{1,9}))?(?:\.([0-9]{0,9})[^-+]*)?(?:[-+].*)?\s*\z"
    number = lambda i: F.coalesce(F.regexp_extract(version, form, i).try_cast("int"), F.lit(0))
    return F.when(version.rlike(form), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def satisfies(version: Column, operator: Column, bound: Column) -> Column:
    """Whether a version stands in a relation (<, <=, >, >=, ==) to another."""
    a, b = semver(version), semver(bound)
    return F.coalesce(F.when(operator == "<", a < b).when(operator == "<=", a <= b).when(operator == ">", a > b).when(operator == ">=", a >= b).when(operator == "==", a == b), F.lit(False))
