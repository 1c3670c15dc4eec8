"""Secret scans: fixed patterns plus sliding-window entropy over candidate strings.

A candidate is a maximal run of key characters. A window of WINDOW characters slides over it; entering and leaving
characters change counts and the sum of c*log2(c), so each step costs the same whatever the window. Windows that reach
the threshold of their character class, joined where they overlap, are hot pieces: `hex` (hexadecimal digits only),
`letters` (no digit) or `base64`. The allow-list judges the hot piece itself, never what stands beside it: identifiers,
words in any case style, paths, placeholders and numbers are suppressed, and so is what a pattern span covers.

A map over rows: no shuffle, one slice of text in memory.

Defined cases: null text counts as empty and has no spans; null and repeated ids are passed through row by row; an
empty table gives no rows; columns other than doc_id and text are ignored; texts of any length are scanned whole, in
time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import slices, table, texts

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_letters", "entropy_base64")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
# A run too short cannot hold a passing match, so the least lengths may stand in these two patterns.
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")

WINDOW = 20
#: Bits a character from which a window of each class is hot.
THRESHOLDS = {"hex": 3.0, "letters": 3.4, "base64": 3.7}
CLASSES = (("hex", re.compile(rb"[0-9a-fA-F]*")), ("letters", re.compile(rb"[^0-9]*")), ("base64", re.compile(rb".*")))
#: What a hot piece may be, as a whole.
ALLOWED = [
    re.compile(p)
    for p in (
        rb"[0-9a-fA-F]{0,8}(-[0-9a-fA-F]{4}){2,3}-[0-9a-fA-F]{0,12}",  # UUIDs
        rb"[^A-Za-z]*",  # numbers
        rb"(?i).*(example|placeholder|changeme|your[_-]?(api|key|token|secret)|x{6,}|0{8,}).*",
        rb"(?i).*(abcdefgh|0123456789|123456789|qwerty).*",
        rb"(?:[A-Za-z]{2,}[0-9]{0,4}[/_=-]+)+[A-Za-z]*[0-9]{0,4}",  # paths and names with a number
        rb"(?i)sha(256|384|512)-.*",  # integrity hashes
    )
]
#: Parts of words in any case style, as they stand in identifiers and paths; consonants that no word has in a row.
WORD_PART = re.compile(rb"[A-Z]?[a-z]{3,}|[A-Z]{3,}|(?<![A-Za-z])[a-z]{1,2}(?![A-Za-z])|[/_=+-]+")
HARSH = re.compile(rb"[bcdfghjklmnpqrstvwxz]{5,}", re.I)
VOWELS = b"aeiouyAEIOUY"
#: Share of a piece of letters that parts of words cover, and of its letters that are vowels, if it is words.
WORDS_COVER, VOWEL_SHARE = 0.8, 0.25
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"

_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def hot_windows(text: bytes, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined spans of the windows whose entropy reaches `threshold`; counts change by one character a step."""
    if len(text) < window:
        return []
    clog = _CLOG if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts = [0] * 256
    total = 0.0
    for ch in text[:window]:
        total += clog[counts[ch] + 1] - clog[counts[ch]]
        counts[ch] += 1
    most = (math.log2(window) - threshold) * window + 1e-9
    found: list[tuple[int, int]] = []
    for start in range(len(text) - window + 1):
        if start:
            out, new = text[start - 1], text[start + window - 1]
            total += clog[counts[out] - 1] - clog[counts[out]]
            counts[out] -= 1
            total += clog[counts[new] + 1] - clog[counts[new]]
            counts[new] += 1
        if total <= most:
            if found and found[-1][1] >= start:
                found[-1] = (found[-1][0], start + window)
            else:
                found.append((start, start + window))
    return found


def of_words(piece: bytes) -> bool:
    """Whether a piece without digits is made of words: long runs of one case, vowels enough, no long row of consonants."""
    letters = len(re.findall(rb"[A-Za-z]", piece))
    if len(HARSH.findall(piece)) or sum(c in VOWELS for c in piece) < VOWEL_SHARE * letters:
        return False
    return sum(len(m[0]) for m in WORD_PART.finditer(piece)) >= WORDS_COVER * len(piece)


def allowed(piece: bytes) -> bool:
    return any(p.fullmatch(piece) for p in ALLOWED) or (not re.search(rb"[0-9]", piece) and of_words(piece))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in bytes, by start and kind."""
    spans = []
    if b":" in text or b"=" in text:
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def entropy_spans(text: bytes, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of high-entropy stretches of candidates that no known span (sorted by start) covers."""
    starts = [s for s, _, _ in known]
    reach = list(accumulate((e for _, e, _ in known), max))
    spans = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        kind = next(k for k, (_, p) in enumerate(CLASSES) if p.fullmatch(run))
        for a, b in hot_windows(run, THRESHOLDS[CLASSES[kind][0]]):
            if allowed(run[a:b]):
                continue
            a, b = a + m.start(), b + m.start()
            before = bisect_right(starts, a)
            if not before or reach[before - 1] < b:
                spans.append((a, b, 3 + kind))
    return spans


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if not spans or text.isascii():
        return spans
    points = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=points[1:])
    return [(int(points[a]), int(points[b]), k) for a, b, k in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, "text")):
            base = base_spans(text)
            more = entropy_spans(text, base)
            spans = in_code_points(text, base + more)
            kinds = [k for _, _, k in base]
            rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(spans[: len(base)]).encode()).hexdigest(), joined(spans), len(more)))
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in each row of (doc_id, text): counts by pattern, digest of pattern spans, all spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan_batches, SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    return scan_secrets(table(spark, sf_dir, "documents"))
