"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose spans, with high recall and overlaps: strict e-mail, internet address, card and phone patterns (those
that pass their checks are the base and always stay; those that fail are never selected), and loose ones (spelled-out
e-mail, phones without country code, national numbers, account numbers), which boosted trees judge. A proposal is put in
few classes by its format (kind, digits, separators, whether its check number holds) and its context (characters beside
it, telling words before it).

The trees learn from a labelled set of EXAMPLES lines for each loose kind, made by rule (pii_examples): right ones in the
contexts such data stand in, and look-alikes in others. One half fits the trees; on the other half each kind gets the
least threshold above which at least PRECISION of the examples are right. The set is the same at every size of input, so
a text gets the same verdict whatever stands beside it, and nothing of the corpus reaches the driver.

Places of matches: a pattern is run once for the matches and once to split, and places are running sums of lengths, kept
by blocks (functions `running`), so that many matches in one text cost little more than their number. The context of a
match reaches back to the match before it at most. Starts are guarded so that a long run of one class of characters is
read once.

Defined cases: null text counts as empty and has no spans; null and repeated ids are judged row by row; an empty table
gives no rows; texts of any length are read whole; spans of different kinds may overlap, and the redaction takes their
union and names it by the span that starts first (ties by kind); it keeps all columns, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh, table
from sparkloom.llm.pii_examples import examples

BASE = ("email", "ip", "card", "phone")
LOOSE = ("email_text", "phone_local", "national", "account")
KINDS = BASE + LOOSE
LOCAL = "A-Za-z0-9._%+-"
# A match starts where the last one ended or where its run of characters starts.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
EMAIL_TEXT = r"(?i)\b[a-z0-9._%+-]{2,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{2,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z]{2,24}){1,3}\b"
PHONE_LOCAL = r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20.-])(?<!\+[0-9]{1,3}\x20\()\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9-]|\.[0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Telling words in the CONTEXT characters before a span, by class; the first class that matches counts.
CUES = (
    r"(?i)\b(?:orders?|invoice|parts?|build|version|model|item|ticket|isbn|ref|serial|sku|page|case|lot|batch|tracking|revision|release)\b[^\n]{0,12}\z",
    r"(?i)\b(?:e-?mail|mail|contact|write|reach|phone|tel|telephone|call|fax|mobile|cell|text|dial)\b[^\n]{0,16}\z",
    r"(?i)\b(?:ssn|social|security|national|insurance|id|identity|born|citizen)\b[^\n]{0,16}\z",
    r"(?i)\b(?:account|iban|bank|pay|transfer|deposit|wire|credit|card|visa)\b[^\n]{0,16}\z",
)
CONTEXT = 32

EXAMPLES = 240
TREES, RATE = 30, 0.3
PRECISION = 0.9
#: Feature, and how many classes it has.
FEATURES = (("kind", 4), ("size", 4), ("separated", 2), ("checked", 2), ("left", 5), ("right", 5), ("cue", 5))
#: Elements that one running value is kept for.
BLOCK = 128
#: Characters of text that are cut out of together.
PIECE = 2000
#: Rows of the labelled set.
EXAMPLE = "array<struct<text:string,kind:int,good:boolean,held_out:boolean>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Of an array, the merged values before each element: by blocks, so that the cost is about BLOCK steps an element."""
    fold = lambda part, start: F.aggregate(part, start, merge)

    def by_values(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(values, b * BLOCK + 1, BLOCK), zero))
        before = let(blocks, lambda sums: F.transform(sums, lambda _, b: fold(F.slice(sums, 1, b), zero)))
        each = lambda at: F.transform(values, lambda _, i: fold(F.slice(values, i - i % BLOCK + 1, i % BLOCK), F.get(at, F.floor(i / BLOCK).cast("int"))))
        return F.when(F.size(values) > 0, let(before, each)).otherwise(F.array().cast("array<int>"))

    return let(values, by_values)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid_ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"\A0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))


def valid_card(match: Column) -> Column:
    number = digits(match)
    return F.length(number).between(14, 19) & luhn(F.substring(number, 1, 19))


def valid_phone(match: Column) -> Column:
    return F.length(digits(match)).between(10, 15)


def valid_local(match: Column) -> Column:
    """Area and exchange that do not begin with 0 or 1."""
    return digits(match).rlike(r"\A[2-9][0-9]{2}[2-9]")


def valid_national(match: Column) -> Column:
    """No group of zeros, and an area that is given out."""
    return ~match.rlike(r"\A(?:000|666|9)|-00-|-0000\z")


def valid_account(match: Column) -> Column:
    """Remainder 1 by 97, the first four characters last and letters as two digits."""
    plain = F.regexp_replace(match, " ", "")
    chars = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c >= "A", a * 100 + F.ascii(c) - 55).otherwise(a * 10 + c.cast("int")) % 97) == 1


@dataclass(frozen=True)
class Generator:
    kind: str
    pattern: str
    #: What a text must have for the pattern to match at all.
    needs: Callable[[Column], Column]
    #: The check: what base matches must pass, and a feature of the loose ones.
    check: Callable[[Column], Column]


GENERATORS = (
    Generator("email", EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    Generator("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), valid_ip),
    Generator("card", CARD, lambda t: t.rlike("[0-9](?:[ -]?[0-9]){13}"), valid_card),
    Generator("phone", PHONE, lambda t: t.contains("+"), valid_phone),
    Generator("email_text", EMAIL_TEXT, lambda t: t.rlike(r"(?i)[\[(] ?at ?[\])]"), lambda m: m.rlike(r"(?i)[\])] ?(?:com|org|net|edu|gov|info|io|de|uk|fr|es|eu)\b|\. ?(?:com|org|net|edu|gov|info|io|de|uk|fr|es|eu)\b")),
    Generator("phone_local", PHONE_LOCAL, lambda t: t.rlike(r"[0-9][ .-][0-9]{4}"), valid_local),
    Generator("national", NATIONAL, lambda t: t.rlike("-[0-9]{2}-"), valid_national),
    Generator("account", ACCOUNT, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), valid_account),
)


def neighbour(char: Column) -> Column:
    """Class of the character beside a span: none (or the next match), blank, letter, digit, other."""
    return F.when(char == "", 0).when(char.rlike(r"\A\s"), 1).when(char.rlike(r"\A\p{L}"), 2).when(char.rlike(r"\A[0-9]"), 3).otherwise(4)


def feature_code(kind: int, match: Column, before: Column, after: Column) -> Column:
    """The classes of a loose proposal as one number; `before` and `after` is the text up to its neighbours."""
    left = F.substring(before, -CONTEXT, CONTEXT)
    cue = F.lit(0)
    for k in reversed(range(len(CUES))):
        cue = F.when(left.rlike(CUES[k]), k + 1).otherwise(cue)
    found = {
        "kind": F.lit(kind - len(BASE)),
        "size": F.least(F.lit(3), F.floor(F.length(digits(match)) / 5)),
        "separated": match.rlike("[ ().-]").cast("int"),
        "checked": F.coalesce(GENERATORS[kind].check(match), F.lit(False)).cast("int"),
        "left": neighbour(F.substring(before, -1, 1)),
        "right": neighbour(F.substring(after, 1, 1)),
        "cue": cue,
    }
    code = F.lit(0)
    for name, n in FEATURES:
        code = code * n + found[name]
    return code.cast("int")


def proposals(text: Column, kind: int) -> Column:
    """Array of (start, kind, end, code) of a generator: matches that pass their check (code -1), or all loose ones."""
    g = GENERATORS[kind]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,code:int>>")

    def placed(x: Column) -> Column:
        matches, gaps = x["matches"], x["gaps"]
        sizes = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(running(sizes, F.lit(0), lambda a, b: a + b), lambda before: F.transform(matches, lambda m, i: let(F.get(before, i) + F.length(F.get(gaps, i)), lambda at: span(m, F.get(gaps, i), F.get(gaps, i + 1), at))))

    def span(match: Column, before: Column, after: Column, at: Column) -> Column:
        code = F.lit(-1) if kind < len(BASE) else feature_code(kind, match, before, after)
        passes = g.check(match) if kind < len(BASE) else F.lit(True)
        out = F.struct(at.cast("int").alias("start"), F.lit(kind).alias("kind"), (at + F.length(match)).cast("int").alias("end"), code.alias("code"))
        return F.when(F.coalesce(passes, F.lit(False)), out)

    found = let(F.struct(F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0)).alias("matches"), F.split(text, g.pattern, -1).alias("gaps")), lambda x: F.filter(placed(x), lambda s: s.isNotNull()))
    return F.when(g.needs(text), found).otherwise(none)


@dataclass(frozen=True)
class Tree:
    """A split on one feature being at most a value, and another split on either side."""

    root: tuple[int, int]
    sides: tuple[tuple[int, int, float, float], tuple[int, int, float, float]]

    def value(self, x: list[int]) -> float:
        feature, cut, low, high = self.sides[0 if x[self.root[0]] <= self.root[1] else 1]
        return low if x[feature] <= cut else high

    def column(self, x: list[Column]) -> Column:
        low, high = (F.when(x[f] <= c, a).otherwise(b) for f, c, a, b in self.sides)
        return F.when(x[self.root[0]] <= self.root[1], low).otherwise(high)


@dataclass(frozen=True)
class Model:
    bias: float
    trees: tuple[Tree, ...]
    #: Least score of each loose kind that is selected.
    thresholds: tuple[float, ...]

    def score(self, x: list[int]) -> float:
        return self.bias + sum(t.value(x) for t in self.trees)

    def selects(self, code: int) -> bool:
        x = unpack(code)
        return self.score(x) >= self.thresholds[x[0]]

    def column(self, code: Column) -> Column:
        """Whether a feature code is selected: the trees as native expressions."""
        return let(F.array(*positions(code)), self.verdict)

    def verdict(self, packed: Column) -> Column:
        x = [F.get(packed, F.lit(k)) for k in range(len(FEATURES))]
        total = F.lit(self.bias)
        for t in self.trees:
            total = total + t.column(x)
        least = F.lit(math.inf)
        for k, value in enumerate(self.thresholds):
            least = F.when(x[0] == k, value).otherwise(least)
        return total >= least


def positions(code: Column) -> list[Column]:
    x: list[Column] = []
    for _, n in reversed(FEATURES):
        x.insert(0, (code % n).cast("int"))
        code = F.floor(code / n)
    return x


def unpack(code: int) -> list[int]:
    x = []
    for _, n in reversed(FEATURES):
        x.insert(0, code % n)
        code //= n
    return x


def best_split(rows: list[tuple[list[int], float, float]]) -> tuple[float, int, int, float, float]:
    """(gain, feature, cut, low value, high value) of the best split of (features, gradient, hessian) rows."""
    g_all, h_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    whole = -g_all / (h_all + 1)
    best = (0.0, 0, 1 << 30, whole, whole)
    for f, (_, n) in enumerate(FEATURES):
        g_at, h_at = [0.0] * n, [0.0] * n
        for x, g, h in rows:
            g_at[x[f]] += g
            h_at[x[f]] += h
        g_low = h_low = 0.0
        for cut in range(n - 1):
            g_low += g_at[cut]
            h_low += h_at[cut]
            g_high, h_high = g_all - g_low, h_all - h_low
            gain = g_low * g_low / (h_low + 1) + g_high * g_high / (h_high + 1) - g_all * g_all / (h_all + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, cut, -g_low / (h_low + 1), -g_high / (h_high + 1))
    return best


def boost(counts: dict[int, tuple[float, float]]) -> Model:
    """Boosted trees for the log-odds of being right, from (right, wrong) counts of feature codes; thresholds are infinite."""
    good, bad = sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())
    never = (math.inf,) * len(LOOSE)
    if not good or not bad:
        return Model(0.0, (), never)
    data = [(unpack(code), *c) for code, c in sorted(counts.items())]
    bias = math.log(good / bad)
    scores = [bias] * len(data)
    trees = []
    for _ in range(TREES):
        rows = []
        for (x, a, b), s in zip(data, scores):
            p = 1 / (1 + math.exp(-s))
            rows.append((x, (a + b) * p - a, (a + b) * p * (1 - p)))
        gain, feature, cut, *_ = best_split(rows)
        if gain <= 1e-9:
            break
        sides = []
        for part in ([r for r in rows if r[0][feature] <= cut], [r for r in rows if r[0][feature] > cut]):
            _, f, c, low, high = best_split(part)
            sides.append((f, c, RATE * low, RATE * high))
        trees.append(Tree((feature, cut), (sides[0], sides[1])))
        scores = [s + trees[-1].value(x) for (x, _, _), s in zip(data, scores)]
    return Model(bias, tuple(trees), never)


def calibrate(model: Model, counts: dict[int, tuple[float, float]]) -> Model:
    """For each loose kind the least score above which PRECISION of the held-out examples are right; infinite where there is none."""
    thresholds = []
    for kind in range(len(LOOSE)):
        rows = sorted(((model.score(unpack(code)), a, b) for code, (a, b) in counts.items() if unpack(code)[0] == kind), reverse=True)
        threshold, right, above = math.inf, 0.0, 0.0
        for k, (s, a, b) in enumerate(rows):
            right, above = right + a, above + a + b
            last = k + 1 == len(rows) or rows[k + 1][0] < s
            if last and right >= PRECISION * above:
                # Half way to the next score: codes that no example had may lie between.
                threshold = s if k + 1 == len(rows) else (s + rows[k + 1][0]) / 2
        thresholds.append(threshold)
    return Model(model.bias, model.trees, tuple(thresholds))


def fit(spark: SparkSession) -> Model:
    """The model of the labelled set: its proposals are made by the same expressions as those of documents."""
    given = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples(EXAMPLES))), EXAMPLE)).alias("e"))
    coded = F.concat(*(proposals(F.col("e.text"), k) for k in range(len(BASE), len(KINDS))))
    found = given.select("e.kind", "e.good", "e.held_out", F.explode(coded).alias("c")).where(F.col("c.kind") == F.col("kind"))
    halves: tuple[dict, dict] = ({}, {})
    for r in found.groupBy("held_out", F.col("c.code").alias("code")).agg(F.count_if("good").alias("right"), F.count_if(~F.col("good")).alias("wrong")).collect():
        halves[r["held_out"]][r["code"]] = (r["right"], r["wrong"])
    return calibrate(boost(halves[0]), halves[1])


def spans_of(text: Column, model: Model) -> Column:
    """Array of (start, kind, end), by start, then kind: the base and what the model selects of the loose proposals."""
    drop = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = [proposals(text, k) for k in range(len(BASE))]
    loose = [F.filter(proposals(text, k), lambda c: model.column(c["code"])) for k in range(len(BASE), len(KINDS))]
    return F.sort_array(F.transform(F.concat(*base, *loose), drop))


def name(kind: Column) -> Column:
    out = F.when(kind == 0, KINDS[0])
    for k, word in enumerate(KINDS):
        out = out.when(kind == k, word)
    return out


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Base counts and digest, and all spans, of each row of (doc_id, text)."""
    model = fit(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans_of(text, model).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{word}") for k, word in enumerate(BASE)), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def cut_out(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text given in pieces of PIECE characters."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    joined = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(joined, (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def without_spans(text: Column, spans: Column) -> Column:
    """`text` with the union of its sorted spans replaced by names."""

    def built(x: Column) -> Column:
        pieces, reach = x["pieces"], x["reach"]
        # A span that starts before the ones before it end only lengthens what is replaced.
        heads = F.filter(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(reach, i), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(reach, i).alias("from")))), lambda h: h.isNotNull())
        rest = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        parts = F.transform(heads, lambda h: F.concat(cut_out(pieces, h["from"], h["start"]), F.lit("<"), name(h["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), cut_out(pieces, rest, F.length(text)))

    return let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)).alias("reach")), built)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`; in texts, every span is replaced by its kind in angle brackets, and n_chars, if there, by the new length."""
    model = fit(docs.sparkSession)
    text = F.col("text")
    held = fresh(docs.columns, "spans")
    rows = docs.withColumn(held, spans_of(F.coalesce(text.cast("string"), F.lit("")), model))
    rows = rows.withColumn("text", F.when(F.size(held) > 0, without_spans(text, F.col(held))).otherwise(text)).drop(held)
    return rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    return find_personal_data(table(spark, sf_dir, "documents"))
