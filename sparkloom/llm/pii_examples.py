"""The labelled set that teaches the personal-data trees: lines made by rule, right ones and look-alikes."""

from __future__ import annotations

import random

SEED = 20
NAMES = ("anna.meyer", "j.doe", "maria_lopez", "sam-lee", "p.novak", "kim", "office", "lena.b")
HOSTS = ("mailbox", "example-post", "city-works", "uni", "northfarm", "web-shop")
ENDS = ("com", "org", "net", "de", "edu", "io")
#: Words before a right one of each loose kind, and before a look-alike.
BEFORE = {
    "email_text": (("write to ", "contact: ", "e-mail ", "reach me, mail ", "you can mail "), ("", "the function ", "we met ", "look ", "see figure ")),
    "phone_local": (("call ", "phone: ", "Tel. ", "my mobile is ", "fax ", "dial "), ("order ", "part no. ", "ref ", "invoice ", "serial ", "tracking ")),
    "national": (("ssn ", "social security number ", "SSN: ", "national id ", "identity no. "), ("build ", "part ", "model ", "lot ", "version ", "case ")),
    "account": (("iban ", "bank account ", "transfer to ", "pay into account ", "deposit to IBAN "), ("serial ", "sku ", "batch ", "tracking ", "item ", "model ")),
}
AFTER = (" please", ".", ", thanks", "", " today", "\nnext line")


def check_digits(country: str, rest: str) -> str:
    """The two digits after the country that leave remainder 1 by 97."""
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def made(rng: random.Random, kind: str, good: bool) -> str:
    """One span of a kind; its check holds if it is right, and seldom if it is not."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email_text":
        dot = rng.choice((".", " dot ", "(dot)", " [dot] ", "[dot]")) if good else "."
        dot = {" dot ": " [dot] "}.get(dot, dot)
        at = rng.choice(("[at]", " [at] ", "(at)", " (at) ")) if good else rng.choice((" (at) ", " [at] "))
        return rng.choice(NAMES) + at + rng.choice(HOSTS) + dot + rng.choice(ENDS if good else ("size", "call", "all", "noon", "index"))
    if kind == "phone_local":
        first = (rng.choice("23456789"), rng.choice("23456789")) if good or rng.random() < 0.5 else (rng.choice("01"), rng.choice("01"))
        area, exchange = first[0] + digits(2), first[1] + digits(2)
        return rng.choice(("{}-{}-{}", "({}) {}-{}", "{} {} {}", "{}.{}.{}")).format(area, exchange, digits(4))
    if kind == "national":
        if good or rng.random() < 0.5:
            return f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
        return rng.choice(("000-{:02d}-{:04d}", "9%02d-{:02d}-{:04d}" % rng.randrange(100), "666-{:02d}-{:04d}")).format(rng.randrange(100), rng.randrange(10000))
    country, rest = rng.choice(("DE", "FR", "GB", "ES", "NL")), digits(rng.choice((14, 16, 18, 20)))
    number = country + (check_digits(country, rest) if good else digits(2)) + rest
    return number if rng.random() < 0.5 else " ".join(number[k : k + 4] for k in range(0, len(number), 4))


def examples(n: int) -> list[dict]:
    """`n` lines of each loose kind (its place among all kinds is given), half of them right; every other one is held out.

    A fifth of the right ones stand without a telling word, and a fifth of the wrong ones with a neutral one before them.
    """
    rng = random.Random(SEED)
    out = []
    for place, (kind, (telling, misleading)) in enumerate(BEFORE.items()):
        for k in range(n):
            good = k % 4 < 2
            words = telling if good else misleading
            before = rng.choice(("see ", "it is ", "")) if rng.random() < 0.2 else rng.choice(words)
            out.append({"text": before + made(rng, kind, good) + rng.choice(AFTER), "kind": 4 + place, "good": good, "held_out": bool(k % 2)})
    return out
