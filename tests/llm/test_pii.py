"""Personal data against plain versions of the base, of the loose spans and of the redaction."""

import hashlib
import random
import re
import time

import pytest
import regex
from cases import ODD, documents, prose

from sparkloom.llm import pii
from sparkloom.llm.pii_examples import examples


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


def luhn(number):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(number))) % 10 == 0


def plain_personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    found.sort()
    return (*(sum(k == n for _, k, _ in found) for n in range(4)), hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest())


PERSONAL = ["a@b.c%d@e.f x@y a@b.co.", "é a@b-c.d, 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111", "+1 (476) 555-6291. +12345 +1 1 1 ++49 30 1234567890-", "aaa@@b.c a@.b .@-.-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "ñ +34 600 11 22 33 m@x.y", "9" * 8000]


def test_personal_data(spark):
    rows = ODD + [(100 + k, t) for k, t in enumerate(PERSONAL)]
    found = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find_personal_data(documents(spark, rows)).collect()), key=str)
    assert found == sorted(((d, *plain_personal(t or "")) for d, t in rows), key=str)
    assert pii.find_personal_data(documents(spark, [])).count() == 0


def test_redaction(spark):
    docs = documents(spark, ODD + [(100 + k, t) for k, t in enumerate(PERSONAL)])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r for r in out.collect()}
    assert text[100].text == "<email><email> x@y <email>." and text[103].text.startswith("<phone>. +12345") and text[106].text == "ñ <phone> <email>"
    assert text[1].text is None and text[1].n_chars is None and text[106].n_chars == len(text[106].text)


# --- loose spans


def beside(char):
    return 0 if not char else 1 if re.match(r"\s", char, re.A) else 2 if regex.match(r"\p{L}", char) else 3 if char in "0123456789" else 4


def account_holds(match):
    plain = match.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


CHECKS = {
    "email_text": lambda m: bool(re.search(r"(?:[\])]|\.) ?(?:com|org|net|edu|gov|info|io|de|uk|fr|es|eu)\b", m, re.I)),
    "phone_local": lambda m: bool(re.match("[2-9][0-9]{2}[2-9]", re.sub("[^0-9]", "", m))),
    "national": lambda m: not (m[:3] in ("000", "666") or m[0] == "9" or "-00-" in m or m.endswith("-0000")),
    "account": account_holds,
}


def plain_loose(text, model):
    found = []
    for k, kind in enumerate(pii.LOOSE):
        matches = list(regex.finditer(pii.GENERATORS[4 + k].pattern, text))
        for i, m in enumerate(matches):
            before = text[matches[i - 1].end() if i else 0 : m.start()]
            after = text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)]
            left = before[-pii.CONTEXT :]
            cue = next((c + 1 for c, p in enumerate(pii.CUES) if re.search(p.replace(r"\z", r"\Z"), left, re.A)), 0)
            size = min(3, sum(c in "0123456789" for c in m[0]) // 5)
            x = [k, size, int(bool(re.search("[ ().-]", m[0]))), int(CHECKS[kind](m[0])), beside(before[-1:]), beside(after[:1]), cue]
            if model.score(x) >= model.thresholds[k]:
                found.append((m.start(), 4 + k, m.end()))
    return found


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return found + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]


#: Text, and the loose kinds that must be selected in it.
LOOSE_CASES = [
    ("please call 555-423-4567 now", ["phone_local"]), ("order 555 123 4567 parts", []), ("phone: (555) 423-4567, é", ["phone_local"]), ("ref 123.456.7890.", []),
    ("my ssn 123-45-6789", ["national"]), ("build 123-45-6789 ok", []), ("ssn 000-45-6789", []), ("bank account DE89 3704 0044 0532 0130 00 thanks", ["account"]),
    ("AB12 3456 7890 1234 5678", []), ("transfer to GB82WEST12345698765432", ["account"]), ("serial DE12345678901234567890", []),
    ("write to anna.meyer [at] mailbox [dot] com please", ["email_text"]), ("we met anna (at) mailbox.noon", []), ("phone +1 (476) 555-6291", []), ("+1 476-555-6291 a@b.co 123-45-6789", []),
    ("call 555-423-4567 or 555-423-4568, ssn 123-45-6789 ssn 123-45-6780", ["phone_local", "national", "national"]),
]


def test_loose_spans_against_plain_version(spark, model):
    rng = random.Random(8)
    rows = ODD + [(100 + k, t) for k, (t, _) in enumerate(LOOSE_CASES)] + [(200 + k, t) for k, t in enumerate(PERSONAL)]
    made = [e["text"] for e in examples(40)]
    rows += [(300 + k, prose(k, 5) + " ".join(rng.sample(made, 4))) for k in range(60)]
    found = sorted(((r.doc_id, r.spans) for r in pii.find_personal_data(documents(spark, rows)).collect()), key=str)
    assert found == sorted(((d, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(plain_spans(t or "") + plain_loose(t or "", model)))) for d, t in rows), key=str)
    got = dict(found)
    for k, (text, kinds) in enumerate(LOOSE_CASES):
        assert sorted(s.split(":")[0] for s in got[100 + k].split(",") if s.split(":")[0] in pii.LOOSE) == sorted(kinds), text


def test_thresholds_hold_on_new_examples(spark, model, monkeypatch):
    """Of lines made with another seed, what is selected is right in PRECISION of the cases or nearly, and most right ones are."""
    from sparkloom.llm import pii_examples

    monkeypatch.setattr(pii_examples, "SEED", 77)
    for kind in range(len(pii.LOOSE)):
        rows = [e for e in pii_examples.examples(400) if e["kind"] == 4 + kind]
        chosen = [bool(any(k == 4 + kind for _, k, _ in plain_loose(e["text"], model))) for e in rows]
        right = sum(c and e["good"] for c, e in zip(chosen, rows))
        assert right >= 0.85 * sum(chosen) and right >= 0.7 * sum(e["good"] for e in rows), pii.LOOSE[kind]


def test_redaction_takes_the_union(spark, model):
    rows = [(1, "x" * 1999 + " a@b.co" + "é" * 5000 + " +49 30 1234567@host.de 1.2.3.4 end"), (2, "a@b.co" * 3), (3, "ssn 123-45-6789 a@b.co " * 300)]
    got = {r.doc_id: r.text for r in pii.redact(documents(spark, rows)).collect()}
    for d, text in rows:
        want, at = "", 0
        for a, k, b in sorted(plain_spans(text) + plain_loose(text, model)):
            if a >= at:
                want += text[at:a] + f"<{pii.KINDS[k]}>"
            at = max(at, b)
        assert got[d] == want + text[at:]


def test_many_matches_in_one_text(spark):
    began = time.time()
    text = "".join(f"u{k}@y.com " for k in range(16_000))
    found = pii.find_personal_data(documents(spark, [(1, text)])).first()
    assert found.n_email == 16_000 and found.spans.endswith(f"email:{len(text) - 13}:{len(text) - 1}")
    assert len(pii.redact(documents(spark, [(1, text)])).first().text) == 8 * 16_000
    assert time.time() - began < 60


def test_boosting_learns_and_calibrates():
    n = dict(pii.FEATURES)

    def code(**x):
        out = 0
        for name, size in pii.FEATURES:
            assert x.get(name, 0) < n[name]
            out = out * size + x.get(name, 0)
        return out

    counts = {code(kind=1, cue=1): (90, 2), code(kind=1, cue=2): (5, 95), code(kind=2, cue=4): (99, 1)}
    made = pii.calibrate(pii.boost(counts), counts)
    assert made.selects(code(kind=1, cue=1)) and not made.selects(code(kind=1, cue=2)) and made.selects(code(kind=2, cue=4))
    assert not made.selects(code(kind=3))
    assert pii.boost({code(): (3, 0)}).thresholds == (float("inf"),) * 4
