"""Each operator against a plain version of its contract, on small rows with the awkward cases among them."""

import array
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import ODD, documents, prose
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, decontaminate, license_scan, pack_binary, quality_classifier, quality_rules, secret_scan, simhash_dedup, suffix_dedup, weak_labels
from sparkloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HEX40 = hashlib.sha1(b"x").hexdigest()




# --- secrets


def plain_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets(spark):
    key = "AKI" + "A" + "ABCDEFGH12345678"
    texts = ["é tok" + f'en = "{HEX40}" é', key + " " + key[:10], "secret=token: abcdefgh", "PASS" + "WORD: 'x.y-z/1' api_key=short", HEX40 + HEX40, "toſken=abcdefgh"]
    rows = ODD + [(100 + k, t) for k, t in enumerate(texts)]
    found = {(r.doc_id, r.base_sha256) for r in secret_scan.scan_secrets(documents(spark, rows)).collect()}
    assert found == {(d, hashlib.sha256(plain_secrets(t or "").encode()).hexdigest()) for d, t in rows}


def test_entropy_windows():
    import math

    random.seed(3)
    for _ in range(40):
        text = bytes(random.choice(b"abcdefXYZ0123456789") for _ in range(random.randint(1, 70)))
        want = set()
        for a in range(len(text) - 19):
            n = Counter(text[a : a + 20])
            if -sum(c / 20 * math.log2(c / 20) for c in n.values()) >= 3.5 - 1e-9:
                want |= set(range(a, a + 20))
        assert {k for a, b in secret_scan.hot_windows(text, 3.5) for k in range(a, b)} == want


def test_entropy_spans_and_allow_list():
    token = b"q7Zk2Lw9Xp4Vn8Rt3Ym6Bc1D"
    assert secret_scan.entropy_spans(b"use " + token + b" now", [])
    assert not secret_scan.entropy_spans(b"use " + token + b" now", [(0, 40, 0)])
    assert secret_scan.entropy_spans(b"use " + token + b" now", [(0, 8, 0), (1, 20, 2)])
    quiet = [b"ThisIsSomeVeryLongIdentifierName", b"12345678901234567890123456", b"123e4567-e89b-12d3-a456-426614174000", b"EXAMPLE" + token, b"path/to/some/other_folder/file_name", b"internationalization_and_localization", b"JDBC_CONNECTION_TIMEOUT_SECONDS", b"the-quick-brown-fox-jumps-over"]
    for text in quiet:
        assert not secret_scan.entropy_spans(text, []), text
    # What stands beside a key, in one run of key characters with it, does not hide it.
    for text in (b"qwerty" + b"=" * 30 + token, b"example/" + b"a" * 30 + b"/" + token):
        assert any(text[a:b].endswith(token[-8:]) for a, b, _ in secret_scan.entropy_spans(text, []))


@pytest.mark.parametrize("alphabet", ["letters", "lower", "base64", "hex"])
def test_recall_on_planted_keys(alphabet):
    import string

    chars = {"letters": string.ascii_letters, "lower": string.ascii_lowercase, "base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789ABCDEF"}[alphabet]
    rng = random.Random(12)
    found = 0
    for _ in range(400):
        key = "".join(rng.choice(chars) for _ in range(rng.randint(24, 48)))
        text = f"the value is {key} and no more".encode()
        found += any(a < 13 + len(key) and b > 13 for a, b, _ in secret_scan.entropy_spans(text, []))
    assert found >= 0.9 * 400


def plain_entropy(text, known):
    """All hot windows by themselves, joined, without what is allowed or covered."""
    import math

    out = []
    for m in re.finditer(rb"[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0]
        kind = 0 if re.fullmatch(rb"[0-9a-fA-F]*", run) else 1 if not re.search(rb"[0-9]", run) else 2
        least = (3.0, 3.4, 3.7)[kind]
        hot = [a for a in range(len(run) - 19) if -sum(c / 20 * math.log2(c / 20) for c in Counter(run[a : a + 20]).values()) >= least - 1e-9]
        pieces = []
        for a in hot:
            if pieces and a <= pieces[-1][1]:
                pieces[-1][1] = a + 20
            else:
                pieces.append([a, a + 20])
        for a, b in pieces:
            if not secret_scan.allowed(run[a:b]) and not any(s <= m.start() + a and m.start() + b <= e for s, e, _ in known):
                out.append((m.start() + a, m.start() + b, 3 + kind))
    return out


def test_all_spans_against_plain_version(spark):
    rng = random.Random(21)
    chars = "abcdefXYZKQWP0123456789/_=-"
    rows = [(k, " ".join(rng.choice(["word", "token=" + "".join(rng.choice(chars) for _ in range(30)), "é" + "".join(rng.choice(chars) for _ in range(rng.randint(15, 60))), HEX40, "some_longer_identifier_name_here"]) for _ in range(12))) for k in range(60)]
    found = {r.doc_id: r.spans for r in secret_scan.scan_secrets(documents(spark, rows)).collect()}
    for d, text in rows:
        raw = text.encode()
        known = secret_scan.base_spans(raw)
        point = lambda at, raw=raw: len(raw[:at].decode())
        spans = sorted(known + plain_entropy(raw, known), key=lambda s: (s[0], s[2], s[1]))
        assert found[d] == ",".join(f"{secret_scan.KINDS[k]}:{point(a)}:{point(b)}" for a, b, k in spans)


def test_secrets_of_nothing(spark):
    assert secret_scan.scan_secrets(documents(spark, [])).count() == 0


# --- packing


def test_pack(spark):
    import tokenizers

    path = pack_binary.public_tokenizer()
    whole = tokenizers.Tokenizer.from_file(path)
    texts = ["It's  Don'T", "<|endoftext|>x y<|startoftext|>", "á b ́c ΑΣ Σ", "x y z\x85q\x1cw", "日本語 テスト 123", "a&&& b*** (c)", "AÀÿß×÷", "word " * 5000]
    rows = ODD + [(100 + k, t) for k, t in enumerate(texts)]
    found = pack_binary.pack_documents(documents(spark, rows), path).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    assert all(r.offset == 0 and r.length == 1 << r.bucket and r.length <= 2048 for r in found)
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in found if r.doc_id == d), key=lambda r: r.start)
        copies = sum(x == d for x, _ in rows)
        assert [r.start for r in own[::copies]] == [sum(r.length for r in own[::copies][:k]) for k in range(len(own[::copies]))]
        assert array.array("I", b"".join(r.ids for r in own[::copies])).tolist() == ids
        assert {r.doc_tokens for r in own} == {len(ids)}


def test_pack_with_another_tokenizer(spark, tmp_path):
    """A cased word-level model, and one that cuts as the public one does but keeps case."""
    import json

    import tokenizers

    words = ["<unk>", "x", "Hello", "World", "hello", "world", ","]
    cased = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: k for k, w in enumerate(words)}, "<unk>"))
    cased.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    parts = json.load(open(pack_binary.public_tokenizer(), encoding="utf-8"))
    assert isinstance(pack_binary.ids_by(json.dumps(parts)), pack_binary.PieceIds)
    parts["normalizer"]["normalizers"].pop()
    assert isinstance(pack_binary.ids_by(json.dumps(parts)), pack_binary.WholeIds)
    for k, made in enumerate((cased, tokenizers.Tokenizer.from_str(json.dumps(parts)))):
        path = str(tmp_path / f"{k}.json")
        made.save(path)
        rows = [(1, "Hello World, hello"), (2, None), (3, "It's A World" * 50)]
        found = sorted(pack_binary.pack_documents(documents(spark, rows), path).collect(), key=lambda r: (r.doc_id, r.start))
        for d, t in rows:
            assert array.array("I", b"".join(r.ids for r in found if r.doc_id == d)).tolist() == made.encode(t or "", add_special_tokens=False).ids + [1]


def test_decompose():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        parts = pack_binary.decompose(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)


# --- repeats


def plain_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), kept)
    return out


def test_longest_previous_factors(monkeypatch):
    """All values up to LENGTH, and those of `least` or more, against a plain search."""
    monkeypatch.setattr(suffix_dedup, "LENGTH", 20)
    rng = np.random.default_rng(11)
    for size in (2, 3, 60):
        text = rng.integers(0, size, 300).astype(np.uint8)
        text[150:190] = text[20:60]
        at = np.arange(len(text) - 19)
        position = rng.permutation(len(at))
        raw = text.tobytes()

        def shared(a, b, raw=raw):
            return next((k for k in range(20) if raw[a + k] != raw[b + k]), 20)

        want = np.array([max((shared(a, b) for b in at if position[b] < position[a]), default=0) for a in at])
        levels = suffix_dedup.ranks(text)
        order = np.lexsort((position, levels[-1][1][at]))
        lcp = np.zeros(len(at), np.int64)
        lcp[1:] = suffix_dedup.common_prefix(text, levels, order[:-1], order[1:])
        for least in (1, 8, 20):
            got = np.zeros(len(at), np.int64)
            got[order] = suffix_dedup.longest_previous_factor(position[order], lcp, least)
            assert ((got >= least) == (want >= least)).all() and (got[want >= least] == want[want >= least]).all()
        assert (suffix_dedup.repeats(text, at, position) == (want >= 20)).all()


def test_groups_of_sorted_rows():
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(50):
        keys = sorted(rng.randrange(6) for _ in range(rng.randrange(1, 60)))
        cuts = sorted(rng.sample(range(len(keys) + 1), min(len(keys), 5)))
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(range(a, b), pa.int64())], names=["h", "n"]) for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        found = list(suffix_dedup.groups(batches, rng.choice([16, 100, 10_000])))
        assert [n for t, _ in found for n in t.column("n").to_pylist()] == list(range(len(keys)))
        for k in set(keys):
            own = [parts for t, parts in found if k in t.column("h").to_pylist()]
            assert len(own) == 1 or all(own)
        assert all(len(set(t.column("h").to_pylist())) == 1 for t, parts in found if parts)


@pytest.mark.parametrize(("size", "held"), [(1 << 21, 8 << 20), (700, 8 << 20), (700, 300)])
def test_repeats(spark, monkeypatch, size, held):
    """Also with many slices, and with anchors in many parts."""
    monkeypatch.setattr(suffix_dedup, "SLICE", size)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "ARRAY", size)
    random.seed(5)
    pool = ["".join(random.choice("abcdé ") for _ in range(random.choice([60, 99, 100, 101, 150, 400]))) for _ in range(8)]
    rows = [(3 * k - 20, "".join(random.choice(pool) if random.random() < 0.6 else "".join(random.choice("xyz wé") for _ in range(random.randint(0, 180))) for _ in range(random.randint(0, 6)))) for k in range(40)]
    rows += [(1000, "a" * 99), (1001, "a" * 100), (1002, "a" * 101), (1003, "a" * 500), (1004, "ab" * 300), (1005, None), (1006, ""), (None, pool[-1] * 2)]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert found == plain_repeats(rows)


def test_repeated_rows_are_one_document(spark):
    text = "the same passage of a good length " * 2 + "".join(chr(97 + k % 26) + chr(97 + k // 26) for k in range(200))
    found = suffix_dedup.remove_repeats(documents(spark, [(7, text), (7, text), (8, text)])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_removed) for r in found] == [(7, 0), (7, 0), (8, len(text))]
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


# --- quality


def plain_quality(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed


def test_quality_rules(spark):
    rows = ODD + [(100 + k, prose(k) + "\n" + prose(k + 1, 8) + "\n" + prose(k + 1, 8)) for k in range(30)] + [(200 + k, " ".join(w + "$$$" for w in prose(k).split())) for k in range(6)] + [(300, "no no no " * 60), (301, "a\x0bb\x0cc\x1cd e\n\n \na\x0bb")]
    found = quality_rules.judge_quality(documents(spark, rows)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=str)
    assert got == sorted(((d, *plain_quality(t or "")) for d, t in rows), key=str)
    kept = {r.doc_id: r.kept for r in sorted(found, key=key)}
    assert all(kept[100 + k] for k in range(30)) and not any(kept[200 + k] for k in range(6)) and not kept[300] and not kept[1]
    assert quality_rules.judge_quality(documents(spark, [])).count() == 0


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """Every hash is made equal: the words alone must decide."""
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.least(F.length(c[0]), F.lit(0)).cast("long"))
    rows = [(k, " ".join(random.Random(k).choice("abc") for _ in range(40))) for k in range(20)] + [(100, prose(3))]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judge_quality(documents(spark, rows)).collect()}
    assert got == {d: plain_quality(t)[4] for d, t in rows}


def test_weak_labels_recover_accuracies():
    rng = random.Random(1)
    right = [0.95, 0.9, 0.8, 0.75, 0.6]
    patterns = Counter()
    for _ in range(20000):
        truth = 1 if rng.random() < 0.7 else -1
        patterns[tuple(0 if rng.random() < 0.2 else truth if rng.random() < a else -truth for a in right)] += 1
    model = weak_labels.fit(patterns, 5)
    assert all(abs(a - b) < 0.04 for a, b in zip(model.accuracies(), right))
    assert weak_labels.decode(weak_labels.encode((1, 0, -1, 1, -1)), 5) == (1, 0, -1, 1, -1)
    assert abs(weak_labels.fit({}, 3).posterior((0, 0, 0)) - 0.5) < 1e-9


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    found = quality_classifier.op4_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n, right, lost = found.agg(F.count("*"), F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count_if(~F.col("kept") & (F.col("quality") == 1))).first()
    assert right / n > 0.97 and lost / n < 0.01


def test_classifier_filter_keeps_columns(spark):
    docs = documents(spark, ODD + [(k, prose(k)) for k in range(50, 80)])
    kept = quality_classifier.keep_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(50, 80))
    assert quality_classifier.classify(documents(spark, [])).count() == 0


# --- near copies


def plain_components(rows):
    prints = []
    for _, t in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(len(words) - 2, min(len(words), 1)))]
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least.setdefault(find(k), []).append(d)
    return sorted(((d, f"{prints[k]:016x}", min((x for x in least[find(k)] if x is not None), default=None)) for k, (d, _) in enumerate(rows)), key=str)


def test_near_copies(spark):
    rng = random.Random(2)
    rows = list(ODD)
    for k in range(40):
        words = prose(k % 10, 90).split()
        for _ in range(k // 10):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    found = simhash_dedup.near_duplicates(documents(spark, rows))
    got = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in found.collect()), key=str)
    assert got == plain_components(rows)
    one = simhash_dedup.one_of_each(documents(spark, rows))
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted({str(c) for _, _, c in plain_components(rows)})
    assert simhash_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_all_links_within_radius(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in range(5) for _ in range(40)}
    # Differences inside one block only, more than are compared pairwise.
    prints |= {base[0] ^ rng.getrandbits(22) for _ in range(150)}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    found = connected_components(simhash_dedup.linked(spark.createDataFrame(signed, "fp long"))).collect()
    got = {r.id & (2**64 - 1): r.root for r in found}
    known = np.array(sorted(prints), np.uint64)
    root = list(range(len(known)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(known)):
        for b in np.flatnonzero(np.bitwise_count(known ^ known[a]) <= 3):
            root[find(a)] = find(int(b))
    for a in range(len(known)):
        for b in range(a):
            same = got.get(int(known[a]), f"alone {a}") == got.get(int(known[b]), f"alone {b}")
            assert same == (find(a) == find(b))


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- chats


def test_chats(spark):
    trap = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", trap), (1, 1, "assistant", "<\\|im_end|> <\\\\| é|"), (2, 0, "sys\ntem", None), (2, 1, None, "|x<"), (3, 5, "assistant", ""), (3, None, "assistant", "first"), (None, 0, "user", "no id"), (4, 0, "assistant", "t" * 200_000), (4, 1, "assistant", "u" * 5_000_000), (5, 0, "us\\er", "a\n<"), (5, 0, "us\\er", "a\n<")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    found = {r.conv_id: r for r in chat_format.format_chat(frame).mapInArrow(chat_format.read_back, chat_format.DIGESTS).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chat(frame.limit(0)).count() == 0


def test_escape_is_reversible():
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice("<|\\ab\n") for _ in range(rng.randint(0, 12))).encode()
        assert chat_format.unescape(chat_format.escape(text)) == text and b"<|" not in chat_format.escape(text)
        assert chat_format.unescape_role(chat_format.escape_role(text)) == text and b"\n" not in chat_format.escape_role(text)


# --- leaks


def plain_words(text):
    from sparkloom.llm.wordhash import normal

    return [n for n in map(normal, (text or "").split()) if n]


def plain_tiles(item, text, least=5):
    """Longest match of free words first, then least text and least item position, found anew after every tile."""
    item, text, out = list(item), list(text), []
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for p in range(len(item)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and item[p + n] is not None:
                    n += 1
                if n >= least and n > best[0]:
                    best = (n, t, p)
        n, t, p = best
        if not n:
            return out
        out.append((p, t, n))
        item[p : p + n], text[t : t + n] = [None] * n, [object()] * n


def plain_leaks(rows, items):
    out = []
    for i, item in {(i, t) for i, t in items}:
        words = plain_words(item)
        seeds = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for d, text in rows:
            if 0 < len(words) < 5:
                made = [(0, 0, len(words))] * any(plain_words(x) == words for x in (text or "").split("\n"))
            else:
                own = plain_words(text)
                made = plain_tiles(words, own) if any(tuple(own[k : k + 5]) in seeds for k in range(len(own) - 4)) else []
            covered = sum(n for *_, n in made)
            if words and covered >= 0.5 * len(words):
                out.append((d, i, len(words), covered, len(made)))
    return sorted(out, key=str)


def found_leaks(docs, bench):
    return sorted(((r.doc_id, r.item_id, r.item_words, r.covered_words, r.n_tiles) for r in decontaminate.contaminated_pairs(docs, bench).collect()), key=str)


def test_leaks(spark):
    items = [(1, prose(1, 30)), (2, prose(2, 24)), (2, prose(2, 24)), (3, "too few words"), (4, None), (5, "..."), (6, "same same same same same same"), (None, prose(2, 24))]
    one, two = prose(1, 30).split(), prose(2, 24).split()
    rows = ODD + [
        (100, prose(50) + " " + items[0][1].upper() + "! " + prose(51)),
        (101, " ".join(one[20:] + prose(52, 40).split() + one[10:20] + prose(53, 9).split() + one[:10])),
        (102, " ".join(one[:12]) + " " + prose(54)),
        (103, " ".join(two[:16]) + " " + prose(55)),
        (104, prose(56)),
        (105, (items[0][1] + " ") * 30 + items[1][1]),
        (106, "before\nToo few, words!\nafter"),
        (107, "not too few words"),
        (108, "same " * 300),
        (103, " ".join(two[:16]) + " " + prose(55)),
    ]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(rows, items)
    assert {(100, 1, 30, 30, 1), (101, 1, 30, 30, 3), (103, 2, 24, 16, 1), (105, 1, 30, 30, 1), (105, 2, 24, 24, 1), (106, 3, 3, 3, 1), (108, 6, 6, 6, 1)} <= set(want)
    assert found_leaks(docs, bench) == want
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in rows if d not in {x[0] for x in want})
    assert decontaminate.contaminated_pairs(docs, bench.limit(0)).count() == 0 and decontaminate.decontaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.decontaminated(docs.limit(0), bench).count() == 0


def test_leaks_of_the_tables(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = plain_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert want and found_leaks(docs, bench) == want


def test_tiles_against_plain_greedy():
    rng = random.Random(9)
    for size in (2, 4, 30):
        for _ in range(40):
            item, text = [rng.randrange(1, size + 1) for _ in range(rng.randint(0, 25))], [rng.randrange(0, size + 1) for _ in range(rng.randint(0, 40))]
            assert decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3) == plain_tiles(item, text, 3)


def test_tiles_of_one_word_are_quick():
    import time

    for n in (200, 20_000):
        began = time.time()
        assert sum(k for *_, k in decontaminate.tiles(np.full(n, 7, np.uint64), np.full(20_000, 7, np.uint64))) == n
        rng = np.random.default_rng(1)
        decontaminate.tiles(rng.integers(1, 3, n).astype(np.uint64), rng.integers(1, 3, 20_000).astype(np.uint64))
        assert time.time() - began < (1 if n == 200 else 10)


# --- licences


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"].split()
    changed = [w if k % 40 else "other" for k, w in enumerate(mit)]
    rows = ODD + [(100, prose(1) + " " + " ".join(mit).upper() + " " + prose(2)), (101, prose(3) + " " + " ".join(changed)), (102, "Released under the MIT License."), (103, prose(4) + " Licensed under CC BY-NC 4.0."), (104, " ".join(mit[:20])), (105, prose(5))]
    found = {(r.doc_id, r.license): r.containment for r in license_scan.scan_licenses(documents(spark, rows)).collect()}
    assert set(found) == {(100, "MIT"), (101, "MIT"), (102, "MIT-line"), (103, "CC-BY-NC-4.0-line")}
    assert found[100, "MIT"] == 1.0 and found[101, "MIT"] >= 0.8
    with pytest.raises(ValueError):
        license_scan.Catalogue({"short": "three words only"})


def test_licenses_against_plain_containment(spark):
    from sparkloom.llm.wordhash import normal

    shingles = lambda t: {tuple(w[k : k + 5]) for w in [[n for n in map(normal, t.split()) if n]] for k in range(len(w) - 4)}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = {k: shingles(t) for k, t in license_scan.TEMPLATES.items()}
    want = {(r.doc_id, k) for r in docs.collect() for s in [shingles(r.text)] for k, t in own.items() if len(s & t) >= 0.8 * len(t)}
    assert {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()} == want


# --- quality classifier and pipeline


def plain_scores(rows):
    """The classifier in one process, row by row: votes of all, posteriors, and a scorer fitted on the distinct rows (all within the bound)."""
    from sparkloom.llm.weak_labels import fit

    Q = quality_classifier
    texts = [(t or "").encode() for _, t in rows]
    model = fit(Counter(map(Q.votes, texts)), Q.VOTERS)
    examples = []
    for text in {(d, t) for d, t in rows}:
        words = (text[1] or "").encode().split()
        n = Counter(at for w in words for at in Q.features(w))
        n[Q.REPEAT] += Q.repeats(words)
        at = sorted(k for k in n if n[k])
        examples.append((np.array(at, "<i4").tobytes(), (np.array([n[k] for k in at]) / (len(words) + Q.SMOOTH)).astype("<f4").tobytes(), model.posterior(Q.votes((text[1] or "").encode()))))
    weights, bias = Q.train(sorted(examples))
    out = []
    for text in texts:
        words = text.split()
        z = bias + (sum(float(weights[a]) + float(weights[b]) for a, b in map(Q.features, words)) + Q.repeats(words) * float(weights[Q.REPEAT])) / (len(words) + Q.SMOOTH)
        out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))) if words else 0.0)
    return out


def test_classifier_against_plain_version(spark):
    rows = ODD + [(100 + k, prose(k)) for k in range(40)] + [(200 + k, " ".join(w + "$$" for w in prose(k).split())) for k in range(10)] + [(300, "WORD! " * 200), (301, prose(5, 60000))]
    found = sorted(((str(r.doc_id), round(r.score, 6), r.kept) for r in quality_classifier.classify(documents(spark, rows)).collect()))
    scores = plain_scores(rows)
    assert found == sorted((str(d), round(p, 6), bool(p >= 0.5)) for (d, _), p in zip(rows, scores))
    kept = quality_classifier.keep_quality(documents(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for (d, _), p in zip(rows, scores) if p >= 0.5)
    # The rule at KEEP_AT itself: kept.
    assert quality_classifier.KEEP_AT == 0.5 and all(k == (p >= 0.5) for _, p, k in found)


def plain_stage(name, rows, bench):
    """doc_ids that a stage keeps."""
    from test_shingle_dedup import plain_kept

    if name == "quality":
        return [d for (d, _), p in zip(rows, plain_scores(rows)) if p >= 0.5]
    if name == "near_copies":
        stay = {c for _, _, c in plain_components(rows)}
        return plain_kept([(d, t) for d, t in rows if d in stay])
    if name == "leaks":
        gone = {d for d, *_ in plain_leaks(rows, bench)}
        return [d for d, _ in rows if d not in gone]
    return [d for d, _ in rows]


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline
    from test_pii import plain_loose, plain_spans

    from sparkloom.llm import pii

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    model = pii.fit(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = stage(spark, docs, d)
        if name == "packing":
            assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i, _ in before}
            break
        rows = after.collect()
        assert after.columns == docs.columns and sorted(r.doc_id for r in rows) == sorted(plain_stage(name, before, bench)), name
        if name == "personal_data":
            text = dict(before)
            for r in rows:
                spans, want, at = sorted(plain_spans(text[r.doc_id]) + plain_loose(text[r.doc_id], model)), "", 0
                for a, k, b in spans:
                    if a >= at:
                        want += text[r.doc_id][at:a] + f"<{pii.KINDS[k]}>"
                    at = max(at, b)
                assert r.text == want + text[r.doc_id][at:]
        docs = spark.createDataFrame(rows, docs.schema)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Null, repeated, empty and very long rows, clashing columns, and no rows at all."""
    import corpus_pipeline

    long = prose(77, 400_000)
    rows = ODD + [(100 + k, prose(k)) for k in range(30)] + [(100, prose(0)), (400, long), (None, prose(9)), (None, None)]
    spark.createDataFrame([(1, prose(3, 40)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents(spark, rows), documents(spark, [])):
        docs = docs.withColumns({"key": F.lit("k"), "mark": F.lit(1), "node": F.lit(2), "code": F.lit(None).cast("string")})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), after.schema)
        found = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        if rows and found:
            assert {r.doc_id for r in found} == {r.doc_id for r in docs.collect()} and 400 in {r.doc_id for r in found}
