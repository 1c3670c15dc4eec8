"""Near copies by 5-word shingles against all pairs, and what the pipeline keeps of them."""

import random

import numpy as np
import pyarrow as pa

from sparkloom.llm import shingle_dedup

FOLDER = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def near(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def plain_kept(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if near(sets[a], sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), d), d)
    return sorted(least.values())


def test_one_of_similar(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "a few words"), (4, "A few  words"), (5, "a few other words"), (6, "one two three four five")]
    # Families of copies with 0 to 9 changed words, about the similarity, larger than what is compared in the first pass.
    for family in range(3):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(70):
            words = list(base)
            for _ in range(rng.randrange(10)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((100 + len(rows), " ".join(words)))
    # The same line in many texts that are otherwise different.
    for _ in range(60):
        rows.append((1000 + len(rows), "this line stands in very many different texts " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 20)))))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(3)
    found = shingle_dedup.one_of_similar(docs)
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == plain_kept(rows)
    assert shingle_dedup.one_of_similar(docs.limit(0)).count() == 0


def test_a_group_of_less_similar_copies_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    rows = []
    # Nearly all pairs have a similarity of 0.6 to 0.8, and share keys; a few have more.
    for k in range(220):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.choice([1, 2, 3, 3, 3, 3])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    sizes = []

    def counted(df, materialise=shingle_dedup.materialise):
        out = materialise(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(shingle_dedup, "materialise", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sorted(r.doc_id for r in shingle_dedup.one_of_similar(docs).collect()) == plain_kept(rows)
    assert max(sizes) <= (shingle_dedup.BANDS + 1) * len(rows)


def test_joining_all_similar_roots():
    rng = random.Random(3)
    sets = [np.unique([rng.randrange(40) if rng.random() < 0.1 else v for v in range(30)]).astype(np.uint64) for _ in range(60)]
    root = np.array([rng.randrange(30) for _ in sets])

    def parts(links):
        part = root.copy()
        for a, b in links:
            part[part == part[b]] = part[a]
        return [part.tolist().index(x) for x in part.tolist()]

    plain = [(a, b) for a in range(60) for b in range(a) if near(set(sets[a].tolist()), set(sets[b].tolist()))]
    found = shingle_dedup.joining(root, sets)
    assert parts(found) == parts(plain)
    assert all((b, a) in plain for a, b in found)
    assert len(found) == len(set(root.tolist())) - len(set(parts(plain)))


def test_groups_over_batches_stay_whole():
    for step in (1, 2, 3, 7, 20):
        key = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5, 6]
        batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + step], pa.int64())], names=["key"]) for k in range(0, len(key), step)]
        found = [t.column("key").to_pylist() for t in shingle_dedup.whole_groups(iter(batches))]
        assert sum(found, []) == key
        assert all(x[-1] != y[0] for x, y in zip(found, found[1:]))


def test_pipeline_keeps_no_similar_pair(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        if name == "leaks":
            break
    sets = [plain_shingles(r.text) for r in docs.collect()]
    assert not [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])]
