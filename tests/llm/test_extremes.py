"""Every training-data operator on no rows at all, and on a text longer than a slice among nulls, empty texts and clashing columns."""

import random

import pyarrow as pa
import pytest
from cases import documents, prose
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, common, decontaminate, license_scan, pack_binary, pii, quality_classifier, quality_rules, secret_scan, shingle_dedup, simhash_dedup, suffix_dedup


def items(docs):
    return docs.sparkSession.createDataFrame([(1, prose(3, 40)), (None, None)], "item_id long, text string")


#: Operator to rows; those that keep rows and columns, and those that return a row for each document.
KEEPS = {
    "quality": quality_classifier.keep_quality,
    "near_copies": simhash_dedup.one_of_each,
    "similar": shingle_dedup.one_of_similar,
    "leaks": lambda docs: decontaminate.decontaminated(docs, items(docs)),
    "personal_data": pii.redact,
}
EACH = {
    "secrets": secret_scan.scan_secrets,
    "repeats": lambda docs: suffix_dedup.remove_repeats(docs, False),
    "scores": quality_classifier.classify,
    "rules": quality_rules.judge_quality,
    "fingerprints": simhash_dedup.near_duplicates,
    "personal": pii.find_personal_data,
}
SOME = {
    "pieces": lambda docs: pack_binary.pack_documents(docs, pack_binary.public_tokenizer()),
    "pairs": lambda docs: decontaminate.contaminated_pairs(docs, items(docs)),
    "licenses": license_scan.scan_licenses,
}


def clashing(spark, rows):
    """Columns that are named like what operators use inside."""
    names = ("key", "mark", "node", "h", "code", "places", "salt", "mask", "words", "seeds", "component_id")
    return documents(spark, rows).withColumns({n: F.lit(n) for n in names})


@pytest.mark.parametrize("name", [*KEEPS, *EACH, *SOME])
def test_no_rows(spark, name):
    docs = clashing(spark, [])
    found = (KEEPS | EACH | SOME)[name](docs)
    assert found.count() == 0 and (name not in KEEPS or found.columns == docs.columns)


LONG = (prose(1, 30_000) + "\n") * 2 + "mail a@b.co " + prose(2, 900_000)


@pytest.mark.parametrize("name", [*KEEPS, *EACH, *SOME])
def test_text_longer_than_a_slice(spark, name):
    assert len(LONG) > common.SLICE_BYTES
    rng = random.Random(1)
    rows = [(1, LONG), (2, None), (3, ""), (None, "x y z"), (4, " ".join(rng.sample(LONG[:20_000].split(), 300)) + "."), (5, prose(3, 40) + " " + prose(8, 40))]
    docs = clashing(spark, rows)
    found = (KEEPS | EACH | SOME)[name](docs).collect()
    ids = sorted(str(r.doc_id) for r in found)
    if name in EACH or name == "personal_data":
        assert ids == sorted(str(d) for d, _ in rows)
    if name == "personal_data":
        assert next(r.text for r in found if r.doc_id == 1) == LONG.replace("a@b.co", "<email>")
    if name == "pieces":
        assert set(ids) == {str(d) for d, _ in rows} and max(r.doc_tokens for r in found) > 500_000
    if name == "pairs":
        assert ids == ["5"]
    if name == "leaks":
        assert "5" not in ids and "1" in ids
    if name == "repeats":
        # A made word sequence of 30,000 words stands twice in the long text.
        assert next(r.n_removed for r in found if r.doc_id == 1) >= len(prose(1, 30_000))
    if name == "personal":
        assert next(r.n_email for r in found if r.doc_id == 1) == 1


def test_chats_of_no_rows_and_of_a_long_turn(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x" * 6_000_000), (1, 1, "assistant", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.format_chat(turns).mapInArrow(chat_format.read_back, chat_format.DIGESTS).collect()}
    assert found == {1: (2, 0), None: (1, 0)}
    assert chat_format.format_chat(turns.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["quality", "near_copies", "leaks", "packing"])
def test_pipeline_bounds_batches(spark, tmp_path, name):
    """A stage that maps over texts sends no batch of many whole texts to Python."""
    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    items(documents(spark, [(1, "x")])).write.parquet(str(tmp_path / "benchmark.parquet"))
    long = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    spark.conf.unset(common.BATCH_LIMIT)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, documents(spark, [(1, prose(1, 60)), (2, prose(2, 60))]), str(tmp_path))
        found = long.mapInArrow(sizes, "n long, bytes long").collect()
    finally:
        spark.conf.unset(common.BATCH_LIMIT)
    assert sum(r.n for r in found) == 600
    assert max(r.bytes for r in found) < common.SLICE_BYTES + 100_000
