"""Packing by power-of-two decomposition.

A document of n tokens becomes n // 2048 pieces of 2048 and one piece for each bit of the rest, longest first. Every
piece is a sequence by itself, so none crosses documents and, its length being a power of two, none is padded. Pieces
of one length form a bucket; sequence numbers run by partition, bucket and count, so a reader takes equal lengths
together without a shuffle.

Token ids: a tokenizer whose steps before the model are those of CUTS never joins characters across white space, so ids
of a text are those of its pieces in order. Pieces are encoded once and remembered as packed ids (a bounded number), and a
text's ids are one join of bytes. With any other tokenizer every text is encoded as a whole.

Defined cases: null text counts as empty and is one piece with the end id; null and repeated ids are packed row by row
as documents of their own; an empty table gives no rows; columns other than doc_id and text are ignored; a text of any
length is packed whole, alone in memory once it exceeds a slice.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import kept_in_process, slices, table, texts

LONGEST = 2048
END_ID = 1
#: Bytes of text that are cut at once.
SLICE = 2 << 20
#: Pieces that a worker process remembers, over its tasks; beyond that it forgets all and begins anew.
REMEMBERED = 1_000_000
BLANK, LETTER, OTHER, FOREIGN = range(4)
PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff!-&(-;=?-{}~ \t-\r]*")
LETTERS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
PIECE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[^a-z\u00df-\u00f6\u00f8-\u00ff \t-\r]+")
#: Normalizer and pre-tokenizer (fixed values of the tokenizers format) after which texts may be cut into pieces.
CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def decompose(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens: as many of the longest as fit, then the bits of the rest."""
    bits = [1 << k for k in range(longest.bit_length() - 2, -1, -1) if (n % longest) >> k & 1]
    return [longest] * (n // longest) + bits


def byte_kinds() -> np.ndarray:
    """Kind of each byte in a plain text: blank, letter (with the lead byte of Latin letters), other; or not plain."""
    kinds = np.full(256, FOREIGN, np.uint8)
    kinds[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = BLANK
    kinds[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ\xc3", np.uint8)] = LETTER
    kinds[np.frombuffer(b"!\"#$%&()*+,-./0123456789:;=?@[\\]^_`{}~", np.uint8)] = OTHER
    return kinds


class PieceIds(dict):
    """Piece to packed little-endian ids.

    A text of Latin letters, digits, white space and plain punctuation is cut into runs of letters, lower-cased, and
    runs of the rest: the tokenizer lower-cases, and ends its own pieces there. All such texts of a batch are cut at once
    by kinds of bytes, and equal pieces are looked up once. In other texts, words with an apostrophe or angle bracket
    (contractions, control strings) or with other characters stay whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        by_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_form = str.maketrans({c: by_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))})
        self.kinds = byte_kinds()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins = np.concatenate([[0], ends[:-1]])
        data = np.frombuffer(b"".join(texts), np.uint8)
        lower, kind = self.lower[data], self.kinds[data]
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        value = data[second]
        letter = second[(value >= 0x80) & (value <= 0xBF) & (value != 0x97) & (value != 0xB7)]
        kind[letter] = LETTER
        lower[second[(value >= 0x80) & (value <= 0x9E)]] |= 0x20
        foreign = np.concatenate([[0], np.cumsum(kind == FOREIGN)])
        odd = np.flatnonzero(foreign[ends] > foreign[begins]).tolist()
        for k in odd:
            kind[begins[k] : ends[k]] = BLANK
        before = np.concatenate([[BLANK], kind[:-1]]).astype(np.uint8)
        before[begins[begins < len(data)]] = BLANK
        start = np.flatnonzero((kind != BLANK) & (kind != before))
        keep = kind != BLANK
        at = np.cumsum(keep, dtype=np.int32)
        offsets = np.append(at[start] - 1, at[-1:]).astype(np.int32) if len(start) else np.zeros(1, np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(lower[keep])]).dictionary_encode()
        known = pieces.dictionary.to_pylist()
        rest = {k: self.words(texts[k]) for k in odd}
        self.learn(set(known).union(*rest.values()))
        packed = [self[p] for p in known]
        n = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        index = pieces.indices.to_numpy()
        count = n[index]
        stop = np.concatenate([[0], np.cumsum(count)])
        ids = np.frombuffer(b"".join(packed), "<u4")
        flat = ids[np.arange(stop[-1]) + np.repeat((np.cumsum(n) - n)[index] - stop[:-1], count)].tobytes()
        to = 4 * stop[np.searchsorted(start, ends)]
        out = [flat[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist())]
        for k, own in rest.items():
            out[k] = b"".join([self[p] for p in own])
        return out

    def words(self, text: bytes) -> list[bytes]:
        """Pieces of a text that is not plain throughout."""
        pieces = []
        for word in text.split():
            word = word.decode()
            pieces += PIECE.findall(word.lower()) if PLAIN.fullmatch(word) else [word]
        return [p.encode() for p in pieces]

    def learn(self, pieces: set[bytes]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        others = []
        for key in pieces - self.keys():
            piece = key.decode()
            if LETTERS.fullmatch(piece):
                # What the steps before the model make of such a piece is its byte form.
                self[key] = array("I", [t.id for t in self.model.tokenize(piece.translate(self.byte_form))]).tobytes()
            else:
                others.append(piece)
        self.encode(others)

    def encode(self, pieces: list[str]) -> None:
        """Encode many pieces in one call, joined by spaces; a token belongs to the piece that it starts in."""
        for at in range(0, len(pieces), 4000):
            part = pieces[at : at + 4000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            packed = np.asarray(found.ids, dtype="<u4").tobytes()
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            cuts = [0, *(4 * np.searchsorted(starts, ends)).tolist()]
            for piece, a, b in zip(part, cuts, cuts[1:]):
                self[piece.encode()] = packed[a:b]


class WholeIds:
    """Packed ids of whole texts, whatever the tokenizer."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]


def ids_by(tokenizer_json: str) -> PieceIds | WholeIds:
    """By pieces where the tokenizer's steps before a byte-pair model are those of CUTS and its control strings stand in angle brackets, else by whole texts."""
    parts = json.loads(tokenizer_json)
    control = all(t["content"].startswith("<|") and t["content"].endswith("|>") and not t["normalized"] for t in parts.get("added_tokens") or ())
    cut = all(parts.get(k) == v for k, v in CUTS.items()) and not parts.get("truncation") and not parts.get("padding")
    return PieceIds(tokenizer_json) if cut and control and parts["model"]["type"] == "BPE" else WholeIds(tokenizer_json)


def packer(tokenizer_json: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    name = "pieces " + hashlib.sha256(tokenizer_json.encode()).hexdigest()

    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_in_process(name, lambda: ids_by(tokenizer_json))
        task = TaskContext.get()
        partition = task.partitionId() if task else 0
        counts = [0] * LONGEST.bit_length()
        end = END_ID.to_bytes(4, "little")
        schema = pa.schema(FIELDS + [("ids", pa.binary())] * with_ids)
        for batch in slices(batches, "text", SLICE):
            columns: list[list] = [[] for _ in schema]
            for doc_id, row in zip(batch.column(0).to_pylist(), known.ids_of(texts(batch, "text"))):
                ids = row + end
                n, start = len(ids) // 4, 0
                for length in decompose(n):
                    bucket = length.bit_length() - 1
                    piece = ids[4 * start : 4 * (start + length)]
                    sequence = partition << 40 | bucket << 36 | counts[bucket]
                    counts[bucket] += 1
                    for column, value in zip(columns, (doc_id, start, length, zlib.crc32(piece), n, sequence, 0, bucket, piece)):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return pack_batches


def pack_documents(docs: DataFrame, tokenizer: str, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents as sequences; `tokenizer` is a tokenizers JSON file that the driver reads. With ids, each piece's packed little-endian ids follow."""
    with open(tokenizer, encoding="utf-8") as f:
        run = packer(f.read(), with_ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences as one Parquet folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizer(), with_ids=False)
