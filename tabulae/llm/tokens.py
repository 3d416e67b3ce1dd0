"""Encoding of whole texts by a public byte-level BPE vocabulary.

The rank file is turned into a sentencepiece BPE model without any training: each vocabulary entry
becomes a piece whose characters stand for its bytes and whose score is its negative rank, with
identity normalisation. Merging by best score is then merging by lowest rank. Texts are cut into
pre-tokens by the vocabulary's pattern, each distinct pre-token is encoded once a worker and the
ids are put back in order. Decoding maps ids to bytes directly.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Place of the vocabulary; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary's texts are split by before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """A printable character for each of the 256 bytes: itself where printable in Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer message: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a sentencepiece model: ids are ranks, and the piece for unknowns follows the last rank."""
    table = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("the ranks of the vocabulary must run from 0 without gaps")
    pieces = b"".join(_field(1, _field(1, "".join(table[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1)) for token, rank in by_rank)
    unknown = _field(1, _field(1, "<⁇>".encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43)) + _field(45, "<⁇>".encode())
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Encodes and decodes texts by one vocabulary; one lives in each Python worker."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.bytes_of = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.split = regex.compile(PATTERN).findall
        self.map = dict(enumerate(byte_characters()))
        self.known: dict[str, list[int]] = {}

    def batch(self, texts: list[str | None]) -> list[list[str]]:
        """The pre-tokens of each text; all of them are in ``known`` afterwards."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = [self.split(t) if t else [] for t in texts]
        known = self.known
        new = list({p for ps in parts for p in ps if p not in known})
        if new:
            mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for p in new]
            known.update(zip(new, self.model.encode(mapped, out_type=int, num_threads=1)))
        return parts

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known = self.known
        return [[i for p in ps for i in known[p]] for ps in self.batch(texts)]

    def sizes(self, texts: list[str | None]) -> list[int]:
        parts = self.batch(texts)
        size = {p: len(self.known[p]) for ps in parts for p in ps}
        return [sum(map(size.__getitem__, ps)) for ps in parts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _blocks(batches: Iterator[pa.RecordBatch], characters: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about so many characters, whatever the length of its texts."""
    for b in batches:
        mean = max(1, b.nbytes // max(1, b.num_rows))
        step = max(1, characters // mean)
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str | Column = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``ids``, the ids of the whole text without special tokens.

    A null or an empty text gives an empty list; blank texts are encoded as they stand. Repeated
    rows give repeated results, an empty table an empty one. Narrow: no shuffle.
    """
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text") if isinstance(text, str) else text.alias("text"))
    schema = T.StructType([picked.schema["key"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        enc = encoder(vocabulary)
        for b in _blocks(batches):
            ids = enc.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.field("element", pa.int32(), False)))], names=["key", "ids"])

    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each row; null and empty texts have none."""
    picked = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*[picked.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])

    def run(batches):
        enc = encoder(vocabulary)
        for b in _blocks(batches):
            n = enc.sizes(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return picked.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """The inverse of ``encode_texts``: ``key`` and ``text``; null ids give null."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else enc.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=["key", "text"])

    picked = encoded.select(F.col(key).alias("key"), "ids")
    return picked.mapInArrow(run, T.StructType([picked.schema["key"], T.StructField("text", T.StringType())])).withColumnRenamed("key", key)
