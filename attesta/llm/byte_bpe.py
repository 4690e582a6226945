"""Byte-level BPE encoding and decoding through sentencepiece.

A sentencepiece BPE model is serialised directly from a vocabulary of ranks: each byte string becomes a piece by mapping
bytes to printable characters, scored by its negative rank, with identity normalisation. Merging the best-scored pair first
is then merging the lowest rank first. Texts are parted by the pre-token pattern, each distinct pre-token is encoded once
per worker while it stays in a bounded memo, and decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from typing import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, types as T

from attesta.llm.common import tidied

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers at once.
MEMO = 200_000
#: Longer pre-tokens are encoded each time.
MEMO_BYTES = 64


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


@lru_cache(maxsize=1)
def byte_characters() -> str:
    """A printable character for each byte: itself where printable in Latin-1, else from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return "".join(chr(b if b in kept else next(moved)) for b in range(256))


def as_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(byte_characters())


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A field of a protocol buffer: varint, 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; one more piece is the unknown, which bytes never meet."""
    # fixed values: the numbers of fields and kinds in sentencepiece's published model format
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, as_characters(token).encode()) + _field(2, -float(rank)) + _field(3, normal) for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    off = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, off) + _field(42, off) + _field(43, off)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN, memo: int = MEMO):
        if len(set(tokens)) != len(tokens) or not {bytes([b]) for b in range(256)} <= set(tokens):
            raise ValueError("the vocabulary must hold every byte, and each string once")
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.memo: dict[str, bytes] = {}
        self.most = memo

    def _encode(self, pre_tokens: Iterable[str]) -> dict[str, bytes]:
        out, rest = {}, []
        for pre in pre_tokens:
            whole = self.rank.get(pre.encode())
            if whole is None:
                rest.append(pre)
            else:
                out[pre] = struct.pack("<I", whole)
        for pre, ids in zip(rest, self.model.encode([as_characters(p.encode()) for p in rest], num_threads=1) if rest else []):
            out[pre] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        pre_tokens = self.split(text)
        new = [p for p in set(pre_tokens) if p not in self.memo]
        if not new:
            return b"".join(map(self.memo.__getitem__, pre_tokens))
        found = self._encode(new)
        if len(self.memo) > self.most:
            self.memo.clear()
            found |= self._encode(set(pre_tokens) - found.keys())
            ids = b"".join(map(found.__getitem__, pre_tokens))
        else:
            known = self.memo
            ids = b"".join([found[p] if p in found else known[p] for p in pre_tokens])
        self.memo.update((p, i) for p, i in found.items() if len(p) <= MEMO_BYTES)
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, made once per worker."""
    return Codec(read_ranks(path))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded (binary) of every row.

    ``text`` is encoded whole; null counts as empty, which has no ids. Other columns are left out, so theirs may have any
    name. Repeated rows each give their row; an empty table gives none.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return _mapped(docs, path, [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())], lambda x: x)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As ``encode``, with the SHA-256 of ids and decoded in their place, so that they don't leave the worker."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    fields = [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, path, fields, lambda x: hashlib.sha256(x).hexdigest())


def _mapped(docs: DataFrame, path: str, fields: list[T.StructField], told) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), *fields])
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):  # ids of few texts at once
                n, a, b = [], [], []
                for text in part.column("text"):
                    ids = use.encode(text.as_py() or "")
                    n.append(len(ids) // 4)
                    a.append(told(ids))
                    b.append(told(use.decode(ids)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, kinds[0]), pa.array(b, kinds[1])],
                    names=schema.names,
                )
        use.memo.clear()

    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def op6_byte_bpe(spark, sf_dir) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; see ``encode`` for nulls."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
