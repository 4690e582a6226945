"""Token ids as Arrow stream files of fixed-size-list batches.

A data set is a folder of shards. Shard k holds the documents of the k-th range of doc_id, in order, each followed by an end
id. ``tokens-k.arrow`` is one record batch after another in the Arrow stream format, with two columns of equal-length rows:
``ids`` (fixed-size list of unsigned 16- or 32-bit integers) and ``mask`` (fixed-size list of booleans, false where the
shard's last sequence is padded). Mapped into memory, any sequence is a slice: nothing is parsed or copied.
``documents-k.arrow`` has doc_id, start (in the shard) and n_tokens of each document, and ``manifest`` (Parquet) the shards.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from functools import lru_cache
from typing import Iterator
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from attesta.llm.common import free_shuffles, new_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 128
#: Chunks in each of the two generations that a worker remembers, and the longest remembered.
MEMO = 300_000
MEMO_BYTES = 64
#: Combining marks that can join an ASCII letter to one character.
_MARKS = re.compile("[\u0300-\u036f]")
#: A stop or comma that ends a word of letters or digits: a token of its own.
_ENDS_WORD = re.compile(r"[.,](?<=[A-Za-z0-9À-ÖØ-öø-ÿ].)(?=\s|\Z)")


def _parts_into_chunks(told: dict) -> bool:
    """Whether a tokenizer, told as its JSON, is of the kind that the memo of chunks is right for."""
    normalizer, pre, model = told["normalizer"] or {}, told["pre_tokenizer"] or {}, told["model"]
    steps = [n["type"] for n in normalizer.get("normalizers", [])]
    splits = [s for s in pre.get("pretokenizers", []) if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and len(splits) == 1
        and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in str(splits[0]["pattern"].get("Regex"))
        and model["type"] == "BPE"
        and model["end_of_word_suffix"] == "</w>"
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
    )


class Encoder:
    """Ids of texts by the tokenizers library.

    Where the tokenizer drops white space, folds case and parts words from punctuation, as the default one does, the ids of
    a text are those of its chunks between ASCII white space, capitals and the comma after a word make no difference to how
    the chunk before them is merged, and each distinct chunk is encoded once while a bounded memo holds it. Texts that hold
    a special token's string, and all texts for any other tokenizer, go to the library whole.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in told["added_tokens"]]
        self.by_chunks = _parts_into_chunks(told)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most = memo
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        texts = [c.decode() for c in chunks]
        out = {}
        # chunks of letters are one word each: they go to the tokenizer together and come apart at the ids that end words
        letters = [t for t in texts if t.isalpha()]
        if letters:
            found = self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0]
            ids = np.array(found.ids, self.dtype)
            stops = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(stops) == len(letters):  # a letter whose lower case has a mark can make two of a word
                size, data = self.dtype.itemsize, ids.tobytes()
                out = {t: data[size * a : size * b] for t, a, b in zip(letters, [0, *stops], stops)}
        rest = [t for t in texts if t not in out]
        for t, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []):
            out[t] = np.array(e.ids, self.dtype).tobytes()
        return {c: out[t] for c, t in zip(chunks, texts)}

    def _has_special(self, low: str) -> bool:
        return any(s.lower() in low for s in self.special)

    def chunks(self, text: str) -> list[bytes]:
        data = _ENDS_WORD.sub(r" \g<0>", text).encode()
        # lower-casing first could let a letter join a mark that its capital doesn't join
        return (data if _MARKS.search(text) else data.lower()).split()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: none) as bytes of ``dtype``."""
        # chunks are lower-cased, which must not make a special token's string of one in capitals
        if text and (not self.by_chunks or self._has_special(text.lower())):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        chunks = self.chunks(text or "")
        young, unknown = self.young, []
        for c in set(chunks):
            if c not in young:
                ids = self.old.get(c)
                if ids is None:
                    unknown.append(c)
                else:
                    young[c] = ids
        if unknown:
            young.update(self._encode(unknown))
        out = b"".join([young[c] for c in chunks])
        for c in unknown:
            if len(c) > MEMO_BYTES:
                del young[c]
        if len(young) > self.most:
            self.young, self.old = {}, young
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI that Spark was given, and the path in it."""
    if urlparse(uri).scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), urlparse(uri).path
    return pa.fs.FileSystem.from_uri(uri)


class _ShardWriter:
    """Writes a shard under names of this attempt; ``close`` gives the files their own names, so that a retried or repeated
    task leaves whole files only, with the same contents."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, id_type: pa.DataType, sequence: int, batch: int):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.shard, self.sequence, self.batch, self.dtype = shard, sequence, batch, dtype
        context = TaskContext.get()
        self.attempt = f".{context.taskAttemptId() if context else 0}.tmp"
        self.schema = pa.schema(
            [("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))]
        )
        self.doc_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(self._name("tokens") + self.attempt)
        self.doc_out = self.fs.open_output_stream(self._name("documents") + self.attempt)
        self.tokens = pa.ipc.new_stream(self.out, self.schema)
        self.docs = pa.ipc.new_stream(self.doc_out, self.doc_schema)
        self.waiting: list[bytes] = []
        self.n_waiting = self.n_tokens = self.n_docs = self.n_sequences = 0

    def _name(self, kind: str) -> str:
        return f"{self.folder}/{kind}-{self.shard:06d}.arrow"

    def add(self, doc_ids: pa.Array, encoded: list[bytes]) -> None:
        sizes = np.array([len(e) // self.dtype.itemsize for e in encoded], np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.doc_schema))
        self.n_tokens += int(sizes.sum())
        self.n_docs += len(encoded)
        for e in encoded:
            self.waiting.append(e)
            self.n_waiting += len(e) // self.dtype.itemsize
            if self.n_waiting >= self.batch * self.sequence:
                self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        size = self.batch * self.sequence
        whole = len(ids) // size * size if not last else len(ids)
        for at in range(0, whole, size):
            part = ids[at : min(at + size, whole)]
            rows = -(-len(part) // self.sequence)
            full = np.zeros(rows * self.sequence, self.dtype)
            full[: len(part)] = part
            mask = np.arange(len(full)) < len(part)
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(values), type=self.schema.field(name).type)
                for name, values in (("ids", full), ("mask", mask))
            ]
            self.tokens.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            self.n_sequences += rows
        self.waiting = [ids[whole:].tobytes()]
        self.n_waiting = len(ids) - whole

    def abandon(self) -> None:
        """Delete what a failed attempt has written."""
        for stream in (self.out, self.doc_out):
            stream.close()
        for kind in ("tokens", "documents"):
            self.fs.delete_file(self._name(kind) + self.attempt)

    def close(self) -> None:
        self._flush(last=True)
        for stream in (self.tokens, self.docs, self.out, self.doc_out):
            stream.close()
        for kind in ("tokens", "documents"):
            self.fs.move(self._name(kind) + self.attempt, self._name(kind))


MANIFEST = "shard int, n_docs long, n_tokens long, n_sequences long, item_bytes int"


def write(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, batch: int = BATCH
) -> None:
    """Write the ids of every whole text, in ascending doc_id order, to a new data set.

    Null texts count as empty: they have the end id alone. A null doc_id comes first; rows of one doc_id are in order of a
    hash of their texts. Columns other than doc_id and text are left out. An empty table gives a data set without shards.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    id_type = docs.schema["doc_id"].dataType
    arrow_id = pa.int64() if isinstance(id_type, T.LongType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.string()
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, use, out = TaskContext.get().partitionId(), encoder(path), None
        end = np.array([end_id], use.dtype).tobytes()
        try:
            for whole in batches:
                for part in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                    out = out or _ShardWriter(folder, shard, use.dtype, arrow_id, sequence, batch)
                    out.add(part.column("doc_id").cast(arrow_id), [use.encode(t.as_py()) + end for t in part.column("text")])
        except BaseException:
            if out:
                out.abandon()
            raise
        if out:
            out.close()
            told = (shard, out.n_docs, out.n_tokens, out.n_sequences, use.dtype.itemsize)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("shard", "n_docs", "n_tokens", "n_sequences", "item_bytes"), told))],
                schema=pa.schema([("shard", pa.int32()), *((n, pa.int64()) for n in ("n_docs", "n_tokens", "n_sequences")), ("item_bytes", pa.int32())]),
            )

    placed.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    free_shuffles(spark)


def manifest(spark, folder: str) -> DataFrame:
    """A row per shard, with ``start``: the ids in all shards before it."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard: few
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_stream(path: str) -> pa.Table:
    """The batches of a stream file; mapped into memory, not read, where the file is local."""
    fs, at = filesystem(path)
    source = pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
    return pa.ipc.open_stream(source).read_all()


class TokenShard:
    """Random access to the sequences and documents of a shard."""

    def __init__(self, folder: str, shard: int):
        self.table = open_stream(f"{folder}/tokens-{shard:06d}.arrow")
        self.documents = open_stream(f"{folder}/documents-{shard:06d}.arrow")
        self.sequence = self.table.schema.field("ids").type.list_size
        self.ends = np.cumsum([len(c) for c in self.table.column("ids").chunks]).tolist()

    def __len__(self) -> int:
        return self.table.num_rows

    def _flat(self, name: str, chunk: int) -> pa.Array:
        return self.table.column(name).chunk(chunk).values

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids (a view of the file) and the mask of sequence i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        chunk = bisect.bisect_right(self.ends, i)
        at = (i - (self.ends[chunk - 1] if chunk else 0)) * self.sequence
        ids = self._flat("ids", chunk).to_numpy(zero_copy_only=True)[at : at + self.sequence]
        return ids, self._flat("mask", chunk).slice(at, self.sequence)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The n ids from ``start`` of the shard; a view where they are in one batch."""
        parts = []
        while n > 0:
            chunk = bisect.bisect_right(self.ends, start // self.sequence)
            base = (self.ends[chunk - 1] if chunk else 0) * self.sequence
            part = self._flat("ids", chunk).to_numpy(zero_copy_only=True)[start - base : start - base + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def read_documents(spark, folder: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """doc_id, start (in the whole data set), n_tokens and ids_crc32 of each document, from the files."""
    schema = T.StructType(
        [T.StructField("doc_id", id_type)] + [T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenShard(folder, row["shard"])
                for docs in shard.documents.to_batches():
                    starts, sizes = docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()
                    crc = [zlib.crc32(shard.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), pa.array([row["start"] + s for s in starts], pa.int64()), docs.column("n_tokens"), pa.array(crc, pa.int64())],
                        names=schema.names,
                    )

    shards = manifest(spark, folder).select("shard", "start")
    n = max(1, shards.count())
    return shards.repartition(n, "shard").mapInArrow(run, schema)


def op4_token_files(spark, sf_dir) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; see ``write`` for nulls and repeated ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_dir(spark, "tokens")
    write(docs, folder)
    return read_documents(spark, folder, docs.schema["doc_id"].dataType)
