"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is described by counts over its bytes and words and encoded by a
small network; gated attention (tanh times sigmoid, softmax over the bag) weighs the encodings; a logistic unit scores their
weighted sum. Labels stand for whole documents, and which passages matter is learned from them alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from attesta.llm.common import is_held_out, saved

PASSAGE_WORDS = 64
#: Labelled documents that the model is fitted on, at most.
SAMPLE_DOCS = 3000
THRESHOLD = 0.7
HASHED = 24

# classes of bytes; a passage is described by its share of each
_CLASSES = (
    ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("stop", b".,;:"), ("mark", b"!"), ("question", b"?"),
    ("symbol", b"#*$%&<>"), ("bar", b"|"), ("quote", b"\"'()[]{}"), ("other", b"+-/=@\\^_`~"), ("high", bytes(range(128, 256))),
)
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, (_, _bytes) in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _i
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
N_FEATURES = len(_CLASSES) + 1 + 9 + HASHED


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts (float32, a row each), and the number of passages of each text (1 at least).

    A text without words has one passage of zeros.
    """
    encoded = [(t or "").encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(encoded), np.uint8)
    sizes = np.array([len(e) for e in encoded], np.int64)
    doc_start = np.cumsum(sizes) - sizes
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))  # each text ends in a space
    doc_of_word = np.searchsorted(doc_start, begins, "right") - 1
    words_of_doc = np.bincount(doc_of_word, minlength=len(texts))
    passages = np.maximum(1, -(-words_of_doc // PASSAGE_WORDS))
    first_passage = np.cumsum(passages) - passages
    first_word = np.cumsum(words_of_doc) - words_of_doc
    passage = first_passage[doc_of_word] + (np.arange(len(begins)) - first_word[doc_of_word]) // PASSAGE_WORDS
    n = int(passages.sum())
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(begins):
        return out, passages
    lengths = ends - begins
    in_word = np.flatnonzero(~space)
    of_byte = np.repeat(passage, lengths)
    kinds = len(_CLASSES) + 1
    counts = np.bincount(of_byte * kinds + _CLASS[data[in_word]], minlength=n * kinds).reshape(n, kinds)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out[:, :kinds] = counts / total
    words_in = np.bincount(passage, minlength=n)
    per = np.maximum(words_in, 1)
    # a hash of each word, from running sums of its bytes times powers of an odd number
    with np.errstate(over="ignore"):
        at = (np.arange(len(data)) - np.repeat(doc_start, sizes)) & 0xFFFF
        mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        running = np.concatenate(([np.uint64(0)], np.cumsum(mixed * _POWER[at], dtype=np.uint64)))
        hashes = (running[ends] - running[begins]) * _INVERSE[at[begins]]
        hashes ^= hashes >> np.uint64(31)
    same_as_last = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])))
    order = np.lexsort((hashes, passage))
    new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])))
    runs = np.diff(np.append(np.flatnonzero(new), len(order)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, passage[order][new], runs)
    last_byte, first_byte = _CLASS[data[ends - 1]], _CLASS[data[begins]]
    named = {name: i for i, (name, _) in enumerate(_CLASSES)}
    extra = (
        np.bincount(passage, lengths, n) / per / 10,
        np.bincount(passage[order][new], minlength=n) / per,
        most / per,
        np.bincount(passage, same_as_last, n) / per,
        np.bincount(passage, last_byte == named["mark"], n) / per,
        np.bincount(passage, (last_byte == named["symbol"]) | (last_byte == named["bar"]), n) / per,
        np.bincount(passage, first_byte == named["upper"], n) / per,
        np.bincount(passage, lengths > 20, n) / per,
        words_in / PASSAGE_WORDS,
    )
    out[:, kinds : kinds + 9] = np.stack(extra, axis=1)
    slot = (hashes >> np.uint64(7)) % np.uint64(HASHED)
    out[:, kinds + 9 :] = np.bincount(passage * HASHED + slot.astype(np.int64), minlength=n * HASHED).reshape(n, HASHED) / per[:, None]
    return out, passages


_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64


def _powers(base: int) -> np.ndarray:
    out = np.ones(1 << 16, np.uint64)
    out[1:] = np.uint64(base)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


@dataclass
class Model:
    """Weights by name; ``mean`` and ``scale`` standardise features."""

    weights: dict[str, np.ndarray]

    def scores(self, features: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return _forward(self.weights, features, passages)["p"]

    def attention(self, features: np.ndarray, passages: np.ndarray) -> np.ndarray:
        """The weight of each passage in its bag."""
        return _forward(self.weights, features, passages)["a"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], features: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.cumsum(passages) - passages
    bag = np.repeat(np.arange(len(passages)), passages)
    x = np.clip((features - w["mean"]) / w["scale"], -8, 8)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"]), "bag": bag, "starts": starts}


def fit(features: np.ndarray, passages: np.ndarray, labels: np.ndarray, epochs: int = 14, seed: int = 1, hidden: int = 24, gates: int = 12) -> Model:
    """Gradient descent (Adam, log loss, mini-batches of bags) from a fixed seed."""
    rng = np.random.default_rng(seed)
    f = features.shape[1]
    w = {
        "mean": features.mean(axis=0), "scale": features.std(axis=0) + 1e-3,
        "W": rng.normal(0, f**-0.5, (f, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gates)), "U": rng.normal(0, hidden**-0.5, (hidden, gates)),
        "w": rng.normal(0, gates**-0.5, gates), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.array(float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))),
    }
    learned = ("W", "b", "V", "U", "w", "c", "d")
    m1, m2 = ({k: np.zeros_like(w[k]) for k in learned} for _ in range(2))
    first = np.cumsum(passages) - passages
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(passages))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            rows = np.concatenate([np.arange(first[i], first[i] + passages[i]) for i in chosen])
            r = _forward(w, features[rows], passages[chosen])
            dy = (r["p"] - labels[chosen]) / len(chosen)
            dz = dy[:, None] * w["c"]
            da = (dz[r["bag"]] * r["h"]).sum(axis=1)
            de = r["a"] * (da - np.add.reduceat(r["a"] * da, r["starts"])[r["bag"]])
            dt = de[:, None] * w["w"] * r["g"] * (1 - r["t"] ** 2)
            dg = de[:, None] * w["w"] * r["t"] * r["g"] * (1 - r["g"])
            dh = r["a"][:, None] * dz[r["bag"]] + dt @ w["V"].T + dg @ w["U"].T
            dx = dh * (1 - r["h"] ** 2)
            grad = {
                "W": r["x"].T @ dx + 1e-4 * w["W"], "b": dx.sum(axis=0), "V": r["h"].T @ dt, "U": r["h"].T @ dg,
                "w": (r["t"] * r["g"]).T @ de, "c": r["z"].T @ dy + 1e-4 * w["c"], "d": dy.sum(),
            }
            step += 1
            for k in learned:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - 0.01 * 0.85**epoch * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model({k: np.asarray(v, np.float32) for k, v in w.items()})


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` labelled documents, chosen by a hash of the id among those that are not held out.

    A document with several labels takes the largest. With no labelled document, or labels all alike, scores are constant.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = (
        usable.groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), "doc_id")
        .limit(sample_docs)
    )
    chosen = saved(chosen, "labelled")  # bounded by sample_docs: safe to broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = joined.mapInArrow(_described, "doc_id string, quality int, features binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    if not rows:
        return _constant(0.5)
    quality = np.array([r["quality"] for r in rows], np.float64)
    if quality.min() == quality.max():
        return _constant(float(quality[0]) * 0.98 + 0.01)
    each = [np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit(np.concatenate(each).astype(np.float64), np.array([len(e) for e in each]), quality)


def _constant(p: float) -> Model:
    f, one = N_FEATURES, np.zeros((1, 1), np.float32)
    return Model(
        {"mean": np.zeros(f, np.float32), "scale": np.ones(f, np.float32), "W": np.zeros((f, 1), np.float32), "b": one[0], "V": one, "U": one, "w": one[0], "c": one[0], "d": np.float32(np.log(p / (1 - p)))}
    )


def _parts(batches: Iterator[pa.RecordBatch], most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with a bounded number of characters, or one text."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most_chars
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        features, passages = describe(batch.column("text").to_pylist())
        ends = np.cumsum(passages)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.string()),
                batch.column("quality").cast(pa.int32()),
                pa.array([features[e - p : e].tobytes() for e, p in zip(ends, passages)], pa.binary()),
            ],
            names=["doc_id", "quality", "features"],
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and passages (how many) of every row, from its whole text alone.

    Null and empty texts are scored as one passage of zeros. Other columns are left out, so theirs may have any name.
    Repeated rows each give their row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            features, passages = describe(batch.column("text").to_pylist())
            p = np.clip(model.scores(features, passages).astype(np.float64), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(passages, pa.int64())], names=["doc_id", "score", "passages"]
            )

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("passages", T.LongType())]
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_quality_mil(spark, sf_dir) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null and empty texts have a score too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
