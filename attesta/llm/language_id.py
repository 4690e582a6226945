"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (n = 1, 2, 3; words padded by blanks) in order of frequency. A document
gets its own profile, and the language whose profile is nearest by out-of-place distance: the sum, over the document's
n-grams, of how far each stands from its place in the language's profile, or ``top`` where it has none there.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from attesta.llm.common import is_held_out, saved, tidied
from attesta.llm.word_arrays import slices

#: N-grams in a profile.
TOP = 300
#: Documents a language learns from, about: each training document is taken with this probability over their number.
PER_LANGUAGE = 1500
UNDETERMINED = "und"
_SHIFT = 21  # a code point, plus one, has 21 bits


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_codes(text: str | None) -> np.ndarray:
    """The codes of all n-grams of a text, repeats included; empty if it has no letter. Letters are lower-cased."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letters = np.where(_is_letter()[points], points + 1, 1)  # 1 is the blank
    padded = np.concatenate(([1], letters, [1]))
    kept = np.ones(len(padded), bool)
    kept[1:] = (padded[1:] != 1) | (padded[:-1] != 1)
    s = padded[kept]
    if len(s) < 3:
        return np.zeros(0, np.int64)
    two = s[:-1] << _SHIFT | s[1:]
    three = two[:-1] << _SHIFT | s[2:]
    return np.concatenate((s[s != 1], two, three[s[1:-1] != 1]))


def count(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in ascending order, and how often each stands there."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first; ties go to the smaller code."""
    if not len(codes):
        return codes
    found, n = count(codes)
    return found[np.argsort(-n, kind="stable")[:top]]


class Profiles:
    """The learned profiles: ``languages`` in ascending order, and each language's codes by rank."""

    def __init__(self, by_language: dict[str, list[int]], top: int = TOP):
        self.top = top
        self.languages = sorted(by_language)
        self.codes = np.unique(np.array([c for l in self.languages for c in by_language[l]], np.int64))
        self.place = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for j, language in enumerate(self.languages):
            at = np.searchsorted(self.codes, np.array(by_language[language], np.int64))
            self.place[at, j] = np.arange(len(at))

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language of codes by rank."""
        at = np.searchsorted(self.codes, codes)
        at = np.where((at < len(self.codes)) & (np.append(self.codes, -1)[at] == codes), at, len(self.codes))
        place = self.place[at]
        return np.where(place < 0, self.top, np.abs(place - np.arange(len(codes))[:, None])).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 - distance / largest distance; ``und``, 0 without letters."""
        codes = ranked(ngram_codes(text), self.top)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        d = self.distances(codes)
        best = int(np.argmin(d))
        return self.languages[best], float(max(0.0, 1.0 - d[best] / (self.top * len(codes))))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, top: int = TOP) -> Profiles:
    """Learn a profile for each value of ``lang``.

    Only documents with a lang, a text and an id that is not held out count. From each language about ``per_language`` of
    them are taken by a hash of the id (all, if there are fewer), so that what is learned from is bounded by a parameter;
    the whole text of each is counted. Without such documents there are no profiles and every prediction is ``und``.
    """
    usable = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles({}, top)
    share = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("profile")), F.lit(1 << 30)) / float(1 << 30)
    counts = saved(
        usable.where(draw < share[F.col("lang")])
        .select("lang", "text")
        .mapInArrow(tidied(_count_batches), "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n")),
        "ngrams",
    )
    by_language = {}
    for language in sizes:  # as many small top-k jobs as there are languages
        best = counts.where(F.col("lang") == language).orderBy(F.desc("n"), "code").limit(top)
        by_language[language] = [r["code"] for r in best.select("code", "n").collect()]
    return Profiles({l: codes for l, codes in by_language.items() if codes}, top)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by.setdefault(lang, []).append(ngram_codes(text))
        for lang, codes in by.items():
            found, n = count(np.concatenate(codes)) if sum(map(len, codes)) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())],
                names=["lang", "code", "n"],
            )


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The language of each document by ``profiles``: doc_id, lang_pred, score.

    Reads doc_id and text only; other columns are left out, so theirs may have any name. A null text, an empty one, or one
    without a letter gives ``und`` and 0. Repeated rows each give their row; an empty table gives none.
    """
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [profiles.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def labelled(docs: DataFrame, profiles: Profiles, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is determined with ``least_score`` or more, ``lang`` replaced by the prediction.

    Columns stay as they are; repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [profiles.predict(t.as_py()) for t in batch.column("text")]
            at = batch.schema.get_field_index("lang")
            batch = batch.set_column(at, "lang", pa.array([f[0] for f in found], pa.string()))
            yield batch.filter(pa.array([f[0] != UNDETERMINED and f[1] >= least_score for f in found], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op3_language_id(spark, sf_dir) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; see ``predict`` for nulls and texts without letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, learn(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
