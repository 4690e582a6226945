"""Documents with nearly the same shingles: exact Jaccard similarity of at least ``LEAST`` between sets of five-word shingles.

SimHash fingerprints of 64 bits tell pairs of that similarity by some ten differing bits, a few by twenty; so far apart, no
choice of agreeing blocks and no BK-tree tells them from unlike pairs without looking at nearly all. So near pairs come from
SimHash, and the rest from MinHash bands:

1. A document becomes the set of the 64-bit hashes of its shingles; equal sets are one entry, whatever their number.
2. SimHash: fingerprints of the sets, linked by the BK-trees of ``simhash`` where they differ in at most two bits.
3. MinHash: ``BANDS`` bands of ``ROWS`` minima each. Two sets of similarity 0.8 agree in no band with a chance of 3 in a
   million, and more similar ones less. Sets that agree in a band share a bucket.
4. Pairs are looked at in turns, and of each turn only those whose sets are in no common component yet: the SimHash pairs; each
   set with one leader of its buckets; with the leaders of all its buckets; then the sets outside their bucket's leader's
   component with all of the bucket. A bucket's leader is the set that meets most others in its buckets, as the original of
   many near copies does. So each pair of a bucket is compared, or known to be in one component.
5. Pairs go on to be verified if two sketches allow it. At most ``UNLIKE`` of all minima may differ, told by four bits each; a
   pair of similarity 0.8 fails that with a chance of 1 in a million. And the parities of the sets' members by ``PARITIES``
   places may differ in no more places than similar sets of these sizes have unshared members: each such member turns one
   parity, so no similar pair fails that. Every link is verified on the whole sets. Components of the links are the groups.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from attesta.llm import simhash
from attesta.llm.common import forget, free_shuffles, saved, tidied
from attesta.llm.simhash import components
from attesta.llm.word_arrays import hashed_words, mixed, slices

SHINGLE_WORDS = 5
#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS = 32
ROWS = 5
SEED = 7
#: The most of BANDS * ROWS minima that may differ, in their lowest four bits, before a pair counts as unlike.
UNLIKE = 55
#: Places of the parity sketch, a multiple of 64. More tell longer sets apart.
PARITIES = 1024
#: Parts that the pairs of one set are dealt into.
_SALTS = 256
_CHUNK = 2048


def shingle_sets(texts: list[str | None], shingle_words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, ascending. A-Z are lower-cased, words parted by ASCII white space.

    Fewer words than a shingle: the whole sequence is one. No word, or null: the empty set.
    """
    words = hashed_words([None if t is None else t.encode().lower().decode() for t in texts])
    odd = np.random.default_rng([SEED, 0]).integers(1, 1 << 63, shingle_words, np.uint64) * np.uint64(2) + np.uint64(1)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in words.per_text.tolist():
            w = words.hashes[at : at + n]
            at += n
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            size = min(n, shingle_words)
            total = np.full(n - size + 1, size, np.uint64)
            for i in range(size):
                total = total + mixed(w[i : i + len(total)] * odd[i])
            out.append(np.unique(mixed(total)))
    return out


def key_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED)


def minima(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least of each of n hashes of the set's members."""
    rng = np.random.default_rng([SEED, 1])
    odd = rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, n, np.uint64)
    least = np.full(n, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), _CHUNK):
            np.minimum(least, (odd[:, None] * shingles[at : at + _CHUNK] + add[:, None]).min(axis=1), out=least)
    return least


def band_hashes(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band's minima and its number."""
    by_band = least.reshape(bands, -1)
    total = np.arange(1, bands + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(by_band.shape[1]):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + by_band[:, i])
    return total


def sketch_of(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen of them in a number."""
    bits = (mixed(least) & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(bits, axis=1)


def unlike_minima(a: Column, b: Column) -> Column:
    """How many minima differ between two sketches."""

    def one(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return sum((one(i) for i in range(1, BANDS * ROWS // 16)), one(0))


def parities_of(shingles: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` places whether an odd number of members falls there, 64 places in a number."""
    places = (mixed(shingles) % np.uint64(PARITIES)).astype(np.int64)
    odd = np.bincount(places, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def may_be_similar(a: Column, b: Column) -> Column:
    """Whether sets told by size, sketch and parities may be similar.

    Of sets whose similarity is p / q or more, at most (q - p) / (q + p) of their sizes' sum is not shared.
    """
    p, q = LEAST
    x, y = a["parities"], b["parities"]
    unshared = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, PARITIES // 64)), F.bit_count(x[0].bitwiseXOR(y[0])))
    fits = (p + q) * unshared <= (q - p) * (a["size"] + b["size"])
    return _sizes_fit(a["size"], b["size"]) & fits & (unlike_minima(a["sketch"], b["sketch"]) <= UNLIKE)


def simhash_of(shingles: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes; 0 for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is ``LEAST`` or more; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 500, size: str = "4m"):
    """While whole texts and sets go to Python: fewer rows, and bytes, at a time than the session's settings."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Lists of one length."""
    starts = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(len(rows[0]))
    return pa.ListArray.from_arrays(pa.array(starts), _signed(np.concatenate(rows)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), key and size of its set, fp (its SimHash fingerprint), bands, sketch and parities, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            sets = shingle_sets(batch.column("text").to_pylist())
            least = [minima(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("hash"),
                    _signed([key_of(s) for s in sets]),
                    pa.array([len(s) for s in sets], pa.int64()),
                    _signed([simhash_of(s) for s in sets]),
                    _lists([band_hashes(m) for m in least]),
                    _lists([sketch_of(m) for m in least]),
                    _lists([parities_of(s) for s in sets]),
                ],
                names=["doc_id", "hash", "key", "size", "fp", "bands", "sketch", "parities"],
            )

    longs = [(n, T.LongType()) for n in ("hash", "key", "size", "fp")]
    lists = [(n, T.ArrayType(T.LongType())) for n in ("bands", "sketch", "parities")]
    fields = [("doc_id", docs.schema["doc_id"].dataType), *longs, *lists]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(tidied(run), T.StructType([T.StructField(*f) for f in fields]))


def _sets(docs: DataFrame) -> DataFrame:
    """key and shingles (bytes of the ascending hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            sets = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [_signed([key_of(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"]
            )

    return docs.select("text").mapInArrow(tidied(run), "key long, shingles binary")


def _sizes_fit(a: Column, b: Column) -> Column:
    """Sets whose sizes differ more than this can't be similar."""
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose sets are similar. A src may have any number of pairs."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(_SALTS)))
    left = salted.select("src", "salt").distinct().join(sets.toDF("src", "a"), "src")
    rows = salted.join(left, ["src", "salt"]).join(sets.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [
                similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))
                for a, b in zip(batch.column("a"), batch.column("b"))
            ]
            yield batch.select(["src", "dst"]).filter(pa.array(hit, pa.bool_()))

    return rows.mapInArrow(tidied(run), "src long, dst long")


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs (src, dst) that no component holds yet."""
    pairs = pairs.distinct()
    if roots is None:
        return pairs
    for end in ("src", "dst"):
        pairs = pairs.join(roots.toDF(end, f"{end}_root"), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return pairs.where(F.col("src_root") != F.col("dst_root")).select("src", "dst")


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose sketches are alike."""
    both = pairs.join(sketches.toDF("src", "a"), "src").join(sketches.toDF("dst", "b"), "dst")
    return both.where(may_be_similar(F.col("a"), F.col("b"))).select("src", "dst")


def _held(pairs: DataFrame, docs: DataFrame, signed: DataFrame) -> DataFrame:
    """The links among the pairs, after reading the texts of their ends, and of no others, again."""
    pairs = saved(pairs, "shingle-pairs")
    wanted = saved(pairs.select("src").union(pairs.select("dst")).distinct().toDF("key"), "shingle-wanted")
    ids = signed.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("_id")).select("_id").distinct()
    ids = saved(ids, "shingle-ids")
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = _sets(texts).join(wanted, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))
    sets = saved(sets, "shingle-sets")
    found = saved(verified(pairs, sets), "shingle-links")
    forget(pairs, wanted, ids, sets)
    free_shuffles(docs.sparkSession)
    return found


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """src and dst (keys) that link all similar sets, as far as components go."""
    columns = [F.first(c).alias(c) for c in ("size", "fp", "bands", "sketch", "parities")]
    distinct = saved(signed.groupBy("key").agg(*columns), "shingle-distinct")
    sketches = distinct.select("key", F.struct("size", "sketch", "parities").alias("told"))
    entries = distinct.select("key", "size", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = saved(entries.join(buckets, "bucket"), "shingle-crowded")
    met = crowded.groupBy("key").agg(F.sum("n").alias("met"))
    leaders = crowded.join(met, "key").groupBy("bucket").agg(F.max(F.struct("met", "key", "size")).alias("leader"))
    members = saved(crowded.select("bucket", "key", "size").join(leaders, "bucket"), "shingle-members")
    forget(crowded)
    free_shuffles(docs.sparkSession)

    fit = members.where((F.col("key") != F.col("leader.key")) & _sizes_fit(F.col("size"), F.col("leader.size")))
    first = fit.groupBy("key").agg(F.max("leader").alias("leader"))
    led = [f.select(F.col("leader.key").alias("src"), F.col("key").alias("dst")) for f in (first, fit)]
    found, roots = None, None
    for pairs in (_simhash_pairs(distinct), *led):
        more = _held(_alike(_apart(pairs, roots), sketches), docs, signed)
        found = more if found is None else found.union(more)
        if roots is not None:
            forget(roots)
        roots = saved(components(found), "shingle-roots")

    placed = members.select("bucket", "key", F.col("leader.key").alias("leader"))
    placed = placed.join(roots.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = saved(placed, "shingle-placed")
    # buckets of one component have no pair left
    open_ = placed.groupBy("bucket").agg(F.max_by("root", F.col("key") == F.col("leader")).alias("led"), F.min("root").alias("a"), F.max("root").alias("b"))
    open_ = open_.where(F.col("a") != F.col("b")).select("bucket", "led")
    rest = saved(placed.join(open_, "bucket").where(F.col("key") != F.col("leader")).join(sketches, "key"), "shingle-rest")
    outside = rest.where(F.col("root") != F.col("led")).select(
        "bucket", F.col("key").alias("src"), F.col("root").alias("src_root"), F.col("told").alias("src_told")
    )
    # pairs with a leader have been compared; two sets outside the leader's component meet once
    across = outside.join(rest, "bucket").where(
        (F.col("root") != F.col("src_root"))
        & ((F.col("root") == F.col("led")) | (F.col("src") < F.col("key")))
        & may_be_similar(F.col("told"), F.col("src_told"))
    )
    more = _held(across.select("src", F.col("key").alias("dst")).distinct(), docs, signed)
    forget(distinct, members, roots, placed, rest)
    return found.union(more)


def _simhash_pairs(distinct: DataFrame) -> DataFrame:
    """src and dst (keys) of sets with one fingerprint, or with fingerprints that a BK-tree links; of sets of like size only.

    Of many sets with one fingerprint the smallest key stands for all.
    """
    by_fp = distinct.groupBy("fp").agg(F.min(F.struct("key", "size")).alias("one"))
    same = distinct.join(by_fp, "fp").where(F.col("key") != F.col("one.key"))
    same = same.select(F.col("one.key").alias("src"), F.col("key").alias("dst"), F.col("one.size").alias("a"), F.col("size").alias("b"))
    ends = by_fp.select("fp", "one.key", "one.size")
    linked = simhash.links(by_fp.select("fp"))
    linked = linked.join(ends.toDF("src", "u", "a"), "src").join(ends.toDF("dst", "v", "b"), "dst")
    return same.unionByName(linked.select(F.col("u").alias("src"), F.col("v").alias("dst"), "a", "b")).where(_sizes_fit(F.col("a"), F.col("b"))).select("src", "dst")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``signatures``, and for each set: key, and one, the first row of its group as (no_id, doc_id, hash)."""
    with _small_batches(docs.sparkSession):
        signed = saved(signatures(docs), "shingle-signatures")
        roots = components(links(docs, signed))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    first = signed.groupBy("key").agg(F.min(row).alias("first"))
    free_shuffles(docs.sparkSession)
    rooted = first.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("one"))
    return signed, rooted.join(smallest, "root").select("key", "one")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links lead to, for every row.

    Reads doc_id and text only. Null and wordless texts have the empty set and are one group. Repeated rows share a component;
    rows with one doc_id and unlike texts have components of their own. A null doc_id is never the smallest unless a component
    has no other. An empty table gives no rows.
    """
    signed, groups = _groups(docs)
    return signed.select("doc_id", "key").join(groups, "key").select("doc_id", F.col("one.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """All columns of one row of each group of near duplicates: of those with an id the smallest, then that with the least
    hash of its text; of rows alike in both, the smallest in order of their columns, which must be such as can be ordered."""
    keys = ["_no_id", "_id", "_of"]
    no_id, an_id = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    kept = _groups(docs)[1].select("one.doc_id", "one.hash").select(no_id.alias("_no_id"), an_id.alias("_id"), F.col("hash").alias("_of")).distinct()
    keyed = docs.withColumns({"_no_id": no_id, "_id": an_id, "_of": F.xxhash64("text")})
    # repeated rows meet before texts are shuffled, and the join finds them dealt by its own keys
    one = keyed.groupBy(keys).agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_row")).join(kept, keys, "left_semi")
    return one.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
