"""Near duplicates among embeddings by a pivot-permutation index: cosines of at least a threshold, and their components.

1. Equal vectors are one entry that knows how many they are.
2. Pivots are entries of a bounded sample, none too near another: a large group of near copies has one of them, so that the
   other pivots tell its members apart no less than other vectors. There are ``PIVOTS_PER_ROOT`` times the square root of the
   number of vectors, so the lists of 4. grow as that root too. Vectors of another length have pivots of their own.
3. A vector is described by its ``PREFIX`` nearest pivots, nearest first.
4. The list of a pivot holds the vectors that it is nearest to. A vector looks into the lists of all pivots of its prefix, so
   a pair meets if the first pivot of either is in the prefix of the other. In a list, an inverted index of all pivots counts
   those that two prefixes share; pairs that share ``SHARED`` are verified by their cosines in double precision.
5. Long lists are cut into blocks of bounded size. A block gives, for each vector, a number of links and one link of a
   spanning forest, never its pairs; so what leaves a group of near copies grows as the group does.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.ann import paired
from attesta.llm.common import forget, saved
from attesta.llm.simhash import components

COSINE = 0.95
PREFIX = 12
SHARED = 3
PIVOTS_PER_ROOT = 4
#: Pivots are at most this near to each other.
APART = 0.8
#: At most this many pivots for each length of vectors, and numbers in them; the sample is four times as large.
MOST_PIVOTS = 1 << 14
MOST_NUMBERS = 1 << 20
#: Rows of a block, about: of a list and of those that look into it.
LIST_BLOCK = 512
LOOK_BLOCK = 1024
SEED = 13
#: Pairs that are counted at a time.
_CHUNK = 1 << 17


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of a power of two, so that no square overflows or vanishes."""
    if not x.size:
        return x.astype(float)
    x = np.ldexp(x.astype(float), -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def apart(sample: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` unit vectors of the sample, in order, that are no nearer to those before than ``APART``."""
    out = np.zeros((most, sample.shape[1]))
    n = 0
    for v in sample:
        if n == most:
            break
        if not n or (out[:n] @ v).max() <= APART:
            out[n] = v
            n += 1
    return out[:n]


def n_pivots(n: int, d: int) -> int:
    return max(1, min(n, PIVOTS_PER_ROOT * math.isqrt(n), MOST_PIVOTS, MOST_NUMBERS // d))


def pivots_of(entries: DataFrame) -> dict[int, np.ndarray]:
    """The pivots of each length of vectors."""
    sizes = {r["d"]: r["n"] for r in entries.groupBy("d").agg(F.count("*").alias("n")).collect()}
    wanted = entries.sparkSession.createDataFrame([(d, min(1.0, 4 * n_pivots(n, d) / n)) for d, n in sizes.items()], "d int, share double")
    # a vector is in the sample by its hash alone
    draw = F.shiftrightunsigned(F.xxhash64("v", F.lit(SEED)), 11) / float(1 << 53)
    found = entries.join(F.broadcast(wanted), "d").where(draw < F.col("share")).select("d", "v").orderBy("d", F.xxhash64("v", F.lit(SEED)), "v")
    rows = found.toArrow()
    sample: dict[int, list] = {}
    for d, v in zip(rows.column("d").to_pylist(), rows.column("v")):
        sample.setdefault(d, []).append(v.values.to_numpy(zero_copy_only=False))
    return {d: apart(units(np.stack(vs)), n_pivots(sizes[d], d)) for d, vs in sample.items()}


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of the nearest pivots of unit vectors, nearest first; ties go to the smaller number."""
    near = x @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :length].astype(np.int32)


def described(entries: DataFrame, pivots: dict[int, np.ndarray], length: int = PREFIX) -> DataFrame:
    """The entries with ``prefix``."""
    shared = entries.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                # a length that the sample missed has one list
                of_d = pivots.get(d, np.eye(1, d))
                step = max(1, (1 << 22) // max(d, len(of_d)))
                for part in (own.slice(i, step) for i in range(0, own.num_rows, step)):
                    found = prefixes(units(_matrix(part.column("v"))), of_d, length)
                    prefix = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*part.columns, prefix], names=[*part.schema.names, "prefix"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(run, f"{kinds}, prefix array<int>")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def candidates(look: np.ndarray, held: np.ndarray, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of prefixes look[i] and held[j] that share so many pivots, found by an inverted index of held."""
    pivot = held.reshape(-1)
    order = np.argsort(pivot, kind="stable")
    pivot, of = pivot[order], order // held.shape[1]
    step = max(1, _CHUNK // len(held))
    for at in range(0, len(look), step):
        part = look[at : at + step]
        a = np.searchsorted(pivot, part.reshape(-1), "left")
        n = np.searchsorted(pivot, part.reshape(-1), "right") - a
        i = np.repeat(np.arange(part.size) // part.shape[1], n)
        j = of[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        count = np.bincount(i * len(held) + j, minlength=len(part) * len(held))
        found = np.flatnonzero(count >= shared)
        yield at + found // len(held), found % len(held)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest one that the links a[i] - b[i] join it to."""
    root = np.arange(n)
    while len(a):  # hook roots, then follow them, until each link joins equal roots
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]
    return root


def _block_links(held: pa.Table, look: pa.Table, cosine: float, shared: int) -> pa.Table:
    """e, n (copies in the vectors that e is linked to by this block) and root (another of its entries, or e) of linked entries."""
    out = pa.table({"e": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if not held.num_rows or not look.num_rows:
        return out
    (he, hn, hp, hx), (le, ln, lp, lx) = (
        (t.column("e").to_numpy(), t.column("copies").to_numpy(), _matrix(t.column("prefix")), units(_matrix(t.column("v")))) for t in (held, look)
    )
    names, place = np.unique(np.concatenate([he, le]), return_inverse=True)
    h, q = place[: len(he)], place[len(he) :]
    total, links = np.zeros(len(names), np.int64), []
    for i, j in candidates(lp, hp, min(shared, hp.shape[1])):
        other = h[j] != q[i]
        i, j = i[other], j[other]
        near = np.concatenate([paired(lx, i[at : at + _CHUNK], hx, j[at : at + _CHUNK]) for at in range(0, len(i), _CHUNK)] or [np.zeros(0)])
        i, j = i[near >= cosine], j[near >= cosine]
        np.add.at(total, q[i], hn[j])
        # the other way round the pair meets too, unless the first pivot of i is not in the prefix of j
        alone = (hp[j] != lp[i, :1]).all(axis=1)
        np.add.at(total, h[j[alone]], ln[i[alone]])
        root = forest(q[i], h[j], len(names))
        joined = np.flatnonzero(root != np.arange(len(names)))
        links.append((joined, root[joined]))
    root = forest(*(np.concatenate(c) for c in zip(*links)), len(names))
    some = (total > 0) | (root != np.arange(len(names)))
    return pa.table({"e": pa.array(names[some]), "n": pa.array(total[some]), "root": pa.array(names[root][some])})


def block_links(index: DataFrame, cosine: float = COSINE, shared: int = SHARED) -> DataFrame:
    """e, n and root of every block of every list; see 5. above."""
    lists = ["d", "p"]
    held = index.withColumn("p", F.element_at("prefix", 1))
    look = index.select([F.col(c).alias(c) for c in index.columns]).withColumn("p", F.explode("prefix"))

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy(*lists).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    cut = saved(blocks(held, LIST_BLOCK, "held_blocks").join(blocks(look, LOOK_BLOCK, "look_blocks"), lists), "pivot-lists")
    own, other = F.pmod(F.xxhash64("e"), F.col("held_blocks")).cast("int"), F.pmod(F.xxhash64("e"), F.col("look_blocks")).cast("int")
    sides = ["e", "copies", "prefix", "v"]
    held = held.join(cut, lists).select(*lists, own.alias("hb"), F.explode(F.sequence(F.lit(0), F.col("look_blocks") - 1)).alias("lb"), *sides)
    look = look.join(cut, lists).select(*lists, F.explode(F.sequence(F.lit(0), F.col("held_blocks") - 1)).alias("hb"), other.alias("lb"), *sides)
    key = [*lists, "hb", "lb"]
    return (
        held.groupBy(*key)
        .cogroup(look.groupBy(*key))
        .applyInArrow(lambda a, b: _block_links(a, b, cosine, shared), "e long, n long, root long")
    )


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """id, n_links (other vectors at that cosine or above), component_id and kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite entries link with nothing, nor do vectors of different
    lengths with each other. Equal vectors are linked, whatever their ids; rows that repeat count each. component_id is the
    smallest id that links lead to; a null id is never the smallest unless all are. kept: it is the row's own id (a null id
    counts as equal to null). Other columns are left out, so theirs may have any name. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    # 128 bits stand for a vector
    key = [F.xxhash64("v", F.lit(i)).alias(f"k{i}") for i in range(2)]
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    takes_part = F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", "v", takes_part.alias("used"), *key)
    entries = rows.where("used").groupBy("k0", "k1").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("least"))
    entries = saved(entries.select("*", F.size("v").alias("d"), F.monotonically_increasing_id().alias("e")), "pivot-entries")
    index = saved(described(entries.select("e", "d", "copies", "v"), pivots_of(entries), prefix), "pivot-index")
    found = saved(block_links(index, cosine, shared), "pivot-links")
    roots = components(found.select(F.col("e").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "e")
    counts = found.groupBy("e").agg(F.sum("n").alias("n"))
    whole = saved(
        entries.select("k0", "k1", "e", "copies", "least")
        .join(counts, "e", "left")
        .join(roots, "e", "left")
        .select("k0", "k1", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "e").alias("root")),
        "pivot-entries-linked",
    )
    forget(entries, index, found)
    smallest = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = whole.join(smallest, "root").select("k0", "k1", "n_links", "component_id")
    linked = rows.where("used").select("id", "k0", "k1").join(by_key, ["k0", "k1"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT used").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op13_embedding_near_dedup(spark, sf_dir) -> DataFrame:
    """vec_id, n_links, component_id and kept of every embedding; see ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
