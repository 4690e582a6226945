"""Near-duplicate detection by SimHash fingerprints and BK-trees.

1. A document's fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes of its shingles.
2. Distinct fingerprints are dealt into shards. The 64 bits are cut into six blocks; fingerprints that differ in at most
   two bits agree in at least four blocks, so for each of the 15 choices of four blocks, the fingerprints that agree in
   them make a shard. A shard leaves two blocks free: it can't hold more than 2**22 fingerprints, whatever the input.
   Every pair within the radius meets in some shard, and a fingerprint alone in its shard needs no tree.
3. Each shard builds a BK-tree (children keyed by their Hamming distance to the parent) and every member searches it,
   following only edges within the radius. A shard tells its links as a spanning forest, never as all pairs.
4. Connected components of the links, by alternating large and small stars.

The trees are not broadcast: they grow with the corpus. The shuffle takes the fingerprints to the one tree, per choice of
blocks, that can hold their neighbours.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from attesta.llm.common import forget, free_shuffles, saved
from attesta.llm.word_arrays import slices

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: First bit and number of bits of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text: A-Z lower-cased, words parted by ASCII white space, shingles with repeats.

    Fewer words than a shingle: the whole sequence is one. No word, or null: 0.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - shingle_words + 1)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[min(shingle_words, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column("text")), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view("<i8"))], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class BKTree:
    """A BK-tree over distinct 64-bit values, built and searched level by level for all values at once."""

    def __init__(self, values: np.ndarray):
        self.values = np.asarray(values, np.uint64)
        waiting = np.arange(1, len(self.values))
        parent = np.zeros(len(waiting), np.int64)
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(waiting):
            d = np.bitwise_count(self.values[waiting] ^ self.values[parent]).astype(np.int64)
            # all that come to a node come at one time: of those at one distance the first is the child, the others go on to it
            taken, first, which = np.unique(parent * 65 + d, return_index=True, return_inverse=True)
            edges.append(taken)
            children.append(waiting[first])
            parent = waiting[first][which]
            rest = parent != waiting
            waiting, parent = waiting[rest], parent[rest]
        #: Edges as 65 * parent + distance, ascending, and their children: 16 bytes for each value, however few edges it has.
        order = np.argsort(np.concatenate(edges))
        self.edges, self.children = np.concatenate(edges)[order], np.concatenate(children)[order]

    def within(self, queries: np.ndarray, radius: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs (index of the query, node) at most ``radius`` apart."""
        queries = np.asarray(queries, np.uint64)
        for at in range(0, len(queries) if len(self.values) else 0, block):
            q = np.arange(at, min(at + block, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.edges, 65 * node + np.maximum(d - radius, 1), "left")
                n = np.searchsorted(self.edges, 65 * node + np.minimum(d + radius, 64), "right") - low
                q = np.repeat(q, n)
                node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def shard_links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within a shard: (value, smaller root value) as unsigned numbers."""
    values = np.sort(np.asarray(values, np.uint64))
    root = np.arange(len(values))
    for a, b in BKTree(values).within(values, radius):
        keep = a > b
        a, b = a[keep], b[keep]
        while len(a):  # hook roots, then follow them, until each link joins equal roots
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != root[root]).any():
                root = root[root]
    joined = np.flatnonzero(root != np.arange(len(values)))
    return list(zip(values[joined].tolist(), values[root[joined]].tolist()))


def _block(fp: Column, i: int) -> Column:
    start, bits = BLOCKS[i]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """src and dst (fp longs) that link all fingerprints within the radius, as far as components go."""
    if radius > 2:
        raise ValueError("the blocks are cut for a radius of at most 2")
    choices = list(combinations(range(len(BLOCKS)), 4))

    def key(i: int, chosen: tuple[int, ...]) -> Column:
        mask = sum(((1 << BLOCKS[b][1]) - 1) << BLOCKS[b][0] for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        return F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key"))

    dealt = distinct.select("fp", F.explode(F.array(*[key(i, c) for i, c in enumerate(choices)])).alias("k"))
    shards = (
        dealt.groupBy("k.choice", "k.key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for members in batch.column("members"):
                found.update(shard_links(members.values.to_numpy(zero_copy_only=False).view(np.uint64), radius))
            pairs = np.array(sorted(found), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    return shards.mapInArrow(run, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for every node that an edge (src, dst) touches.

    Alternating large and small stars until nothing changes, which takes rounds as the logarithm of the longest path does;
    each round's edges are written to the shared folder. Numbers compare as signed.
    """
    edges = saved(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        last, edges = edges, saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(last)
        # edges are distinct: equal counts and sums of two 64-bit hashes mean equal sets, but for a chance of 2 ** -128
        sums = [F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(20,0)")) for i in range(2)]
        now = edges.agg(F.count("*"), *sums).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links lead to, for every row.

    Reads doc_id and text only; other columns may have any name. A null or wordless text has fingerprint 0 and links like
    any other. Repeated rows share a component; a null doc_id is never the smallest unless a component has no other. An
    empty table gives no rows.
    """
    fps = saved(fingerprints(docs, shingle_words), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    free_shuffles(docs.sparkSession)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; see ``near_duplicates`` for nulls, ties and repeated rows."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
