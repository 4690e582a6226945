"""Mixing sources to target weights.

1. Each source's words are packed into streams of fixed-length blocks. There is a stream for every ``STREAM_ROWS`` documents,
   so that no task lays out a whole source; a stream's last block may be shorter. Blocks are numbered through the source.
2. Targets: weights share all words; a target stops at ``MOST`` times its source's size, and the excess is shared again.
3. The mix has as many slots for a source as blocks make up its target. Slots are dealt to output shards: each shard's
   counts by source are a multinomial draw, with what is left to deal as the probabilities.
4. A source's k-th slot is in epoch k // blocks and takes the block that the epoch's pseudorandom permutation of the
   source's block numbers gives for k % blocks. Slots are laid out in ranges of at most ``RANGE`` by as many tasks as their
   number calls for, and join blocks by number.

The driver holds a row for each source, and the counts of shards by source: ``CELLS`` numbers at most, or one shard.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.llm.common import SPACE, saved, words

BLOCK_WORDS = 32
#: Documents of all sources that a stream number stands for, about.
STREAM_ROWS = 1_000
#: Slots of an output shard, about, and the most numbers that are dealt on the driver.
SHARD_SLOTS = 1 << 14
CELLS = 1 << 22
#: Slots of a range, and of a task, about.
RANGE = 1 << 14
TASK_SLOTS = 1 << 17
MOST = 3
SEED = 20


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Each source's target of sum(sizes) by weight, none above ``most`` times its size."""
    found = [Fraction(0)] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s]
    left = Fraction(sum(sizes))
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                found[i] = share * weights[i]
            break
        for i in full:
            found[i] = Fraction(most * sizes[i])
            left -= found[i]
        open_ = [i for i in open_ if i not in full]
    return found


def deal(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source (column) in each shard (row): multinomial draws that end with each source's slots all dealt.

    Works on the driver, in time and memory as shards times sources.
    """
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for j in range(shards):
        room = -(-int(left.sum()) // (shards - j))
        while room > 0:
            drawn = np.minimum(rng.multinomial(room, left / left.sum()), left)
            out[j] += drawn
            left -= drawn
            room -= int(drawn.sum())
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of k under a pseudorandom permutation of 0 .. n-1 that ``key`` chooses.

    A Feistel network over the next even number of bits, followed again and again until the value is below n.
    """
    k, n, key = k.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum((np.ceil(np.log2(np.maximum(n.astype(np.float64), 2.0))).astype(np.uint64) + np.uint64(1)) >> np.uint64(1), 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.copy(), np.arange(len(k))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = (right ^ key[todo]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9 * (r + 1) % (1 << 64))
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


class Mix(NamedTuple):
    """``sources``: source, source_ix, source_size, blocks, target, slots. ``rows``: the columns kept, size, source_ix,
    stream, place (which with source_ix and stream names a row), first_block, last_block, first_word (of the source's
    stream). ``slots``: shard, source_ix, slot, block: what the mix takes, in order."""

    sources: pd.DataFrame
    rows: DataFrame
    slots: DataFrame


def mix(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = (1, 2, 3),
    block_words: int = BLOCK_WORDS,
    streams: int | None = None,
    shards: int | None = None,
    seed: int = SEED,
) -> Mix:
    """Plan a mix of documents (doc_id, text, source). Sources by code point, null last, weigh ``weights`` in turn.

    Columns that aren't in ``keep`` are left out, so theirs may have any name. Documents without words have no blocks and
    are never taken. Repeated rows and repeated ids are documents of their own: what puts rows in order within a stream is
    their id, their size and a hash of their text. Without words there are no slots.
    """
    spark = docs.sparkSession
    base = docs.select(*keep, F.col("source").alias("_source"), n_words(F.col("text")).alias("size"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    streams = streams or max(1, docs.count() // STREAM_ROWS)
    base = base.withColumn("stream", F.pmod(F.xxhash64(F.col("_id").cast("string"), "_hash"), F.lit(streams)).cast("int"))
    by_stream = saved(
        base.groupBy("_source", "stream").agg(F.sum("size").alias("size")).withColumn("blocks", F.expr(f"(size + {block_words - 1}) div {block_words}")),
        "mix-streams",
    )
    totals = {r._source: r for r in by_stream.groupBy("_source").agg(F.sum("size").alias("size"), F.sum("blocks").alias("blocks")).collect()}
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    sizes, blocks = [int(totals[s]["size"]) for s in names], [int(totals[s]["blocks"]) for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    n_slots = [min(MOST * b, round(t * b / s)) if s else 0 for t, b, s in zip(goal, blocks, sizes)]
    sources = pd.DataFrame(
        {
            "source": pd.Series(names, dtype=object),
            "source_ix": pd.Series(range(len(names)), dtype="int32"),
            "source_size": pd.Series(sizes, dtype="int64"),
            "blocks": pd.Series(blocks, dtype="int64"),
            "target": pd.Series([float(t) for t in goal], dtype="float64"),
            "slots": pd.Series(n_slots, dtype="int64"),
        }
    )
    places = spark.createDataFrame(list(enumerate(names)), "source_ix int, _name string")

    def placed_in(rows: DataFrame) -> DataFrame:
        return rows.join(places, F.col("_source").eqNullSafe(F.col("_name"))).drop("_source", "_name")

    earlier = Window.partitionBy("source_ix").orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed_in(by_stream).select("source_ix", "stream", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)).cast("long").alias("_base"))
    within = Window.partitionBy("source_ix", "stream").orderBy("_id", "size", "_hash")
    rows = (
        placed_in(base)
        .withColumns(
            {
                "place": F.row_number().over(within),
                "first_word": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
            }
        )
        .join(bases, ["source_ix", "stream"])
        .withColumn("first_block", F.expr(f"_base + first_word div {block_words}"))
        .withColumn("last_block", F.expr(f"_base + (first_word + size - 1) div {block_words}"))
        .drop("_id", "_hash")
    )
    shards = shards or max(1, min(sum(n_slots) // SHARD_SLOTS, CELLS // max(1, len(names))))
    return Mix(sources, rows, _slots(spark, blocks, n_slots, shards, seed))


def block_of(source: np.ndarray, slot: np.ndarray, blocks: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The block that each slot takes of its source, which has so many blocks."""
    with np.errstate(over="ignore"):
        key = (source.astype(np.int64) << 20) + slot // blocks + (seed << 40)
        return permuted(slot % blocks, blocks, key * 0x5851F42D4C957F2D)


def _slots(spark, blocks: list[int], n_slots: list[int], shards: int, seed: int) -> DataFrame:
    dealt = deal(n_slots, shards, seed)
    first = np.cumsum(dealt, axis=0) - dealt
    rows = [
        (j, i, int(first[j, i]), int(dealt[j, i]), blocks[i]) for j in range(shards) for i in range(len(blocks)) if dealt[j, i]
    ]

    @F.pandas_udf("long")
    def taken_block(source: pd.Series, slot: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(block_of(source.to_numpy(np.int64), slot.to_numpy(np.int64), n.to_numpy(np.int64), seed))

    counts = spark.createDataFrame(rows, "shard int, source_ix int, first long, n long, blocks long")
    tasks = max(1, -(-sum(n_slots) // TASK_SLOTS))  # a number given here is not merged by adaptive execution
    ranges = counts.withColumn("r", F.explode(F.expr(f"sequence(0L, (n - 1) div {RANGE})"))).repartition(tasks, "shard", "source_ix", "r")
    slot = F.explode(F.expr(f"sequence(first + r * {RANGE}, first + least(n, (r + 1) * {RANGE}) - 1)"))
    return ranges.withColumn("slot", slot).select("shard", "source_ix", "slot", taken_block("source_ix", "slot", "blocks").alias("block"))


def pieces(mixed: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What each row gives to each of its blocks: the columns of ``rows``, block, words from ``at`` (from 0, in the document)
    to ``to``, and times, how often the mix takes the block. A row without words gives one piece with a null block."""
    # a plan can't know how many slots come of the few counts by shard, so that the join is told not to broadcast them
    times = mixed.slots.groupBy("source_ix", "block").agg(F.count("*").alias("times")).hint("merge")
    each = mixed.rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.expr("sequence(first_block, last_block)"))))
    start = F.expr(f"(block - _base) * {block_words} - first_word")
    each = each.withColumns({"at": F.greatest(start, F.lit(0)), "to": F.least(start + block_words, F.col("size"))})
    return each.join(times, ["source_ix", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def taken(mixed: Mix) -> DataFrame:
    """Each row once: the columns kept, size, source_size, target and taken, the words that the mix takes from it."""
    spark = mixed.rows.sparkSession
    inner = ["stream", "place", "first_word", "first_block", "last_block", "_base", "source_ix"]
    kept = [c for c in mixed.rows.columns if c not in inner]
    words_taken = F.sum(F.when(F.col("block").isNotNull(), (F.col("to") - F.col("at")) * F.col("times")).otherwise(0))
    rows = pieces(mixed).groupBy("source_ix", "stream", "place").agg(*[F.first(c).alias(c) for c in kept], words_taken.alias("taken"))
    sources = spark.createDataFrame(
        [(int(r.source_ix), int(r.source_size), float(r.target)) for r in mixed.sources.itertuples()],
        "source_ix int, source_size long, target double",
    )
    return rows.join(sources, "source_ix", "left").select(*kept, "source_size", "target", F.col("taken").cast("long").alias("taken"))


def remixed(docs: DataFrame, columns: list[str], text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The mix as documents: a row for each time that some of a document is taken, with the words of the blocks taken.

    The e-th row of a document holds the words of its blocks that the mix takes at least e times, in their order and parted
    by one space; a document that is taken whole once keeps its text as it is. Documents without words stay as they are.
    """
    mixed = mix(docs, keep=tuple(dict.fromkeys(["doc_id", *columns])))
    key = ["source_ix", "stream", "place"]
    part = pieces(mixed).where("times > 0").select(*key, F.explode(F.expr("sequence(1, int(times))")).alias("e"), "at", "to")
    parts = part.groupBy(*key, "e").agg(F.sort_array(F.collect_list(F.struct("at", "to"))).alias("parts"))
    whole = F.size("parts").cast("long") > F.col("last_block") - F.col("first_block")

    def taken_words(w: Column) -> Column:
        cut = F.transform("parts", lambda p: F.slice(w, (p["at"] + 1).cast("int"), (p["to"] - p["at"]).cast("int")))
        return F.array_join(F.flatten(cut), " ")

    some = F.get(F.transform(F.array(words(F.col(text))), taken_words), F.lit(0))  # the words are parted once, not for each part
    out = (
        mixed.rows.join(parts, key, "left")
        .where(F.col("parts").isNotNull() | (F.col("size") == 0))
        .withColumn(text, F.when(F.col("parts").isNull() | whole, F.col(text)).otherwise(some))
    )
    if n_chars:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*columns)


def op2_mixing(spark, sf_dir) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; see ``mix`` for nulls, ties and repeated rows."""
    return taken(mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
