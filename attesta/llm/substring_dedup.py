"""Substring deduplication with prefix-partitioned suffix trees.

A window of ``WINDOW`` words is repeated if its word sequence starts anywhere else; words that repeated windows cover are
removed. Equal texts are merged first. Suffixes are never listed for every word of the corpus:

1. Of the k-grams in a window, the one with the least hash is the window's anchor. Equal windows have equal anchors, and an
   anchor serves on average a dozen windows. Anchors are the places that suffixes are grouped by.
2. Groups are told by prefixes of variable length. The first is the anchor's k-gram; a group of one is dropped, as nothing
   in it repeats. The second is the anchor's whole context, all words of all windows around it: members that share it are
   repeats as they stand, and one of them goes on for all.
3. What is left of a group with several contexts is a subtree of its suffixes, cut at ``WINDOW`` words, built from the root
   down. A node of depth ``WINDOW`` with two leaves or more is a repeat.
4. A group too large for memory is parted by the longest prefix, ``WINDOW`` words: its leaves are counted where they meet.

Words stand as 64-bit hashes, and stretches of words are taken as equal where two hashes of 64 bits are: of the prefix and
of what follows it, or of a whole window by two multipliers. Texts move once, into a table in buckets of their key, and are read there without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import forget, free_shuffles, new_dir, remove, saved
from attesta.llm.word_arrays import Words, hashed_words, mixed, slices

WINDOW = 35
GRAM = 8
#: Members of a group whose subtree is built in one task.
GROUP = 2000
_ODD = 0x9FB21C651E98DF25
_OTHER_ODD = 0xA0761D6478BD642F
#: A key with more than this share of all rows has its rows where they are; there are at most as many such keys.
HOT_KEYS = 1024


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + n] for each i; what would pass the end repeats the last values."""
    done, out = 1, x
    while done < n:
        step = min(done, n - done)
        out = pick(out, np.concatenate((out[step:], np.full(min(step, len(out)), out[-1], out.dtype))))
        done += step
    return out


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A hash of the n words from each place; the last n - 1 places have none that counts."""
    out = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out[: len(h) - j] += h[j:] * np.uint64(pow(_ODD, j + 1, 1 << 64))
    return mixed(out) | np.uint64(1)


def anchors(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The places (among all words of ``w``) that are the anchor of some window, and the hashes of their k-grams."""
    if not len(w.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    span = window - gram + 1  # k-grams in a window
    g = grams(w.hashes, gram)
    place = np.arange(len(g))
    starts_window = place + window <= w.end_of_word
    least = np.where(starts_window, _slide(g, span, np.minimum), np.uint64(0))
    # the largest least-hash among the windows that hold a k-gram is its own hash just if one of them picked it
    most = _slide(least[::-1], span, np.maximum)[::-1]
    at = np.flatnonzero((most == g) & (place + gram <= w.end_of_word))
    return at, g[at]


def contexts(w: Words, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For anchors: first and past-the-last word of their context, and its hash with the anchor's place in it."""
    reach = window - gram
    a = np.maximum(at - reach, w.start_of_word[at])
    b = np.minimum(at + gram + reach, w.end_of_word[at])
    out = mixed(((at - a) * 64 + (b - a)).astype(np.uint64))
    with np.errstate(over="ignore"):
        for j in range(2 * reach + gram):
            inside = a + j < b
            out += np.where(inside, w.hashes[np.minimum(a + j, len(w.hashes) - 1)], np.uint64(0)) * np.uint64(pow(_ODD, j + 1, 1 << 64))
    return a, b, mixed(out)


def _columns(**arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays.values()], names=list(arrays))


def _find_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        _, g = anchors(hashed_words(batch.column("text").to_pylist()))
        yield _columns(prefix=g.view(np.int64))


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = hashed_words(batch.column("text").to_pylist())
        at, g = anchors(w)
        a, b, context = contexts(w, at)
        text = w.text_of_word[at]
        start = w.start_of_word[at]
        t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("t1", "t2"))
        yield _columns(
            prefix=g.view(np.int64), context=context.view(np.int64), t1=t1, t2=t2,
            pos=(at - start).astype(np.int32), a=(a - start).astype(np.int32), b=(b - start).astype(np.int32),
        )


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] places, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _hash_runs(h: np.ndarray, starts: np.ndarray, n: int, odd: int = _ODD) -> np.ndarray:
    """A hash of the n words from each start."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += h[starts + j] * np.uint64(pow(odd, j + 1, 1 << 64))
    return mixed(out)


def _find_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around each anchor asked for; for those of large groups, the hash of each window around it instead."""
    for batch in slices(batches):
        w = hashed_words(batch.column("text").to_pylist())
        first = np.cumsum(w.per_text) - w.per_text
        asked = batch.column("asked")
        text = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
        flat = asked.flatten()
        prefix, a, b = (flat.field(n).to_numpy() for n in ("prefix", "a", "b"))
        large = flat.field("large").to_numpy(zero_copy_only=False)
        t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
        small = ~large
        sizes = (b - a)[small].astype(np.int64)
        around = w.hashes[_ranges((first[text] + a)[small], sizes)]
        offsets = np.concatenate(([0], np.cumsum(8 * sizes))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(around)])
        yield _columns(
            prefix=prefix[small], other=np.zeros(len(sizes), np.int64), t1=t1[text[small]], t2=t2[text[small]], a=a[small].astype(np.int32), words=words
        )
        n = np.maximum((b - a)[large].astype(np.int64) - WINDOW + 1, 0)
        places, of = _ranges(a[large].astype(np.int64), n), np.repeat(text[large], n)
        for at in range(0, len(places), 1 << 17):
            p, t = places[at : at + (1 << 17)], of[at : at + (1 << 17)]
            whole, other = (_hash_runs(w.hashes, first[t] + p, WINDOW, odd) for odd in (_ODD, _OTHER_ODD))
            yield _columns(
                prefix=whole.view(np.int64), other=other.view(np.int64), t1=t1[t], t2=t2[t], a=p.astype(np.int32), words=pa.nulls(len(p), pa.binary())
            )


def subtree_repeats(
    prefix: np.ndarray, text: np.ndarray, at: np.ndarray, sizes: np.ndarray, words: np.ndarray, window: int = WINDOW, step: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Members (by index) and places of their windows that also stand elsewhere in the group of their prefix.

    A member is a stretch of ``sizes`` words of ``text`` from place ``at``; all members' words stand in ``words``. The trees
    of all prefixes are built from the root down: suffixes, cut at ``window`` words, are parted by their next ``step`` words
    at each node, and a suffix alone at a node goes. What is left at depth ``window`` are the leaves of deep internal nodes.
    """
    counts = np.maximum(sizes - window + 1, 0)
    member = np.repeat(np.arange(len(sizes)), counts)
    start = _ranges(np.cumsum(sizes) - sizes, counts)
    place = _ranges(at, counts)
    order = np.lexsort((place, text[member], prefix[member]))  # a place that several members hold is one leaf
    p, t, q = prefix[member][order], text[member][order], place[order]
    one = order[np.append(True, (p[1:] != p[:-1]) | (t[1:] != t[:-1]) | (q[1:] != q[:-1]))[: len(order)]]
    member, start, place, node = member[one], start[one], place[one], prefix[member[one]]
    for depth in range(0, window, step):
        edge = _hash_runs(words, start + depth, min(step, window - depth))
        order = np.lexsort((edge, node))
        new = np.append(True, (node[order][1:] != node[order][:-1]) | (edge[order][1:] != edge[order][:-1]))[: len(order)]
        number = np.cumsum(new) - 1
        kept = np.bincount(number, minlength=1)[number] > 1
        member, start, place, node = member[order][kept], start[order][kept], place[order][kept], number[kept]
    return member, place


def _search_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated words, of members in order of their prefix; a prefix whose members go on waits for the next batch."""
    waiting: pa.RecordBatch | None = None
    for batch in batches:
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        prefix = batch.column("prefix").to_numpy()
        whole = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if (prefix != prefix[-1]).any() else 0
        waiting = batch.slice(whole)
        if whole:
            yield _subtree_ranges(batch.slice(0, whole))
    if waiting is not None and waiting.num_rows:
        yield _subtree_ranges(waiting)


def _subtree_ranges(batch: pa.RecordBatch) -> pa.RecordBatch:
    prefix, t1, t2, at = (batch.column(c).to_numpy() for c in ("prefix", "t1", "t2", "a"))
    held = batch.column("words").to_pylist()
    sizes = np.array([len(x) // 8 for x in held], np.int64)
    with np.errstate(over="ignore"):
        text = mixed(t1.view(np.uint64) + t2.astype(np.int64).view(np.uint64) * np.uint64(_ODD))
    member, place = subtree_repeats(prefix, text, at.astype(np.int64), sizes, np.frombuffer(b"".join(held), np.uint64))
    order = np.lexsort((place, member))
    member, place = member[order], place[order]
    opens = np.append(True, (member[1:] != member[:-1]) | (np.diff(place) > WINDOW))[: len(place)]  # else they touch or overlap
    closes = np.append(opens[1:], True)[: len(place)]
    m = member[opens]
    return _columns(t1=t1[m], t2=t2[m], a=place[opens].astype(np.int32), b=(place[closes] + WINDOW).astype(np.int32))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n_words, n_removed, digest, spans = [], [], [], []
        for text, copies, ranges in zip(*(batch.column(c).to_pylist() for c in ("text", "copies", "ranges"))):
            found = (text or "").encode().split()
            gone = np.zeros(len(found) + 1, np.int32)
            if copies > 1 and len(found) >= WINDOW:
                gone[0], gone[-1] = 1, -1
            for r in ranges or ():
                gone[r["a"]] += 1
                gone[r["b"]] -= 1
            removed = np.cumsum(gone)[:-1] > 0
            kept = b" ".join([x for x, g in zip(found, removed.tolist()) if not g]) if removed.any() else b" ".join(found)
            change = np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))
            spans.append([{"a": int(x), "b": int(y)} for x, y in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1))])
            n_words.append(len(found))
            n_removed.append(int(removed.sum()))
            digest.append(hashlib.sha256(kept).hexdigest())
        yield _columns(
            t1=batch.column("t1"), t2=batch.column("t2"), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()),
            kept_sha256=pa.array(digest, pa.string()),
            removed=pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
        )


def _in(rows: DataFrame, keys: list[str], table: DataFrame, spread: list[str]) -> DataFrame:
    """The rows whose keys ``table`` (a saved frame of the keys and n, the rows of each) has, and its n.

    Keys that hold more than their share of the rows are told to all tasks, ``HOT_KEYS`` at most, and their rows move as
    ``spread`` deals them, so that no task gets a third of all rows for one key.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = table.where(F.col("n") > total / HOT_KEYS).select(*keys, F.col("n").alias("_hot"))
    flagged = rows.join(F.broadcast(hot), keys, "left")
    flagged = flagged.withColumn("_key", F.when(F.col("_hot").isNotNull(), F.xxhash64(*spread)).otherwise(F.col(keys[0])))
    known = table.select(F.col(keys[0]).alias("_key"), *keys[1:], F.col("n").alias("_n"))
    found = flagged.join(known, ["_key", *keys[1:]], "left").withColumn("n", F.coalesce("_hot", "_n"))
    return found.where(F.col("n").isNotNull()).drop("_key", "_hot", "_n")


def repeated_substrings(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (ranges of words, from 0, the end exclusive) of every row.

    ``text`` counts whole; null has no words. A text of fewer words than a window loses none. Rows with equal texts are
    repeats of each other, repeated rows among them. Columns other than doc_id and text are left out, so theirs may have any
    name. An empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text")})
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, folder = f"attesta_texts_{uuid.uuid4().hex}", new_dir(spark, "texts")
    (
        keyed.groupBy("t1", "t2")
        .agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        .write.bucketBy(buckets, "t1", "t2")
        .option("path", folder)
        .format("parquet")
        .saveAsTable(name)
    )
    free_shuffles(spark)
    texts = spark.table(name)

    prefixes = texts.select("text").mapInArrow(_find_prefixes, "prefix long")
    again = saved(prefixes.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
    free_shuffles(spark)
    found = texts.select("t1", "t2", "text").mapInArrow(
        _find_anchors, "prefix long, context long, t1 long, t2 int, pos int, a int, b int"
    )
    found = saved(_in(found, ["prefix"], again, ["t1", "pos"]).drop("n"), "anchors")
    forget(again)
    free_shuffles(spark)

    member = F.struct("t1", "t2", "a", "b")
    by_context = saved(found.groupBy("prefix", "context").agg(F.count("*").alias("n"), F.min(member).alias("one")), "contexts")
    repeated = saved(by_context.where("n > 1").select("prefix", "context", "n"), "contexts")
    whole = _in(found.where(F.col("b") - F.col("a") >= WINDOW), ["prefix", "context"], repeated, ["t1", "pos"]).select("t1", "t2", "a", "b")
    several = saved(by_context.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "members")
    one = by_context.select("prefix", "one").where(F.col("one.b") - F.col("one.a") >= WINDOW)
    asked = (
        _in(one, ["prefix"], several, ["one.t1", "one.a"])
        .select("one.t1", "one.t2", F.struct("prefix", "one.a", "one.b", (F.col("n") > group).alias("large")).alias("x"))
        .groupBy("t1", "t2")
        .agg(F.collect_list("x").alias("asked"))
    )
    suffixes = saved(
        texts.select("t1", "t2", "text")
        .join(asked, ["t1", "t2"])
        .mapInArrow(_find_suffixes, "prefix long, other long, t1 long, t2 int, a int, words binary"),
        "suffixes",
    )
    free_shuffles(spark)
    subtrees = (
        suffixes.where(F.col("words").isNotNull())
        .drop("other")
        .repartition("prefix")
        .sortWithinPartitions("prefix")
        .mapInArrow(_search_subtrees, "t1 long, t2 int, a int, b int")
    )
    leaf = F.struct("t1", "t2", "a")
    leaves = suffixes.where(F.col("words").isNull()).select("prefix", "other", "t1", "t2", "a")
    nodes = leaves.groupBy("prefix", "other").agg(F.min(leaf).alias("x"), F.max(leaf).alias("y"), F.count("*").alias("n"))
    nodes = saved(nodes.where("x != y").select("prefix", "other", "n"), "nodes")
    counted = _in(leaves, ["prefix", "other"], nodes, ["t1", "a"]).select("t1", "t2", "a", (F.col("a") + WINDOW).alias("b"))
    ranges = saved(
        whole.union(subtrees).union(counted).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "ranges"
    )
    free_shuffles(spark)
    results = saved(
        texts.join(ranges, ["t1", "t2"], "left").mapInArrow(
            _finish, "t1 long, t2 int, n_words long, n_removed long, kept_sha256 string, removed array<struct<a:int,b:int>>"
        ),
        "results",
    )
    spark.sql(f"DROP TABLE {name}")
    remove(spark, folder)
    forget(found, by_context, repeated, several, suffixes, nodes, ranges)
    return keyed.select("doc_id", "t1", "t2").join(results, ["t1", "t2"]).drop("t1", "t2")


def op9_substring_dedup(spark, sf_dir) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; see ``repeated_substrings`` for nulls and short texts."""
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


OP9_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, i, sha256(array_to_string(ws[i : i + 34], ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM rep)),
each AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (
  SELECT e.rid, string_agg(word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM each e LEFT JOIN gone g ON e.rid = g.rid AND e.p = g.p WHERE g.p IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""
