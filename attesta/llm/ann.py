"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe tables and exact reranking.

1. Equal vectors are one entry with its smallest ids; a search never needs more of them than it returns.
2. Largest inner product becomes smallest angle: entries are parted into bands of like length, and those shorter than the
   longest of their band get one more coordinate that makes up the difference (queries get 0 there); all are padded with
   zeros to a power of two. Each band has tables of its own, and a query probes those of every band. Where lengths differ, a
   band of at most ``WHOLE_BAND`` vectors is compared whole: long vectors are few, and answer queries at wide angles too.
3. Each table hashes unit vectors by several fast pseudo-rotations (three rounds of random signs and a Hadamard transform),
   each to its nearest signed axis; together the axes are the bucket. The last polytope may use some of its axes only, so
   that the number of buckets grows in proportion to the number of entries: a bucket holds ``BUCKET`` of them on average.
4. A query probes as many buckets of a table as the square root of their number, those first whose axes are together
   nearest to it. The share of all entries that it meets falls as they grow.
5. Buckets lie in groups of about ``ENTRY_BLOCK`` entries, in which candidates are scored exactly on the original vectors in
   double precision. Large groups are cut into blocks of bounded size on both sides.
6. Each query is first scored against one bounded sample of entries. No score below its k + 1 best there can be in the
   answer, so that groups tell few of their candidates; what the sample holds is a candidate like any other. Tables are
   searched in turns (``TURNS``), and what a turn finds raises the floors of the next.
"""

from __future__ import annotations

import math
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.llm.common import forget, saved

TABLES = 16
#: Entries in a bucket, on average.
BUCKET = 3
#: Rows of a block, about, for index entries and for queries.
ENTRY_BLOCK = 1024
QUERY_BLOCK = 512
#: Entries that give each query its floor: at most this many, and at most an eighth of all.
SAMPLE = 2048
#: The first table of each turn.
TURNS = (0, 1, 4)
SEED = 10
#: Lengths of a band differ at most by this factor.
BAND_RATIO = 1.25
WHOLE_BAND = 1024
#: Where lengths differ: a query for which an entry at a cosine below this could count compares the band whole.
WIDE = 0.2
_SALTS = 16
#: Pairs scored, or combinations of axes ranked, at a time.
_CHUNK = 1 << 18


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def extended(x: np.ndarray, longest: float | np.ndarray, is_query: bool, width: int) -> np.ndarray:
    """Vectors as points whose angles order as the inner products do: see 2. above."""
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    if not is_query and width > x.shape[1]:
        out[:, x.shape[1]] = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0.0))
    return out


def band_of(x: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """The number of each row's band: the first whose longest vector (ascending) is not shorter than the row."""
    lengths = np.sqrt((x**2).sum(axis=1))
    return np.minimum(np.searchsorted(longest, lengths * (1 - 1e-9)), len(longest) - 1)


class Layout(NamedTuple):
    """The tables of a band: ``dims``, the coordinates that each polytope uses, and the bits of bucket and group numbers."""

    dims: tuple[int, ...]
    bits: int
    group_bits: int

    @property
    def probes(self) -> int:
        return math.isqrt((1 << self.bits) - 1) + 1


def layout(n: int, width: int) -> Layout:
    """For n entries of ``width`` (a power of two) coordinates."""
    full = width.bit_length()  # a polytope has 2 * width axes
    bits = max(min(full, 3), round(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 0)
    dims = (width,) * (bits // full) + ((1 << (bits % full - 1),) if bits % full else ())
    return Layout(dims, bits, min(bits, max(0, n // ENTRY_BLOCK).bit_length()))


WHOLE = Layout((), 0, 0)


def buckets(x: np.ndarray, table: int, dims: tuple[int, ...], probes: int) -> np.ndarray:
    """For each row the numbers of the ``probes`` buckets nearest to it (all, if there are fewer), nearest first.

    How far a bucket is: the sum over its polytopes of (the largest coordinate minus its axis's) squared. An axis is numbered
    2 * i, its opposite 2 * i + 1, and the polytopes' axes make up the number as digits do.
    """
    step = max(1, _CHUNK // max(64, probes))
    if len(x) > step:
        return np.concatenate([buckets(x[at : at + step], table, dims, probes) for at in range(0, len(x), step)])
    code, far = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for i, d in enumerate(dims):
        turned = rotated(x, 64 * table + i)[:, :d]
        both = np.stack([turned, -turned], axis=2).reshape(len(x), -1)
        if probes == 1:
            code = code * (2 * d) + both.argmax(axis=1)[:, None]
            continue
        axis = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        near = np.take_along_axis(both, axis, 1)
        # of sums of two ascending lists, the one at places a and b has (a + 1) * (b + 1) - 1 that are not larger
        a, b = np.nonzero(np.outer(np.arange(far.shape[1]) + 1, np.arange(near.shape[1]) + 1) <= probes)
        far = far[:, a] + (near[:, :1] - near)[:, b] ** 2
        code = code[:, a] * (2 * d) + axis[:, b]
        order = np.argsort(far, axis=1, kind="stable")[:, :probes]  # a bucket's first axes are among the best of first axes
        code, far = np.take_along_axis(code, order, 1), np.take_along_axis(far, order, 1)
    return code


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows, added up in the order of coordinates, so that equal vectors get equal scores."""
    out = np.zeros((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    for i in range(a.shape[1]):
        out += a[:, i : i + 1] * columns[i]
    return out


def paired(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of a[i] and b[j], added up as ``inner`` does."""
    out = np.zeros(len(i))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        out += x[i] * y[j]
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v of the vectors that take part: not null, of numbers only, all finite, not all zero, with an id."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        .where(F.col("id").isNotNull() & v.isNotNull())
        .where(~bad & F.exists(v, lambda x: x != 0))
    )


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """A row for each distinct vector: v and ids, its k + 1 smallest ids in ascending order.

    Ids are taken in two steps, by salt and then together, so that a very common vector isn't one task's work.
    """
    salted = Window.partitionBy("v", "salt").orderBy("id")
    together = Window.partitionBy("v").orderBy("id")
    rows = vectors.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    few = rows.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1).drop("n", "salt")
    few = few.withColumn("n", F.row_number().over(together)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    tables: int = TABLES,
    probes: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of ``vectors`` that ``queries`` (a condition on ``id``) picks,
    the k other ids with the largest inner product among the candidates, largest first, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part. An inner product needs vectors of one
    dimension: those of another than the most common one (ties: the smaller) are left out. Equal rows count once; different
    vectors under one id are candidates each. Other columns are left out, so theirs may have any name. A query that finds
    fewer than k gets the exact answer, all candidates if they are fewer; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    valid = usable(vectors, id_col, vector_col)
    shape = (
        valid.groupBy(F.size("v").alias("d"))
        .agg(F.count("*").alias("n"), F.max(_norm2(F.col("v"))).alias("most"), F.min(_norm2(F.col("v"))).alias("least"))
        .orderBy(F.desc("n"), "d")
        .first()
    )
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = shape["d"]
    even = shape["most"] - shape["least"] <= 1e-6 * shape["most"]  # then no coordinate has to be added
    width = 1 << max(0, (d if even else d + 1) - 1).bit_length()
    valid = valid.where(F.size("v") == d)
    index = saved(entries(valid, k), "ann-entries")
    bands = [(shape["most"], index.count())] if even else bands_of(index)
    longest = np.sqrt([most for most, _ in bands])
    layouts = [WHOLE if n <= WHOLE_BAND and not even else layout(n, width) for _, n in bands]
    asked = valid.where(queries)
    distinct = saved(_floors(asked.groupBy("v").agg(F.min("id").alias("q")), _sample(index, sum(n for _, n in bands)), k), "ann-queries")

    hashed = saved(_hashed(index, longest, layouts, width, tables), "ann-hashed")
    n_parts = max(1, distinct.count() // 128)
    merged = distinct.select("q", F.explode("found").alias("x")).select("q", "x.minus", "x.id")
    floors = distinct.select("v", "q", "floor")
    for a, b in zip(TURNS, (*TURNS[1:], tables)):
        if a >= tables:
            break
        probing = saved(_probing(floors.repartition(n_parts), longest, layouts, width, tables, range(a, min(b, tables)), probes), "ann-probing")
        turn = hashed.where((F.col("t") % tables >= a) & (F.col("t") % tables < b))
        merged = saved(_best(_meet(turn, probing, k).unionByName(merged), k), "ann-found")
        forget(probing)
        reached = merged.groupBy("q").agg(F.max("minus").alias("last"), F.count("*").alias("n")).where(F.col("n") > k)
        floors = distinct.select("v", "q", "floor").join(reached, "q", "left").select("v", "q", F.greatest("floor", -F.col("last")).alias("floor"))
    forget(hashed)
    # a query that found fewer than there are to find looks at all entries, block by block
    there = index.select(F.explode("ids").alias("id")).limit(k + 1).count()
    enough = merged.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= there).select("q")
    short = distinct.select("v", "q").join(enough, "q", "left_anti")
    all_of = [F.lit(0).alias("t"), F.lit(0).cast("long").alias("g")]
    everything = _meet(
        index.select(*all_of, F.lit(0).cast("long").alias("code"), "v", "ids"),
        saved(short.select(*all_of, F.lit(None).cast("array<bigint>").alias("codes"), "v", "q", F.lit(float("-inf")).alias("floor")), "ann-short"),
        k,
    )
    answers = merged.join(enough, "q", "left_semi").unionByName(_best(everything, k))
    one = asked.select("id", "v").distinct().join(distinct.select("v", "q"), "v").select(F.col("id").alias("query_id"), "q")
    others = one.join(answers, "q").where(F.col("id") != F.col("query_id"))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("minus", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), (-F.col("minus")).alias("score"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k + 1 rows (minus, id) of each q; a row that several tables give counts once."""
    order = Window.partitionBy("q").orderBy("minus", "id")
    rows = found.groupBy("q", "minus", "id").agg(F.lit(1).alias("_one")).drop("_one")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("q", "minus", "id")


def bands_of(index: DataFrame) -> list[tuple[float, int]]:
    """Each band's largest squared length, ascending, and its entries.

    There are as many as the lengths' range has powers of ``BAND_RATIO`` at most.
    """
    band = F.floor(F.log(_norm2(F.col("v"))) / (2 * np.log(BAND_RATIO)))
    rows = index.groupBy(band.alias("band")).agg(F.max(_norm2(F.col("v"))).alias("most"), F.count("*").alias("n")).collect()
    return sorted((r.most, r.n) for r in rows)


def _sample(index: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``SAMPLE`` entries, the first by a hash: vectors, and for each id the vector's place and the id."""
    rows = index.orderBy(F.xxhash64("v", F.lit(SEED)), "v").limit(min(SAMPLE, n // 8)).toArrow()
    ids = rows.column("ids").to_pylist()
    at = np.repeat(np.arange(len(ids)), [len(i) for i in ids]).astype(np.int64)
    return _matrix(rows.column("v")), at, np.array([j for i in ids for j in i], np.int64)


def _floors(asked: DataFrame, sample: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> DataFrame:
    """v, q, floor (the score of the k + 1 best of the sample; minus infinity if it has fewer) and found, those k + 1."""
    vectors, at, ids = sample
    kind = pa.list_(pa.struct([("minus", pa.float64()), ("id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            floor, found = np.full(batch.num_rows, -np.inf), [[] for _ in range(batch.num_rows)]
            if len(ids):
                for i, scores in enumerate(inner(_matrix(batch.column("v")), vectors)):
                    each = scores[at]
                    top = np.lexsort((ids, -each))[: k + 1]
                    found[i] = [{"minus": -float(each[j]), "id": int(ids[j])} for j in top]
                    if len(top) > k:
                        floor[i] = each[top[k]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("v"), batch.column("q"), pa.array(floor), pa.array(found, kind)], names=["v", "q", "floor", "found"]
            )

    v = asked.schema["v"].dataType.simpleString()
    return asked.select("v", "q").mapInArrow(run, f"v {v}, q long, floor double, found array<struct<minus:double,id:long>>")


def _hashed(index: DataFrame, longest: np.ndarray, layouts: list[Layout], width: int, tables: int) -> DataFrame:
    """t, g, code, v and ids of every entry in each table of its band: t counts on from band * tables, g is the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            own = band_of(x, longest)
            points = extended(x, longest[own], False, width)
            for band in np.unique(own).tolist():
                use, at = layouts[band], np.flatnonzero(own == band)
                some = batch.take(pa.array(at))
                for t in range(tables if use.bits else 1):
                    code = buckets(points[at], t, use.dims, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), band * tables + t, np.int32)),
                            pa.array(code >> (use.bits - use.group_bits)),
                            pa.array(code),
                            some.column("v"),
                            some.column("ids"),
                        ],
                        names=["t", "g", "code", "v", "ids"],
                    )

    v = index.schema["v"].dataType.simpleString()
    return index.select("v", "ids").mapInArrow(run, f"t int, g long, code long, v {v}, ids array<bigint>")


def _probing(
    asked: DataFrame, longest: np.ndarray, layouts: list[Layout], width: int, tables: int, turn: range, probes: int | None
) -> DataFrame:
    """t, g, codes (the buckets to look at; null: all of the group), v, q and floor of every query, for each group it probes
    in a turn's tables; a band that is compared whole belongs to the first turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            x = _matrix(batch.column("v"))
            points = extended(x, 0.0, True, width)
            lengths = np.sqrt((x**2).sum(axis=1))
            floor = batch.column("floor").to_numpy()

            def rows(t: int, g: np.ndarray, codes: pa.Array, at: np.ndarray) -> pa.RecordBatch:
                some = batch.take(pa.array(at))
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t, np.int32)), pa.array(g), codes, some.column("v"), some.column("q"), some.column("floor")],
                    names=["t", "g", "codes", "v", "q", "floor"],
                )

            for band, use in enumerate(layouts):
                # the cosine, to the band's longest, that an entry needs to reach the floor
                needs = floor / (lengths * longest[band])
                whole = np.full(len(x), use.bits == 0) if len(layouts) == 1 else (needs < WIDE) | (use.bits == 0)
                there = needs <= 1 + 1e-9
                at = np.flatnonzero(whole & there)
                if len(at) and turn.start == 0:
                    n = 1 << use.group_bits
                    groups = np.tile(np.arange(n), len(at))
                    yield rows(band * tables, groups, pa.nulls(len(groups), pa.list_(pa.int64())), np.repeat(at, n))
                at = np.flatnonzero(~whole & there)
                for t in turn if len(at) else ():
                    found = np.sort(buckets(points[at], t, use.dims, probes or use.probes), axis=1)
                    g = found >> (use.bits - use.group_bits)
                    opens = np.ones(found.shape, bool)
                    opens[:, 1:] = g[:, 1:] != g[:, :-1]
                    starts = np.flatnonzero(opens.reshape(-1))
                    codes = pa.ListArray.from_arrays(pa.array(np.append(starts, found.size).astype(np.int32)), pa.array(found.reshape(-1)))
                    yield rows(band * tables + t, g.reshape(-1)[starts], codes, at[starts // found.shape[1]])

    v = asked.schema["v"].dataType.simpleString()
    return asked.mapInArrow(run, f"t int, g long, codes array<bigint>, v {v}, q long, floor double")


def _meet(hashed: DataFrame, probing: DataFrame, k: int) -> DataFrame:
    """q, minus and id: the answers of ``_answers`` for queries and entries of one (t, g), in blocks of bounded size."""
    n_entries = hashed.groupBy("t", "g").agg(F.ceil(F.count("*") / (2 * ENTRY_BLOCK)).cast("int").alias("entry_blocks"))
    n_queries = probing.groupBy("t", "g").agg(F.ceil(F.count("*") / (2 * QUERY_BLOCK)).cast("int").alias("query_blocks"))
    # a group of more than two blocks is cut; only such groups are told, and Spark broadcasts them if they are few
    large = saved(n_entries.join(n_queries, ["t", "g"]).where("entry_blocks > 1 OR query_blocks > 1"), "ann-large")
    entry_blocks, query_blocks = (F.coalesce(c, F.lit(1)) for c in ("entry_blocks", "query_blocks"))
    entry_rows = hashed.join(large, ["t", "g"], "left").select(
        "t", "g", F.pmod(F.xxhash64("v"), entry_blocks).cast("int").alias("eb"), F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("qb"), "code", "v", "ids"
    )
    query_rows = probing.join(large, ["t", "g"], "left").select(
        "t", "g", F.explode(F.sequence(F.lit(0), entry_blocks - 1)).alias("eb"), F.pmod(F.xxhash64("q"), query_blocks).cast("int").alias("qb"), "codes", "v", "q", "floor"
    )
    group = ["t", "g", "eb", "qb"]
    return (
        entry_rows.groupBy(*group)
        .cogroup(query_rows.groupBy(*group))
        .applyInArrow(lambda e, q: _answers(e, q, k), "q long, minus double, id long")
    )


def _answers(entries_: pa.Table, queries_: pa.Table, k: int) -> pa.Table:
    """For each query of a block, of the block's entries in its buckets that reach its floor, the k + 1 best with their ids."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if entries_.num_rows and queries_.num_rows:
        code = entries_.column("code").to_numpy()
        entries_ = entries_.take(pa.array(np.argsort(code, kind="stable")))
        code = np.sort(code, kind="stable")
        vectors, ids = _matrix(entries_.column("v")), entries_.column("ids").combine_chunks()
        n_ids, first, flat = np.diff(ids.offsets.to_numpy()), ids.offsets.to_numpy()[:-1], ids.values.to_numpy()
        asked, q, floor = _matrix(queries_.column("v")), queries_.column("q").to_numpy(), queries_.column("floor").to_numpy()
        codes = queries_.column("codes").combine_chunks()
        whole = codes.is_null().to_numpy(zero_copy_only=False)
        sizes = np.where(whole, 1, np.diff(codes.offsets.to_numpy()))
        of = np.repeat(np.arange(len(q)), sizes)
        wanted = np.full(len(of), -1, np.int64)
        wanted[~whole[of]] = codes.flatten().to_numpy()
        a = np.where(whole[of], 0, np.searchsorted(code, wanted, "left"))
        n = np.where(whole[of], len(code), np.searchsorted(code, wanted, "right")) - a
        some = n > 0
        of, a, n = of[some], a[some], n[some]
        per_query = np.bincount(of, n, len(q)).astype(np.int64)
        for part in _parts(per_query):
            take = (of >= part.start) & (of < part.stop)
            i = np.repeat(of[take], n[take])
            j = np.repeat(a[take] - np.cumsum(n[take]) + n[take], n[take]) + np.arange(int(n[take].sum()))
            scores = paired(asked, i, vectors, j)
            keep = scores >= floor[i]
            i, j, scores = i[keep], j[keep], scores[keep]
            order = np.lexsort((flat[first[j]], -scores, i))
            i, j, scores = i[order], j[order], scores[order]
            opens = np.append(True, i[1:] != i[:-1])[: len(i)]
            place = np.arange(len(i)) - np.maximum.accumulate(np.where(opens, np.arange(len(i)), 0))
            top = place <= k
            i, j, scores = i[top], j[top], scores[top]
            each = np.repeat(np.arange(len(j)), n_ids[j])
            within = np.arange(len(each)) - np.repeat(np.cumsum(n_ids[j]) - n_ids[j], n_ids[j])
            out.append((q[i[each]], -scores[each], flat[first[j[each]] + within]))
    columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
    return pa.table(dict(zip(("q", "minus", "id"), (pa.array(c) for c in columns))))


def _parts(sizes: np.ndarray) -> Iterator[range]:
    """Runs of queries that have together about ``_CHUNK`` pairs, or one query."""
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > _CHUNK:
            yield range(at, i)
            at, total = i, 0
        total += n
    if len(sizes):
        yield range(at, len(sizes))


def op10_ann_cross_polytope(spark, sf_dir) -> DataFrame:
    """query_id, rank, vec_id and score of the 20 nearest of each vector whose vec_id is divisible by 20; see ``nearest``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
