"""The Merkle manifest against plain Python, on odd rows and small trees of every size."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from attesta.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string, idx int, g string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    fields = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(hashes, fanout):
    """The root, and for each place the (before, after) of each level."""
    proofs, groups = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, joined = [], []
        for at in range(0, len(hashes), fanout):
            run = hashes[at : at + fanout]
            for k, members in enumerate(groups[at : at + fanout]):
                for i in members:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(digest("".join(run)))
            joined.append([i for members in groups[at : at + fanout] for i in members])
        hashes, groups = up, joined
    return hashes[0], proofs


def brute(rows, fanout=2):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own], fanout)))
    root, tops = climb([t[1] for t in trees], fanout)
    out = []
    for (own, subroot, proofs), top in zip(trees, tops):
        for r, proof in zip(own, proofs):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, int(bad))
            for before, after in proof + top:
                node = digest(before + node + after)
            out.append((r[0], leaf(r), subroot, root, digest("".join(b + a for b, a in proof + top)), node, node == root))
    return sorted(map(str, out))


def digests(df, fanout=2):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.document_manifest(df, tampered, fanout).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", F.col("folded_root") == F.col("root")
    )
    return sorted(str(tuple(r)) for r in rows.collect())


@pytest.mark.parametrize("fanout, sizes", [(2, {"en": 1, "de": 2, None: 3, "é": 5}), (2, {"en": 17}), (3, {"a": 10, "B": 1, "": 4}), (2, {"en": 1})])
def test_trees_of_many_shapes(spark, fanout, sizes):
    rows = [(10 * i + j, f"src{j % 2}", lang, j, f"text {j} ü", 7, "x") for i, (lang, n) in enumerate(sizes.items()) for j in range(n)]
    assert digests(spark.createDataFrame(rows, KIND).repartition(3), fanout) == brute(rows, fanout)


def test_nulls_repeats_ties_and_long_texts(spark):
    rows = [(1, None, "en", None, None, 0, None)] * 3 + [(None, "s", "en", 4, "", 0, ""), (None, None, None, None, None, None, None)]
    rows += [(5, "s", "en", 2**40, "a"), (5, "s", "en", 1, "b"), (5, "s", None, 1, "x" * 100_000), (-3, "", "", -1, "é€𝄞")]
    rows = [(*r, None, None)[:7] for r in rows]
    assert digests(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], KIND)) == []


def test_a_changed_row_is_found(spark, small_docs):
    whole = {r.doc_id: r for r in merkle.document_manifest(small_docs).collect()}
    other = small_docs.withColumn("text", F.when(F.col("doc_id") == 17, F.lit("changed")).otherwise(F.col("text")))
    leaves = other.select("doc_id", merkle.leaf_of(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf")).collect()
    proofs = small_docs.sparkSession.createDataFrame([(r.doc_id, r.leaf, whole[r.doc_id].proof, whole[r.doc_id].root) for r in leaves], "doc_id long, leaf string, proof array<struct<before:string,after:string>>, root string")
    wrong = proofs.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [17]
