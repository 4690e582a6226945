"""A Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots, with a proof for every row.

1. A leaf is the sha256 of a row's framed fields. Leaves are numbered within their group without a task that holds the group:
   they are dealt out by ranges of (group, order), numbered within each range, and offsets are sums over (group, range).
2. A level: a window over the nodes of one group and one parent, in order, collects the whole run. The run is the parent's
   preimage and holds each node's siblings; the first node of each run stands for the parent on the next level. A level has
   half the rows of the one before, and its windows hold ``FANOUT`` rows, however large a group is.
3. What remains of each group is its subroot; subroots, in the order of their groups, make the tree of the root alike.
4. Proofs are handed down from the root: a node's proof is its siblings, then the proof of its parent. So each level is joined
   once with the one above it, and a leaf's siblings are never looked up level by level for all leaves.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.llm.common import forget, saved

FANOUT = 2
#: Levels of proofs that one plan hands down.
LEVELS_A_PLAN = 6
_PROOF = "array<struct<before:string,after:string>>"


def framed(field: Column) -> Column:
    """A field as part of a leaf: ``-`` for null, else its count of UTF-8 bytes, a colon and the value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(framed, fields)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """The sha256 of a proof's siblings, from the leaf's to the root's, each level's from left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda step: F.concat(step["before"], step["after"]))), 256)


def numbered(leaves: DataFrame) -> DataFrame:
    """idx (from 0, within g, by ord and then leaf) and n (rows of g) for rows g, ord, leaf and row."""
    leaves = saved(leaves, "merkle-leaves")
    # the row's place in its file is the last key, so that a row repeated ever so often is dealt to many tasks
    keys = ["g", "ord", "leaf", "at"]
    dealt = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    dealt = saved(dealt.drop("at", "ord"), "merkle-ranges")
    forget(leaves)
    ranges = dealt.groupBy("g", "part").agg(F.min("seq").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "g",
        "part",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("g")).alias("n"),
    )
    return dealt.join(ranges, ["g", "part"]).select("g", (F.col("seq") + F.col("shift")).alias("idx"), "n", F.col("leaf").alias("hash"), "row")


class Tree(NamedTuple):
    """levels: g, idx, n, parent and run (the hashes of all nodes under the parent) of each level that has one; the lowest
    holds row and the groups of one leaf too. tops: g, level (0: the leaf itself) and hash of what remains of each group."""

    levels: list[DataFrame]
    tops: DataFrame | None


def tree(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """The trees over ``numbered`` nodes, a job for each level."""
    run = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels: list[DataFrame] = []
    tops: list[DataFrame] = []
    most = None
    while most is None or most > 1:
        level = nodes.withColumn("parent", F.expr(f"idx div {fanout}")).withColumn("run", F.collect_list("hash").over(run)).drop("hash")
        level = saved(level, "merkle-level")
        if not levels:
            most = level.agg(F.max("n")).first()[0] or 0
            tops.append(level.where("n = 1").select("g", F.lit(0).alias("level"), F.get("run", F.lit(0)).alias("hash")))
        levels.append(level)
        first = level.where(f"n > 1 AND idx % {fanout} = 0")
        hashed = F.sha2(F.concat_ws("", "run"), 256).alias("hash")
        tops.append(first.where(f"n <= {fanout}").select("g", F.lit(len(levels)).alias("level"), hashed))
        nodes = first.where(f"n > {fanout}").select("g", F.col("parent").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), hashed)
        most = -(-most // fanout)
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return Tree(levels, saved(out, "merkle-tops") if most else None)


def proofs(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """row, leaf, proof and carry of every leaf, for tops with g, level, proof (from the top on) and carry."""
    place = (F.col("idx") % fanout).cast("int")
    siblings = F.struct(
        F.concat_ws("", F.slice("run", F.lit(1), place)).alias("before"), F.concat_ws("", F.slice("run", place + 2, F.lit(fanout))).alias("after")
    )

    def seeds(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("parent"), "proof", "carry")

    above, done = None, []
    for i in reversed(range(len(levels))):
        parents = seeds(i + 1) if above is None else seeds(i + 1).unionByName(above)
        under = levels[i].where("n > 1").join(parents, ["g", "parent"])
        proof = F.concat(F.array(siblings), "proof").alias("proof")
        if i:
            above = under.select("g", F.col("idx").alias("parent"), proof, "carry")
            if (len(levels) - i) % LEVELS_A_PLAN == 0:
                above = saved(above, "merkle-proofs")
                done.append(above)
    leaf = F.get("run", place).alias("leaf")
    alone = levels[0].where("n = 1").join(seeds(0), ["g", "parent"])
    return under.select("row", leaf, proof, "carry").unionByName(alone.select("row", leaf, F.col("proof").cast(_PROOF), "carry"))


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """row, leaf, subroot, root and proof of every row of ``leaves`` (group: string, ord, leaf: hexadecimal digest, row: any).

    ``proof`` is an array, from the leaf's level to the root, of the siblings' digests before and after the node, each
    concatenated. Leaves ascend by ord within their group, null first; of equal ord by leaf, so that repeated rows and ties
    give the same tree whatever their order was. Groups ascend bytewise, null first. An empty table gives no rows.
    """
    spark = leaves.sparkSession
    # '0' for the null group and '1' before others: joins meet it, and it comes first
    group = F.coalesce(F.concat(F.lit("1"), "group"), F.lit("0"))
    rows = tree(numbered(leaves.select(group.alias("g"), "ord", "leaf", "row")), fanout)
    if rows.tops is None:
        return spark.createDataFrame([], f"row {leaves.schema['row'].dataType.simpleString()}, leaf string, subroot string, root string, proof {_PROOF}")
    groups = rows.tops.select(F.lit("").alias("g"), F.col("g").alias("ord"), F.col("hash").alias("leaf"), F.struct("g", "level").alias("row"))
    top = tree(numbered(groups), fanout)
    whole = top.tops.first()
    at_root = top.tops.select("g", "level", F.array().cast(_PROOF).alias("proof"), F.lit(None).cast("string").alias("carry"))
    subroots = proofs(top.levels, at_root, fanout).select("row.g", "row.level", "proof", F.col("leaf").alias("carry"))
    out = proofs(rows.levels, saved(subroots, "merkle-subroots"), fanout)
    return out.select("row", "leaf", F.col("carry").alias("subroot"), F.lit(whole["hash"]).alias("root"), "proof")


def document_manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, claimed and folded_root of every document, grouped by lang and ordered by doc_id.

    ``claimed`` is the leaf that is checked against the proof: where ``tampered`` holds, that of a row with 1 added to
    n_chars (null stays null), else the leaf itself. Reads doc_id, source, lang, n_chars and text, null or not; other
    columns may have any name. A null doc_id comes first. Rows that repeat are leaves each.
    """

    def leaf(n_chars: Column) -> Column:
        return leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    n_chars = F.col("n_chars").cast("long")
    other = F.coalesce(tampered, F.lit(False)) & n_chars.isNotNull() if tampered is not None else F.lit(False)
    leaves = docs.select(
        F.col("lang").alias("group"),
        F.col("doc_id").alias("ord"),
        leaf(n_chars).alias("leaf"),
        F.struct("doc_id", F.when(other, leaf(F.try_add(n_chars, F.lit(1)))).alias("other")).alias("row"),
    )
    claimed = F.coalesce("row.other", "leaf")
    return manifest(leaves, fanout).select(
        "row.doc_id", "leaf", "subroot", "root", "proof", claimed.alias("claimed"), folded(claimed, F.col("proof")).alias("folded_root")
    )


def op11_merkle_manifest(spark, sf_dir) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document; see ``document_manifest``.

    Where 7 divides crc32 of the decimal doc_id, the leaf that is checked is that of a tampered row. A null doc_id is not.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return document_manifest(docs, tampered).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: The table of crc32, as the polynomial gives it, is made in SQL.
OP11_SQL = """
WITH RECURSIVE
bits AS (
  SELECT range AS i, range AS c, 0 AS step FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
),
crc AS (SELECT list(c ORDER BY i) AS entry FROM bits WHERE step = 8),
fields AS (
  SELECT doc_id, lang, n_chars::BIGINT AS n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc.entry[((xor(c, b) & 255) + 1)::INT])) AS inverse
  FROM documents, crc
),
marked AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(inverse, 4294967295) % 7 = 0
      THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other
  FROM fields
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    coalesce('1' || lang, '0') AS g
  FROM marked
),
levels(g, level, idx, n, hash) AS (
  SELECT g, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT g, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx)) FROM levels WHERE n > 1
  GROUP BY g, level, idx // 2, n
),
subroots AS (
  SELECT g, level, hash, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM levels WHERE n = 1
),
tops(level, idx, n, hash) AS (
  SELECT 0, idx, n, hash FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n
),
nodes AS (
  SELECT l.doc_id, l.idx AS leaf_idx, l.g, v.level, (l.idx >> v.level) % 2 AS place,
    (SELECT s.hash FROM levels s WHERE s.g = l.g AND s.level = v.level AND s.idx = xor(l.idx >> v.level, 1)) AS sibling
  FROM leaves l JOIN (SELECT DISTINCT g, level FROM levels WHERE n > 1) v ON v.g = l.g
  UNION ALL
  SELECT l.doc_id, l.idx, l.g, 1000 + t.level, (s.idx >> t.level) % 2,
    (SELECT o.hash FROM tops o WHERE o.level = t.level AND o.idx = xor(s.idx >> t.level, 1))
  FROM leaves l JOIN subroots s ON s.g = l.g CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) t
),
proofs AS (
  SELECT g, leaf_idx, list({'place': place, 'hash': coalesce(sibling, '')} ORDER BY level) AS steps FROM nodes GROUP BY g, leaf_idx
),
root AS (SELECT hash FROM tops WHERE n = 1),
checked AS (
  SELECT l.doc_id, l.leaf, s.hash AS subroot, root.hash AS root,
    sha256(coalesce(list_aggregate(list_transform(p.steps, lambda x: x.hash), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_prepend({'place': 0, 'hash': coalesce(l.other, l.leaf)}, coalesce(p.steps, [])),
      lambda a, b: {'place': 0, 'hash': CASE WHEN b.place = 1 THEN sha256(b.hash || a.hash) ELSE sha256(a.hash || b.hash) END}).hash AS folded_root
  FROM leaves l JOIN subroots s ON s.g = l.g CROSS JOIN root LEFT JOIN proofs p ON p.g = l.g AND p.leaf_idx = l.idx
)
SELECT *, folded_root = root AS verified FROM checked
"""
