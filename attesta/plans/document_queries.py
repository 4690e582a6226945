"""Queries over documents as texts: lines, paragraphs, sections, blocks, windows, chunks, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import documents as ops
from attesta.plans import sql
from attesta.plans.registry import query
from attesta.session import table

#: Lines that open a section in the test documents.
HEADINGS = {"released under the mit license.": "license", "all rights reserved.": "rights", "subscribe to our newsletter.": "notice"}
_IN = ", ".join(f"'{k}'" for k in HEADINGS)
_CASE = "CASE " + " ".join(f"WHEN k = '{k}' THEN '{v}'" for k, v in HEADINGS.items()) + " END"
_LINES = f"""
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
keyed AS (SELECT *, lower({sql.clean('text')}) AS k FROM lines),
named AS (SELECT doc_id, line, text, {_CASE} AS section FROM keyed)"""


@query(f"WITH {_LINES} SELECT doc_id, line, section FROM named WHERE section IS NOT NULL")
def doc_line_headings(spark, sf_dir):
    return ops.headings(table(spark, sf_dir, "documents"), HEADINGS).select("doc_id", "line", "section")


@query(f"""
WITH p AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {sql.clean('s')}), lambda s: s <> '') AS l FROM documents),
r AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS paragraph, unnest(l) AS text FROM p),
o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM r)
SELECT doc_id, paragraph, CAST(s AS BIGINT) AS start_at, CAST(s + length(text) AS BIGINT) AS end_at, sha256(text) AS sha FROM o""")
def doc_paragraphs_offsets(spark, sf_dir):
    rows = ops.paragraphs(table(spark, sf_dir, "documents"), split="\n")
    return rows.select(
        "doc_id", "paragraph", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")
    )


@query(f"""
WITH {_LINES},
c AS (SELECT doc_id, line, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM named)
SELECT doc_id, section, count(*) AS n_lines, min(line) AS first_line FROM c GROUP BY 1, 2""")
def section_carry_forward(spark, sf_dir):
    rows = ops.lines(table(spark, sf_dir, "documents")).withColumn("section", ops.heading_of(F.col("text"), HEADINGS))
    return ops.carry_sections(rows).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"))


@query(f"""
WITH n AS (
  SELECT conv_id, turn, {sql.clean('text')} AS t,
         sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block
  FROM conversations)
SELECT conv_id, CAST(block AS BIGINT) AS block, min(turn) AS first, count(*) AS n_rows, sha256(string_agg(t, ' ' ORDER BY turn)) AS sha FROM n GROUP BY conv_id, block""")
def claim_blocks_sessionised(spark, sf_dir):
    rows = ops.blocks(table(spark, sf_dir, "conversations"), F.coalesce(F.col("role") == "user", F.lit(False)), "conv_id", "turn")
    return rows.select("conv_id", "block", "first", "n_rows", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query(f"""
SELECT doc_id, CAST(len(list_filter(string_split(t, chr(10)), lambda l: {sql.clean('l')} <> '')) AS BIGINT) AS n_paragraphs,
       CAST(len({sql.sentences('t')}) AS BIGINT) AS n_sentences, CAST(len({sql.words_in(sql.clean('t'))}) AS BIGINT) AS n_words,
       CAST(length(t) AS BIGINT) AS n_characters, sha256(t) AS sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def document_statistics(spark, sf_dir):
    return ops.statistics(table(spark, sf_dir, "documents"))


@query(f"""
WITH s AS (SELECT doc_id, {sql.sentences('text')} AS s FROM documents),
w AS (SELECT doc_id, s, unnest(range(0, CAST(greatest(0, ceil((len(s) - 3) / 2.0)) AS BIGINT) + 1)) AS i FROM s WHERE len(s) > 0)
SELECT doc_id, i + 1 AS window_no, sha256(array_to_string(s[i * 2 + 1 : i * 2 + 3], ' ')) AS sha FROM w""")
def sentence_windows(spark, sf_dir):
    rows = ops.windows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("window").cast("long").alias("window_no"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


_MANUAL = "trim(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"
_CHUNKS = f"""
m AS (SELECT doc_id, {_MANUAL} AS t FROM documents),
chunks AS (
  SELECT doc_id, i + 1 AS chunk, i * 5500 AS start_at, least(i * 5500 + 6000, length(t)) AS end_at, substr(t, i * 5500 + 1, 6000) AS text
  FROM (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - 6000) / 5500.0)) AS BIGINT) + 1)) AS i FROM m WHERE length(t) > 0))"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk, CAST(start_at AS BIGINT) AS start_at, CAST(end_at AS BIGINT) AS end_at, sha256(text) AS sha FROM chunks")
def manual_chunks(spark, sf_dir):
    rows = ops.chunks(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
    )


_TOKENS = sql.plain_words("text", "[a-z0-9]{3,}")


@query(f"""
WITH {_CHUNKS},
ct AS (SELECT doc_id, chunk, unnest({_TOKENS}) AS token FROM chunks),
qt AS (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, chunk, count(*) AS score FROM qt JOIN ct USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk) AS rank FROM s)
SELECT item_id, rank, doc_id, chunk, score FROM r WHERE rank <= 5""")
def manual_search_topk(spark, sf_dir):
    from attesta.operators.search import manual_search

    return manual_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query()
def page_texts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", ops.strip_tags(F.col("html")).alias("text"))
    return pages.select("page_id", F.length("text").alias("n_characters"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query(f"WITH {sql.PACKED} SELECT doc_id, CAST(passage AS INTEGER) AS passage, CAST(length(text) AS INTEGER) AS n_characters, 'P-' || substr(sha256({sql.clean('text')}), 1, 12) AS passage_id FROM passages")
def passage_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.sentences_with_ends(F.col("text"), ".!?").alias("s"))
    rows = docs.select("doc_id", F.posexplode(tx.packed(F.col("s"), 700)).alias("passage", "text"))
    return rows.select("doc_id", "passage", F.length("text").alias("n_characters"), tx.stable_id("P", F.col("text")).alias("passage_id"))
