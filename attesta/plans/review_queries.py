"""Queries over signals, coverage, gates, hashes and results as JSON. Orders stand for reports that cite, lines for claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import evidence, findings, reports, review as ops
from attesta.plans import sql
from attesta.plans.claim_queries import _CLAIMS, _TURNS, _versions, claims
from attesta.plans.evidence_queries import _RETRIEVER, _SCORES, CLAIM, _best_scores, _claim_sizes, _evidence, _retrieved, pairs_sql
from attesta.plans.graph_queries import _GRAPH, _graph
from attesta.plans.registry import ORACLE_SQL, query
from attesta.plans.risk_queries import _OBJECTIONS, _SIGNALS, _objections, _signals
from attesta.plans.search_queries import _cosine_sql, _dense
from attesta.session import table
from attesta.sources import results

_CITED = "'See EP ' || (1000000 + o_orderkey) || ', wo 2019/' || (100000 + o_custkey) || ' and US' || (1000 + o_orderkey) || 'B2; IN ' || (20190000 + o_custkey) || ', US' || (1000 + o_orderkey) || 'b2'"
_FOUND = "list_concat(" + ", ".join(f"regexp_extract_all(t, '{p}')" for p in ops.CITATION_PATTERNS) + ")"


@query(f"""
WITH o AS (SELECT o_orderkey, {_CITED} AS t FROM orders),
f AS (SELECT o_orderkey, list_transform({_FOUND}, lambda x: {sql.clean('x')}) AS l FROM o),
u AS (SELECT o_orderkey, unnest(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)) AS reference FROM f)
SELECT o_orderkey, reference, CASE WHEN upper(reference) LIKE 'WO%' THEN 'WO' WHEN upper(reference) LIKE 'EP%' THEN 'EP' WHEN upper(reference) LIKE 'IN%' THEN 'Indian' ELSE 'patent_document' END AS kind FROM u""")
def fer_citations(spark, sf_dir):
    return ops.citations(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CITED).alias("text")), ["o_orderkey"])


_DUE = (
    "'Filed ' || (1 + o_orderkey % 28) || '/' || (1 + o_custkey % 12) || '/2023 ' || repeat('lorem  ipsum ', CAST(o_orderkey % 60 AS INT)) || 'Reply by 1' || (o_orderkey % 9) || "
    "' March 2024 or MARCH 3, 2025 ' || repeat('dolor ', CAST(o_custkey % 70 AS INT)) || (o_orderkey % 30) || '-7-21 ' || repeat('sit ', CAST(o_custkey % 200 AS INT)) || '1-2-2020'"
)
_DATES = " UNION ALL ".join(f"SELECT o_orderkey, t, {k} AS k, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM o" for k, p in enumerate(reports.DATE_PATTERNS))


@query(f"""
WITH o AS (SELECT o_orderkey, {_DUE} AS t FROM orders), d AS ({_DATES}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM d),
a AS (SELECT *, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS pos FROM i),
c AS (SELECT o_orderkey, k, i, {sql.clean('m')} AS date_text, {sql.clean('substring(t, CAST(greatest(pos - 250, 0) + 1 AS BIGINT), CAST(pos + length(m) + 250 - greatest(pos - 250, 0) AS BIGINT))')} AS context FROM a)
SELECT o_orderkey, date_text, context FROM c WHERE len(list_filter({reports.DEADLINE_WORDS}, lambda w: contains(lower(context), w))) > 0
QUALIFY row_number() OVER (PARTITION BY o_orderkey, lower(date_text), lower(context) ORDER BY k, i) = 1""")
def fer_deadlines(spark, sf_dir):
    # dealt out before the texts are made: orders are few bytes, and a task's contexts stay with it
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    return reports.deadlines(orders.select("o_orderkey", F.expr(_DUE).alias("text")), ["o_orderkey"])


_ACTIONS = ", ".join(f"('{c}', '{a}')" for c, a in reports.ACTIONS.items())


@query(f"""
WITH {_OBJECTIONS}, acts(category, action) AS (VALUES {_ACTIONS})
SELECT conv_id, turn, obj.category, coalesce(action, '{reports.OTHER_ACTION}') AS action, CASE WHEN obj.category IN ('novelty', 'inventive_step', 'section_3') THEN 'high' ELSE 'review' END AS priority
FROM obj LEFT JOIN acts ON obj.category = acts.category""")
def fer_response_matrix(spark, sf_dir):
    return reports.response_actions(_objections(spark, sf_dir)).select("conv_id", "turn", "category", "action", "priority")


def _has(x: str, terms: list[str]) -> str:
    return f"list_filter({terms}, lambda t: contains({x}, t))"


_SPEC = "text || CASE part % 3 WHEN 0 THEN ' Improved efficiency and reduced noise in response to feedback' WHEN 1 THEN ' to reduce wear during use' ELSE '' END"
_KINDS = " || ".join(f"CASE WHEN len({_has('low', words)}) > 0 THEN '{kind},' ELSE '' END" for kind, words in ops.RELATIONSHIPS.items())


@query(f"""
WITH {_CLAIMS}, l AS (SELECT family, number, part, {sql.normalize(_SPEC)} AS low FROM claims),
k AS (SELECT family, number, part, array_to_string({_has('low', ops.PROBLEM_TERMS)}, ',') AS problems, array_to_string({_has('low', ops.EFFECT_TERMS)}, ',') AS effects, rtrim({_KINDS}, ',') AS relationships FROM l)
SELECT *, relationships <> '' AS related FROM k""")
def technical_signals(spark, sf_dir):
    return ops.technical_signals(claims(spark, sf_dir).withColumn("text", F.expr(_SPEC)), ["family", "number", "part"])


_REF = "old || CASE turn % 2 WHEN 1 THEN ' which may be combined, optionally, to reduce cost' ELSE '' END"
_SHARED = f"len(list_intersect(list_distinct({sql.meaningful('ref', tx.COMBINATION_STOP_WORDS)}), list_distinct({sql.meaningful('new', tx.COMBINATION_STOP_WORDS)})))"


@query(f"""
WITH {_TURNS}, r AS (SELECT conv_id, turn, {_REF} AS ref, new FROM turns),
s AS (SELECT conv_id, turn, list_concat({_has(sql.normalize('ref'), ops.MOTIVATION_TERMS)}, CASE WHEN {_SHARED} >= 3 THEN ['shared_technical_vocabulary'] ELSE [] END) AS s FROM r)
SELECT conv_id, turn, array_to_string(s, ',') AS signals, CAST(round(least(1.0, least(1.0, 0.15 * len(s)) + CASE WHEN list_has_any(s, {ops.COMBINATION_TERMS}) THEN 0.25 ELSE 0.0 END), 4) AS DOUBLE) AS score FROM s""")
def motivation_scores(spark, sf_dir):
    return ops.motivation(_versions(spark, sf_dir).withColumn("ref", F.expr(_REF)), ["conv_id", "turn"], "ref", "new")


@query(f"""
WITH p AS ({pairs_sql(' WHERE x.k <= 8 AND y.k <= 8')}),
s AS (SELECT *, array_to_string(list_filter([CASE WHEN coverage < 1 THEN 'combination_requires_feature_mapping' END, CASE WHEN complementarity > 0.6 THEN 'references_contribute_distinct_feature_sets' END, CASE WHEN overlap < 0.2 THEN 'limited_overlap_between_references' END], lambda x: x IS NOT NULL), ',') AS signals FROM p)
SELECT *, signals <> '' AS review_required FROM s""")
def hindsight_signals(spark, sf_dir):
    return ops.hindsight(findings.reference_pairs(_best_scores(spark, sf_dir), _claim_sizes(spark, sf_dir), references=8))


@query(f"""
WITH {_SCORES}, {_cosine_sql(10)},
j AS (SELECT ev.item_id, ev.doc_id, CAST(passage AS INTEGER) AS passage, lexical, coalesce(dense.score, 0.0) AS semantic FROM ev LEFT JOIN dense ON dense.item_id = ev.item_id AND dense.doc_id = ev.doc_id),
rs AS (SELECT *, round(CAST(0.65 AS DOUBLE) * semantic + CAST(0.35 AS DOUBLE) * lexical, 6) AS combined FROM j)
SELECT *, CASE WHEN combined >= 0.8 THEN 'EXPLICIT' WHEN combined >= 0.6 THEN 'STRONG_MATCH' WHEN combined >= 0.4 THEN 'PARTIAL' WHEN combined >= 0.2 THEN 'WEAK_MATCH' ELSE 'UNCERTAIN' END AS status FROM rs""")
def evidence_rescored(spark, sf_dir):
    semantic = _dense(spark, sf_dir, 10).withColumnRenamed("score", "semantic")
    return ops.rescored(_evidence(spark, sf_dir).select("item_id", "doc_id", "passage", "lexical"), semantic, ["item_id", "doc_id"])


@query(f"""
WITH {_RETRIEVER}, b AS (SELECT item_id, doc_id, passage, combined, status, row_number() OVER (PARTITION BY item_id ORDER BY combined DESC, doc_id, passage) AS rank FROM ret)
SELECT item_id, doc_id, passage, combined, status, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 3""")
def best_evidence(spark, sf_dir):
    return evidence.best_evidence(_retrieved(spark, sf_dir)).select("item_id", "doc_id", "passage", "combined", "status", "rank")


@query(f"""
WITH {_RETRIEVER}, l AS (SELECT {CLAIM} AS claim, b.item_id, coalesce(max(combined), 0.0) AS coverage FROM benchmark b LEFT JOIN ret USING (item_id) GROUP BY 1, 2)
SELECT claim, count(*) AS n_limitations, round(CAST(sum(CAST(coverage AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) AS coverage FROM l GROUP BY 1""")
def retrieved_claim_coverage(spark, sf_dir):
    rows = evidence.limitation_coverage(table(spark, sf_dir, "benchmark"), _retrieved(spark, sf_dir))
    return rows.groupBy(F.expr(CLAIM).alias("claim")).agg(F.count("*").alias("n_limitations"), F.round(F.sum(F.col("coverage").cast("decimal(20,6)")).cast("double") / F.count("*"), 6).alias("coverage"))


@query("""
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT e.l_orderkey, count(*) AS expected, count(s.l_partkey) AS supported FROM e LEFT JOIN s ON s.l_orderkey = e.l_orderkey AND s.l_partkey = e.l_partkey GROUP BY 1)
SELECT *, expected - supported AS unsupported, round(CAST(supported AS DOUBLE) / expected, 4) AS coverage FROM c""")
def evidence_coverage(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return ops.coverage_of(lines, lines.where("l_returnflag = 'R'"), ["l_orderkey"], "l_partkey")


@query(f"WITH {_SIGNALS} SELECT claim, finding, score, confidence, CAST(row_number() OVER (PARTITION BY claim ORDER BY score DESC, confidence DESC, finding) AS INTEGER) AS priority FROM signals")
def signals_prioritized(spark, sf_dir):
    return ops.prioritized(_signals(spark, sf_dir).select("claim", "finding", "score", "confidence"), "claim", "finding")


@query(f"""
WITH s AS ({ORACLE_SQL['section_screen_scores']})
SELECT section, count(*) AS total_findings, count(*) FILTER (status = 'STRONG_REVIEW_SIGNAL') AS n_strong, count(*) FILTER (status = 'REVIEW_SIGNAL') AS n_review, count(*) FILTER (status = 'WEAK_REVIEW_SIGNAL') AS n_weak FROM s GROUP BY 1""")
def section_dashboard(spark, sf_dir):
    from attesta.plans.claim_queries import section_screen_scores

    n = {c: F.count_if(F.col("status") == s).alias(c) for c, s in (("n_strong", "STRONG_REVIEW_SIGNAL"), ("n_review", "REVIEW_SIGNAL"), ("n_weak", "WEAK_REVIEW_SIGNAL"))}
    return section_screen_scores(spark, sf_dir).groupBy("section").agg(F.count("*").alias("total_findings"), *n.values())


_PROBLEMS = """
i AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN o_orderkey % 2 = 0 THEN 'graph' ELSE 'document' END AS category FROM orders)"""


def _gate_sql(strict: bool) -> str:
    return f"""
WITH {_PROBLEMS}, c AS (SELECT count(*) FILTER (severity = 'ERROR') AS n_error, count(*) FILTER (severity = 'WARNING') AS n_warning, count(*) FILTER (severity = 'INFO') AS n_info, count(*) FILTER (severity = 'WARNING' AND category IN ('evidence', 'provenance', 'findings', 'graph')) AS w FROM i)
SELECT n_error, n_warning, n_info, n_error > 0 OR w > 0 AS review_required, n_error {'+ n_warning' if strict else ''} = 0 AS report_allowed FROM c"""


def _problems(spark, sf_dir):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "WARNING").otherwise("INFO")
    return table(spark, sf_dir, "orders").select(severity.alias("severity"), F.when(F.col("o_orderkey") % 2 == 0, "graph").otherwise("document").alias("category"))


@query(_gate_sql(False))
def validation_gate(spark, sf_dir):
    return ops.gate(_problems(spark, sf_dir))


@query(_gate_sql(True))
def validation_gate_strict(spark, sf_dir):
    return ops.gate(_problems(spark, sf_dir), strict=True)


_STORED = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN '0' ELSE {h} END"


@query(f"SELECT doc_id, sha256(coalesce(text, '')) AS calculated, coalesce(sha256(coalesce(text, '')) = {_STORED.format(h=chr(39).join(['sha256(coalesce(text, ', '', '))']))}, false) AS valid FROM documents")
def artifact_integrity(spark, sf_dir):
    stored = F.expr(_STORED.format(h="sha2(coalesce(text, ''), 256)"))
    return ops.integrity(table(spark, sf_dir, "documents").withColumn("stored", stored), ["doc_id"], "text", "stored")


@query(f"""
WITH {_GRAPH}, t AS (SELECT source AS node_id, edge_type, 1 AS o FROM edges UNION ALL SELECT target, edge_type, 0 FROM edges)
SELECT node_id, edge_type, CAST(sum(o) AS BIGINT) AS n_out, count(*) - CAST(sum(o) AS BIGINT) AS n_in FROM t GROUP BY 1, 2""")
def graph_degrees(spark, sf_dir):
    return ops.degrees(_graph(spark, sf_dir)[1])


@query(f"WITH {_GRAPH} SELECT node_id, label FROM nodes WHERE node_type = 'PART' AND contains(lower(label), 'ring')")
def graph_find_nodes(spark, sf_dir):
    return ops.find_nodes(_graph(spark, sf_dir)[0], "PART", "Ring").select("node_id", "label")


#: Answers of providers over parts, ten results each, under other names and in other shapes by turns.
_PAYLOAD_ITEM = """'{' || CASE p_partkey % 5 WHEN 0 THEN '"title": "", "name": ' WHEN 1 THEN '"document_title": ' WHEN 2 THEN '"patent_title": null, "title": ' WHEN 3 THEN '"title": [], "document_title": {}, "name": ' ELSE '"name": ' END
 || '" ' || p_name || '  x ", ' || CASE p_partkey % 6 WHEN 0 THEN '"pub_number": "' WHEN 1 THEN '"document_number": "' WHEN 2 THEN '"publicationNumber": "' WHEN 3 THEN '"patent_number": "' WHEN 4 THEN '"patent_no": "' ELSE '"application_no": "' END
 || 'P ' || p_partkey || '", ' || CASE p_partkey % 3 WHEN 0 THEN '"inventors": ["' || p_brand || '", " ", "B  C"], "owner": "A; B|C,"' WHEN 1 THEN '"inventor": "' || p_brand || '; Z", "assignees": []' ELSE '"applicant": "X", "ipc": ["G06F"]' END
 || ', "score": ' || CASE p_partkey % 3 WHEN 0 THEN '"0.5"' WHEN 1 THEN CAST(p_size AS VARCHAR(9)) ELSE '"high"' END || ', "summary": "' || p_type || '"}'"""
_PAYLOAD = """CASE k % 6 WHEN 0 THEN '[' || body || ', 7, "x"]' WHEN 1 THEN '{"results": [' || body || ']}' WHEN 2 THEN '{"results": "none", "items": [' || body || ']}' WHEN 3 THEN '{"n": 1, "records": [' || body || ']}' WHEN 4 THEN '{"documents": [], "data": [' || body || ']}' ELSE '{"broken": [' || body END"""
_ANSWERS = f"""
parts AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS k, p_partkey, {_PAYLOAD_ITEM} AS j FROM part),
bodies AS (SELECT k, string_agg(j, ', ' ORDER BY p_partkey) AS body FROM parts GROUP BY k),
answers AS (SELECT k, {_PAYLOAD} AS raw FROM bodies),
valid AS (SELECT k, CAST(raw AS JSON) AS j FROM answers WHERE json_valid(raw)),
lists AS (SELECT k, CASE WHEN json_type(j) = 'ARRAY' THEN j {' '.join(f"WHEN json_type(j, '$.{n}') = 'ARRAY' THEN json_extract(j, '$.{n}')" for n in results.RESULT_KEYS)} END AS l FROM valid),
items AS (SELECT k, unnest(range(0, len(e))) AS place, unnest(e) AS item FROM (SELECT k, CAST(l AS JSON[]) AS e FROM lists WHERE l IS NOT NULL)),
objects AS (SELECT k, CAST(place AS INTEGER) AS place, item FROM items WHERE json_type(item) = 'OBJECT')"""


def _first_sql(names: list[str]) -> str:
    values = ", ".join(f"CASE WHEN json_extract_string(item, '$.{n}') NOT IN ('', '[]', '{{}}') THEN json_extract(item, '$.{n}') END" for n in names)
    return f"coalesce({values})"


def _text_sql(names: list[str]) -> str:
    return sql.clean(f"json_extract_string({_first_sql(names)}, '$')")


def _list_sql(names: list[str]) -> str:
    x = _first_sql(names)
    found = f"CASE WHEN json_type({x}) = 'ARRAY' THEN json_extract_string({x}, '$[*]') ELSE regexp_split_to_array(json_extract_string({x}, '$'), '[;|,]') END"
    return f"array_to_string(list_filter(list_transform(coalesce({found}, []), lambda v: {sql.clean('v')}), lambda v: v <> ''), ';')"


_RESULT_SQL = ", ".join(
    [f"{_text_sql(n)} AS {c}" for c, n in results.FIELDS.items()]
    + [f"{_list_sql(n)} AS {c}" for c, n in results.LISTS.items()]
    + [f"coalesce(TRY_CAST(json_extract_string({_first_sql(results.SCORES)}, '$') AS DOUBLE), 0.0) AS relevance_score"]
)


def _answers(spark, sf_dir):
    """k and raw: an answer of a provider for ten parts, made from the table, as its files would hold it."""
    item = _PAYLOAD_ITEM.replace("VARCHAR(9)", "STRING")
    parts = table(spark, sf_dir, "part").select(F.expr("p_partkey div 10").alias("k"), "p_partkey", F.expr(item).alias("j"))
    bodies = parts.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", "j")))["j"], ", ").alias("body"))
    return bodies.select("k", F.expr(_PAYLOAD).alias("raw"))


def _flat(rows):
    return rows.withColumns({c: F.array_join(c, ";") for c in results.LISTS})


@query(f"WITH {_ANSWERS} SELECT k, place, {_RESULT_SQL} FROM objects")
def provider_results(spark, sf_dir):
    return _flat(results.normalized_items(results.items(_answers(spark, sf_dir), ["k"]), ["k", "place"]))


@query(f"WITH objects AS (SELECT p_partkey, CAST({_PAYLOAD_ITEM} AS JSON) AS item FROM part) SELECT p_partkey, {_RESULT_SQL} FROM objects")
def results_normalized(spark, sf_dir):
    item = _PAYLOAD_ITEM.replace("VARCHAR(9)", "STRING")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(item).alias("raw"))
    return _flat(results.normalized(rows, ["p_partkey"]))


#: What is searched for among the results that files hold.
LOCAL_QUERY = "large ring with Brass plated bolt in it"
_LOCAL_TEXT = "lower(" + " || ' ' || ".join(sql.clean(f"json_extract_string(item, '$.{f}')") for f in results.SEARCHED) + ")"


@query(f"""
WITH {_ANSWERS}, w AS (SELECT unnest({sorted({x.lower() for x in LOCAL_QUERY.split() if len(x) >= 3})}) AS w),
s AS (SELECT k, place, count(*) FILTER (contains({_LOCAL_TEXT}, w)) / CAST(count(*) AS DOUBLE) AS score FROM objects, w GROUP BY k, place)
SELECT k, place, score FROM s WHERE score > 0 ORDER BY score DESC, k, place LIMIT 20""")
def provider_local_search(spark, sf_dir):
    return results.search_local(results.items(_answers(spark, sf_dir), ["k"]), ["k", "place"], LOCAL_QUERY)
