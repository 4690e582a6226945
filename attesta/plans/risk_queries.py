"""Queries over findings: orders stand for findings (priority for severity), their lines for the evidence; conversations and
events for examination reports and issues from other sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import similarity as sim, text as tx
from attesta.operators import findings as ops, reports
from attesta.plans import sql
from attesta.plans.registry import query
from attesta.session import table

SEVERITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "review", "5-LOW": "low"}
_SEV = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY.items()) + " END"
_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sim.SEVERITY_WEIGHTS.items()) + f" ELSE {sim.UNKNOWN_SEVERITY} END"
_FACTOR = "CASE WHEN n_evidence > 0 THEN least(1.0, 0.6 + 0.1 * n_evidence) ELSE 1.0 END"
_SIGNALS = f"""
n AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS finding, o_custkey AS claim, o_orderstatus AS category, {_SEV} AS severity, CAST(o_orderkey % 10 + 1 AS DOUBLE) / 10 AS confidence, coalesce(c, 0) AS n_evidence FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
signals AS (SELECT *, round(greatest(0.0, least(1.0, CAST({_WEIGHT} AS DOUBLE) * confidence * CAST({_FACTOR} AS DOUBLE))), 4) AS score FROM f)"""


def _signals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_evidence"))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[F.col("o_orderpriority")]
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").na.fill(0, ["n_evidence"])
    rows = rows.select(
        F.col("o_orderkey").alias("finding"), F.col("o_custkey").alias("claim"), F.col("o_orderstatus").alias("category"), severity.alias("severity"),
        ((F.col("o_orderkey") % 10 + 1).cast("double") / 10).alias("confidence"), "n_evidence",
    )
    return rows.withColumn("score", ops.finding_score(F.col("severity"), F.col("confidence"), F.col("n_evidence")))


@query(f"WITH {_SIGNALS} SELECT finding, severity, confidence, n_evidence, score, {sql.ladder('score', sim.RISK_STEPS, 'INFO')} AS level FROM signals")
def finding_scores(spark, sf_dir):
    return _signals(spark, sf_dir).select("finding", "severity", "confidence", "n_evidence", "score", sim.risk_level(F.col("score")).alias("level"))


def _risk_sql(by: str) -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    level = sql.ladder("score", sim.RISK_STEPS, "INFO")
    counts = ", ".join(f"count(*) FILTER ({level} = '{l}') AS n_{l.lower()}" for l in ("HIGH", "MEDIUM", "LOW"))
    return f"""
WITH {_SIGNALS}, a AS (SELECT {keys}round(greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), CAST(coalesce(sum(CAST(score AS DECIMAL(20,4))), 0) AS DOUBLE) / greatest(CAST(1.0 AS DOUBLE), CAST(0.75 * count(*) AS DOUBLE)))), 4) AS risk, count(*) AS n_signals, {counts} FROM signals {group})
SELECT *, {sql.ladder('risk', sim.RISK_STEPS, 'INFO')} AS level FROM a"""


@query(_risk_sql(""))
def risk_overall(spark, sf_dir):
    return ops.aggregate_risk(_signals(spark, sf_dir), [])


@query(_risk_sql("claim"))
def risk_by_claim(spark, sf_dir):
    return ops.aggregate_risk(_signals(spark, sf_dir), ["claim"])


@query(_risk_sql("category"))
def risk_by_category(spark, sf_dir):
    return ops.aggregate_risk(_signals(spark, sf_dir), ["category"])


# issues -------------------------------------------------------------------------------------------------------------

_ISSUES = """
src AS (
  SELECT 0 AS s, 'O' || o_orderkey AS issue_id, 'order' AS issue_type, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity, o_custkey AS claim, o_orderstatus AS title, CAST(0.7 AS DOUBLE) AS confidence FROM orders
  UNION ALL SELECT 1, 'E' || event_id, 'event', CASE WHEN event_type = 'error' THEN 'HIGH' ELSE 'LOW' END, user_id, event_type, CAST(0.9 AS DOUBLE) FROM events
  UNION ALL SELECT 2, 'O' || o_orderkey, 'recheck', 'MEDIUM', o_custkey, 'recheck', CAST(0.5 AS DOUBLE) FROM orders WHERE o_orderstatus = 'P'),
issues AS (SELECT issue_id, issue_type, severity, claim, title, confidence FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY s DESC) AS k FROM src) WHERE k = 1)"""


def _issues(spark, sf_dir):
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    high = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH").when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW")
    key = F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("issue_id")
    first = orders.select(key, F.lit("order").alias("issue_type"), high.alias("severity"), F.col("o_custkey").alias("claim"), F.col("o_orderstatus").alias("title"), F.lit(0.7).alias("confidence"))
    second = events.select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("issue_id"), F.lit("event").alias("issue_type"),
        F.when(F.col("event_type") == "error", "HIGH").otherwise("LOW").alias("severity"), F.col("user_id").alias("claim"), F.col("event_type").alias("title"), F.lit(0.9).alias("confidence"),
    )
    third = orders.where("o_orderstatus = 'P'").select(key, F.lit("recheck").alias("issue_type"), F.lit("MEDIUM").alias("severity"), F.col("o_custkey").alias("claim"), F.lit("recheck").alias("title"), F.lit(0.5).alias("confidence"))
    return ops.union_issues(first, second, third)


@query(f"WITH {_ISSUES} SELECT * FROM issues")
def issue_union_dedupe(spark, sf_dir):
    return _issues(spark, sf_dir)


@query(f"""
WITH {_ISSUES}, c AS (SELECT claim, count(*) FILTER (issue_type = 'order') AS n_order, count(*) FILTER (issue_type = 'event') AS n_event, count(*) FILTER (issue_type = 'recheck') AS n_recheck, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) AS n_issues FROM issues GROUP BY 1)
SELECT *, CASE WHEN n_high > 0 THEN 'HIGH_PRIORITY_REVIEW' WHEN n_issues > 1 THEN 'REVIEW_REQUIRED' ELSE 'OPEN_ISSUE' END AS status FROM c""")
def claim_status_pivot(spark, sf_dir):
    return ops.claim_status(_issues(spark, sf_dir), ["order", "event", "recheck"])


@query(f"WITH {_ISSUES} SELECT *, CASE severity WHEN 'HIGH' THEN 'P1' WHEN 'MEDIUM' THEN 'P2' ELSE 'P3' END AS priority FROM issues")
def action_items_sorted(spark, sf_dir):
    return ops.action_items(_issues(spark, sf_dir)).orderBy("priority", "issue_type", "title", "issue_id")


@query("""
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'order' AS kind, count(*) AS n FROM orders GROUP BY 1
UNION ALL SELECT CAST(CAST(ts AS DATE) AS VARCHAR), 'event', count(*) FROM events GROUP BY 1
UNION ALL SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 'shipment', count(*) FROM lineitem GROUP BY 1""")
def timeline_sorted(spark, sf_dir):
    def part(name, column, kind):
        return table(spark, sf_dir, name).groupBy(F.col(column).cast("date").cast("string").alias("date")).agg(F.count("*").alias("n")).select("date", F.lit(kind).alias("kind"), "n")

    rows = part("orders", "o_orderdate", "order").unionByName(part("events", "ts", "event")).unionByName(part("lineitem", "l_shipdate", "shipment"))
    return rows.orderBy("date", "kind")


# examination reports ------------------------------------------------------------------------------------------------

#: Categories of objections and their words, in the vocabulary of the test texts; in order of priority.
CATEGORIES = {"novelty": ["eaux", "erre"], "inventive_step": ["thth", "schie"], "clarity": ["tion"], "formal": ["and", "der", "los"]}
_CATS = ", ".join(f"({i}, '{c}', {t})" for i, (c, t) in enumerate(CATEGORIES.items()))
_OBJECTIONS = f"""
k(priority, category, ts) AS (VALUES {_CATS}),
t AS (SELECT conv_id, turn, lower({sql.clean('text')}) AS low FROM conversations WHERE length(text) >= 30),
m AS (SELECT conv_id, turn, priority, category, len(list_filter(ts, lambda x: contains(low, x))) AS n_terms FROM t, k),
obj AS (
  SELECT conv_id, turn, arg_min(category, priority) AS category, arg_min(n_terms, priority) AS n_terms, count(*) AS n_categories FROM m WHERE n_terms > 0 GROUP BY 1, 2)"""


def _objections(spark, sf_dir):
    return reports.objections(table(spark, sf_dir, "conversations"), CATEGORIES, ["conv_id", "turn"])


@query(f"WITH {_OBJECTIONS} SELECT conv_id, turn, category, CAST(n_terms AS INTEGER) AS n_terms, CAST(n_categories AS INTEGER) AS n_categories FROM obj")
def fer_objections(spark, sf_dir):
    return _objections(spark, sf_dir)


@query(f"WITH {_OBJECTIONS} SELECT category, conv_id, count(*) AS n_objections, array_to_string(list_sort(list(turn)), ',') AS turns FROM obj GROUP BY 1, 2")
def fer_claim_map(spark, sf_dir):
    rows = _objections(spark, sf_dir).groupBy("category", "conv_id").agg(F.count("*").alias("n_objections"), F.sort_array(F.collect_list("turn")).alias("t"))
    return rows.select("category", "conv_id", "n_objections", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("turns"))


@query()
def fer_claim_numbers(spark, sf_dir):
    from attesta.plans.claim_queries import claims

    t = F.concat(F.lit("Claims 1-3, and claim "), F.col("number").cast("string"), F.lit(" lack novelty under Section 3(k): "), F.col("text"))
    rows = claims(spark, sf_dir).select("family", "number", t.alias("t"))
    rows = rows.select("family", "number", reports.claim_numbers(F.col("t")).alias("c"), reports.statutory_sections(F.col("t")).alias("s"))
    return rows.select("family", "number", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("claim_numbers"), F.array_join("s", ",").alias("sections"))


@query(f"""
WITH p AS (SELECT n_nationkey AS provision_id, n_name || ' region ' || r_name || ' provisions' AS text FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT DISTINCT lower(replace(split_part(c_name, '#', 1) || ' ' || c_mktsegment || ' region nation_' || c_nationkey, '#', ' ')) AS query FROM customer),
t AS (SELECT query, list_distinct(list_filter(regexp_split_to_array(query, '[^a-z0-9]+'), lambda x: length(x) > 2)) AS ts FROM q),
s AS (SELECT query, provision_id, CASE WHEN contains(lower(text), query) THEN 5 ELSE 0 END + len(list_filter(ts, lambda x: contains(lower(text), x))) AS score FROM t, p)
SELECT query, provision_id, CAST(score AS INTEGER) AS score FROM s WHERE score > 0""")
def legal_search(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    provisions = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("provision_id"), F.concat("n_name", F.lit(" region "), "r_name", F.lit(" provisions")).alias("text"))
    q = F.lower(F.concat(F.split_part("c_name", F.lit("#"), F.lit(1)), F.lit(" "), "c_mktsegment", F.lit(" region nation_"), F.col("c_nationkey").cast("string")))
    return reports.provision_search(table(spark, sf_dir, "customer").select(q.alias("query")).distinct(), provisions, ["query"])


@query()
def report_markdown(spark, sf_dir):
    return reports.markdown_lines(risk_by_category(spark, sf_dir), ["category"], "Risk by category")


_CELL = "regexp_replace(coalesce(CAST({} AS VARCHAR), ''), '[|\\n]', ' ', 'g')"


def _section_sql(name: str, title: str, rows: str, order: str, columns: list[str]) -> str:
    """CTEs of a section: k and line in order, with its heading; one line where it has no rows."""
    line = " || ' | ' || ".join(_CELL.format(c) for c in columns)
    return f"""
{name}_rows AS ({rows}),
{name}_lines AS (
  SELECT -5 AS k, '' AS line UNION ALL SELECT -4, '## {title}' UNION ALL SELECT -3, ''
  UNION ALL SELECT -2, '| {' | '.join(columns)} |' FROM (SELECT count(*) AS n FROM {name}_rows) WHERE n > 0 UNION ALL SELECT -1, '|{'---|' * len(columns)}' FROM (SELECT count(*) AS n FROM {name}_rows) WHERE n > 0
  UNION ALL SELECT -1, '_No rows._' FROM (SELECT count(*) AS n FROM {name}_rows) WHERE n = 0
  UNION ALL SELECT row_number() OVER (ORDER BY {order}), '| ' || {line} || ' |' FROM {name}_rows)"""


_REPORT = [
    ("r", "Regions", "SELECT r_regionkey, r_name FROM region", "r_name", ["r_regionkey", "r_name"]),
    ("c", "Customers of machinery", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'", "c_nationkey, c_custkey", ["c_custkey", "c_name", "c_nationkey"]),
    ("e", "Nothing", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 0", "n_name", ["n_nationkey", "n_name"]),
    ("o", "Orders by part", "SELECT l_partkey, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_partkey", "n_lines, l_partkey", ["l_partkey", "n_lines", "n_orders"]),
]


@query(f"""
WITH {', '.join(_section_sql(*s) for s in _REPORT)},
every AS (SELECT 0 AS s, 0 AS k, '# Report' AS line UNION ALL {' UNION ALL '.join(f'SELECT {i + 1}, k, line FROM {s[0]}_lines' for i, s in enumerate(_REPORT))})
SELECT row_number() OVER (ORDER BY s, k) AS n, line FROM every""")
def report_lines(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("region", "customer", "nation", "lineitem")}
    parts = t["lineitem"].groupBy("l_partkey").agg(F.count("*").alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"))
    return reports.report(
        "Report",
        [
            ("Regions", t["region"].select("r_regionkey", "r_name"), ["r_name"]),
            ("Customers of machinery", t["customer"].where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name", "c_nationkey"), ["c_nationkey", "c_custkey"]),
            ("Nothing", t["nation"].where("n_nationkey < 0").select("n_nationkey", "n_name"), ["n_name"]),
            ("Orders by part", parts, ["n_lines", "l_partkey"]),
        ],
    )
