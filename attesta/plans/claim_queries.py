"""Queries over claims. The test tables hold no claims, so an order stands for an application and its lines for claims, each
with a text put together from the part it is about; conversations stand for versions of a text."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from attesta.operators import claims as ops, rules
from attesta.plans import sql
from attesta.plans.registry import query
from attesta.functions import text as tx
from attesta.session import table

_TEXT = "'The ' || lower(p_type) || ' device of claim ' || (l_linenumber - 1) || ' comprising a ' || p_name || ' coupled to the housing; and a ' || lower(p_brand) || ' sensor configured to report the ' || p_name || ' wherein said controller is substantially ' || lower(l_returnflag) || ' at size ' || p_size"
_CLAIMS = f"""
claims AS (SELECT l_orderkey AS family, CAST(l_linenumber AS INTEGER) AS number, l_partkey AS part, {_TEXT} AS text FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def claims(spark, sf_dir):
    """family, number, part and text, one row for each line of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_brand", "p_size")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("family"), F.col("l_linenumber").cast("int").alias("number"), F.col("l_partkey").alias("part"), F.expr(_TEXT).alias("text")
    )


def joined(column):
    """An array of strings or numbers as text, so that results are flat."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


_DEPS = "list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(text, '(?i)\\bclaims?\\s+([0-9\\s,;\\-]+)', 1), lambda s: regexp_extract_all(s, '\\d+'))), lambda n: CAST(n AS INTEGER))))"


@query(f"WITH {_CLAIMS} SELECT family, number, part, array_to_string({_DEPS}, ',') AS depends_on, CASE WHEN len({_DEPS}) > 0 THEN 'dependent' ELSE 'independent' END AS claim_type FROM claims")
def claim_dependencies(spark, sf_dir):
    t = F.col("text")
    return claims(spark, sf_dir).select("family", "number", "part", joined(ops.dependencies(t)).alias("depends_on"), ops.claim_type(t).alias("claim_type"))


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower({sql.clean('text')}), '{p}') THEN '{n}'" for p, n in ops.CATEGORY_PATTERNS) + " ELSE 'other' END"


@query(f"WITH {_CLAIMS} SELECT part, {_CATEGORY} AS category, count(*) AS n FROM claims GROUP BY 1, 2")
def claim_category_ladder(spark, sf_dir):
    return claims(spark, sf_dir).groupBy("part", ops.category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


_PARTS = f"list_filter(list_transform(regexp_split_to_array({sql.clean('text')}, '(?i);\\s*|\\bwherein\\b|\\bconfigured to\\b|\\bcomprising\\b'), lambda p: regexp_replace(trim(p), '(?i)^(and|or)\\s+', '')), lambda p: length(p) >= 8)[1:50]"


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(x), '{t}')" for t in terms) + ")"


_KIND = f"CASE WHEN {_any(ops.FUNCTIONAL)} THEN 'functional' WHEN {_any(ops.RELATIONSHIP)} THEN 'relationship' WHEN regexp_matches(lower(x), '\\bwherein\\b|\\bcomprising\\b') THEN 'constraint' ELSE 'technical_element' END"
_LIMITATIONS = f"""
lim AS (SELECT family, number, part, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM (SELECT *, {_PARTS} AS p FROM claims))"""


@query(f"WITH {_CLAIMS}, {_LIMITATIONS} SELECT family, number, part, 'L' || i AS limitation, x AS text, {_KIND} AS kind, array_to_string({sql.keywords('x')}, ',') AS search_terms FROM lim")
def claim_limitations(spark, sf_dir):
    rows = ops.limitations(claims(spark, sf_dir), ["family", "number", "part"])
    return rows.withColumn("search_terms", F.array_join("search_terms", ","))


@query(f"WITH {_CLAIMS} SELECT family, number, part, array_to_string({sql.keywords('text')}, ',') AS keywords FROM claims")
def claim_keywords(spark, sf_dir):
    return claims(spark, sf_dir).select("family", "number", "part", joined(tx.claim_keywords(F.col("text"))).alias("keywords"))


_ARTICLE = "list_transform(regexp_extract_all({t}, '(?i)\\b(?:{a})\\s+([A-Za-z][A-Za-z0-9_-]{{2,50}})', 1), lambda s: lower(s))"


@query(f"""
WITH {_CLAIMS},
d AS (SELECT family, number, part, {_ARTICLE.format(t='text', a='a|an')} AS intro, unnest(list_distinct({_ARTICLE.format(t='text', a='the|said')})) AS term FROM claims)
SELECT family, number, part, term, 'MEDIUM' AS severity FROM d WHERE NOT list_contains(intro, term) AND term NOT IN {sql.words_list(tx.CLAIM_GENERIC_WORDS)}""")
def antecedent_issues(spark, sf_dir):
    return ops.antecedent_issues(claims(spark, sf_dir), ["family", "number", "part"])


@query(f"""
WITH {_CLAIMS},
d AS (SELECT family, number, unnest({_DEPS}) AS parent FROM claims),
k AS (SELECT DISTINCT family, number FROM claims)
SELECT d.family, d.number, d.parent, CASE WHEN k.number IS NULL THEN 'missing_parent_claim' ELSE 'claim_dependency_order' END AS issue
FROM d LEFT JOIN k ON k.family = d.family AND k.number = d.parent WHERE k.number IS NULL OR d.parent >= d.number""")
def missing_parent_claims(spark, sf_dir):
    return ops.missing_parents(claims(spark, sf_dir))


@query(f"""
WITH {_CLAIMS}, e AS (SELECT family, len({_DEPS}) > 0 AS dep, len({_PARTS}) AS n FROM claims)
SELECT family, count(*) AS n_claims, count(*) FILTER (NOT dep) AS n_independent, count(*) FILTER (dep) AS n_dependent, CAST(sum(n) AS BIGINT) AS n_limitations, round(avg(n), 2) AS average_limitations
FROM e GROUP BY family""")
def claim_analysis(spark, sf_dir):
    return ops.analyze(claims(spark, sf_dir))


# rules --------------------------------------------------------------------------------------------------------------

#: Rules over the test documents: their vocabulary stands for a domain's.
RULES = [
    rules.Rule("R-LICENSE", "provenance", "high", ["license", "copyright", "all rights reserved"]),
    rules.Rule("R-SECRET", "security", "high", ["password", "api_key", "token ="]),
    rules.Rule("R-PRIVATE", "privacy", "medium", ["@", "tel:", "phone"]),
    rules.Rule("R-NEGATION", "clarity", "low", [" not ", " nicht ", " pas ", " sin "]),
    rules.Rule("R-GENERAL", "scope", "review", [" the ", " der ", " les ", " los "]),
]
_RULES = ", ".join(f"('{r.rule_id}', '{r.severity}', {[k for k in r.keywords]})" for r in RULES)


@query(f"""
WITH r(rule_id, severity, ks) AS (VALUES {_RULES}),
t AS (SELECT doc_id, lower({sql.clean('text')}) AS low FROM documents),
m AS (SELECT doc_id, rule_id, severity, list_filter(ks, lambda k: contains(low, lower(k))) AS f FROM t, r)
SELECT doc_id, rule_id, severity, array_to_string(f, ',') AS matched_terms, CAST(round(least(1.0, 0.45 + 0.10 * len(f)), 3) AS DOUBLE) AS confidence FROM m WHERE len(f) > 0""")
def rule_match_findings(spark, sf_dir):
    return rules.match_rules(table(spark, sf_dir, "documents"), RULES, ["doc_id"])


@query(f"""
WITH {_CLAIMS}, t AS (SELECT family, number, part, list_filter({rules.VAGUE_TERMS}, lambda v: contains(lower({sql.clean('text')}), v)) AS f FROM claims)
SELECT family, number, part, array_to_string(f, ',') AS terms, CAST(0.68 AS DOUBLE) AS confidence FROM t WHERE len(f) > 0""")
def clarity_findings(spark, sf_dir):
    return rules.clarity_issues(claims(spark, sf_dir), ["family", "number", "part"])


_TURNS = """
turns AS (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS old, coalesce(text, '') AS new FROM conversations)"""


def _versions(spark, sf_dir):
    """Each turn of a conversation with the turn before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce(F.lag("text").over(order), F.lit("")).alias("old"), F.coalesce("text", F.lit("")).alias("new")
    )


_W5, _W4N, _W4O = sql.plain_words("new", "[a-z]{5,}"), sql.plain_words("new", "[a-z]{4,}"), sql.plain_words("old", "[a-z]{4,}")


@query(f"""
WITH {_TURNS}, w AS (SELECT *, {_W5} AS ws FROM turns),
c AS (SELECT conv_id, turn, CAST(len(ws) AS INTEGER) AS n_terms,
  CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(len(list_filter(ws, lambda x: contains(lower(old), x))) / CAST(len(ws) AS DOUBLE), 4) END AS coverage FROM w)
SELECT *, (coverage >= 0.35 OR n_terms = 0) AS supported FROM c""")
def claim_support_gaps(spark, sf_dir):
    return rules.support(_versions(spark, sf_dir), ["conv_id", "turn"], "new", "old")


@query(f"""
WITH {_TURNS}, a AS (SELECT conv_id, turn, list_sort(list_filter({_W4N}, lambda x: NOT list_contains({_W4O}, x))) AS added FROM turns)
SELECT conv_id, turn, CAST(len(added) AS INTEGER) AS n_added, array_to_string(added[1:30], ' ') AS added FROM a WHERE len(added) > 0""")
def amendment_added_terms(spark, sf_dir):
    return rules.added_terms(_versions(spark, sf_dir), ["conv_id", "turn"], "old", "new")


@query(f"""
WITH {_TURNS}, t AS (SELECT conv_id, turn, {sql.revision_tokens('old')} AS o, {sql.revision_tokens('new')} AS n FROM turns),
x AS (SELECT *, len(list_filter(n, lambda v: NOT list_contains(o, v))) AS a FROM t),
y AS (SELECT *, CASE WHEN len(n) = 0 THEN 0.0 ELSE round(a / CAST(len(n) AS DOUBLE), 4) END AS r FROM x)
SELECT conv_id, turn, CAST(len(o) AS INTEGER) AS n_old, CAST(len(n) AS INTEGER) AS n_new, CAST(a AS INTEGER) AS n_added, r AS added_ratio, r > 0.2 AS high_change FROM y""")
def new_matter_overlap(spark, sf_dir):
    return rules.token_overlap(_versions(spark, sf_dir), ["conv_id", "turn"], "old", "new")


_REV = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s.%/-]', ' ', 'g'))"


@query(f"""
WITH o AS (SELECT DISTINCT {_REV} AS k FROM documents WHERE source = 'src0')
SELECT doc_id, 'CHANGED_OR_NEW' AS status FROM documents WHERE source <> 'src0' AND {_REV} NOT IN (SELECT k FROM o)""")
def changed_claims_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return rules.changed_texts(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "doc_id")


#: Sections and their triggers, in the vocabulary of the test claims and documents.
SECTIONS = {"small_parts": ["small", "ring", "bolt"], "widgets": ["widget", "red", "economy"], "control": ["controller", "sensor", "report"], "general": ["standard", "medium", "large"]}
_SECTIONS = ", ".join(f"('{k}', {v})" for k, v in SECTIONS.items())


@query(f"""
WITH {_CLAIMS}, s(section, ts) AS (VALUES {_SECTIONS}),
c AS (SELECT family, number, part, {sql.normalize_unicode('text')} AS c, {sql.normalize_unicode("'the standard ' || CAST(part AS VARCHAR) || ' sensor report'")} AS sp FROM claims),
x AS (SELECT family, number, part, section, len(list_filter(ts, lambda t: contains(c, t))) AS a, len(list_filter(ts, lambda t: contains(sp, t))) AS b FROM c, s),
y AS (SELECT *, CAST(round(least(1.0, least(0.7, 0.2 * a) + least(0.3, 0.05 * b)), 4) AS DOUBLE) AS score FROM x)
SELECT family, number, part, section, score, {sql.ladder('score', [(0.7, 'STRONG_REVIEW_SIGNAL'), (0.4, 'REVIEW_SIGNAL')], 'WEAK_REVIEW_SIGNAL')} AS status FROM y WHERE score > 0""")
def section_screen_scores(spark, sf_dir):
    rows = claims(spark, sf_dir).withColumn("specification", F.concat(F.lit("the standard "), F.col("part").cast("string"), F.lit(" sensor report")))
    return rules.section_scores(rows, SECTIONS, ["family", "number", "part"], "text", "specification")


def _claim_versions(spark, sf_dir):
    """Claims, and an amended version of them: each goes on by one number, some words change, some limitations come and go."""
    old = claims(spark, sf_dir).select("family", F.col("number").cast("long").alias("number"), "text")
    text = F.regexp_replace("text", "substantially", "fully")
    text = F.when(F.col("family") % 5 == 0, F.concat(text, F.lit("; and a display connected to the controller"))).otherwise(text)
    text = F.when(F.col("family") % 7 == 0, F.regexp_replace(text, " coupled to the housing; and", " coupled to a frame of steel and glass;")).otherwise(text)
    text = F.when(F.col("family") % 11 == 0, F.regexp_replace(text, "; and a [^;]* configured to", "; configured to")).otherwise(text)
    new = old.where("family % 13 > 0 OR number > 1").select("family", (F.col("number") + 1).alias("number"), text.alias("text"))
    return old, new


@query()
def amendment_match(spark, sf_dir):
    from attesta.operators.amendments import match_versions

    return match_versions(*_claim_versions(spark, sf_dir))


@query()
def amendment_limitation_changes(spark, sf_dir):
    from attesta.operators.amendments import compare_versions

    return compare_versions(*_claim_versions(spark, sf_dir)).limitations


@query()
def amendment_claim_changes(spark, sf_dir):
    from attesta.operators.amendments import compare_versions

    rows = compare_versions(*_claim_versions(spark, sf_dir)).claims
    flat = {c: joined(c) for c in ("old_dependencies", "new_dependencies")}
    return rows.withColumns(flat | {"review_flags": F.array_join("review_flags", " | ")})


@query()
def amendment_summary(spark, sf_dir):
    from attesta.operators.amendments import compare_versions, summary

    return summary(compare_versions(*_claim_versions(spark, sf_dir)).claims)


@query()
def amendment_review_map(spark, sf_dir):
    from attesta.operators.amendments import compare_versions, review_map

    rows = review_map(compare_versions(*_claim_versions(spark, sf_dir)).claims)
    return rows.withColumn("review_flags", F.array_join("review_flags", " | "))


@query()
def word_diffs(spark, sf_dir):
    from attesta.operators.amendments import text_similarity, word_diff

    rows = _versions(spark, sf_dir).withColumns({"similarity": text_similarity("old", "new"), "changes": word_diff("old", "new")})
    return rows.select("conv_id", "turn", "similarity", F.size("changes").alias("n_changes"))
