"""Secret scanning with a trigram inverted index. DataFrame functions only.

1. Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain.
2. The index has a posting (trigram, text) for each trigram that some query names and each distinct text that contains it,
   case folded. Texts are named by a 64-bit hash; two texts that shared one would only share candidates.
3. The queries are in disjunctive form: a text is a candidate for a rule if, for one clause, it stands in the postings of
   all trigrams of the clause.
4. Candidates are verified by the regular expression over the whole text. A rule without mandatory trigrams is verified on
   every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

try:  # the standard library's parser of regular expressions
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import saved


@dataclass(frozen=True)
class Rule:
    """``pattern`` is for the regular expressions that Java and Python share; matches are leftmost and don't overlap.

    A match counts if its group ``group`` has at least ``least`` characters.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0


#: The rules of the contract.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    # runs of fewer than 16 digits would be dropped: asking for 16 finds the same
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: Published token formats, beside those of the contract.
MORE_RULES = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}", 39),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}", 15),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}", 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 25),
)
RULES = BASE_RULES + MORE_RULES
#: Strings that one piece of an expression may stand for before they are no longer followed one by one.
MOST_STRINGS = 24

Clause = frozenset  # of trigrams, all of which must be there


def _trigrams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _strings(node) -> list[str] | None:
    """All strings that a part of an expression stands for, lower-cased; None if there are too many."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return [chr(arg).lower()]
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return sorted({chr(v).lower() for _, v in arg})
    if name == "IN" and len(arg) == 1 and str(arg[0][0]) == "RANGE" and arg[0][1][1] - arg[0][1][0] < MOST_STRINGS:
        return sorted({chr(v).lower() for v in range(arg[0][1][0], arg[0][1][1] + 1)})
    if name == "SUBPATTERN":
        return _all_strings(arg[-1])
    if name == "BRANCH":
        parts = [_all_strings(p) for p in arg[1]]
        return None if any(p is None for p in parts) else sorted({s for p in parts for s in p})
    if name == "MAX_REPEAT" and arg[1] <= 2:
        part = _all_strings(arg[2])
        if part is not None:
            return sorted({"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(part, repeat=n)})
    return None


def _all_strings(seq) -> list[str] | None:
    out = [""]
    for node in seq:
        part = _strings(node)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = [a + b for a in out for b in part]
    return out


def trigram_query(pattern: str) -> list[Clause] | None:
    """The query of a pattern as a disjunction of clauses, over lower-cased trigrams; None if a match needs no trigram.

    The expression is read as a sequence: stretches that stand for few strings each give a disjunction (the trigrams of
    each string), and the most selective stretch is the query. Whatever follows a long stretch is checked when verifying.
    """
    best: list[Clause] | None = None

    def consider(strings: list[str]) -> None:
        nonlocal best
        clauses = {_trigrams(s) for s in strings}
        if not all(clauses):
            return
        clauses = {c for c in clauses if not any(d < c for d in clauses)}  # a weaker clause makes a stronger one idle
        if best is None or min(map(len, clauses)) > min(map(len, best)):
            best = sorted(clauses, key=sorted)

    def read(seq) -> None:
        run = [""]
        for node in seq:
            part = _strings(node)
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = [a + b for a in run for b in part]
                continue
            consider(run)
            run = [""]
            if str(node[0]) == "SUBPATTERN":
                read(node[1][-1])
            elif str(node[0]) == "MAX_REPEAT" and node[1][0] >= 1:
                read(node[1][2])
        consider(run)

    read(sre.parse(pattern))
    return best


def queries_of(rules: tuple[Rule, ...]) -> dict[str, list[Clause] | None]:
    return {r.kind: trigram_query(r.pattern) for r in rules}


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index over a column ``text``: distinct rows of text_key and trigram, for trigrams that a query names."""
    named = sorted({t for q in queries_of(rules).values() if q for c in q for t in c})
    folded = texts.select(F.xxhash64("text").alias("text_key"), F.lower("text").alias("folded"))
    held = F.filter(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in named]), lambda t: t.isNotNull())
    # copies of a text give the same postings: they are merged before and after the shuffle
    return folded.select("text_key", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """text_key and kinds, the rules that have a clause all of whose trigrams post the text."""
    spark = index.sparkSession
    rows = [
        (kind, n, t, len(clause))
        for kind, q in queries_of(rules).items()
        for n, clause in enumerate(q or [])
        for t in sorted(clause)
    ]
    clauses = spark.createDataFrame(rows, "kind string, clause int, trigram string, needed int")  # of the rules: small
    return (
        index.join(F.broadcast(clauses), "trigram")
        .groupBy("text_key", "kind", "clause")
        .agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
        .where(F.col("n") == F.col("needed"))
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    )


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches: array of (start, order, end), in code points.

    Splitting at the matches gives what lies between them; positions are the running lengths.
    """
    pattern = F.lit(rule.pattern)
    long_enough = F.length(F.col("m.part")) >= rule.least
    pieces = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m)).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m)).alias("part"),
    )
    empty = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    walked = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + F.coalesce(m["size"], F.lit(0))).alias("at"),
            F.when(
                m["part"] >= rule.least,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + m["gap"]).alias("start"),
                            F.lit(order).alias("rule"),
                            (acc["at"] + m["gap"] + m["size"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return F.when(F.regexp_like(text, pattern), walked["spans"]).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and spans: array<struct<start,rule,end>> by start, then rule (its place in ``rules``).

    ``text`` is scanned whole; null counts as empty and has no spans. Positions are code points, the end exclusive. Columns
    that aren't in ``keep`` are left out, so theirs may have any name. Repeated rows each give their row; an empty table
    gives none.
    """
    clean = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    found = candidates(postings(clean.select(F.col("_text").alias("text")), rules), rules)
    found = saved(found.select(F.col("text_key").alias("_key"), F.col("kinds").alias("_kinds")), "candidates")
    always = [r for r in rules if trigram_query(r.pattern) is None]
    # rules without a query run on every text; the others only where the index says so
    joined = clean.withColumn("_key", F.xxhash64("_text")).join(found.hint("shuffle_hash"), "_key", "left")
    empty = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col("_text"), rule, i)
        parts.append(spans if rule in always else F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(empty))
    return joined.select(*keep, F.array_sort(F.concat(*parts)).alias("spans"))


def redacted(text: Column, spans: Column, put: str) -> Column:
    """The text with each stretch that spans cover, one or several together, replaced by ``put``."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def joined(acc: Column, s: Column) -> Column:
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        apart = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= s["start"])
        return F.when(apart, F.concat(acc, F.array(one))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))

    stretches = F.aggregate(spans, none, joined)
    done = F.aggregate(
        stretches,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(put)).alias("out"), s["end"].alias("at")
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return done


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def op5_secret_scan(spark, sf_dir) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every document; see ``scan`` for nulls and empty texts."""
    spans = F.col("spans")
    n_base = len(BASE_RULES)

    def n(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rule"] == kind)).cast("long")

    base = _listed(F.filter(spans, lambda s: s["rule"] < n_base), RULES)
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _listed(spans, RULES).alias("spans"),
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL for the query's rows: every rule over every text, with positions from what lies between matches."""
    letters = "password passwd secret token api key".split()
    folded = {w: "".join(f"[{c}{c.upper()}]" for c in w) for w in letters}

    def pattern(rule: Rule) -> str:
        p = rule.pattern
        if p.startswith("(?i:"):
            inner, rest = p[4:].split("))", 1)
            for w, f in folded.items():
                inner = re.sub(rf"(?<![a-z]){w}(?![a-z])", f.replace("\\", ""), inner)
            p = inner + ")" + rest
        return p.replace("'", "''")

    parts = []
    for i, rule in enumerate(rules):
        p = pattern(rule)
        parts.append(
            f"SELECT rid, {i} AS k, '{rule.kind}' AS kind, j, list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS s, "
            f"length(m[j]) AS n, length(v[j]) AS part, {rule.least} AS least FROM (SELECT rid, m, v, g, unnest(range(1, len(m) + 1)) AS j FROM "
            f"(SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {rule.group}) AS v, string_split_regex(t, '{p}') AS g FROM d))"
        )
    n_base = len(BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT rid, k, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS x FROM found WHERE part >= least),
a AS (SELECT rid, {counts}, string_agg(x, ',' ORDER BY s, k) FILTER (k < {n_base}) AS base, string_agg(x, ',' ORDER BY s, k) AS every FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN a USING (rid)
"""
