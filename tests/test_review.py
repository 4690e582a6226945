"""Operators on small tables with values worked out by hand: nulls, empty texts, ties, repeated rows, clashing names."""

import re

from attesta.operators import amendments, evidence, reports, review
from attesta.plans.catalog import QUERIES
from attesta.sources import results
from attesta.streaming import ledger


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def passages(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, passage int, text string")


def test_scores_add_neighbouring_tokens(spark):
    items = spark.createDataFrame([(1, "red sensor housing"), (2, None), (3, "")], "item_id long, text string")
    found = evidence.passage_scores(items, passages(spark, "the red sensor in a blue housing", "housing red sensor", None, "nothing here"))
    # four tokens on one side: 3 of 4 shared, one pair of neighbours; then all three shared, one pair
    assert rows(found, "item_id", "doc_id", "lexical", "phrase", "score") == [(1, 0, 0.75, 0.05, 0.8), (1, 1, 1.0, 0.05, 1.0)]


def test_charts_reward_limitations_held_whole_and_count_the_rest(spark):
    items = spark.createDataFrame([(1, "Red sensor"), (2, "unseen words")], "item_id long, text string")
    docs = passages(spark, "a red sensor lies in the long blue housing of it", "sensor red and some other long words too", None)
    found = evidence.chart(items, docs)
    # 2 of 10 tokens (a one-letter word is none), and .4; 2 of 8
    assert rows(found, "item_id", "doc_id", "score", "status") == [(1, 0, 0.6, "PARTIAL"), (1, 1, 0.25, "UNCERTAIN")]
    totals = items.selectExpr("item_id", "3 AS n_rows")
    counted = evidence.chart_statistics(found, ["item_id"], totals)
    assert rows(counted, "item_id", "n_partial", "n_not_found", "weighted_coverage") == [(1, 1, 1, 0.1667), (2, 0, 3, 0.0)]
    sizes = spark.createDataFrame([(7, 2)], "claim long, n_limitations long")
    ranked = evidence.rank_documents(found.selectExpr("7L AS claim", "*"), sizes)
    assert rows(ranked, "doc_id", "coverage", "rank") == [(0, 0.25, 1), (1, 0.0, 2)]


def test_limitations_without_evidence_are_not_found(spark):
    results_ = spark.createDataFrame([(1, "verified", 0.9), (1, "contradicted", 0.1), (2, "contradicted", 0.2)], "item_id long, status string, combined double")
    items = spark.createDataFrame([(1,), (2,), (3,), (3,)], "item_id long")
    assert rows(evidence.verification_rollup(results_, "item_id", items), "item_id", "status", "coverage") == [(1, "verified", 0.9), (2, "contradicted", 0.2), (3, "not_found", 0.0)]


def test_versions_match_one_to_one(spark):
    schema = "family long, number long, text string"
    old = spark.createDataFrame([(1, 1, "a device comprising a red sensor"), (1, 2, "a method of cooling batteries"), (2, 1, "only old"), (3, 1, None)], schema)
    new = spark.createDataFrame([(1, 5, "a device comprising a red sensor"), (1, 6, "a method of cooling the batteries"), (4, 1, "only new")], schema)
    found = rows(amendments.match_versions(old, new), "family", "old_number", "new_number", "status")
    assert found == sorted([(1, 1, 5, "unchanged"), (1, 2, 6, "matched"), (2, 1, None, "deleted"), (3, 1, None, "deleted"), (4, None, 1, "added")], key=str)
    assert amendments.match_versions(old.limit(0), new.limit(0)).count() == 0


def test_citations_and_coverage(spark):
    texts = spark.createDataFrame([(1, "see EP 1234567 and ep 1234567", "x"), (2, None, "y"), (3, "", "z")], "id long, text string, reference string")
    assert rows(review.citations(texts, ["id"]), "id", "reference", "kind") == [(1, "1234567", "patent_document"), (1, "EP 1234567", "EP")]
    expected = spark.createDataFrame([(1, "A"), (1, "a "), (1, "b"), (1, None), (2, " ")], "k long, item string")
    supported = spark.createDataFrame([(1, "B"), (1, "c")], "k long, item string")
    assert rows(review.coverage_of(expected, supported, ["k"], "item"), "k", "expected", "supported", "unsupported", "coverage") == [(1, 2, 1, 1, 0.5)]


def test_gate_of_no_issues_is_open(spark):
    issues = spark.createDataFrame([("WARNING", "graph")], "severity string, category string")
    columns = ("review_required", "report_allowed")
    assert rows(review.gate(issues.limit(0), True), *columns) == [(False, True)]
    assert rows(review.gate(issues), *columns) == [(True, True)] and rows(review.gate(issues, True), *columns) == [(True, False)]


def test_results_of_json_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"publication": " EP  1 ", "name": "N"}\n\n{"publication_number": "X", "title": "T", "summary": "S"}\nnot json\n')
    found = results.normalized(results.read_json(spark, str(tmp_path / "in")), ["raw"])
    assert rows(found, "publication_number", "title", "abstract") == [("", "", ""), ("EP 1", "N", ""), ("X", "T", "S")]
    lines = spark.createDataFrame([(1, "b < c"), (0, "a")], "n long, line string")
    results.write_lines(lines, str(tmp_path / "out"), as_html=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["<p>a</p>", "<p>b &lt; c</p>"]


def test_ledger_takes_each_content_once(spark, tmp_path):
    events = spark.createDataFrame([("a", "op", "x", 1), ("a", "op", "x", 2), ("b", "op", None, 3)], "kind string, operation string, payload string, s long")
    events.selectExpr("kind", "operation", "payload", "timestamp_seconds(s) AS at").write.parquet(str(tmp_path / "in"))
    schema = "kind string, operation string, payload string, at timestamp"
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = ledger.append(ledger.entries(stream, "kind", "operation", "payload", "at"), str(tmp_path / "ledger"), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)
    assert sorted(r.kind for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == ["a", "b"]


def test_deadlines_of_odd_texts(spark):
    far = "x" * 260
    texts = [(1, None), (2, ""), (3, "1/2/23"), (4, "due 1/2/23"), (5, f"due {far} 1/2/23"), (6, f"1/2/23 {far} due 3-4-2024, 5 may 2025"), (4, "due 1/2/23"), (7, "😀due May 5, 2025")]
    found = reports.deadlines(spark.createDataFrame(texts, "k long, text string"), ["k"])
    assert [r[:2] for r in rows(found, "k", "date_text")] == [(4, "1/2/23"), (6, "3-4-2024"), (6, "5 may 2025"), (7, "May 5, 2025")]
    assert {r.context for r in found.where("k = 6").collect() if r.date_text == "5 may 2025"} == {"x" * 235 + " due 3-4-2024, 5 may 2025"}
    assert {r.context for r in found.where("k = 7").collect()} == {"😀due May 5, 2025"}
    assert reports.deadlines(spark.createDataFrame([], "k long, text string"), ["k"]).count() == 0


def test_deadlines_in_many_and_near_dates(spark):
    texts = [(1, "1/2/23,3/4/24;5-6-2025 due\n\n 7 May 2026 " + "x " * 300 + "8/9/27"), (2, " ".join(f"{i % 28 + 1}/3/2024" for i in range(400)) + " due"), (1, "1/2/23,3/4/24;5-6-2025 DUE   7 may 2026 " + "x " * 300 + "8/9/27")]
    found = reports.deadlines(spark.createDataFrame(texts, "k long, text string"), ["k"])
    assert sorted(r.date_text for r in found.where("k = 1").collect()) == ["1/2/23", "3/4/24", "5-6-2025", "7 May 2026"]
    plain = {}
    for m in re.finditer(r"\d{1,2}/\d{1,2}/\d{4}", texts[1][1]):
        context = texts[1][1][max(0, m.start() - 250) : m.end() + 250].strip()
        plain |= {(m.group(), context): 1} if "due" in context else {}
    assert sorted((r.date_text, r.context) for r in found.where("k = 2").collect()) == sorted(plain)


def test_contexts_of_deadlines_are_not_shuffled(spark):
    plan = QUERIES["fer_deadlines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_actions_for_unknown_categories(spark):
    found = reports.response_actions(spark.createDataFrame([("section_3",), ("new",), (None,)], "category string"))
    assert sorted(((r.category or "", r.action, r.priority) for r in found.collect())) == sorted(
        [("section_3", reports.ACTIONS["section_3"], "high"), ("new", reports.OTHER_ACTION, "review"), ("", reports.OTHER_ACTION, "review")]
    )
