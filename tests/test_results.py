"""Answers of providers by hand: names and shapes of fields, empty values, answers that can't be read."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import review, rules
from attesta.sources import results


def taken(spark, *answers):
    rows = spark.createDataFrame([(i, a if a is None or isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)], "n int, raw string")
    found = results.normalized_items(results.items(rows, ["n"]), ["n", "place"])
    return {(r.n, r.place): r for r in found.collect()}


@pytest.mark.parametrize("column, name", [(c, n) for c, names in results.FIELDS.items() for n in names])
def test_every_name_of_a_text(spark, column, name):
    assert taken(spark, [{name: "  a\n b "}])[0, 0][column] == "a b"


def test_every_name_of_a_list_and_of_a_score(spark):
    for column, names in results.LISTS.items():
        for name in names:
            row = taken(spark, [{name: ["x", " ", None, "y  z", 3]}, {name: "a; b|c,,d"}, {name: []}])
            assert row[0, 0][column] == ["x", "y z", "3"] and row[0, 1][column] == ["a", "b", "c", "d"] and row[0, 2][column] == []
    scores = taken(spark, [{"score": 0.25}, {"similarity": "0.5"}, {"relevance_score": "high"}, {"score": None, "similarity": 2}, {}])
    assert [scores[0, i].relevance_score for i in range(5)] == [0.25, 0.5, 0.0, 2.0, 0.0]


def test_empty_values_hide_nothing(spark):
    row = taken(spark, [{"title": "", "document_title": None, "patent_title": [], "name": "here"}])[0, 0]
    assert row.title == "here" and row.abstract == "" and row.inventors == []


def test_where_answers_hold_results(spark):
    one = {"title": "t"}
    found = taken(spark, [one, 1, "x", one], {"results": "no", "items": [one]}, {"data": [], "records": [one]}, {"other": [one]}, "{broken", None, "", {"records": [one, [one]]})
    assert sorted(found) == [(0, 0), (0, 3), (1, 0), (7, 0)]


def test_files_hold_one_answer_each(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"title": "ring  of brass"}, {"title": "bolt", "abstract": "no ring"}]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps([{"name": "ring", "claims": "A bolt"}]))
    (tmp_path / "c.json").write_text("")
    rows = results.items(results.read_payloads(spark, str(tmp_path)), ["file"])
    assert rows.count() == 3
    top = results.search_local(rows, ["file", "place"], "Bolt of ring", most=2).collect()
    assert [(r.file, r.place, r.score) for r in top] == [("a.json", 1, 1.0), ("a.json", 0, 0.5)]
    assert results.search_local(rows, ["file", "place"], "of").count() == 3


def test_motivation_reads_normalised_tokens(spark):
    rows = [(1, "The cell may be\n combined!", "x"), (2, "with from that said", "with from that said"), (3, "li-ion 18650 3.7v pack", "LI-ION, 18650; 3.7V"), (4, None, None), (5, "Reduce; power", "")]
    found = {r.n: (r.signals, r.score) for r in review.motivation(spark.createDataFrame(rows, "n int, a string, b string"), ["n"], "a", "b").collect()}
    assert found[1] == ("combine,may be combined", 0.55) and found[2] == ("", 0.0) and found[4] == ("", 0.0)
    assert found[3] == ("shared_technical_vocabulary", 0.15) and found[5] == ("reduce power", 0.15)


def test_steps_of_section_signals(spark):
    rows = [(1, "a b c d", ""), (2, "a b", ""), (3, "a", "b c"), (4, "", "a"), (5, None, None)]
    found = rules.section_scores(spark.createDataFrame(rows, "n int, c string, s string"), {"x": ["a", "b", "c", "d"]}, ["n"], "c", "s")
    assert {r.n: (r.score, r.status) for r in found.collect()} == {
        1: (0.7, "STRONG_REVIEW_SIGNAL"), 2: (0.4, "REVIEW_SIGNAL"), 3: (0.3, "WEAK_REVIEW_SIGNAL"), 4: (0.05, "WEAK_REVIEW_SIGNAL"),
    }
