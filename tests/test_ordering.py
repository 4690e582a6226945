"""Numbers in a global order, reports written and read back, and manifests that tell what changed."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import manifests, reports
from attesta.operators.ordering import numbered
from attesta.sources import results


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("a").alias("n"))
    found = numbered(rows, ["x"]).collect()
    assert sorted((r.x, r.n) for r in found) == [(i, i + 1) for i in range(5000)]
    plan = numbered(rows, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("SinglePartition") == 1  # of a row for each range


def test_ties_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(2,), (None,), (2,), (1,), (2,)], "x int")
    found = sorted((r.n, r.x) for r in numbered(rows, ["x"]).collect())
    assert found == [(1, None), (2, 1), (3, 2), (4, 2), (5, 2)]
    assert numbered(rows.limit(0), ["x"]).collect() == []


@pytest.fixture(scope="module")
def lines(spark):
    many = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("a|b\n<"), F.col("id").cast("string"))).alias("name"))
    return reports.report("All & more", [("First", many.repartition(5), ["id"]), ("None", many.limit(0), ["id"]), ("Last", many.where("id < 2"), ["name", "id"])])


def test_sections_in_order(lines):
    found = sorted((r.n, r.line) for r in lines.collect())
    assert [n for n, _ in found] == list(range(1, len(found) + 1))
    text = [line for _, line in found]
    assert text[:7] == ["# All & more", "", "## First", "", "| id | name |", "|---|---|", "| 0 |  |"] and text[7] == "| 1 | a b <1 |"
    assert text[306:310] == ["", "## None", "", "_No rows._"] and text[310:] == ["", "## Last", "", "| id | name |", "|---|---|", "| 0 |  |", "| 1 | a b <1 |"]


@pytest.mark.parametrize("as_html", [False, True])
def test_reports_are_read_back_in_order(spark, lines, tmp_path, as_html):
    results.write_lines(lines, str(tmp_path / "out"), as_html)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    wanted = [r.line for r in sorted(lines.collect(), key=lambda r: r.n)]
    if as_html:
        wanted = ["<p>" + w.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") + "</p>" for w in wanted]
    assert text == wanted


ROWS = [(i, f"text {i}", None if i % 5 else "s") for i in range(400)] + [(None, "x", "y"), (7, "text 7", None), (8, "other", "s")]
KIND = "id int, text string, source string"


def changes(spark, now, chunks=64):
    a, b = (manifests.row_digests(spark.createDataFrame(r, KIND), ["id"], ["id", "text", "source"], chunks) for r in (ROWS, now))
    return sorted(((r.id, r.change) for r in manifests.changed_rows(a, b, ["id"]).collect()), key=str)


def test_altered_missing_new_and_swapped_rows(spark):
    now = [r for r in ROWS if r[0] != 11] + [(1000, "new", None)]
    swapped = {20: "text 21", 21: "text 20", 30: "text 30 "}
    now = [(i, swapped.get(i, t), s) for i, t, s in now]
    assert changes(spark, now[::-1]) == sorted([(11, "missing"), (1000, "new"), (20, "altered"), (21, "altered"), (30, "altered")], key=str)
    assert changes(spark, ROWS[::-1]) == [] and changes(spark, ROWS[:-2] + [(8, "other", "s")]) == [(7, "altered")]
    assert changes(spark, [(*r[:2], "") if r[0] is None else r for r in ROWS]) == [(None, "altered")]


def test_chunks_that_differ_are_those_of_changed_rows(spark):
    def made(rows, chunks=64):
        return manifests.manifest(spark.createDataFrame(rows, KIND), ["id"], ["id", "text", "source"], chunks)

    whole = made(ROWS).collect()
    top = max(r.level for r in whole)
    assert [(r.level, r.n) for r in whole if r.level == top] == [(2, len(ROWS))] and sum(r.n for r in whole if r.level == 0) == len(ROWS)
    assert manifests.differing(made(ROWS), made(ROWS[::-1])).collect() == []
    other = [(i, "changed" if i == 50 else t, s) for i, t, s in ROWS]
    found = manifests.differing(made(ROWS), made(other)).collect()
    assert sorted(r.level for r in found) == [0, 1, 2] and all(r.n_stored == r.n_now for r in found)
    assert made([]).collect() == []
