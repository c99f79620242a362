import time

import pytest
from pyspark.sql import functions as F

from sumline.functions import patterns as P  # noqa: F401
from sumline.operators import cleaning as C
from sumline.operators import profiles, regions
from sumline.plans import repairs


def grid(spark, rows):
    return spark.createDataFrame([(rows,)], "grid array<array<string>>")


def apply(spark, f, rows):
    return grid(spark, rows).select(f(F.col("grid")).alias("x")).first().x


def test_currency_columns(spark):
    rows = [["Revenue", "$", "10", "(", "5)"], ["Cost", None, "4", None, "6"], ["Profit", "$ ", None, "", "7"]]
    assert apply(spark, C.merge_currency_columns, rows) == [["Revenue", "$10", "(5)"], ["Cost", "4", "6"], ["Profit", "$ ", "7"]]
    assert apply(spark, C.merge_currency_columns, [["$", "(", "5)"]]) == [["$(", "5)"]]  # left to right: the second sign is used up
    assert apply(spark, C.merge_currency_columns, []) == [] and apply(spark, C.merge_currency_columns, None) is None
    assert apply(spark, C.merge_currency_columns, [["a", "$"]]) == [["a", "$"]]


def test_year_labels_and_blanks(spark):
    assert apply(spark, C.merge_year_labels, [["2013", "from", "2012", "5"], ["2013", "4", "2012"], ["2013"], [None, "x", "y"]]) == [["2013 from 2012", "5"], ["2013", "4", "2012"], ["2013"], [None, "x", "y"]]
    assert apply(spark, C.drop_blank, [["a", None, "1"], [None, " "], ["b", "", "2"]]) == [["a", "1"], ["b", "2"]]
    assert apply(spark, C.drop_blank, [[None, ""], []]) == []


def test_labels(spark):
    label = lambda s, figure=False: spark.range(1).select(C.deprose(C.desection(F.lit(s)), F.lit(figure)).alias("x")).first().x
    assert label("Total non-current assets Current assets") == "Total non-current assets"
    assert label("Total assets equity that runs on for a long while yet") == "Total assets equity that runs on for a long while yet"
    assert label("reasonable assurance about whether these are free of Total current assets") == "Total current assets"
    assert label("we have audited in our opinion and so on trade receivables that were shown", True) == "trade receivables"
    assert label("we have audited in our opinion and so on trade receivables that were shown") == "we have audited in our opinion and so on trade receivables that were shown"
    assert label(None) is None and label("") == ""


def test_trailing_prose(spark):
    rows = [["Revenue", "10"], ["Total", None], ["the notes on pages seven through nineteen form part", None], ["x", None]]
    assert apply(spark, C.trim_trailing_prose, rows) == rows[:2]
    assert apply(spark, C.trim_trailing_prose, rows[1:]) == rows[1:]
    assert apply(spark, C.trim_trailing_prose, []) == []


def test_note_refs(spark):
    rows = [["", "2024", "2023"], ["AED'000", "AED'000"], ["Revenue 6 (b)", "1,000", "900"], ["Cost of sales", "16 2,475,403", "7"], ["Notes Tax", "5", "4"], ["", "2024", "2023"]]
    got = C.strip_note_refs(grid(spark, rows)).first()
    assert got.grid == [["", "2024", "2023"], ["Revenue", "1,000", "900"], ["Cost of sales", "2,475,403", "7"], ["Tax", "5", "4"]]
    assert got.note_refs == {"revenue": "6 (b)", "cost of sales": "16"}
    rows = [["Revenue", "6", "1,000", "900"], ["Cost", "7.1", "500", "400"], ["Tax", None, "50", "40"], ["Profit 8", None, "450", "460"]]
    got = C.strip_note_refs(grid(spark, rows)).first()
    assert got.grid == [["Revenue", "1,000", "900"], ["Cost", "500", "400"], ["Tax", "50", "40"], ["Profit", "450", "460"]]
    assert got.note_refs == {"revenue": "6", "cost": "7.1", "profit": "8"}
    rows[0][1] = "600"
    assert C.strip_note_refs(grid(spark, rows)).first().grid[0] == ["Revenue", "600", "1,000", "900"]
    assert C.strip_note_refs(grid(spark, [])).first().grid == []


def test_note_refs_of_a_long_table(spark, tmp_path):
    n = 12_000
    name = F.format_string("Supplier#%09d", F.col("id") % (n - 5))  # the last five repeat the first five's names
    suppliers = spark.range(n).select(F.col("id").alias("s_suppkey"), name.alias("s_name"), F.lit(3).alias("s_nationkey"), (F.col("id") + 1000.0).alias("s_acctbal"))
    suppliers.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.monotonic()
    got = sorted((r.v, r.s_name, r.ref) for r in repairs.note_references(spark, str(tmp_path)).collect())
    assert time.monotonic() - began < 60  # a map beside every line takes minutes
    assert got == sorted((f"{i + 1000:,}", f"Supplier#{i % (n - 5):09d}", str(i % (n - 5) % 20 + 1)) for i in range(n))


@pytest.mark.parametrize(
    ("f", "vals", "want"),
    [
        (regions.collapse_repeats, ["a b", "a b"], ["a b", None]),
        (regions.collapse_repeats, ["a", "a"], ["a", "a"]),
        (regions.spread_glued, ["Contract assets", "22", "432,541 221,711 205,270", None, None], ["Contract assets", "22", "432,541", "221,711", "205,270"]),
        (regions.spread_glued, ["x", "1 2", "3"], ["x", "1 2", "3"]),
        (regions.spread_glued, [], []),
        (lambda v: regions.peel_row(v, F.lit(4)), ["Property, plant and equipment 6 8,063,422 7,741,119", None, None, None], ["Property, plant and equipment", "6", "8,063,422", "7,741,119"]),
        (lambda v: regions.peel_row(v, F.lit(4)), ["Total assets 8,063 7,741", None, None, None], ["Total assets", "8,063", "7,741"]),
        (lambda v: regions.peel_row(v, F.lit(4)), ["Revenue 5", None], ["Revenue 5", None]),
        (lambda v: regions.peel_row(v, F.lit(3)), [None, None], [None, None]),
        (lambda v: regions.widen(v, F.lit(4)), ["a", "1 2", "3 4"], ["a", "1 2", "3", "4"]),
        (lambda v: regions.widen(v, F.lit(3)), ["a"], ["a", None, None]),
        (lambda v: regions.widen(v, F.lit(3)), ["a", ")87,579( )11,915("], ["a", ")87,579(", ")11,915("]),
        (lambda v: regions.repair(v, F.lit(3)), ["Total assets 8,063 7,741"] * 3, ["Total assets", "8,063", "7,741"]),
    ],
)
def test_rows(spark, f, vals, want):
    assert spark.createDataFrame([(vals,)], "v array<string>").select(f(F.col("v")).alias("x")).first().x == want


def test_reversed_wrap(spark):
    assert spark.range(1).select(regions.unwrap_reversed(F.lit(")69,040\n1,1(")).alias("x")).first().x == ")1,169,040("


REGION = f"page int, region_id int, x0 double, y0 double, x1 double, y1 double, rows {regions.ROWS}"


def test_side_by_side(spark):
    labels = [(float(10 * i), float(10 * i + 9), [f"Line {w}"]) for i, w in enumerate(("one", "two", "three"))]
    figures = [(float(10 * i), float(10 * i + 9), [str(i), str(i + 5)]) for i in (0, 2)]
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 29.0, labels), (1, 2, 60.0, 0.0, 90.0, 29.0, figures), (2, 1, 0.0, 0.0, 50.0, 29.0, labels), (2, 2, 60.0, 0.0, 90.0, 29.0, labels)], REGION)
    got = {(r.page, r.region_id): r for r in regions.merge_side_by_side(df, ["page"]).collect()}
    assert [list(r.vals) for r in got[1, 1].rows] == [["Line one", "0", "5"], ["Line two", None, None], ["Line three", "2", "7"]]
    assert got[1, 1].x1 == 90.0 and set(got) == {(1, 1), (2, 1), (2, 2)}


def test_stacked(spark):
    row = lambda *v: (0.0, 1.0, list(v))
    df = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 50.0, 20.0, [row("a", "1", "2")]), (1, 2, 5.0, 40.0, 55.0, 60.0, [row("b", "3 4")]), (1, 3, 5.0, 200.0, 55.0, 220.0, [row("c", "3")]), (1, 4, 90.0, 230.0, 95.0, 240.0, [row("d", "3")])], REGION
    )
    got = {r.region_id: r for r in regions.merge_stacked(df, ["page"]).collect()}
    assert set(got) == {1, 3, 4} and [list(r.vals) for r in got[1].rows] == [["a", "1", "2"], ["b", "3", "4"]] and (got[1].x1, got[1].y1) == (55.0, 60.0)


def test_fused_and_prose_columns(spark):
    assert apply(spark, regions.is_fused, [["Total assets", "1"], ["Cost of sales", "2"]])
    assert not apply(spark, regions.is_fused, [["Total assets", "1"], ["the note on cost of sales", None]])
    prose = "we have audited these statements of the group for the year"
    rows = [["Revenue", "10", prose], ["Costs", "5", prose], ["Profit", "5", None]]
    assert apply(spark, regions.drop_prose_columns, rows) == [["Revenue", "10"], ["Costs", "5"], ["Profit", "5"]]
    only = [["10", prose], ["5", prose]]
    assert apply(spark, regions.drop_prose_columns, only) == only and apply(spark, regions.drop_prose_columns, []) == []


def test_profiles(spark):
    df = spark.createDataFrame([(["Revenue", "Cost of sale", "Gross profit"],), ([],), (None,), (["Segment result", "Revenue"],)], "labels array<string>")
    known = ["Revenue", "Cost of sales", "Profit for the year", "Gross profit"]
    assert [r.s for r in df.select(profiles.match_score(F.col("labels"), known, ["Segment results"]).alias("s")).collect()] == [0.75, 0.0, 0.0, -0.25]
    assert [r.s for r in df.select(profiles.anchored(F.col("labels"), known).alias("s")).collect()] == [True, False, False, False]
    cand = [(1, 1, 3, 10.2, 12, 0.9, False, False, False, 2, 0.91), (1, 2, 3, 9.9, 12, 0.9, True, True, False, 2, 0.5), (1, 3, 4, 0.0, 11, 0.1, True, True, True, 1, 0.5), (1, 4, 5, 0.0, 2, 0.9, True, True, True, 2, 0.5), (1, 5, 5, 0.0, 9, 0.1, True, True, True, 2, 0.5)]
    df = spark.createDataFrame(cand, "file int, candidate_id int, page int, top double, n_rows int, score double, reconciles boolean, anchored boolean, cut_found boolean, n_values int, labelled double")
    got = profiles.ranked(profiles.plausible(df, ["file"]), ["file"]).collect()
    assert {r.candidate_id: r.place for r in got} == {3: 1, 1: 2}
