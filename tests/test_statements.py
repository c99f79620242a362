import datetime

import pytest
from pyspark.sql import functions as F

from sumline.functions.numbers import keep
from sumline.operators.footing import foot
from sumline.operators.health import with_health
from sumline.operators.statements import assemble, merge_wrapped, read_tables, reversed_years
from sumline.plans import queries
from sumline.sources.tables import CELLS

PL = ("Consolidated statement of profit or loss", [["", 2024, 2023], ["Revenue", 1000000, 900000], ["Cost of sales", -400000, -350000], ["Gross profit", 600000, 550000], ["Operating expenses", -200000, -180000], ["Finance costs", -50000, -40000], ["Profit before tax", 350000, 330000], ["Income tax", -50000, -30000], ["Profit for the year", 300000, 300000]])
BS = ("Consolidated statement of financial position", [["", 2024, 2023], ["Non-current assets"], ["Property, plant and equipment", 800000, 750000], ["Total non-current assets", 800000, 750000], ["Current assets"], ["Inventories", 200000, 180000], ["Total current assets", 200000, 180000], ["Total assets", 1000000, 930000], ["Equity"], ["Share capital", 400000, 400000], ["Retained earnings", 200000, 150000], ["Total equity", 600000, 550000], ["Total liabilities", 400000, 380000], ["Total equity and liabilities", 1000000, 930000]])
EQUITY = ("Statement of changes in equity", [["", "Total AED'000"], ["At 1 January 2018", 8342576], ["Profit for the year", 1752992], ["Other comprehensive income", 2687], ["Total comprehensive income", 1755679], ["Cash dividends paid", -1586517], ["Total transactions with shareholders", -1586517], ["At 31 December 2018", 8511738]])
CASH = lambda k, off: ("Statement of cash flows", [["", 2024, 2023], *[[a, v * k + o, v * k + o] for a, v, o in (("Net cash generated from operating activities", 5000, 0), ("Net cash used in investing activities", -2000, 0), ("Net cash used in financing activities", -1000, 0), ("Net increase in cash and cash equivalents", 2000, off), ("Cash and cash equivalents at the end of the year", 2000, off))]])
RATIO = ("Profit and Loss Summary", [["", 2024, 2023], ["Revenue", 1000, 900], ["EBITDA", 400, 380], ["EBITDA margin", 40, 42], ["Net profit", 300, 280]])
BRIDGE = ("Statement of profit or loss", [["", "As reported", "IFRS 16", "Restated"], *[[x, 1000 * i, 50 * i, 1050 * i] for i, x in enumerate(["Revenue", "Operating expenses", "Finance costs", "Income tax", "Profit for the year"], 2)]])


def changed(table, row, col, value):
    title, rows = table
    rows = [list(r) for r in rows]
    rows[row][col] = value
    return title, rows


TABLES = {
    "pl": PL, "bs": BS, "equity": EQUITY, "cash": CASH(1, 400), "cash_big": CASH(1000, 400), "ratio": RATIO, "bridge": BRIDGE, "pl_wrong": changed(PL, 2, 1, -300000), "pl_huge": changed(PL, 5, 1, -50000000000),
    "pl_tiny": changed(PL, 4, 2, -1), "pl_reversed": (PL[0], [["", 2023, 2024], *PL[1][1:]]), "pl_prose": (PL[0], [*PL[1][:4], ["We have audited the statements of the group and believe that they are fair"], ["", 12345, 4567], *PL[1][4:]]),
}


@pytest.fixture(scope="module")
def read(spark):
    cells = [(k, f"{k}.pdf", 1, i, t, r, c, f"({-v:,})" if isinstance(v, int) and v < 0 else str(v)) for i, (k, (t, rows)) in enumerate(TABLES.items()) for r, row in enumerate(rows) for c, v in enumerate(row)]
    df = keep(foot(read_tables(assemble(spark.createDataFrame(cells, CELLS).repartition(3)))))
    out = with_health(df).withColumn("backwards", reversed_years())
    return {r.table_id: r for r in out.collect()}


def oks(r):
    return [x.ok for x in r.foot_by_col]


def test_income_statement(read):
    assert (read["pl"].kind, read["pl"].years, read["pl"].foots, oks(read["pl"]), read["pl"].health) == ("income statement", [2024, 2023], True, [True, True], 1.0)
    assert (oks(read["pl_wrong"]), read["pl_wrong"].foots) == ([False, True], True)
    assert read["pl_reversed"].backwards and not read["pl"].backwards


def test_other_statements(read):
    assert (read["bs"].kind, read["bs"].foots, oks(read["bs"])) == ("statement of financial position", True, [True, True])
    assert (read["equity"].kind, read["equity"].foots) == ("statement of changes in equity", True)
    assert (read["cash"].foots, read["cash_big"].foots) == (False, True)


def test_demotion(read):
    assert read["ratio"].kind == read["bridge"].kind == "table" and read["bridge"].foots is None


def test_health(read):
    assert read["pl_huge"].health_figures.score < 1 and "one year" in read["pl_tiny"].health_figures.suspect[0].why
    assert [x.why for x in read["pl_prose"].health_labels.suspect] == ["reads as a prose sentence", "figures with no label"]


def test_wrapped_labels(spark):
    cells = [("t", "f", 1, 1, "", r, c, v) for r, row in enumerate([["Gain on disposal of"], ["property held"], ["for sale", "1,000"], ["Next line", "5"], ["", "7"]]) for c, v in enumerate(row)]
    rows = assemble(spark.createDataFrame(cells, CELLS)).select(F.transform(merge_wrapped(F.col("rows")), lambda r: F.struct(r["label"], F.get(r["cells"], F.lit(1))["num"].alias("v"))).alias("x")).first().x
    assert [(r.label, r.v) for r in rows] == [("Gain on disposal of property held for sale", 1000.0), ("Next line", 5.0), ("", 7.0)]


def test_empty(spark):
    assert foot(read_tables(assemble(spark.createDataFrame([], CELLS)))).count() == 0


def _large_reports(spark, folder):
    """Orders of five nations and three years whose figures are in the tens of billions."""
    spark.createDataFrame([(n, n) for n in range(5)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    orders = [(n, datetime.datetime(y, 6, 1), 2e10 + 1e9 * n + 1e8 * (y - 1995)) for n in range(5) for y in (1995, 1996, 1997)]
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_errors_of_large_cash_flows_show(spark, tmp_path):
    got = {(r.table_id, r.year): r.ok for r in queries.foot_cashflow(spark, _large_reports(spark, tmp_path)).collect()}
    assert got == {(f"{n}-{y}", str(x)): x < y or (n * 7 + y) % 5 != 0 for n in range(5) for y in (1996, 1997) for x in (y, y - 1)}


def test_restated_lines_of_large_reports_show(spark, tmp_path):
    got = {(r.table_id, r.mismatch, r.verdict) for r in queries.cross_year_verdict(spark, _large_reports(spark, tmp_path)).collect()}
    assert got == {(f"{n}-{y}", int(n % 3 == 0), "agree" if n % 3 else "restated") for n in range(5) for y in (1996, 1997)}
