"""Financial reports made from the driver's tables: statements with known verdicts, printed as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def printed(v: Column) -> Column:
    """A whole number as reports print it: thousands separators, parentheses for negatives."""
    return F.when(v < 0, F.concat(F.lit("("), F.format_number(-v, 0), F.lit(")"))).otherwise(F.format_number(v, 0))


def nation_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, year, revenue): whole revenue of each nation's customers by order year."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    customers = read("customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy("nation", "year").agg((F.floor(F.sum("price")) + 1_000_000).cast("long").alias("revenue"))


def income_lines(revenue: Column, error: Column) -> list[tuple[str, Column]]:
    """Lines of an income statement; error goes into the cost of sales alone."""
    cost, admin = -F.floor(revenue * 0.6).cast("long"), -F.floor(revenue * 0.15).cast("long")
    finance, tax = -F.floor(revenue / 50).cast("long"), -F.floor(revenue / 70).cast("long")
    gross = revenue + cost
    return [
        ("Revenue", revenue), ("Cost of sales", cost + error), ("Gross profit", gross), ("General and administrative costs", admin), ("Finance costs", finance),
        ("Profit before tax", gross + admin + finance), ("Income tax", tax), ("Profit for the year", gross + admin + finance + tax),
    ]


def balance_lines(revenue: Column, error: Column) -> list[tuple[str, Column]]:
    fixed, stock, owed = F.floor(revenue * 0.7).cast("long"), F.floor(revenue * 0.2).cast("long"), F.floor(revenue * 0.4).cast("long")
    total = fixed + stock
    return [
        ("Property, plant and equipment", fixed), ("Total non-current assets", fixed), ("Inventories", stock), ("Total current assets", stock), ("Total assets", total + error),
        ("Share capital", total - owed - 1000), ("Retained earnings", F.lit(1000).cast("long")), ("Total equity", total - owed), ("Total liabilities", owed),
    ]


def cash_lines(revenue: Column, error: Column) -> list[tuple[str, Column]]:
    op, inv, fin = F.floor(revenue * 0.3).cast("long"), -F.floor(revenue * 0.1).cast("long"), -F.floor(revenue * 0.05).cast("long")
    return [
        ("Profit for the period", op), ("Net cash generated from operating activities", op), ("Purchase of equipment", inv), ("Net cash used in investing activities", inv),
        ("Dividends paid", fin), ("Net cash used in financing activities", fin), ("Net increase in cash and cash equivalents", op + inv + fin + error),
    ]


def equity_lines(revenue: Column, error: Column) -> list[tuple[str, Column]]:
    opening, profit, other, paid = F.floor(revenue * 0.5).cast("long"), F.floor(revenue * 0.1).cast("long"), F.lit(5000).cast("long"), -F.floor(revenue * 0.04).cast("long")
    return [
        ("Balance at 1 January", opening), ("Profit for the year", profit), ("Other comprehensive income", other), ("Total comprehensive income", profit + other),
        ("Cash dividends paid", paid), ("Balance at 31 December", opening + profit + other + paid + error),
    ]


TITLES = {
    "income": ("Consolidated statement of profit or loss", income_lines), "balance": ("Consolidated statement of financial position", balance_lines),
    "cash": ("Consolidated statement of cash flows", cash_lines), "equity": ("Consolidated statement of changes in equity", equity_lines),
}
#: A report is wrong by this much, at least, in its current year where (nation * 7 + year) is divisible by 5.
ERROR, EVERY = 777_777, 5
#: A restated line differs by this much, at least.
RESTATED = 12_345


def planted(least: int, of: Column) -> Column:
    """What a figure is wrong by: a thousandth of a large amount, as the tolerances of cash flows and of years compared grow with it."""
    return F.greatest(F.lit(least), F.floor(F.abs(of) / 1000)).cast("long")


def report_cells(spark: SparkSession, sf_dir: str, what: str, restate: bool = False) -> DataFrame:
    """Cells of one statement for each nation and year with the year before beside it. restate: prior columns of every
    third nation differ from what was first reported in one line. What is planted shows at any size of the figures."""
    title, lines = TITLES[what]
    base = nation_years(spark, sf_dir)
    prior = base.select("nation", (F.col("year") + 1).alias("year"), F.col("revenue").alias("before"))
    both = base.join(prior, ["nation", "year"])
    wrong = F.when((F.col("nation") * 7 + F.col("year")) % EVERY == 0, planted(ERROR, F.col("revenue"))).otherwise(0).cast("long")
    now, old = lines(F.col("revenue"), F.lit(0).cast("long") if restate else wrong), lines(F.col("before"), F.lit(0).cast("long"))
    cell = lambda r, c, x: F.struct(F.lit(r).alias("row_idx"), F.lit(c).alias("col_idx"), x.alias("raw"))
    cells = [cell(0, 0, F.lit("")), cell(0, 1, F.col("year").cast("string")), cell(0, 2, (F.col("year") - 1).cast("string"))]
    for i, ((label, v), (_, w)) in enumerate(zip(now, old), 1):
        if restate and i == 5:
            w = w + F.when(F.col("nation") % 3 == 0, planted(RESTATED, w)).otherwise(0)
        cells += [cell(i, 0, F.lit(label)), cell(i, 1, printed(v)), cell(i, 2, printed(w))]
    report = F.concat_ws("-", F.col("nation").cast("string"), F.col("year").cast("string"))
    return both.select(report.alias("table_id"), F.concat(F.lit("report "), report, F.lit(".pdf")).alias("file"), F.lit(1).alias("page"), (F.col("nation") * 10_000 + F.col("year")).cast("int").alias("table_ord"), F.lit(title).alias("title"), F.explode(F.array(*cells)).alias("x")).select("table_id", "file", "page", "table_ord", "title", "x.*")
