"""Page, header and column operators on small cases, also empty ones."""

from pyspark.sql import functions as F

from sumline.operators import headers, link, pages
from sumline.plans import layout

ROW = "array<struct<txt:string,num:double>>"


def one(spark, f, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


def test_title_and_header_rows(spark):
    title = lambda *r: one(spark, headers.is_title_row, list(r), ROW)
    assert title(("Current assets", None), (None, None)) and not title(("Current assets.", None)) and not title((None, 3.0)) and not title()
    assert not title(("one two three four five six seven eight nine ten eleven", None))
    header = lambda *r: one(spark, headers.looks_like_header, list(r), ROW)
    assert header(("", None), (None, 2019.0)) and header(("Notes", None)) and header(("AED", None), ("USD", None))
    assert not header(("Notes", None), (None, 1000.0), (None, -2000.0)) and not header(("Income", None)) and not header() and not header(("year 2019", None))


def test_split_year_unit(spark):
    split = lambda g: one(spark, headers.split_year_unit, g, "array<array<string>>")
    assert split([["", "2018 AED'000", None], ["a", "1", "2"]]) == [["", "2018", None], [None, "AED'000", None], ["a", "1", "2"]]
    assert split([["", "2018"], ["2018 AED'000", "1"]]) == [["", "2018"], ["2018 AED'000", "1"]] and split([]) == []


def test_shift_missing_notes(spark):
    shift = lambda rows: one(spark, headers.shift_missing_notes, rows, f"array<{ROW}>")
    ref, bare = [("a", None), ("4", None), (None, 10.0), (None, 9.0)], [("b", None), (None, 700.0), ("-", None), (None, None)]
    assert [tuple(c) for c in shift([ref, bare])[1]] == [("b", None), (None, None), (None, 700.0), ("-", None)]
    assert [tuple(c) for c in shift([bare])[0]] == bare and shift([]) == []


def test_small_figures_are_no_references(spark, tmp_path):
    suppliers = [(0, "a", 1, 10.5), (1, "b", 1, 45.0), (2, "c", 1, 0.0), (4, "d", 1, 99.0), (5, "e", 1, 100.0), (1, "f", 2, 7.0), (2, "g", 2, 700.0)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(tuple(r) for r in layout.shifted_notes(spark, str(tmp_path)).collect())
    assert got == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2), (4, 2), (5, 2)]
    # Cells typed by their look: a small whole number is a reference and stays.
    ref, small = [("a", None), (None, 4.0), (None, 10.0)], [("b", None), (None, 45.0), (None, 3.0), (None, None)]
    assert [tuple(c) for c in one(spark, headers.shift_missing_notes, [ref, small], f"array<{ROW}>")[1]] == small


def test_clean_cell(spark):
    cases = [("(1,234)", None, -1234.0), (")1,234(", None, -1234.0), ("$ 5", None, 5.0), ("5 %", None, 5.0), ("1 2", "1 2", None), (" \n", None, None), (None, None, None), ("a\nb", "a b", None), ("-", "-", None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    for r in df.select("i", headers.clean_cell(F.col("v")).alias("c")).collect():
        assert (r.c.txt, r.c.num) == cases[r.i][1:], cases[r.i]


def test_scan_order(spark):
    df = spark.createDataFrame([("f", p, h) for h in (None, 3, 99) for p in range(1, 6)], "f string, p int, h int").withColumn("f", F.concat("f", F.coalesce(F.col("h").cast("string"), F.lit(""))))
    got = {}
    for r in pages.scan_order(df, ["f"], "p", F.col("h")).orderBy("f", "place").collect():
        got.setdefault(r.f, []).append(r.p)
    assert got == {"f": [1, 2, 3, 4, 5], "f3": [3, 2, 4, 1, 5], "f99": [5, 4, 3, 2, 1]}


def test_left_labels_read_line_by_line(spark):
    words = [(1, "book", 30.0, 10.0), (1, "Net", 10.0, 10.2), (1, "value", 50.0, 9.8), (1, "At", 10.0, 20.0), (1, "year", 30.0, 20.1), (1, "5", 300.0, 10.0), (2, "x", 10.0, 10.0)]
    rows = [(1, 0, 8.0, 22.0, 5.0, 200.0), (1, 1, 50.0, 60.0, 5.0, 200.0)]
    got = pages.left_labels(spark.createDataFrame(rows, "p int, row_idx int, top double, bot double, search_x0 double, region_x0 double"), spark.createDataFrame(words, "p int, text string, x0 double, top double"), ["p"])
    assert {r.row_idx: r.label for r in got.collect()} == {0: "Net book value At year", 1: None}


def test_sample_is_repeatable(spark):
    a, b = ([r.id for r in pages.sample_tables(spark.range(100).repartition(n), "id", 7, 3).collect()] for n in (1, 5))
    assert a == b and len(set(a)) == 7 and a != [r.id for r in pages.sample_tables(spark.range(100), "id", 7, 4).collect()]


def test_paired_keys_greedy(spark):
    a = spark.createDataFrame([(1, "trade receivables", 1), (1, "trade receivable", 2), (1, "cash", 3), (1, "loans", 4)], "p int, key string, at int")
    b = spark.createDataFrame([(1, "trade receivables net", 1), (1, "cash", 2), (1, "zakat", 3)], "p int, key string, at int")
    got = {(r.a_key, r.b_key) for r in link.paired_keys(a, b, ["p"]).collect()}
    assert got == {("trade receivables", "trade receivables net"), ("trade receivable", None), ("cash", "cash"), ("loans", None), (None, "zakat")}
    assert link.paired_keys(a.filter("false"), b.filter("false"), ["p"]).count() == 0
    renamed = link.with_paired_keys(a, b, ["p"])
    assert {r.key for r in renamed.collect()} == {"trade receivables", "cash", "zakat"}


def test_stitched(spark):
    row = "struct<label:string>"
    kind = f"table_id string, file string, page int, table_ord int, kind string, header_idx int, data array<{row}>, rows array<{row}>"
    lines = lambda *names: [(n,) for n in names]
    top, rest = lines("Property and equipment", "Inventories"), lines("Trade payables", "Share capital", "Total equity and liabilities")
    bs = "statement of financial position"
    tables = [("a", "f", 1, 0, bs, 0, top, top), ("b", "f", 2, 1, "table", 0, rest, rest), ("c", "g", 1, 0, bs, 0, rest, rest)]
    df = spark.createDataFrame(tables, kind)
    got = {r.table_id: r for r in link.stitched(df, lambda t: t.withColumn("data", F.col("rows"))).collect()}
    assert set(got) == {"a", "c"} and [x.label for x in got["a"].rows] == [x[0] for x in top + rest] and got["a"].stitched_from == 2
    back = {r.table_id: r for r in link.stitched(df, lambda t: t.withColumn("kind", F.lit("table"))).collect()}
    assert set(back) == {"a", "b", "c"} and [x.label for x in back["a"].rows] == [x[0] for x in top]
