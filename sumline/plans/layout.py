"""Queries of the page, header and column operators over the driver's tables, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.numbers import coerce_cell
from ..operators import headers, link, pages
from .queries import query, read


def _cell(text=None, number=None) -> Column:
    text = F.lit(None) if text is None else text
    number = F.lit(None) if number is None else number
    return F.struct(text.cast("string").alias("txt"), number.cast("double").alias("num"))


@query("""
with w as (select c_custkey, o_orderkey % 200 as wx, o_orderkey % 331 as wy, c_nationkey from orders join customer on o_custkey = c_custkey),
b as (select s_nationkey, s_suppkey, s_suppkey % 150 as x0, s_suppkey % 300 as y0 from supplier)
select s_suppkey as box_id, exists (select 1 from w where c_nationkey = s_nationkey and wx between x0 and x0 + 20 and wy between y0 and y0 + 9) as has_text from b
""")
def boxes_with_text(spark, sf_dir):
    """Which of the boxes drawn on a page hold a word."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    words = orders.select(F.col("c_nationkey").alias("page"), (F.col("o_orderkey") % 200).alias("wx"), (F.col("o_orderkey") % 331).alias("wy"))
    k = F.col("s_suppkey")
    boxes = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), k.alias("box_id"), (k % 150).alias("x0"), (k % 300).alias("y0"), (k % 150 + 20).alias("x1"), (k % 300 + 9).alias("y1"))
    return pages.box_has_text(boxes, words, ["page"]).select("box_id", "has_text")


@query("""
select o_orderkey, case when o_orderkey % 4 = 0 or o_orderkey % 50 = o_orderkey % 46 then cast(o_orderkey % 50 as varchar) else (o_orderkey % 46) || ' (PDF page ' || (o_orderkey % 50) || ')' end as shown from orders
""")
def displayed_pages(spark, sf_dir):
    k = F.col("o_orderkey")
    label = F.when(k % 4 != 0, (k % 46).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", pages.display_page(label, k % 50).alias("shown"))


@query("""
with p as (select user_id, row_number() over (partition by user_id order by event_id) as page, count(*) over (partition by user_id) as n from events),
h as (select *, case when user_id % 3 = 0 then page else abs(page - greatest(1, least(n, user_id % 7 + 1))) end as away from p)
select user_id, page, row_number() over (partition by user_id order by away, page) - 1 as place from h
""")
def page_order(spark, sf_dir):
    """Pages of a file from the hinted one outwards."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = read(spark, sf_dir, "events").select("user_id", nth.alias("page"))
    hint = F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 7 + 1)
    return pages.scan_order(rows, ["user_id"], "page", hint).select("user_id", "page", F.col("place").cast("long").alias("place"))


@query("""
with t as (select p_partkey as k, 30 + p_partkey % 600 as w, p_partkey % 97 as h, 1 + p_partkey % 5 as n, p_partkey % 13 as words, p_partkey % 6 as filled, len(string_split(p_name, ' ')) as per from part)
select k as p_partkey, w < 45 or h < 8 or (w >= 540 and h >= 81) or filled * n < 0.15 * 6 * n or (n <= 3 and words > 0 and filled * n * per < 0.6 * words) as junk from t
""")
def junk_tables(spark, sf_dir):
    """Found tables that are none; rows of six cells of which some are filled with a part's name."""
    k = F.col("p_partkey")
    cells = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i < k % 6, F.col("p_name")))
    grid = F.transform(F.sequence(F.lit(1), (1 + k % 5).cast("int")), lambda i: cells)
    part = read(spark, sf_dir, "part").withColumn("grid", grid)
    return part.select("p_partkey", pages.is_junk(F.col("grid"), 30 + k % 600, k % 97, F.lit(600), F.lit(90), k % 13).alias("junk"))


@query("""
with w as (select p_partkey as page, unnest(string_split(p_name, ' ')) as t, unnest(range(len(string_split(p_name, ' ')))) as i from part)
select page, cast(r as bigint) as row_idx, (select string_agg(t, ' ' order by i desc) from w where w.page = p.page) as label from (select p_partkey as page, unnest(case when p_partkey % 2 = 0 then [0, 2] else [0] end) as r from part) p
""")
def labels_left(spark, sf_dir):
    """Labels taken from the words left of a table's rows; a name's words stand in turn on lines above one another, and so are read from the last."""
    word = F.posexplode(F.split("p_name", " ")).alias("i", "text")
    k, part = F.col("p_partkey"), read(spark, sf_dir, "part")
    words = part.select(k.alias("page"), word).select("page", "text", (10.0 + 30 * F.col("i")).alias("x0"), F.explode(F.array(F.lit(0), F.lit(2))).alias("r"), "i")
    words = words.select("page", "text", "x0", (100.0 + 40 * F.col("r") - 9 * F.col("i")).alias("top"))
    far = words.withColumn("x0", F.col("x0") + 500).withColumn("text", F.lit("figure"))
    rows = part.select(k.alias("page"), F.explode(F.expr("if(p_partkey % 2 = 0, array(0L, 2L), array(0L))")).alias("row_idx"))
    top = 100.0 + 40 * F.col("row_idx")
    rows = rows.select("page", "row_idx", (top - 40).alias("top"), (top + 2).alias("bot"), F.lit(12.0).alias("search_x0"), F.lit(400.0).alias("region_x0"))
    return pages.left_labels(rows, words.unionByName(far), ["page"]).select("page", "row_idx", "label")


@query("""
with c as (select l_orderkey as t, l_linenumber as o, cast(l_linenumber % 3 as integer) as r, cast(l_partkey % 4 as integer) as c, l_returnflag as x from lineitem),
p as (select t, o, unnest([r, r + 1]) as row_idx, c, x from c), q as (select t, o, row_idx, unnest([c, c + 2]) as col_idx, x from p)
select t as l_orderkey, row_idx, col_idx, max(o) as ord from q group by 1, 2, 3
""")
def spanning_cells(spark, sf_dir):
    """Cells that span rows and columns at every place they cover, the last one on top."""
    line, c = F.col("l_linenumber"), (F.col("l_partkey") % 4).cast("int")
    r = (line % 3).cast("int")
    cells = read(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("ord"), F.array(r, r + 1).alias("row_nums"), F.array(c, c + 2).alias("column_nums"), line.cast("string").alias("text"))
    out = pages.spanned(cells, ["l_orderkey"])
    return out.select("l_orderkey", "row_idx", "col_idx", F.col("text").cast("bigint").alias("ord"))


@query("""
select o_orderkey, o_orderkey % 5 in (0, 3) as title, o_orderkey % 5 = 1 or (o_orderkey % 5 = 3 and o_orderkey between 1900 and 2099) as header from orders
""")
def header_rows(spark, sf_dir):
    """Title rows, column headers, data rows and running text told apart."""
    k = F.col("o_orderkey")
    year, value = F.year("o_orderdate"), F.col("o_totalprice") + 1000
    rows = [
        (_cell(F.concat(F.lit("Segment "), F.col("o_orderpriority"))), _cell(), _cell()),
        (_cell(F.lit("Notes")), _cell(number=year), _cell(F.lit("AED'000"))),
        (_cell(F.lit("Notes payable")), _cell(number=value), _cell(number=value + 1)),
        (_cell(F.lit("")), _cell(F.concat(F.lit("Operating income "), k)), _cell()),
        (_cell(F.concat(F.lit("for the year ended "), year)), _cell(), _cell(F.lit("restated"))),
    ]
    row = F.coalesce(*[F.when(k % 5 == i, F.array(*r)) for i, r in enumerate(rows)])
    orders = read(spark, sf_dir, "orders").withColumn("row", row)
    return orders.select("o_orderkey", headers.is_title_row(F.col("row")).alias("title"), headers.looks_like_header(F.col("row")).alias("header"))


@query("""
select o_orderkey, case when o_orderkey % 2 = 0 then '|' || year(o_orderdate) || '|Notes/|AED''000|/x|1|2' else '|' || year(o_orderdate) || '|Notes/x|1|2' end as grid from orders
""")
def year_and_unit_rows(spark, sf_dir):
    """A year and a unit printed above one another and read as one cell, parted again."""
    year = F.year("o_orderdate").cast("string")
    head = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("("), year, F.lit(") AED'000"))).otherwise(year)
    grid = F.array(F.array(F.lit(""), head, F.lit("Notes")), F.array(F.lit("x"), F.lit("1"), F.lit("2")))
    out = headers.split_year_unit(grid)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(out, lambda r: F.array_join(r, "|", "")), "/").alias("grid"))


@query("""
select s_suppkey, case when min(s_suppkey % 3) over (partition by s_nationkey) = 0 then case when s_suppkey % 3 = 0 then 1 else 2 end else 1 end as value_at from supplier
""")
def shifted_notes(spark, sf_dir):
    """Rows that skip the column of note references, moved so that their figures stand under the others'. value_at: where the first figure of a row is."""
    k = F.col("s_suppkey")
    with_ref = F.array(_cell(F.col("s_name")), _cell(F.lit("7, 12")), _cell(F.lit("-")), _cell(number=F.lit(5)))
    without = F.array(_cell(F.col("s_name")), _cell(number=F.col("s_acctbal")), _cell(number=F.lit(3)), _cell())
    row = F.struct(k, F.when(k % 3 == 0, with_ref).otherwise(without).alias("r"))
    grids = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(row), lambda a, b: (a["s_suppkey"] - b["s_suppkey"]).cast("int")).alias("x"))
    moved = headers.shift_missing_notes(F.transform("x", lambda x: x["r"]), numbers_refer=False)  # references are texts here
    rows = grids.select(F.explode(F.arrays_zip(F.transform("x", lambda x: x["s_suppkey"]).alias("k"), moved.alias("r"))).alias("z"))
    first = F.array_position(F.transform("z.r", lambda c: (c["num"].isNotNull() | (c["txt"] == "7, 12")).cast("int")), 1) - 1
    return rows.select(F.col("z.k").alias("s_suppkey"), first.cast("int").alias("value_at"))


@query("""
select l_orderkey, count(*) as n, count(*) filter (where l_linenumber % 2 = 0) >= 0.35 * count(*) as financial from lineitem group by l_orderkey
""")
def financial_tables(spark, sf_dir):
    """Tables of which a third and more of the cells are figures."""
    cell = _cell(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_returnflag")), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")))
    tables = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(cell).alias("cells"))
    return tables.select("l_orderkey", F.size("cells").cast("long").alias("n"), headers.is_financial(F.col("cells")).alias("financial"))


@query("""
select o_orderkey, case o_orderkey % 4 when 0 then 'AED||false' when 1 then '|%|false' when 2 then '||true' end as dressing from orders
""")
def cell_dressing(spark, sf_dir):
    """What a figure was printed with: currency, percent sign, parentheses."""
    n = F.format_number(F.floor("o_totalprice"), 0)
    way = lambda i: F.col("o_orderkey") % 4 == i
    raw = F.when(way(0), F.concat(F.lit("AED "), n)).when(way(1), F.concat(n, F.lit("%"))).when(way(2), F.concat(F.lit("("), n, F.lit(")"))).otherwise(n)
    d = headers.dressing(F.col("c"))
    return read(spark, sf_dir, "orders").withColumn("c", coerce_cell(raw)).select("o_orderkey", F.when(d.isNotNull(), F.concat_ws("|", d["p"], d["s"], d["n"].cast("string"))).alias("dressing"))


@query("""
select o_orderkey, case when o_orderkey % 5 in (0, 3) then -floor(o_totalprice) when o_orderkey % 5 = 4 then null else floor(o_totalprice) end as num, case when o_orderkey % 5 = 4 then o_orderpriority end as txt from orders
""")
def plain_cells(spark, sf_dir):
    """Cells by the plain reading: figures only where nothing else is left."""
    n = F.format_number(F.floor("o_totalprice"), 0)
    way = lambda i: F.col("o_orderkey") % 5 == i
    raw = F.when(way(0), F.concat(F.lit("("), n, F.lit(")"))).when(way(1), F.concat(F.lit("$ "), n)).when(way(2), F.concat(n, F.lit(" %"))).when(way(3), F.concat(F.lit(")"), n, F.lit("("))).otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").withColumn("c", headers.clean_cell(raw)).select("o_orderkey", F.col("c.num").alias("num"), F.col("c.txt").alias("txt"))


@query("""
select s_suppkey, s_name || '|' || (s_suppkey + 2) || '|' || (s_suppkey + 1) as swapped, (s_suppkey + 2) || '|' || s_name as chosen, s_name || '|Current|' || (s_suppkey + 2) as renamed from supplier
""")
def arranged_columns(spark, sf_dir):
    """Two years swapped, columns chosen and moved, a header renamed."""
    k = F.col("s_suppkey")
    rows = F.array(F.array(F.col("s_name"), (k + 1).cast("string"), (k + 2).cast("string")))
    first = lambda x: F.array_join(F.get(x, F.lit(0)), "|")
    return read(spark, sf_dir, "supplier").select("s_suppkey", first(headers.swap_columns(rows, 1, 2)).alias("swapped"), first(headers.select_columns(rows, [2, 0])).alias("chosen"), first(headers.rename_column(rows, 0, 1, "Current")).alias("renamed"))


@query("""
select s_suppkey as pair, case when s_suppkey % 2 = 0 then 'federal royalty' else 'staff costs' end as a_key, case when s_suppkey % 2 = 0 then 'federal royalty on regulated profit' end as b_key from supplier
union all select s_suppkey, null, case when s_suppkey % 2 = 0 then 'zakat' else 'finance income' end from supplier
""")
def repaired_keys(spark, sf_dir):
    """Lines whose wording drifted between two reports, paired again before the reports are compared."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier")
    even = k % 2 == 0
    a = s.select(k.alias("pair"), F.when(even, "federal royalty").otherwise("staff costs").alias("key"), F.lit(1).alias("at"))
    b = s.select(k.alias("pair"), F.when(even, "federal royalty on regulated profit").otherwise("finance income").alias("key"), F.lit(1).alias("at"))
    b = b.unionByName(s.filter(even).select(k.alias("pair"), F.lit("zakat").alias("key"), F.lit(2).alias("at")))
    return link.paired_keys(a, b, ["pair"]).select("pair", "a_key", "b_key")
