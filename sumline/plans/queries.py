"""One query per operator over the driver's tables, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import coerce_cell, formatted, keep, normspace, parse_number
from ..functions.text import doc_years, norm_label, selection, years_in
from ..operators import edits, geometry, health, link, score, search, statements
from ..operators.footing import foot
from . import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- figures -----------------------------------------------------------------------------------

CENTS = "cast(round(l_extendedprice * 100) as bigint)"


def _printed_lines(spark, sf_dir):
    """Line items with their price printed in ten ways."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CENTS).alias("cents"), F.expr("pmod(l_orderkey * 3 + l_linenumber, 10)").alias("way"))
    us = F.format_number((F.col("cents") / 100).cast("decimal(18,2)"), 2)
    way = lambda i: F.col("way") == i
    text = (
        F.when(way(0), us).when(way(1), F.concat(F.lit("("), us, F.lit(")"))).when(way(2), F.concat(F.lit("-"), us)).when(way(3), F.concat(us, F.lit("-"))).when(way(4), F.concat(F.lit("AED "), us))
        .when(way(5), F.translate(us, ",.", ".,")).when(way(6), F.concat(us, F.lit(" CR"))).when(way(7), F.concat(us, F.lit("%"))).when(way(8), F.concat(F.lit("$ "), us, F.lit(" $"))).otherwise(F.concat(F.lit(")"), us, F.lit("(")))
    )
    return lines.withColumn("raw", text)


@query(f"""
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, case when (l_orderkey * 3 + l_linenumber) % 10 in (1, 2, 3, 6, 9) then -{CENTS} else {CENTS} end as cents from lineitem
""")
def parse_number_roundtrip(spark, sf_dir):
    return _printed_lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(parse_number(F.col("raw"))["num"] * 100).cast("long").alias("cents"))


@query("""
select way, count(*) as n, cast(0 as bigint) as parsed from (select o_orderkey % 6 as way from orders) group by way
""")
def parse_number_rejects(spark, sf_dir):
    """Texts that are no figure, whatever the key they are made from."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("way"))
    key = F.lpad(F.col("o_orderkey").cast("string"), 9, "1")
    raw = F.when(F.col("way") == 0, F.concat(key, F.lit("00000000"))).when(F.col("way") == 1, F.concat(F.lit("2020 2019 "), F.substr(key, F.lit(1), F.lit(4)))).when(F.col("way") == 2, F.lit("nil")).when(F.col("way") == 3, F.lit("—")).when(F.col("way") == 4, F.concat(F.lit("see note "), key)).otherwise(F.lit("AED '000"))
    return o.withColumn("v", parse_number(raw)["num"]).groupBy("way").agg(F.count("*").alias("n"), F.count("v").alias("parsed"))


@query("""
select (l_orderkey * 3 + l_linenumber) % 10 as way, count(*) as n, count(*) filter (where (l_orderkey * 3 + l_linenumber) % 10 <> 5 or round(l_extendedprice * 100) >= 100000) as same from lineitem group by 1
""")
def coerce_vs_parse(spark, sf_dir):
    """The cleaner's fast path and the full parser agree on every way of printing but one: the fast path reads the lone decimal comma of 999,12 as a separator."""
    lines = _printed_lines(spark, sf_dir).select("way", coerce_cell(F.col("raw")).alias("c"), parse_number(F.col("raw"))["num"].alias("p"))
    return lines.groupBy("way").agg(F.count("*").alias("n"), F.count(F.when(F.col("c.num") == F.col("p"), 1)).alias("same"))


@query("""
select o_orderkey, case when o_orderkey % 3 = 0 then format('({:,})', cast(floor(o_totalprice) as bigint)) when o_orderkey % 3 = 1 then format('AED {:,}', cast(floor(o_totalprice) as bigint)) else format('{:,}%', cast(floor(o_totalprice) as bigint)) end as shown from orders
""")
def formatted_text(spark, sf_dir):
    """Figures parsed and printed again as they stood."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("v"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), "v", F.lit(")"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("AED "), "v")).otherwise(F.concat("v", F.lit("%")))
    o = o.withColumn("c", parse_number(raw))
    return o.select("o_orderkey", formatted(F.col("c.num"), F.col("c.prefix"), F.col("c.suffix"), F.col("c.paren_neg")).alias("shown"))


# --- text --------------------------------------------------------------------------------------


@query(r"""
select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) as label, trim(regexp_replace(p_name, '\s+', ' ', 'g')) as spaced from part
""")
def norm_labels(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    noisy = F.concat(F.upper("p_name"), F.lit(" (Note 1, 2.3)"))
    return p.select("p_partkey", norm_label(noisy).alias("label"), normspace(F.replace(F.col("p_name"), F.lit(" "), F.lit("  \n "))).alias("spaced"))


@query("""
select o_orderkey, cast(year(o_orderdate) as integer) as first_year, cast(case when year(o_orderdate) = 1996 then 1 else 2 end as integer) as n_years from orders
""")
def label_years(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    years = years_in(F.concat_ws(" ", F.lit("as at"), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("and 1996, 1850, 20150"), F.year("o_orderdate")))
    return o.select("o_orderkey", F.get(years, F.lit(0)).alias("first_year"), F.size(years).alias("n_years"))


@query("select o_orderkey, cast(year(o_orderdate) as integer) as this_year, cast(year(o_orderdate) - 1 as integer) as last_year from orders")
def file_years(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    y = doc_years(F.concat(F.lit("annual 1995 report "), F.year("o_orderdate").cast("string"), F.lit(".pdf")))
    return o.select("o_orderkey", F.get(y, F.lit(0)).alias("this_year"), F.get(y, F.lit(1)).alias("last_year"))


@query("select p_partkey from part where p_partkey in (1, 3, 5, 6, 7, 8)")
def page_selection(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey").filter(F.col("p_partkey").isin(selection("8,1, 3,5-7,0,x", 10_000)))


# --- statements --------------------------------------------------------------------------------

_BASE = """
with rev as (select c_nationkey as nation, year(o_orderdate) as year, cast(floor(sum(cast(o_totalprice as decimal(18,2)))) as bigint) + 1000000 as revenue
  from orders join customer on o_custkey = c_custkey group by 1, 2),
rep as (select a.nation, a.year, a.revenue, b.revenue as before, (a.nation * 7 + a.year) % 5 = 0 as wrong from rev a join rev b on a.nation = b.nation and b.year = a.year - 1)
"""


def _read(spark, sf_dir, what, **options):
    return statements.read_tables(statements.assemble(reports.report_cells(spark, sf_dir, what, **options)))


def _foot_sql(kind: str) -> str:
    return _BASE + f"select nation || '-' || year as table_id, '{kind}' as kind, cast(y as varchar) as year, y < rep.year or not wrong as ok from rep, lateral (select unnest([rep.year, rep.year - 1]) as y)"


def _verdicts(tables):
    return foot(tables).select("table_id", "kind", F.explode_outer("foot_by_col").alias("f")).select("table_id", "kind", "f.year", "f.ok")


@query(_foot_sql("income statement"))
def foot_income(spark, sf_dir):
    return _verdicts(_read(spark, sf_dir, "income"))


@query(_foot_sql("statement of financial position").replace("y < rep.year or not wrong", "y < rep.year or not wrong"))
def foot_balance(spark, sf_dir):
    return _verdicts(_read(spark, sf_dir, "balance"))


@query(_foot_sql("statement of cash flows"))
def foot_cashflow(spark, sf_dir):
    return _verdicts(_read(spark, sf_dir, "cash"))


@query(_foot_sql("statement of changes in equity"))
def foot_equity(spark, sf_dir):
    return _verdicts(_read(spark, sf_dir, "equity"))


@query(_BASE + "select nation || '-' || year as table_id, 'Finance costs' as break_label, cast(floor(revenue / 50) as bigint) as gap from rep")
def foot_explain(spark, sf_dir):
    """A doubled line is named as the one that breaks the sum."""
    cells = reports.report_cells(spark, sf_dir, "income", restate=True)
    twice = cells.withColumn("row_idx", F.explode(F.when(F.col("row_idx") == 5, F.array(F.lit(10), F.lit(11))).otherwise(F.array(F.col("row_idx") * 2))))
    tables = foot(statements.read_tables(statements.assemble(twice)))
    one = F.get("foot_by_col", F.lit(0))
    gap = F.regexp_extract(one["worked"], r"difference = ([-0-9,]+)", 1)
    return tables.select("table_id", one["break_label"].alias("break_label"), F.abs(F.replace(gap, F.lit(","), F.lit("")).cast("long")).alias("gap"))


@query(_BASE + """
select kind, count(*) as tables, cast(sum(n) as bigint) as value_cols, min(d) as data_start, max(t) as total_rows from rep,
  (values ('income statement', 2, 1, 3), ('statement of financial position', 2, 1, 5), ('statement of cash flows', 2, 1, 5), ('statement of changes in equity', 2, 1, 2)) as k(kind, n, d, t) group by kind
""")
def read_kinds(spark, sf_dir):
    """What is read from all four statements: kind, value columns, first row of data, total rows."""
    out = None
    for what in reports.TITLES:
        one = _read(spark, sf_dir, what).select("kind", F.size("value_cols").alias("v"), "data_start", F.size("total_rows").alias("t"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind").agg(F.count("*").alias("tables"), F.sum("v").alias("value_cols"), F.min("data_start").alias("data_start"), F.max("t").alias("total_rows"))


@query("""
select n_nationkey as nation, [1, 3] as value_cols, 2 as note_col from nation
""")
def value_columns(spark, sf_dir):
    """A column of small numbers on some rows holds note references, not figures."""
    n = read(spark, sf_dir, "nation")
    row = lambda i, *xs: F.array(*[F.struct(F.lit(i).alias("row_idx"), F.lit(j).alias("col_idx"), x.alias("raw")) for j, x in enumerate(xs)])
    big = lambda i: F.format_number(F.col("n_nationkey") * 1000 + 5000 + i, 0)
    rows = [row(i, F.lit(f"Line number {chr(97 + i)}"), big(i), F.lit("7" if i % 2 else ""), big(i * 3)) for i in range(8)]
    cells = n.select(F.col("n_nationkey").cast("string").alias("table_id"), F.lit("f").alias("file"), F.lit(1).alias("page"), F.lit(1).alias("table_ord"), F.lit("Lines").alias("title"), F.explode(F.concat(*rows)).alias("x")).select("table_id", "file", "page", "table_ord", "title", "x.*")
    return statements.read_tables(statements.assemble(cells)).select(F.col("table_id").cast("int").alias("nation"), "value_cols", "note_col")


@query(_BASE + "select nation || '-' || year as table_id, 8 - (case when wrong then 1 else 0 end) as trusted, 8 as scored from rep")
def figure_health(spark, sf_dir):
    """A figure a thousand times that of the year beside it is suspect."""
    cells = reports.report_cells(spark, sf_dir, "income", restate=True)
    nation_year = F.split("table_id", "-")
    wrong = (nation_year[0].cast("int") * 7 + nation_year[1].cast("int")) % 5 == 0
    cells = cells.withColumn("raw", F.when(wrong & (F.col("row_idx") == 7) & (F.col("col_idx") == 1), F.concat(F.regexp_replace("raw", r"\)$", ""), F.lit(",000)"))).otherwise(F.col("raw")))
    tables = health.with_health(statements.read_tables(statements.assemble(cells)))
    return tables.select("table_id", (F.col("health_figures.scored") - F.size("health_figures.suspect")).alias("trusted"), F.col("health_figures.scored").alias("scored"))


@query(_BASE + "select nation || '-' || year as table_id, case when wrong then 'starts lower-case (leading word clipped?)' end as why from rep")
def label_health(spark, sf_dir):
    cells = reports.report_cells(spark, sf_dir, "income", restate=True)
    nation_year = F.split("table_id", "-")
    wrong = (nation_year[0].cast("int") * 7 + nation_year[1].cast("int")) % 5 == 0
    cells = cells.withColumn("raw", F.when(wrong & (F.col("row_idx") == 4) & (F.col("col_idx") == 0), "and administrative costs").otherwise(F.col("raw")))
    tables = health.with_health(statements.read_tables(statements.assemble(cells)))
    return tables.select("table_id", F.get("health_labels.suspect", F.lit(0))["why"].alias("why"))


# --- across tables -----------------------------------------------------------------------------


@query(_BASE + """
, pairs as (select a.nation, a.year, a.nation % 3 = 0 as changed from rep a join rep b on a.nation = b.nation and b.year = a.year + 1),
sides as (select nation, year, year + 1 as vs, year as shared, changed, 0 as mirror from pairs union all select nation, year + 1, year, year, changed, 1 from pairs)
select nation || '-' || year as table_id, nation || '-' || vs as vs, shared as year, cast(8 as bigint) as checked, cast(case when changed then 1 else 0 end as bigint) as mismatch,
  case when changed then 'restated' else 'agree' end as verdict from sides s where mirror = 0 or not exists (select 1 from sides t where t.nation = s.nation and t.year = s.year and t.mirror = 0)
""")
def cross_year_verdict(spark, sf_dir):
    """Each report's current year against the next report's prior year."""
    tables = keep(foot(_read(spark, sf_dir, "income", restate=True)))
    items = link.series(tables).withColumn("nation", F.split("table_id", "-")[0])
    return link.cross_year(items, ["nation"]).select("table_id", "vs", F.col("year").cast("long").alias("year"), "checked", "mismatch", "verdict")


@query(_BASE + """
select nation || '-' || year as table_id, cast(8 as bigint) as keys, revenue from rep
""")
def line_series(spark, sf_dir):
    items = link.series(keep(foot(_read(spark, sf_dir, "income", restate=True))))
    newest = F.max(F.when(F.col("key") == "revenue", F.struct("year", "value")))
    return items.groupBy("table_id").agg(F.count_distinct("key").alias("keys"), newest["value"].cast("long").alias("revenue"))


def _diff_of_years(spark, sf_dir):
    items = link.series(keep(foot(_read(spark, sf_dir, "income", restate=True))))
    split = F.split("table_id", "-")
    items = items.withColumn("nation", split[0].cast("int")).withColumn("report", split[1].cast("int"))
    a = items.withColumn("key", F.when(F.col("key") == "gross profit", "other income").otherwise(F.col("key"))).withColumn("year_of", F.col("report"))
    b = items.withColumn("year_of", F.col("report") + 1)
    common = a.select("nation", "year_of").distinct().intersect(b.select("nation", "year_of").distinct())
    return link.diff_tables(a.join(common, ["nation", "year_of"]), b.join(common, ["nation", "year_of"]), ["nation", "year_of"])


@query(_BASE + """
, x as (select a.nation, a.year, a.revenue as ra, a.before as pa, b.revenue as rb from rep a join rep b on a.nation = b.nation and b.year = a.year - 1),
k as (select unnest(['revenue', 'gross profit', 'other income', 'profit before tax']) as key)
select nation, year, key, case when key = 'other income' then 'NEW in A' when key = 'gross profit' then 'removed (only in B)' when key = 'revenue' and ra = pa then '' else 'changed' end as status from x, k
where key in ('revenue', 'gross profit', 'other income')
""")
def report_diff(spark, sf_dir):
    """A report against the one of the year before; one line has another name in it."""
    out = _diff_of_years(spark, sf_dir)
    return out.filter(F.col("key").isin("revenue", "gross profit", "other income")).select("nation", F.col("year_of").cast("long").alias("year"), "key", "status")


@query(_BASE + """
, x as (select a.nation, a.year, a.revenue as ra, a.before as pa from rep a join rep b on a.nation = b.nation and b.year = a.year - 1),
k as (select unnest(['revenue', 'cost of sales', 'gross profit', 'other income', 'general and administrative costs', 'finance costs', 'profit before tax', 'income tax', 'profit for the year']) as key)
select nation, year, key, case when key = 'other income' then 'NEW in A' when key = 'gross profit' then 'removed (only in B)' when key = 'revenue' and ra = pa then '' else 'changed' end as status from x, k
""")
def report_diff_lines(spark, sf_dir):
    """Every line of the diff that report_diff shows three keys of."""
    return _diff_of_years(spark, sf_dir).select("nation", F.col("year_of").cast("long").alias("year"), "key", "status")


@query()
def matched_tables(spark, sf_dir):
    """Statements of neighbouring years paired by kind and title; greedy, so tested by hand-made cases."""
    tables = None
    for what in reports.TITLES:
        one = keep(_read(spark, sf_dir, what).select("table_id", "kind", "title")).select("*", F.lit(list(reports.TITLES).index(what)).alias("table_ord"))
        tables = one if tables is None else tables.unionByName(one)
    split = F.split("table_id", "-")
    tables = tables.withColumn("report", F.concat_ws("-", split[0], split[1])).withColumn("table_id", F.concat_ws("/", "table_id", "kind"))
    later = tables.withColumn("report", F.concat_ws("-", split[0], (F.split(split[1], "/")[0].cast("int") + 1).cast("string")))
    return link.match_tables(tables, later)


@query(_BASE + "select nation || '-' || year as table_id, nation || '-' || year || '+' as next_id from rep")
def page_breaks(spark, sf_dir):
    """A balance sheet cut after its sixth row goes on with the table that follows it."""
    cells = reports.report_cells(spark, sf_dir, "balance", restate=True)
    rest = F.col("row_idx") > 5
    cells = cells.withColumn("table_id", F.when(rest, F.concat("table_id", F.lit("+"))).otherwise(F.col("table_id"))).withColumn("table_ord", F.when(rest, 2).otherwise(1)).withColumn("page", F.when(rest, 2).otherwise(1)).withColumn("title", F.when(rest, "").otherwise(F.col("title")))
    return link.continuations(keep(statements.read_tables(statements.assemble(cells))))


# --- geometry ----------------------------------------------------------------------------------


@query("""
with e as (select user_id, event_id, epoch_us(ts) as t from events), f as (select *, case when t - lag(t) over w > 3600000000 then 1 else 0 end as n from e window w as (partition by user_id order by t, event_id))
select user_id, cast(g as integer) as grp, count(*) as n, cast(max(t) - min(t) as bigint) as span from (select *, sum(n) over (partition by user_id order by t, event_id rows unbounded preceding) as g from f) group by 1, 2
""")
def gap_groups(spark, sf_dir):
    """Runs of positions without a gap over the limit, as words are joined into cells."""
    e = read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    out = geometry.gap_groups(e, ["user_id"], "t", "t", 3_600_000_000)
    return out.groupBy("user_id", "grp").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))


@query("""
with e as (select p_brand, p_size, case when p_size - lag(p_size) over (partition by p_brand order by p_size) > 20 then 1 else 0 end as n from (select distinct p_brand, p_size * p_size as p_size from part)),
g as (select p_brand, grp, avg(p_size) as lo from (select *, sum(n) over (partition by p_brand order by p_size rows unbounded preceding) as grp from e) group by 1, 2)
select p_brand, cast(grp as integer) as band, round(lo * 1000)::bigint as lo, round(hi * 1000)::bigint as hi from (select *, lead(lo) over (partition by p_brand order by grp) as hi from g) where hi is not null
""")
def edge_bands(spark, sf_dir):
    edges = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * F.col("p_size")).cast("double").alias("x")).distinct()
    out = geometry.edge_bands(edges, ["p_brand"], "x", 20.0)
    return out.select("p_brand", "band", F.round(F.col("lo") * 1000).cast("long").alias("lo"), F.round(F.col("hi") * 1000).cast("long").alias("hi"))


@query("""
select p_brand, s_suppkey, count(*) as n from part join supplier on p_retailprice >= 900 + s_suppkey * 10 and p_retailprice < 905 + s_suppkey * 10 group by 1, 2
""")
def words_in_band(spark, sf_dir):
    """Positions in bands: an interval join on buckets."""
    points = read(spark, sf_dir, "part").select(F.lit(1).alias("page"), "p_brand", F.col("p_retailprice").alias("x"))
    bands = read(spark, sf_dir, "supplier").select(F.lit(1).alias("page"), "s_suppkey", (900 + F.col("s_suppkey") * 10).cast("double").alias("lo"), (905 + F.col("s_suppkey") * 10).cast("double").alias("hi"))
    return geometry.in_bands(points, bands, ["page"], "x", "lo", "hi", 20.0).groupBy("p_brand", "s_suppkey").agg(F.count("*").alias("n"))


@query("""
select c.event_id, m.event_id as near_event_id from (select * from events where event_type = 'click') c asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by 1, 2) m on c.user_id = m.user_id and c.ts >= m.ts
""")
def nearest_heading(spark, sf_dir):
    """Each row with the last mark above it."""
    e = read(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    marks = e.filter("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("event_id").alias("event_id"))
    clicks = e.filter("event_type = 'click'").select("user_id", "t", "event_id")
    return geometry.nearest_before(clicks, marks, ["user_id"], "t", "t", ["event_id"]).select("event_id", "near_event_id")


def _boxes(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    x0, y0 = F.col("l_partkey") % 40, F.col("l_suppkey") % 30
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("box_id"), F.lit(0).alias("rank"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 1 + F.floor("l_quantity")).cast("double").alias("x1"), (y0 + 5 + F.col("l_linenumber")).cast("double").alias("y1"))


_BOXES = "b as (select l_orderkey, l_linenumber as box_id, l_partkey % 40 as x0, l_suppkey % 30 as y0, l_partkey % 40 + 1 + floor(l_quantity) as x1, l_suppkey % 30 + 5 + l_linenumber as y1 from lineitem)"


@query(f"""
with {_BOXES}, p as (select p.l_orderkey, p.box_id as a, q.box_id as b, greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) as s, least((p.x1 - p.x0) * (p.y1 - p.y0), (q.x1 - q.x0) * (q.y1 - q.y0)) as m from b p join b q on p.l_orderkey = q.l_orderkey and p.box_id < q.box_id)
select l_orderkey, cast(a as bigint) as a, cast(b as bigint) as b from p where s > 0.55 * greatest(1, m)
""")
def overlap_pairs(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    side = lambda n: b.select("l_orderkey", F.col("box_id").alias(n), *[F.col(k).alias(f"{n}_{k}") for k in ("x0", "y0", "x1", "y1")])
    pairs = side("a").join(side("b"), "l_orderkey").filter("a < b")
    return pairs.filter(geometry.overlap("a_", "b_") > 0.55).select("l_orderkey", "a", "b")


@query(f"""
with {_BOXES}, p as (select l_orderkey, box_id, greatest(0, least(x1, 30) - greatest(x0, 10)) * greatest(0, least(y1, 25) - greatest(y0, 5)) as s, (x1 - x0) * (y1 - y0) as m from b)
select l_orderkey, cast(arg_max(box_id, s * 100 - box_id) as bigint) as box_id from p where s > 0 and (s >= 0.5 * m or s >= 200) group by 1
""")
def best_region(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    asked = boxes.select("l_orderkey").distinct().select("l_orderkey", F.lit(1).alias("ask_id"), *[F.lit(v).alias(k) for k, v in (("q_x0", 10.0), ("q_y0", 5.0), ("q_x1", 30.0), ("q_y1", 25.0))])
    return geometry.best_region(boxes, asked, ["l_orderkey"]).select("l_orderkey", "box_id")


@query()
def kept_boxes(spark, sf_dir):
    """Greedy suppression of overlapping boxes; sequential, so tested against brute force."""
    return geometry.suppress(_boxes(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "box_id")


@query()
def lines_of_words(spark, sf_dir):
    """Words to lines by their first word's height; sequential, so tested by hand-made pages."""
    li = read(spark, sf_dir, "lineitem")
    words = li.select(F.col("l_suppkey").cast("string").alias("file"), F.month("l_shipdate").alias("page"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("text"), (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_partkey") % 500 + 20).cast("double").alias("x1"), (F.col("l_orderkey") % 700).cast("double").alias("top"))
    return geometry.build_lines(words).groupBy("file", "page").agg(F.count_distinct("line_id").alias("lines"), F.count("*").alias("words"))


# --- accuracy ----------------------------------------------------------------------------------


@query("""
select a.p_partkey, cast(round(1000 * (1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)))) as bigint) as alike from part a join part b on b.p_partkey = a.p_partkey + 1
""")
def levenshtein_cells(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = p.alias("a").join(p.alias("b"), F.expr("b.p_partkey = a.p_partkey + 1"))
    none = F.lit(None).cast("double")
    return pairs.select("a.p_partkey", F.round(1000 * score.cell_similarity(F.col("a.p_name"), F.col("b.p_name"), none, none)).cast("long").alias("alike"))


@query()
def ratio_cells(spark, sf_dir):
    """Ratio of matching blocks of neighbouring part names; no SQL has it."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = p.alias("a").join(p.alias("b"), F.expr("b.p_partkey = a.p_partkey + 1"))
    return pairs.select("a.p_partkey", F.round(link.ratio(F.col("a.p_name"), F.col("b.p_name")), 6).alias("ratio"))


@query()
def aligned_tables(spark, sf_dir):
    """Income statements against themselves without one row: alignment scores."""
    tables = _read(spark, sf_dir, "income")
    long = tables.select("table_id", F.explode("rows").alias("r")).select("table_id", "r.row_idx", F.posexplode("r.cells").alias("col_idx", "c"))
    long = long.select(F.col("table_id").alias("case"), "row_idx", "col_idx", F.col("c.txt").alias("txt"), F.col("c.num").alias("num"))
    cases = long.withColumn("side", F.lit("truth")).unionByName(long.filter("row_idx <> 5").withColumn("side", F.lit("found")))
    return score.score_tables(cases).withColumn("score", F.round("score", 6))


@query("select source, cast(round(1000 * avg(quality)) as bigint) as mean from documents join labels using (doc_id) group by source")
def suite_average(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.round(1000 * F.avg("quality")).cast("long").alias("mean"))


# --- pages and edits ---------------------------------------------------------------------------


@query(r"""
select doc_id as page, cast(length(regexp_replace(lower(text), 'tion', 'tion_', 'g')) - length(text) as integer) as hits from documents where contains(lower(text), 'tion') order by doc_id limit 300
""")
def search_hits(spark, sf_dir):
    """Pages with a text, in order; the first 300 are the feature."""
    return search.search(read(spark, sf_dir, "documents"), "TION", "doc_id", F.col("text")).select("page", "hits")


@query(r"""
select nation, label, min(year) as page from (select c_nationkey as nation, cast(year(o_orderdate) as integer) as year, unnest(['income statement', 'statement of cash flows']) as label from orders join customer on o_custkey = c_custkey) group by 1, 2
""")
def quick_find(spark, sf_dir):
    base = reports.nation_years(spark, sf_dir)
    pages = base.select("nation", F.col("year").alias("page"), F.concat(F.lit("Consolidated Statement of Profit or Loss for "), "year", F.lit(" and Cash Flow Statement")).alias("text"))
    return search.quick_find(pages, "nation", "page", "text")


@query("""
with f as (select source, n_chars, row_number() over (partition by source order by doc_id) as n from documents)
select source, cast(floor(sum(n_chars) / count(*)) as bigint) as mean_chars, sum(n_chars) / count(*) < 90 as scanned from f where n <= 12 group by source
""")
def scanned_guard(spark, sf_dir):
    out = search.scanned_files(read(spark, sf_dir, "documents"), "source", "doc_id", F.col("n_chars"))
    return out.select("source", F.floor("mean_chars").alias("mean_chars"), "scanned")


@query("""
select user_id, arg_max(event_id, event_id) as edit_id, cast(round(100 * arg_max(value, event_id) filter (where event_type <> 'error')) as bigint) as payload from events group by user_id having arg_max(event_type, event_id) <> 'error'
""")
def edits_latest(spark, sf_dir):
    """The log's last state of each table; errors are deletes."""
    e = read(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("table_id"), F.col("event_id").alias("edit_id"), F.when(F.col("event_type") == "error", "delete").otherwise("edit").alias("op"), F.round(F.col("value") * 100).cast("long").alias("payload"))
    return edits.latest(log).select(F.col("table_id").alias("user_id"), "edit_id", "payload")


@query("""
select nation, year from (select nation, year, row_number() over (partition by nation order by n desc, year) as k from (select c_nationkey as nation, cast(year(o_orderdate) as integer) as year, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2)) where k <= 3
""")
def page_years(spark, sf_dir):
    """The three years that a page names most often, ties by the earlier."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = o.select(F.col("c_nationkey").alias("nation"), F.explode(years_in(F.date_format("o_orderdate", "dd.MM. yyyy"))).alias("year"))
    count = years.groupBy("nation", "year").count()
    return count.withColumn("k", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("count"), "year"))).filter("k <= 3").select("nation", "year")


@query("""
select p_partkey, case when p_partkey % 11 = 0 then 'statement' when p_partkey % 3 = 0 and p_partkey % 9 <= 5 then 'mostly-text' when p_partkey % 9 >= 2 then 'table' else 'small/other' end as shape from part
""")
def table_shapes(spark, sf_dir):
    """Tables of two rows of four cells below a header, some of them figures; every third has long texts, every eleventh a statement's words."""
    k, none = F.col("p_partkey"), F.lit(None)
    words = F.when(k % 11 == 0, F.concat("p_name", F.lit(" Total  Assets"))).otherwise(F.col("p_name"))
    text = F.when(k % 3 == 0, F.rpad("p_name", 41, ".")).otherwise(F.substr("p_name", F.lit(1), F.lit(12)))
    cell = lambda i: F.struct(F.when(k % 9 <= i, text).alias("txt"), F.when(k % 9 > i, F.col("p_retailprice")).cast("double").alias("num"))
    row = lambda cells: F.struct(F.array(*cells).alias("cells"))
    head = F.struct(F.replace(words, F.lit("  "), F.lit(" ")).alias("txt"), none.cast("double").alias("num"))
    rows = F.array(row([head]), row([cell(i) for i in range(4)]), row([cell(i) for i in range(4, 8)]))
    return read(spark, sf_dir, "part").select("p_partkey", search.shape(rows).alias("shape"))


@query("select o_orderkey as table_id from orders where o_orderkey % 5 in (0, 1) or (o_orderkey % 3 <> 0 and o_orderkey % 4 >= 2)")
def inventory(spark, sf_dir):
    """Statements and notes, and of other tables those that aren't mostly text and have three rows."""
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, F.lit(search.P.STATEMENTS[0])).when(k % 5 == 1, "note").otherwise("table")
    shape = F.when(k % 3 == 0, "mostly-text").otherwise("table")
    tables = read(spark, sf_dir, "orders").select(k.alias("table_id"), kind.alias("kind"), shape.alias("shape"), F.sequence(F.lit(0), (k % 4).cast("int")).alias("rows"))
    return search.inventory(tables).select("table_id")
