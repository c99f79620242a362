"""Queries of the cell, region and candidate operators over the driver's tables, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cleaning, profiles, regions
from .queries import query, read


def _text() -> Column:
    return F.lit(None).cast("string")


def _grids(rows: DataFrame, by: str, order: str, *cells: Column) -> DataFrame:
    """(by, grid): rows of a group as cells, in order."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.array(*cells).alias("r")))).alias("x"))
    return listed.select(by, F.transform("x", lambda r: r["r"]).alias("grid"))


def _suppliers(spark, sf_dir) -> DataFrame:
    cents = F.expr("cast(round(abs(s_acctbal)) as bigint)")
    return read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.col("s_acctbal"), F.format_number(cents, 0).alias("v"))


_SHOWN = "format('{:,}', cast(round(abs(s_acctbal)) as bigint))"


@query(f"""
select s_name, concat_ws('|', s_name, case when s_suppkey = min(s_suppkey) over (partition by s_nationkey) then '$' else '' end || {_SHOWN}, case when s_acctbal < 0 then '(' || {_SHOWN} || ')' else {_SHOWN} end) as cells from supplier
""")
def currency_columns(spark, sf_dir):
    """Columns of lone currency signs and opening parentheses joined to the figures on their right."""
    s = _suppliers(spark, sf_dir)
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    s = s.join(first, "s_nationkey")
    neg = F.col("s_acctbal") < 0
    grids = _grids(s, "s_nationkey", "s_suppkey", F.col("s_name"), F.when(F.col("s_suppkey") == F.col("first"), "$"), F.col("v"), F.when(neg, "("), F.when(neg, F.concat("v", F.lit(")"))).otherwise(F.col("v")))
    rows = grids.select(F.explode(cleaning.clean(F.col("grid"))).alias("r"))
    return rows.select(F.get("r", F.lit(0)).alias("s_name"), F.concat_ws("|", "r").alias("cells"))


@query(f"""
select s_name, cast(s_suppkey % 20 + 1 as varchar) as ref, {_SHOWN} as v from supplier
""")
def note_references(spark, sf_dir):
    """References to notes at the end of labels or before figures, taken off and kept by label."""
    s = _suppliers(spark, sf_dir)
    ref, odd = (F.col("s_suppkey") % 20 + 1).cast("string"), F.col("s_suppkey") % 2 == 1
    grids = _grids(s, "s_nationkey", "s_suppkey", F.when(odd, F.concat_ws(" ", "s_name", ref)).otherwise(F.col("s_name")), F.when(odd, F.col("v")).otherwise(F.concat_ws(" ", ref, "v")))
    name = lambda r: F.get(r, F.lit(0))
    line = F.transform("grid", lambda r: F.struct(F.lower(name(r)).alias("key"), _text().alias("ref"), r.alias("r")))
    noted = F.transform(F.map_entries("note_refs"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("ref"), F.lit(None).cast("array<string>").alias("r")))
    # References meet their lines by key; a map beside every line of a long table would be copied and searched as often as there are lines.
    rows = cleaning.strip_note_refs(grids).select("s_nationkey", F.inline(F.concat(line, noted)))
    rows = rows.withColumn("ref", F.max("ref").over(Window.partitionBy("s_nationkey", "key"))).filter("r is not null")
    return rows.select(name("r").alias("s_name"), "ref", F.get("r", F.lit(1)).alias("v"))


@query("""
select n_nationkey, cast(coalesce(n, 0) + (n_nationkey % 2) as bigint) as kept from nation join (select s_nationkey, count(*) as n from supplier group by 1) on s_nationkey = n_nationkey
""")
def trailing_prose(spark, sf_dir):
    """Rows of running text after the last figure; a short row right after it stays."""
    s = _suppliers(spark, sf_dir)
    grids = _grids(s, "s_nationkey", "s_suppkey", F.col("s_name"), F.col("v"))
    prose = F.array(F.lit("the notes on these pages form an integral part of the statements"), _text())
    short = F.when(F.col("s_nationkey") % 2 == 1, F.array(F.array(F.lit("Total"), _text()))).otherwise(F.array().cast("array<array<string>>"))
    grids = grids.withColumn("grid", F.concat("grid", short, F.array(prose)))
    return grids.select(F.col("s_nationkey").alias("n_nationkey"), F.size(cleaning.trim_trailing_prose(F.col("grid"))).cast("long").alias("kept"))


@query("""
select p_partkey, case p_partkey % 4 when 0 then 'Total non-current assets' when 1 then 'Total current assets' when 2 then 'trade receivables' else p_name end as label from part
""")
def label_lines(spark, sf_dir):
    """Labels freed of the next section's heading and of an auditor's sentence."""
    way = lambda i: F.col("p_partkey") % 4 == i
    raw = F.when(way(0), "Total non-current assets Current assets").when(way(1), "reasonable assurance about whether these are free of Total current assets").when(way(2), "we have audited in our opinion and so on trade receivables that were shown").otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", cleaning.deprose(cleaning.desection(raw), way(2)).alias("label"))


_LINE = "cast(l_partkey + 1000 as bigint)"


@query(f"""
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, case l_orderkey % 3 when 0 then 'Contract assets|' || l_linenumber || '|' else case l_orderkey % 3 when 1 then 'Contract assets|' else 'Contract assets||' end end
  || format('{{:,}}', {_LINE}) || '|' || format('{{:,}}', cast(l_suppkey + 5 as bigint)) || case l_orderkey % 3 when 1 then '|' else '' end as cells from lineitem
""")
def repaired_rows(spark, sf_dir):
    """Rows of which a grid finder glued the figures, to one another or to the label."""
    li = read(spark, sf_dir, "lineitem").withColumn("a", F.format_number(F.col("l_partkey") + 1000, 0)).withColumn("b", F.format_number(F.col("l_suppkey") + 5, 0))
    label, way, both = F.lit("Contract assets"), F.col("l_orderkey") % 3, F.concat_ws(" ", "a", "b")
    whole = F.concat_ws(" ", label, "a", "b")
    vals = F.when(way == 0, F.array(label, F.col("l_linenumber").cast("string"), both, _text())).when(way == 1, F.array(whole, whole, whole, whole)).otherwise(F.array(label, F.lit(""), both))
    fixed = regions.repair(vals, F.lit(4))
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.array_join(fixed, "|", "").alias("cells"))


def _region_rows(spark, sf_dir) -> DataFrame:
    """One region of one row for each supplier, at its key's height on its nation's page."""
    y = (F.col("s_suppkey") * 3).cast("double")
    row = F.struct(y.alias("top"), (y + 10).alias("bot"), F.array(F.col("s_name"), F.col("v")).alias("vals"))
    return _suppliers(spark, sf_dir).select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").cast("int").alias("region_id"), F.lit(10.0).alias("x0"), y.alias("y0"), F.lit(200.0).alias("x1"), (y + 10).alias("y1"), F.array(row).alias("rows"))


@query("""
with s as (select s_nationkey, s_suppkey, case when s_suppkey * 3 - lag(s_suppkey * 3 + 10) over w <= 60 then 0 else 1 end as new from supplier window w as (partition by s_nationkey order by s_suppkey)),
g as (select *, sum(new) over (partition by s_nationkey order by s_suppkey) as g from s)
select s_nationkey as page, cast(min(s_suppkey) as bigint) as region_id, count(*) as n_rows from g group by s_nationkey, g
""")
def stacked_regions(spark, sf_dir):
    """Regions below one another joined where the gap is small."""
    out = regions.merge_stacked(_region_rows(spark, sf_dir), ["page"])
    return out.select("page", F.col("region_id").cast("long").alias("region_id"), F.size("rows").cast("long").alias("n_rows"))


@query(f"""
select s_nationkey as page, s_name, {_SHOWN} as v from supplier
""")
def side_by_side_regions(spark, sf_dir):
    """A block of labels and the block of figures beside it, joined row by row."""
    rows = _region_rows(spark, sf_dir).select("page", "y0", F.explode("rows").alias("r"))

    def block(i: int, x0: float, x1: float) -> DataFrame:
        one = F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(r["top"].alias("top"), r["bot"].alias("bot"), F.array(F.get(r["vals"], F.lit(i))).alias("vals")))
        return rows.groupBy("page").agg(F.lit(i).alias("region_id"), F.lit(x0).alias("x0"), F.min("y0").alias("y0"), F.lit(x1).alias("x1"), (F.max("y0") + 10).alias("y1"), one.alias("rows"))

    out = regions.merge_side_by_side(block(0, 10.0, 100.0).unionByName(block(1, 120.0, 200.0)), ["page"])
    cells = out.select("page", F.explode("rows.vals").alias("v"))
    return cells.select("page", F.get("v", F.lit(0)).alias("s_name"), F.get("v", F.lit(1)).alias("v"))


@query("""
select s_nationkey, s_nationkey % 2 = 1 as fused, cast(case when s_nationkey % 3 = 0 then 2 else 3 end as bigint) as n_cols from (select distinct s_nationkey from supplier)
""")
def fused_and_prose(spark, sf_dir):
    """Regions that hold two kinds of statement; columns of running text beside a table."""
    s = _suppliers(spark, sf_dir)
    beside = F.when(F.col("s_nationkey") % 3 == 0, F.lit("we conducted our audit in accordance with standards on auditing and so on")).otherwise(F.col("v"))
    grids = _grids(s, "s_nationkey", "s_suppkey", F.concat(F.lit("Line "), "s_name"), F.col("v"), beside)
    head = lambda t: F.array(F.lit(t), _text(), _text())
    marks = F.when(F.col("s_nationkey") % 2 == 1, F.array(head("Total assets"), head("Gross profit"))).otherwise(F.array(head("Total assets"), head("a note on gross profit")))
    g = F.concat("grid", marks)
    return grids.select("s_nationkey", regions.is_fused(g).alias("fused"), F.size(F.get(regions.drop_prose_columns(g), F.lit(0))).cast("long").alias("n_cols"))


_CANDIDATE = """c as (select o_custkey as file, o_orderkey as candidate_id, o_orderkey % 7 as page, o_orderkey % 5 as n5, 3 + o_orderkey % 11 as n_rows, (o_orderkey % 9) / 10.0 as score,
  o_orderstatus = 'F' as reconciles, o_orderkey % 2 = 0 as anchored, o_orderkey % 4 = 0 as cut_found, o_orderkey % 4 as n_values, (o_orderkey % 10) / 10.0 as labelled from orders)"""


@query(f"""
with {_CANDIDATE}, p as (select *, row_number() over (partition by file, page, n5, n_rows order by candidate_id) as nth from c where score >= 0.2 or (reconciles and n_rows >= 10 and score >= 0.08 and anchored))
select file, candidate_id, row_number() over (partition by file order by cast(cut_found as int) desc, cast(reconciles as int) desc, cast(anchored as int) desc, least(n_values, 2) desc, labelled desc, score desc, n_rows desc, candidate_id) as place from p where nth = 1
""")
def ranked_candidates(spark, sf_dir):
    """Candidates for a known table: those worth a look, in the order in which they are preferred."""
    k = F.col("o_orderkey")
    c = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("file"), k.alias("candidate_id"), (k % 7).alias("page"), (k % 5).cast("double").alias("top"), (3 + k % 11).alias("n_rows"), ((k % 9) / 10).alias("score"),
        (F.col("o_orderstatus") == "F").alias("reconciles"), (k % 2 == 0).alias("anchored"), (k % 4 == 0).alias("cut_found"), (k % 4).alias("n_values"), ((k % 10) / 10).alias("labelled"),
    )
    return profiles.ranked(profiles.plausible(c, ["file"]), ["file"]).select("file", "candidate_id", F.col("place").cast("long").alias("place"))


@query()
def profile_scores(spark, sf_dir):
    """Share of known names that each brand's parts resemble; the ratio has no SQL, so it is tested by hand-made cases."""
    parts = read(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("labels"))
    return parts.select("p_type", profiles.match_score(F.col("labels"), ["Revenue", "Cost of sales", "Gross profit"], ["Segment result"]).alias("score"))
