"""Across tables: series of line items, cross-year checks, report diffs, matching, page breaks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import norm_label


def series(tables: DataFrame) -> DataFrame:
    """(table_id, file, table_ord, kind, key, label, year, value): a table's figures by line and year.

    A key keeps its first label; a later figure of the same key and year stands."""
    end = F.array_min(F.filter(F.transform("data", lambda r, i: F.when(r["label"].rlike(P.PROFIT_ROW_SERIES), i + 1)), lambda i: i.isNotNull()))
    data = F.when(F.col("kind") == P.STATEMENTS[0], F.slice("data", 1, F.coalesce(end, F.size("data")))).otherwise(F.col("data"))
    rows = tables.select("table_id", "file", "table_ord", "kind", "years", "value_cols", F.posexplode(data).alias("at", "r"))
    rows = rows.filter((F.col("r.label") != "") & ~F.col("r.label").rlike(P.PROSE)).withColumn("key", norm_label(F.col("r.label"))).filter("key <> ''")
    cells = rows.select("*", F.posexplode("value_cols").alias("k", "c"))
    year = F.coalesce(F.get("years", F.col("k")), F.when(F.size("years") == 0, 9000 + F.col("k")).otherwise(-F.col("k")))
    cells = cells.select("table_id", "file", "table_ord", "kind", "key", "at", F.col("r.label").alias("label"), year.alias("year"), F.get("r.cells", F.col("c"))["num"].alias("value")).filter("value is not null")
    first = Window.partitionBy("table_id", "key").orderBy("at")
    cells = cells.withColumn("label", F.first("label").over(first))
    return cells.groupBy("table_id", "file", "table_ord", "kind", "key", "year").agg(F.first("label").alias("label"), F.max_by("value", "at").alias("value"), F.min("at").alias("at"))


def cross_year(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each table the best-covered check of a shared year against a later table of another file:
    table_id, vs, year, checked, mismatch, verdict, worst (three, by difference). by: columns, as the company, that tables must share."""
    by = by or []
    own = items.filter(F.col("kind").isin(P.STATEMENTS) & F.col("year").between(P.FIRST_YEAR, P.LAST_YEAR))
    a = own.select(*by, "kind", "key", "year", F.col("table_id").alias("a_id"), F.col("file").alias("a_file"), F.col("table_ord").alias("a_ord"), F.col("value").alias("va"))
    b = own.select(*by, "kind", "key", "year", F.col("table_id").alias("b_id"), F.col("file").alias("b_file"), F.col("table_ord").alias("b_ord"), F.col("value").alias("vb"))
    pairs = a.join(b, [*by, "kind", "key", "year"]).filter("a_ord < b_ord and a_file <> b_file")
    off = F.abs(F.col("va") - F.col("vb"))
    bad = off > F.greatest(F.lit(2.0), F.abs("va") * 1e-4)
    by_pair = pairs.groupBy("a_id", "b_id", "a_ord", "b_ord", "year").agg(F.count("*").alias("checked"), F.count(F.when(bad, 1)).alias("mismatch"), F.slice(F.sort_array(F.collect_list(F.when(bad, F.struct(off.alias("off"), "key", "va", "vb"))), asc=False), 1, 3).alias("worst"))
    latest = by_pair.withColumn("nth", F.row_number().over(Window.partitionBy("a_id", "b_id").orderBy(F.desc("year")))).filter("nth = 1 and checked >= 4")
    best = latest.withColumn("nth", F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("checked"), "b_ord"))).filter("nth = 1")
    verdict = F.when(F.col("mismatch") == 0, "agree").when((F.col("mismatch") <= 3) | (F.col("mismatch") / F.col("checked") <= 0.25), "restated").otherwise("columns likely misaligned")
    found = best.select(F.col("a_id").alias("table_id"), F.col("b_id").alias("vs"), "year", "checked", "mismatch", verdict.alias("verdict"), "worst", F.lit(0).alias("mirror"), "a_ord")
    mirror = found.select(F.col("vs").alias("table_id"), F.col("table_id").alias("vs"), "year", "checked", "mismatch", "verdict", "worst", F.lit(1).alias("mirror"), "a_ord")
    every = found.unionByName(mirror)
    return every.withColumn("nth", F.row_number().over(Window.partitionBy("table_id").orderBy("mirror", "a_ord"))).filter("nth = 1").drop("nth", "mirror", "a_ord")


def ratio(a: Column, b: Column) -> Column:
    """Share of matching blocks of two strings, 0 to 1, as difflib defines it."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return of(a, b)


#: From what ratio on two keys are one line under two wordings, and the ratio of a key that holds the other.
SAME_LINE, HOLDS = 0.82, 0.9


def paired_keys(keys_a: DataFrame, keys_b: DataFrame, by: list[str]) -> DataFrame:
    """(by, a_key, b_key): the keys of two reports, equal ones paired, others by likeness, greedily in a's order; what is left alone.

    keys: by, key, at (its place in the report). Only keys that the other side lacks are compared, within one pair of tables; the
    greedy choice is a fold over a's lone keys."""
    a = keys_a.groupBy(*by, "key").agg(F.min("at").alias("at"))
    b = keys_b.groupBy(*by, "key").agg(F.min("at").alias("at"))
    both = a.withColumnRenamed("at", "a_at").join(b.withColumnRenamed("at", "b_at"), [*by, "key"], "full_outer")
    lone_a = both.filter("b_at is null").select(*by, F.col("key").alias("a_key"), "a_at")
    lone_b = both.filter("a_at is null").select(*by, F.col("key").alias("b_key"), "b_at")
    held = F.when(F.contains("a_key", F.col("b_key")) | F.contains("b_key", F.col("a_key")), HOLDS).otherwise(0.0)
    scored = lone_a.join(lone_b, by).withColumn("s", F.greatest(ratio(F.col("a_key"), F.col("b_key")), held)).filter(F.col("s") >= SAME_LINE)
    # Best first, the earlier of equals.
    options = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "b_at", "b_key")))
    wishes = scored.groupBy(*by, "a_key", "a_at").agg(F.transform(options, lambda x: x["b_key"]).alias("wish"))
    turns = wishes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a_at", "a_key", "wish"))).alias("turns"))
    none = F.array().cast("array<struct<a_key:string,b_key:string>>")

    def choose(taken: Column, turn: Column) -> Column:
        # A key's best match counts among what is left when its turn comes.
        free = F.filter(turn["wish"], lambda w: ~F.exists(taken, lambda t: t["b_key"] == w))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(F.struct(turn["a_key"].alias("a_key"), F.get(free, F.lit(0)).alias("b_key"))))).otherwise(taken)

    chosen = turns.select(*by, F.inline(F.aggregate("turns", none, choose)))
    same = both.filter("a_at is not null and b_at is not null").select(*by, F.col("key").alias("a_key"), F.col("key").alias("b_key"))
    rest_a = lone_a.join(chosen, [*by, "a_key"], "left_anti").select(*by, "a_key", F.lit(None).cast("string").alias("b_key"))
    rest_b = lone_b.join(chosen, [*by, "b_key"], "left_anti").select(*by, F.lit(None).cast("string").alias("a_key"), "b_key")
    return same.unionByName(chosen).unionByName(rest_a).unionByName(rest_b)


def with_paired_keys(items_a: DataFrame, items_b: DataFrame, by: list[str]) -> DataFrame:
    """items_b under the keys of a's lines, where they are the same lines under other wordings, for diff_tables."""
    pairs = paired_keys(items_a.select(*by, "key", "at"), items_b.select(*by, "key", "at"), by).filter("a_key is not null and b_key is not null and a_key <> b_key")
    renamed = items_b.join(pairs.select(*by, F.col("b_key").alias("key"), "a_key"), [*by, "key"], "left")
    return renamed.withColumn("key", F.coalesce("a_key", "key")).drop("a_key")


def diff_tables(items_a: DataFrame, items_b: DataFrame, by: list[str]) -> DataFrame:
    """Lines of paired tables side by side: by, key, label, a_cur, a_prev, b_cur, b_prev, change, change_pct, restated, status.

    by: columns that name a pair. cur is a side's newest year, prev its oldest."""

    def side(items, name):
        span = items.groupBy(*by).agg(F.max("year").alias("__new"), F.min("year").alias("__old"))
        rows = items.join(span, by)
        pick = lambda y: F.max(F.when(F.col("year") == F.col(y), F.col("value")))
        return rows.groupBy(*by, "key").agg(F.first("label").alias(f"{name}_label"), pick("__new").alias(f"{name}_cur"), F.max(F.when((F.col("year") == F.col("__old")) & (F.col("__old") < F.col("__new")), F.col("value"))).alias(f"{name}_prev"), F.max("__new").alias(f"{name}_new"), F.max(F.when(F.col("__old") < F.col("__new"), F.col("__old"))).alias(f"{name}_old"))

    both = side(items_a, "a").join(side(items_b, "b"), [*by, "key"], "full_outer")
    change = F.col("a_cur") - F.col("a_prev")
    restated = F.coalesce((F.col("a_old") == F.col("b_new")) & (F.abs(F.col("a_prev") - F.col("b_cur")) > 2), F.lit(False))
    status = F.when(F.col("b_label").isNull(), "NEW in A").when(F.col("a_label").isNull(), "removed (only in B)").when(change != 0, "changed").otherwise("")
    return both.select(*by, "key", F.coalesce("a_label", "b_label").alias("label"), "a_cur", "a_prev", "b_cur", "b_prev", change.alias("change"), F.round(F.when(F.col("a_prev") != 0, 100 * change / F.abs("a_prev")), 1).alias("change_pct"), restated.alias("restated"), status.alias("status"))


def match_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) of tables of the same kind by title, greedily in a's order, each table of b once.

    a and b: report, table_id, table_ord, kind, title; matched within a report pair."""

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (_, a_id), group in rows.sort_values(["a_ord", "b_ord"], kind="stable").groupby(["a_ord", "a_id"], sort=True):
            best, score = None, 0.0
            for r in group.itertuples():
                s = r.s
                if r.b_id not in used and s > score:
                    best, score = r.b_id, s
            if best is not None and score >= 0.45:
                used.add(best)
                out.append((rows["report"].iloc[0], a_id, best))
        return pd.DataFrame(out, columns=["report", "a_id", "b_id"])

    left = a.select("report", "kind", F.col("table_id").alias("a_id"), F.col("table_ord").alias("a_ord"), norm_label(F.coalesce("title", F.lit(""))).alias("ta"))
    right = b.select("report", "kind", F.col("table_id").alias("b_id"), F.col("table_ord").alias("b_ord"), norm_label(F.coalesce("title", F.lit(""))).alias("tb"))
    pairs = left.join(right, ["report", "kind"]).withColumn("s", ratio(F.col("ta"), F.col("tb")) + F.when(F.col("kind").isin(P.STATEMENTS), 0.5).otherwise(0.0))
    return pairs.groupBy("report").applyInPandas(greedy, "report string, a_id string, b_id string")


def stitched(tables: DataFrame, analyse) -> DataFrame:
    """tables with each unfinished statement joined to the table that goes on with it, which goes; stitched_from: that table's page.

    analyse(tables) reads rows anew; where that makes the statement another kind the join is taken back and both tables stay.
    Of statements that ask for the same table the first gets it, and a table that is itself joined to another isn't given away."""
    pairs = continuations(tables).join(tables.select("table_id", "table_ord"), "table_id")
    nth = F.row_number().over(Window.partitionBy("next_id").orderBy("table_ord"))
    pairs = pairs.withColumn("__n", nth).filter("__n = 1").select("table_id", "next_id")
    pairs = pairs.join(pairs.select(F.col("next_id").alias("table_id")), "table_id", "left_anti")
    following = tables.select(F.col("table_id").alias("next_id"), F.col("rows").alias("__more"), F.col("page").alias("stitched_from"))
    open_ones = tables.join(pairs, "table_id").join(following, "next_id")
    longer = open_ones.withColumn("rows", F.concat("rows", "__more")).drop("__more")
    read_again = analyse(longer)
    good = read_again.filter(F.col("kind").isin(P.STATEMENTS[:2]))
    rest = tables.join(good.select("table_id"), "table_id", "left_anti").join(good.select(F.col("next_id").alias("table_id")), "table_id", "left_anti")
    return rest.withColumn("stitched_from", F.lit(None).cast(tables.schema["page"].dataType)).unionByName(good.select(*tables.columns, "stitched_from"))


def continuations(tables: DataFrame) -> DataFrame:
    """(table_id, next_id): an unfinished statement and the table that goes on with it on the same or the next page."""
    order = Window.partitionBy("file").orderBy("table_ord")
    closed = F.exists("data", lambda r: F.when(F.col("kind") == P.STATEMENTS[0], r["label"].rlike(P.PROFIT_ROW)).otherwise(r["label"].rlike(r"(?i)total (equity and )?liabilities( and equity)?\b")))
    named = tables.withColumn("open", F.col("kind").isin(P.STATEMENTS[:2]) & ~closed)
    head = F.slice("data", 1, 12)
    goes_on = F.size(F.filter(head, lambda r: r["label"].rlike(P.KNOWN_LINE)))
    named = named.withColumn("follows", (F.col("header_idx") == 0) & (F.size("data") > 0) & (goes_on >= F.greatest(F.lit(2.0), F.size(head) * 0.5)))
    out = named
    for k in (1, 2, 3):
        at = lambda c, k=k: F.lead(c, k).over(order)
        out = out.withColumn(f"__{k}", F.when(at("page").between(F.col("page"), F.col("page") + 1) & at("follows"), at("table_id")))
    return out.filter("open").select("table_id", F.coalesce("__1", "__2", "__3").alias("next_id")).filter("next_id is not null")
