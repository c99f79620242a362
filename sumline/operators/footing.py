"""Does it add up? Ordered folds and identities over a statement's value columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import patterns as P
from ..functions.numbers import let, settle
from .statements import is_bridge, is_unlike_statement

_LEAVES = "array<struct<label:string,v:double>>"


def column_of(data: Column, c: Column) -> Column:
    """The labels and figures of a column: array of label, v and at (row in data), where there is a figure."""
    return F.filter(F.transform(data, lambda r, i: F.struct(r["label"].alias("label"), F.get(r["cells"], c)["num"].alias("v"), i.cast("int").alias("at"))), lambda x: x["v"].isNotNull())


def walk(seq: Column, tol: float) -> Column:
    """Sum the leaves of a sequence of label and v: struct(ok, target, running, gap, leaves). ok is null below three figures.

    Lines with a total's label, lines that equal the running sum and lines that equal the sum of
    the last two to twelve leaves are no leaves. The last figure is the target."""

    def step(acc, x):
        leaves, v = acc["leaves"], x["v"]
        run = F.aggregate(F.reverse(F.slice(leaves, F.greatest(F.size(leaves) - 11, F.lit(1)), 12)), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(False).alias("hit")), lambda a, leaf: F.struct((a["sum"] + leaf["v"]).alias("sum"), (a["k"] + 1).alias("k"), (a["hit"] | ((a["k"] >= 1) & (F.abs(v - a["sum"] - leaf["v"]) <= tol))).alias("hit")), lambda a: a["hit"])
        skip = x["label"].rlike(P.HARD_TOTAL) | ((F.size(leaves) > 0) & (F.abs(v - acc["run"]) <= tol)) | run
        return F.when(skip, acc).otherwise(F.struct((acc["run"] + v).alias("run"), F.concat(leaves, F.array(F.struct(x["label"].alias("label"), v.alias("v")))).alias("leaves")))

    zero = F.struct(F.lit(0.0).alias("run"), F.array().cast(_LEAVES).alias("leaves"))

    def of(s):
        target = F.get(s, F.size(s) - 1)["v"]
        done = F.aggregate(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), zero, step)
        enough = F.size(s) >= 3
        return let(done, lambda d: F.struct(F.when(enough, (F.size(d["leaves"]) >= 2) & (F.abs(d["run"] - target) <= tol)).alias("ok"), target.alias("target"), d["run"].alias("running"), (d["run"] - target).alias("gap"), d["leaves"].alias("leaves")))

    return let(seq, of)


def break_label(w: Column, tol: float) -> Column:
    """The line that explains a gap: one whose removal closes it, else one of about its size if the gap is small."""
    doubled = F.get(F.filter(w["leaves"], lambda x: F.abs(w["running"] - x["v"] - w["target"]) <= tol), F.lit(0))["label"]
    near = F.array_min(F.transform(w["leaves"], lambda x: F.struct(F.abs(F.abs(x["v"]) - F.abs(w["gap"])).alias("d"), x["label"].alias("label"))))
    small = F.abs(w["gap"]) <= F.abs(F.when(w["target"] == 0, 1.0).otherwise(w["target"])) * 0.15
    return F.when(~w["ok"], F.coalesce(doubled, F.when(small & (near["d"] <= F.abs(w["gap"]) * 0.1), near["label"])))


def worked(w: Column, named: Column) -> Column:
    """The arithmetic in words."""
    n = lambda x: F.format_number(x, 0)
    tail = F.when(named.isNotNull(), F.concat(F.lit("; check row: "), named)).otherwise("")
    text = F.concat(F.lit("sum of "), F.size(w["leaves"]).cast("string"), F.lit(" line items = "), n(w["running"]), F.lit("; printed total = "), n(w["target"]), F.lit("; difference = "), n(w["gap"]), tail)
    return F.when(w["ok"].isNull(), "too few numeric rows to check").otherwise(text)


def last_value(seq: Column, pattern: str) -> Column:
    """The figure of the last line whose label matches."""
    return F.get(F.reverse(F.filter(seq, lambda x: x["label"].rlike(pattern))), F.lit(0))["v"]


def _last_row(data: Column, pattern: str) -> Column:
    return F.array_max(F.filter(F.transform(data, lambda r, i: F.when(r["label"].rlike(pattern), i.cast("int"))), lambda i: i.isNotNull()))


def income_cut(data: Column, cols: Column) -> Column:
    """struct(cut, found): the rows up to the profit for the year, without the tail of earnings per share."""
    profit = _last_row(data, P.PROFIT_ROW)
    tail = F.array_min(F.filter(F.transform(data, lambda r, i: F.when(r["label"].rlike(P.OCI_ROW), i.cast("int"))), lambda i: i.isNotNull()))
    n = F.size(data)
    cut = F.when(profit.isNotNull() & (profit + 1 < n), profit + 1).otherwise(F.coalesce(tail, n))
    found = profit.isNotNull() | tail.isNotNull()

    def trim(k):
        small = F.transform(F.slice(data, 1, k), lambda r: let(F.filter(F.transform(cols, lambda c: F.get(r["cells"], c)["num"]), lambda v: v.isNotNull()), lambda v: (F.size(v) > 0) & F.forall(v, lambda x: F.abs(x) < 1000)))
        return F.aggregate(F.reverse(small), F.struct(k.alias("k"), F.lit(False).alias("stop")), lambda a, s: F.when(a["stop"] | ~s | (a["k"] < 3), F.struct(a["k"].alias("k"), F.lit(True).alias("stop"))).otherwise(F.struct((a["k"] - 1).alias("k"), F.lit(False).alias("stop"))), lambda a: a["k"])

    return F.struct(let(cut, trim).alias("cut"), found.alias("found"))


def balance_checks(seq: Column, tol: float) -> Column:
    """Whether any identity of a balance sheet holds; null if none applies."""
    at = lambda p: last_value(seq, p)
    parts = F.struct(
        at(r"(?i)total assets\b").alias("ta"), at(P.EQUITY).alias("te"), at(r"(?i)total liabilities\b(?!\s+and)").alias("tl"), at(r"(?i)total equity and liabilities\b").alias("teq"), at(r"(?i)net assets\b").alias("na"),
        at(r"(?i)total non[- ]?current assets\b").alias("nca"), at(r"(?i)total current assets\b").alias("ca"), at(r"(?i)total non[- ]?current liabilities\b").alias("ncl"), at(r"(?i)total current liabilities\b").alias("cl"),
    )

    def of(p):
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        checks = F.array(
            F.abs(p["ta"] - (p["nca"] + p["ca"])) <= tol, F.abs(p["ta"] - p["teq"]) <= tol, F.abs(p["ta"] - (p["te"] + p["tl"])) <= tol, F.abs(p["na"] - p["te"]) <= tol,
            F.when(p["ta"].isNull(), F.abs(p["nca"] + p["ca"] - (zero(p["ncl"]) + zero(p["cl"])) - p["te"]) <= tol),
        )
        known = F.filter(checks, lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.exists(known, lambda x: x))

    return let(parts, of)


def cash_flow_check(data: Column, c: Column, least: float) -> Column:
    """The first cash flow identity that applies; null if none does. The tolerance grows with the flows."""
    value = lambda i: F.get(F.get(data, i)["cells"], c)["num"]
    seq = column_of(data, c)
    rows = F.struct(*[_last_row(data, p).alias(k) for k, p in (("op", P.CASH_OPERATING), ("inv", P.CASH_INVESTING), ("fin", P.CASH_FINANCING), ("net", P.CASH_CHANGE), ("fs", P.CASH_BLOCK))])

    def of(i):
        op, inv, fin, net = (value(i[k]) for k in ("op", "inv", "fin", "net"))
        opening, closing, fx = last_value(seq, P.CASH_OPENING), last_value(seq, P.CASH_CLOSING), F.coalesce(last_value(seq, P.CASH_FX), F.lit(0.0))
        tol = F.greatest(F.lit(least), 5e-4 * F.coalesce(F.greatest(F.abs(op), F.abs(fin), F.abs(net), F.abs(closing)), F.lit(0.0)))
        between = lambda a, b: F.aggregate(F.filter(seq, lambda x: (x["at"] > a) & (x["at"] < b)), F.lit(0.0), lambda s, x: s + x["v"])
        fin_sum = F.when(fin.isNotNull() & (i["fin"] > i["fs"]), fin).otherwise(between(i["fs"], i["net"]))
        block = (i["op"] < i["fs"]) & (i["fs"] < i["net"]) & op.isNotNull() & net.isNotNull()
        return F.coalesce(F.abs(op + inv + fin - net) <= tol, F.abs(opening + net + fx - closing) <= tol, F.abs(opening + op + inv + fin + fx - closing) <= tol, F.when(block, F.abs(op + between(i["op"], i["fs"]) + fin_sum - net) <= tol))

    return let(rows, of)


def equity_check(seq: Column, tol: float) -> Column:
    """Closing balance = opening balance + movements, over the last two balances; null with under two movements."""
    balances = F.filter(seq, lambda x: x["label"].rlike(P.BALANCE_ROW))

    def of(b):
        first, last = F.get(b, F.size(b) - 2), F.get(b, F.size(b) - 1)
        moves = F.filter(seq, lambda x: (x["at"] > first["at"]) & (x["at"] < last["at"]) & ~x["label"].rlike(P.BALANCE_ROW) & ~x["label"].rlike(r"(?i)^\s*total\b"))
        return F.when((F.size(b) >= 2) & (F.size(moves) >= 2), F.abs(first["v"] + F.aggregate(moves, F.lit(0.0), lambda s, x: s + x["v"]) - last["v"]) <= tol)

    return let(balances, of)


def foot(tables: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Tables (from read_tables) with foot_by_col (array of col, year, ok, break_label, worked), foots and the final kind."""
    cols, data = F.col("value_cols"), F.col("data")
    out = settle(settle(tables).withColumn("__cut", F.when(F.col("kind") == P.STATEMENTS[0], income_cut(data, cols))))
    # Without the statement's own end, the rows after the last total are tried where the whole walk fails everywhere.
    before = F.slice(data, 1, F.greatest(F.col("__cut.cut") - 1, F.lit(0)))
    out = out.withColumn("__start", F.when(F.col("kind").eqNullSafe(P.STATEMENTS[0]) & ~F.col("__cut.found"), F.coalesce(_last_row(before, P.HARD_TOTAL) + 1, F.lit(0))).otherwise(0))
    out = settle(out)
    part = lambda a: F.slice(data, a + 1, F.greatest(F.col("__cut.cut") - a, F.lit(0)))
    oks = lambda d: F.transform(cols, lambda c: walk(column_of(d, c), config.tol_pl)["ok"])
    holds = lambda d: F.exists(oks(d), lambda x: F.coalesce(x, F.lit(False)))
    out = out.withColumn("__start", F.when(F.col("__start") > 0, F.when(holds(part(F.lit(0))) | ~holds(part(F.col("__start"))), 0).otherwise(F.col("__start"))).otherwise(0))
    out = settle(out).withColumn("__walked", F.when(F.col("kind") == P.STATEMENTS[0], part(F.col("__start"))).otherwise(data))

    def by_column(c, k):
        year = F.coalesce(F.get("years", k).cast("string"), F.concat(F.lit("col "), (k + 1).cast("string")))
        w = F.when(F.col("kind").isin(P.STATEMENTS[0], "note"), walk(column_of(F.col("__walked"), c), config.tol_pl))
        ok = (
            F.when(F.col("kind") == P.STATEMENTS[1], balance_checks(column_of(data, c), config.tol_bs))
            .when(F.col("kind") == P.STATEMENTS[2], cash_flow_check(data, c, config.tol_cashflow))
            .when(F.col("kind") == P.STATEMENTS[3], equity_check(column_of(data, c), config.tol_equity))
        )
        return let(w, lambda x: F.struct(c.alias("col"), year.alias("year"), F.coalesce(x["ok"], ok).alias("ok"), break_label(x, config.tol_pl).alias("break_label"), F.when(x.isNotNull(), worked(x, break_label(x, config.tol_pl))).alias("worked")))

    out = settle(settle(out).withColumn("foot_by_col", F.transform("value_cols", by_column)))
    verdicts = F.transform("foot_by_col", lambda x: x["ok"])
    some = F.exists(verdicts, lambda x: F.coalesce(x, F.lit(False)))
    known, failed = F.exists(verdicts, lambda x: x.isNotNull()), F.forall(verdicts, lambda x: ~F.coalesce(x, F.lit(True)))
    strict = F.col("kind").isin(P.STATEMENTS[2], P.STATEMENTS[3])
    out = out.withColumn("foots", F.when(F.size("value_cols") == 0, None).when(some, True).when(F.when(strict, failed).otherwise(known), False))
    odd = F.col("kind").isin(P.STATEMENTS) & (is_bridge(data, cols) | (~F.coalesce("foots", F.lit(False)) & is_unlike_statement(config)))
    out = settle(out)
    out = settle(out.withColumn("kind", F.when(odd, "table").otherwise(F.col("kind"))))
    plain = F.col("kind") == "table"
    out = out.withColumn("foots", F.when(~plain, F.col("foots"))).withColumn("foot_by_col", F.when(plain, F.slice("foot_by_col", 1, 0)).otherwise(F.col("foot_by_col")))
    return settle(out.drop("__cut", "__start", "__walked"))
