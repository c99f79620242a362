"""Tables from cells, and their semantic reading: kind, header, years, value columns, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import patterns as P
from ..functions.numbers import coerce_cell, let, settle
from ..functions.text import is_label, years_in

TABLE = ["table_id", "file", "page", "table_ord", "title"]


def assemble(cells: DataFrame) -> DataFrame:
    """One row per table from cells (TABLE, row_idx, col_idx, raw): rows, an array of row_idx, label and cells, padded to ncols."""
    typed = settle(settle(cells).select(*TABLE, "row_idx", "col_idx", coerce_cell(F.col("raw")).alias("cell")))
    by_row = typed.groupBy(*TABLE, "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "cell"))).alias("at"), F.max("col_idx").alias("last"))
    ordered = by_row.groupBy(*TABLE).agg(F.collect_list(F.struct("row_idx", "at")).alias("raw"), (F.max("last") + 1).cast("int").alias("ncols"))
    blank = F.struct(F.lit(None).cast("string").alias("txt"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("suffix"), F.lit(False).alias("paren_neg"))

    def row(r):
        full = F.transform(F.sequence(F.lit(0), F.col("ncols") - 1), lambda c: F.coalesce(F.try_element_at(r["at"], c), blank))
        return F.struct(r["row_idx"].alias("row_idx"), let(full, row_label).alias("label"), full.alias("cells"))

    rows = F.array_sort(F.transform("raw", row), lambda a, b: a["row_idx"] - b["row_idx"])
    full = settle(settle(ordered).select(*TABLE, "ncols", rows.alias("rows")))
    return settle(full.withColumn("rows", drop_empty(F.col("rows"))))


def row_label(cells: Column) -> Column:
    """The first text cell with two letters in a row, trimmed; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(cells, lambda c: F.trim(c["txt"])), lambda t: t.isNotNull() & is_label(t)), F.lit(0)), F.lit(""))


def drop_empty(rows: Column) -> Column:
    """Without rows whose cells are all blank."""
    return F.filter(rows, lambda r: F.exists(r["cells"], lambda c: c["txt"].isNotNull() | c["num"].isNotNull()))


def numbers(row: Column) -> Column:
    return F.filter(F.transform(row["cells"], lambda c: c["num"]), lambda v: v.isNotNull())


def shown(cell: Column) -> Column:
    return F.coalesce(cell["txt"], F.when(cell["num"] == F.rint(cell["num"]), cell["num"].cast("decimal(20,0)").cast("string")).otherwise(cell["num"].cast("string")))


def row_text(row: Column) -> Column:
    return F.array_join(F.filter(F.transform(row["cells"], shown), lambda t: t.isNotNull()), " ")


def merge_wrapped(rows: Column) -> Column:
    """Rows that go on from the one above joined to it: a lower-case label of up to eight words, or figures without a label.
    The row above must have a label and no figures; it may itself have been joined before."""

    def step(done, r):
        last = F.try_element_at(done, F.lit(-1))
        open_ = (F.size(done) > 0) & (last["label"] != "") & (F.size(numbers(last)) == 0)
        words = F.size(F.split(F.trim(r["label"]), r"\s+"))
        goes_on = r["label"].rlike("^[a-z]") & (words <= 8)
        bare = (r["label"] == "") & (F.size(numbers(r)) > 0)
        label = F.when(goes_on, F.concat(last["label"], F.lit(" "), r["label"])).otherwise(last["label"])
        cells = F.zip_with(last["cells"], r["cells"], lambda a, b: F.when(a["txt"] == last["label"], F.struct(label.alias("txt"), a["num"].alias("num"), a["prefix"].alias("prefix"), a["suffix"].alias("suffix"), a["paren_neg"].alias("paren_neg"))).when(b["num"].isNotNull() | (b["txt"].isNotNull() & ~goes_on), b).otherwise(a))
        merged = F.struct(last["row_idx"].alias("row_idx"), label.alias("label"), cells.alias("cells"))
        return F.when(open_ & (goes_on | bare), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(rows, F.slice(rows, 1, 0), step)


def kind(title: Column, rows: Column) -> Column:
    labels = F.lower(F.array_join(F.transform(rows, lambda r: r["label"]), " || "))

    def of(labs):
        has = lambda *xs: F.lit(False) if not xs else _any([F.contains(labs, F.lit(x)) for x in xs])
        t = F.lower(F.coalesce(title, F.lit("")))
        profit = has("revenue", "total income", "profit for the year", "operating expenses", "operating income")
        balance = has("total assets", "total equity", "total liabilities", "net assets")
        cash = has("operating activities", "financing activities", "investing activities")
        return (
            F.when((t.rlike("profit or loss|income statement|comprehensive income") & profit) | (has("profit for the year") & has("revenue", "total income", "operating expenses")), P.STATEMENTS[0])
            .when((t.rlike("financial position|balance sheet") & balance) | (has("total assets") & has("total equity")), P.STATEMENTS[1])
            .when((t.rlike("cash flow") & cash) | has("cash flows from operating activities"), P.STATEMENTS[2])
            .when(t.rlike("changes in equity") | has("balance at 1 january", "as at 1 january"), P.STATEMENTS[3])
            .when(F.coalesce(title, F.lit("")).rlike(r"^\s*\d{1,2}(\.\d{1,2})*[.\)]?\s+[A-Z]"), "note")
            .otherwise("table")
        )

    return let(labels, of)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _is_year(v: Column) -> Column:
    return F.floor(F.abs(v)).between(P.FIRST_YEAR, P.LAST_YEAR) & (v > 0)


def header_row(rows: Column) -> Column:
    """Index of the header among the first four rows, -1 if none."""

    def step(acc, r):
        nums = numbers(r)
        big = F.exists(nums, lambda v: (F.abs(v) >= 100) & ~_is_year(v))
        text = row_text(r)
        years_only = (F.size(nums) > 0) & F.forall(nums, _is_year) & (r["label"] == "")
        looks = years_only | (~big & ((F.size(years_in(text)) > 0) | text.rlike(P.HEADER_UNITS)))
        return (
            F.when(acc["stop"], acc)
            .when(looks, F.struct((acc["at"] + 1).alias("at"), acc["at"].alias("hdr"), F.lit(False).alias("stop")))
            .otherwise(F.struct((acc["at"] + 1).alias("at"), acc["hdr"].alias("hdr"), (F.size(nums) > 0).alias("stop")))
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("hdr"), F.lit(False).alias("stop"))
    return F.aggregate(F.slice(rows, 1, 4), zero, step, lambda a: a["hdr"])


def read_tables(tables: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """tables (from assemble) with kind, header_idx, data_start, data, years, value_cols, note_col and total_rows.

    The columns doc_years and page_years, arrays of years, are used where the table names none."""
    known = set(tables.columns)
    none = F.lit(None).cast("array<int>")
    doc, page = (F.col(c) if c in known else none for c in ("doc_years", "page_years"))
    out = tables.withColumn("kind", kind(F.col("title"), F.col("rows"))).withColumn("__h", header_row(F.col("rows")))
    out = settle(out).withColumn("data_start", F.when(F.col("__h") >= 0, F.col("__h") + 1).otherwise(0)).withColumn("header_idx", F.greatest("__h", F.lit(0)))
    out = out.withColumn("data", F.slice("rows", F.col("data_start") + 1, F.greatest(F.size("rows") - F.col("data_start"), F.lit(0))))
    out = settle(out)
    of_row = F.transform(F.slice("rows", 1, F.col("header_idx") + 3), lambda r: years_in(row_text(r)))
    head = years_in(F.coalesce(row_text(F.get("rows", F.col("header_idx"))), F.lit("")))
    near = F.get(F.filter(of_row, lambda y: F.size(y) > 0), F.lit(0))
    years = F.when(F.size(head) > 0, head).when(near.isNotNull(), near).otherwise(F.coalesce(doc, page, F.array().cast("array<int>")))
    out = settle(out.withColumn("__y", years))
    years = F.col("__y")
    years = F.when((F.size(years) == 1) & (F.size(doc) > 1) & (F.get(years, F.lit(0)) == F.get(doc, F.lit(1))), doc).otherwise(years)
    out = settle(out.withColumn("years", years))
    years = F.col("years")
    out = out.withColumn("years", F.slice(F.sort_array(F.array_distinct(years), asc=False), 1, 4))

    def column(c):
        vals = F.filter(F.transform("data", lambda r: F.get(r["cells"], c)["num"]), lambda v: v.isNotNull())
        return let(vals, lambda v: F.struct(c.alias("c"), ((F.size(v) >= 3) & (F.size(v) >= 0.3 * F.size("data"))).alias("full"), (F.forall(v, lambda x: F.abs(x) < 1000) & (F.size(v) < 0.7 * F.size("data"))).alias("small")))

    cols = F.when(F.col("ncols") > 1, F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.col("ncols") - 1, F.lit(1))), column), lambda x: x["full"])).otherwise(F.array().cast("array<struct<c:int,full:boolean,small:boolean>>"))
    out = settle(out.withColumn("__c", cols))
    out = out.withColumn("value_cols", F.transform(F.filter("__c", lambda x: ~x["small"]), lambda x: x["c"])).withColumn("note_col", F.get(F.transform(F.filter("__c", lambda x: x["small"]), lambda x: x["c"]), F.lit(0)))
    out = out.withColumn("total_rows", F.filter(F.transform("data", lambda r, i: F.when((r["label"] != "") & r["label"].rlike(P.TOTAL_ROW), (i + F.col("data_start")).cast("int"))), lambda i: i.isNotNull()))
    return settle(out.drop("__h", "__c", "__y"))


def reversed_years(out: Column = None) -> Column:
    """Whether the header lists years oldest first over the value columns."""
    head = F.slice("rows", 1, F.greatest(F.col("data_start"), F.lit(1)))
    seen = F.flatten(F.transform(head, lambda r: F.transform("value_cols", lambda c: F.get(years_in(F.coalesce(shown(F.get(r["cells"], c)), F.lit(""))), F.lit(0)))))
    seen = F.filter(seen, lambda y: y.isNotNull())
    return let(seen, lambda y: (F.size("years") >= 2) & (F.size("value_cols") >= 2) & (F.size(y) >= 2) & (y == F.sort_array(y)))


def is_bridge(data: Column, cols: Column) -> Column:
    """Three value columns of which the first two add up to the third on nearly all full rows."""
    at = lambda r, i: F.get(r["cells"], F.get(cols, F.lit(i)))["num"]
    full = F.filter(F.transform(data, lambda r: F.struct(at(r, 0).alias("a"), at(r, 1).alias("b"), at(r, 2).alias("c"))), lambda v: v["a"].isNotNull() & v["b"].isNotNull() & v["c"].isNotNull())
    return let(full, lambda f: (F.size(cols) == 3) & (F.size(f) >= 5) & (F.size(F.filter(f, lambda v: F.abs(v["a"] + v["b"] - v["c"]) <= F.greatest(F.lit(2.0), F.abs(v["c"]) * 1e-4))) >= 0.85 * F.size(f)))


def is_unlike_statement(config: Config = DEFAULT) -> Column:
    """A table read as a statement that reads like a note or a page of policies."""
    labs = F.lower(F.array_join(F.transform("data", lambda r: r["label"]), " || "))
    anchors = let(labs, lambda t: sum((F.contains(t, F.lit(a)).cast("int") for a in P.ANCHORS), F.lit(0)))
    prose = F.size(F.filter("data", lambda r: ~F.exists(numbers(r), lambda v: F.abs(v) >= 100) & (r["label"].rlike(P.PROSE) | ((r["label"] != "") & (F.size(F.split(r["label"], r"\s+")) >= config.prose_min_words)))))
    total = (F.size("total_rows") > 0) | F.exists("data", lambda r: r["label"].rlike("(?i)total|net (assets|cash|profit)|profit for the year"))
    near = (F.size("years") < 2) | (F.abs(F.get("years", F.lit(0)) - F.get("years", F.lit(1))) <= config.max_year_gap)
    ratio = F.exists("data", lambda r: r["label"].rlike(P.MARGIN_ROW) & (F.size(numbers(r)) > 0) & F.forall(numbers(r), lambda v: F.abs(v) <= 100))
    return (anchors < 3) | (prose > F.size("data") * config.prose_row_ratio) | ~total | ~near | labs.rlike(P.HIGHLIGHTS) | ratio | ((F.col("kind") == P.STATEMENTS[0]) & (F.size("value_cols") >= 4))
