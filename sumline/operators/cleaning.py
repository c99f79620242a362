"""Grids of printed cells put right before they are read. A grid is array<array<string>>, rows of cells as printed.

Null and empty cells are blank; a null grid gives null, an empty one an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.numbers import let, normspace, settle

_NUMBER = r"^\(?-?[\d,]*\d[\d,]*(\.\d+)?\)?%?$"


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _filled(v: Column) -> Column:
    return F.coalesce(F.trim(v) != "", F.lit(False))


def _indexes(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def padded(grid: Column) -> Column:
    """All rows as long as the longest."""
    return let(grid, lambda g: let(F.coalesce(F.array_max(F.transform(g, lambda r: F.size(r))), F.lit(0)), lambda w: F.transform(g, lambda r: F.concat(r, F.array_repeat(_no_text(), w - F.size(r))))))


def _width(g: Column) -> Column:
    return F.coalesce(F.size(F.get(g, F.lit(0))), F.lit(0))


def merge_currency_columns(grid: Column) -> Column:
    """Columns that hold nothing but a currency sign or an opening parenthesis joined to the column on their right, left to right."""

    def joined(a: Column, b: Column) -> Column:
        return F.when(_filled(a) & _filled(b), F.concat(F.trim(a), F.trim(b))).when(_filled(b), b).otherwise(a)

    def of(g: Column) -> Column:
        def sign(c: Column) -> Column:
            seen = F.filter(F.transform(g, lambda r: F.trim(F.get(r, c))), lambda v: v != "")
            return let(seen, lambda s: (F.size(s) > 0) & F.forall(s, lambda v: v.rlike(P.BARE_CURRENCY)))

        signs = F.transform(_indexes(_width(g)), sign)
        # A column that was just joined to the one before it starts no pair of its own.
        starts = let(signs, lambda s: F.aggregate(_indexes(F.size(s)), F.array().cast("array<boolean>"), lambda acc, c: F.concat(acc, F.array(F.get(s, c) & (c + 1 < F.size(s)) & ~F.coalesce(F.get(acc, c - 1), F.lit(False))))))

        def rows(st: Column) -> Column:
            left = F.filter(_indexes(F.size(st)), lambda c: ~F.coalesce(F.get(st, c - 1), F.lit(False)))
            return F.transform(g, lambda r: F.transform(left, lambda c: F.when(F.get(st, c), joined(F.get(r, c), F.get(r, c + 1))).otherwise(F.get(r, c))))

        return let(starts, rows)

    return let(padded(grid), of)


def merge_year_labels(grid: Column) -> Column:
    """Rows that begin with year, word, year as three cells: one label."""
    row = lambda r: F.when(
        F.coalesce((F.size(r) >= 3) & F.get(r, F.lit(0)).rlike(P.YEAR_TOKEN) & F.get(r, F.lit(1)).rlike(P.YEAR_CONNECTOR) & F.get(r, F.lit(2)).rlike(P.YEAR_TOKEN), F.lit(False)),
        F.concat(F.array(F.concat_ws(" ", *[F.trim(F.get(r, F.lit(i))) for i in range(3)])), F.slice(r, 4, F.greatest(F.size(r) - 3, F.lit(0)))),
    ).otherwise(r)
    return F.transform(grid, row)


def drop_blank(grid: Column) -> Column:
    """Without rows and columns that are blank throughout."""

    def columns(g: Column) -> Column:
        used = F.filter(_indexes(_width(g)), lambda c: F.exists(g, lambda r: _filled(F.get(r, c))))
        return let(used, lambda u: F.transform(g, lambda r: F.transform(u, lambda c: F.get(r, c))))

    return let(padded(F.filter(grid, lambda r: F.exists(r, _filled))), columns)


def desection(label: Column) -> Column:
    """A total's label without the next section's heading, if that has at most four words."""
    s = F.trim(label)
    tail = F.regexp_extract(s, P.GLUED_SECTION, 2)
    return F.when((tail != "") & (F.size(F.split(F.trim(tail), r"\s+")) <= 4), F.trim(F.regexp_extract(s, P.GLUED_SECTION, 1))).otherwise(label)


def deprose(label: Column, has_figure: Column) -> Column:
    """The statement line in a label of six or more words that an auditor's sentence has run into; has_figure: the row has a figure of 100 or more."""
    none = _no_text()
    found = lambda pattern, at=1: F.when(F.regexp_extract(label, pattern, at) != "", F.regexp_extract(label, pattern, at)).otherwise(none)
    phrase = found(P.PHRASE_AT_END)
    line = F.coalesce(found(P.LINE_AT_END), F.when(F.trim(phrase).rlike(P.KNOWN_LINE), phrase), found(P.LINE_AT_START), F.when(has_figure, found(P.LINE_IN_MIDDLE)))
    words = lambda s: F.size(F.split(F.trim(s), r"\s+"))
    return F.when(label.rlike(P.AUDITOR_PROSE) & (words(label) >= 6) & line.isNotNull() & words(line).between(1, 7), F.trim(line)).otherwise(label)


def number(v: Column) -> Column:
    """The plain figure in a printed cell, null if there is none; parentheses are negative."""
    s = F.trim(v)
    size = F.translate(s, "(),%", "").try_cast("double")
    return F.when(s.rlike(_NUMBER), F.when(s.startswith("("), -size).otherwise(size))


def trim_trailing_prose(grid: Column) -> Column:
    """Without the rows after the last figure from the first long or wordy one on; a grid without figures stays."""

    def of(g: Column) -> Column:
        last = F.array_max(F.transform(g, lambda r, i: F.when(F.exists(r, lambda v: number(v).isNotNull()), i)))

        def cut(at: Column) -> Column:
            text = lambda r: F.concat_ws(" ", r)
            wordy = F.array_min(F.transform(g, lambda r, i: F.when((i > at) & ((F.length(text(r)) > 40) | F.lower(text(r)).rlike(P.THREE_LONG_WORDS)), i)))
            return F.when(at.isNull() | wordy.isNull(), g).otherwise(F.slice(g, 1, F.coalesce(wordy, F.lit(0))))

        return let(last, cut)

    return let(grid, of)


def _label_ref(label: Column) -> Column:
    """struct(label, ref): the label without the note reference after it."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(label, P.TRAILING_NOTE, "")), r"^\s*Notes?\s+(?=[A-Z])", "")
    ref = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(label, P.TRAILING_NOTE, 0)), r"\)([a-z0-9]{1,3})\(", "($1)"), r"\s+", " ")
    worded = F.coalesce(bare.rlike("[A-Za-z]{3,}"), F.lit(False))
    return F.struct(F.when(worded, bare).otherwise(label).alias("label"), F.when(worded & (ref != ""), ref).alias("ref"))


def strip_note_refs(tables: DataFrame, grid: str = "grid") -> DataFrame:
    """tables with grid freed of note references and note_refs, a map of lower-case labels to them.

    References go from the end of labels, from the front of figures and, in tables of four or more rows and columns, as a second
    column of which nine tenths look like references and none is a figure of 100 or more. Rows of units alone and rows of years that another row
    has as well go too. Of several references of a label the first stands; those of a column come before those of labels."""
    years = lambda r: F.filter(r, _filled)
    year_row = lambda r: F.exists(r, _filled) & F.forall(years(r), lambda v: F.trim(v).rlike(r"^\(?(19[9]\d|20\d\d)\)?$"))
    unit_row = lambda r: F.exists(r, _filled) & F.forall(years(r), lambda v: F.trim(v).rlike(P.UNIT_CELL)) & ~year_row(r)
    cells = lambda r: F.transform(years(r), lambda v: F.regexp_replace(v, r"\D", ""))
    g = F.col(grid)
    twice = lambda r, i: year_row(r) & F.exists(F.transform(g, lambda o, j: (i != j) & year_row(o) & (F.size(F.array_except(cells(r), cells(o))) == 0)), lambda x: x)
    # Of equal rows of years none would be left by the plain rule; the first stays here.
    first = lambda r, i: F.exists(F.transform(g, lambda o, j: (j < i) & year_row(o) & (cells(o) == cells(r))), lambda x: x)
    wider = lambda r, i: F.exists(F.transform(g, lambda o, j: year_row(o) & (F.size(F.array_except(cells(r), cells(o))) == 0) & (cells(o) != cells(r))), lambda x: x)
    kept = F.filter(g, lambda r, i: ~unit_row(r) & ~(twice(r, i) & (first(r, i) | wider(r, i))))
    out = settle(tables.withColumn(grid, kept))

    def row(r: Column) -> Column:
        lead = F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda v: F.struct(F.regexp_replace(v, P.LEADING_NOTE, "").alias("v"), F.trim(F.regexp_extract(v, P.LEADING_NOTE, 0)).alias("ref")))
        in_figure = F.get(F.filter(F.transform(lead, lambda x: x["ref"]), lambda x: x != ""), F.lit(0))
        return let(_label_ref(F.get(r, F.lit(0))), lambda lab: F.struct(F.concat(F.array(lab["label"]), F.transform(lead, lambda x: x["v"])).alias("cells"), F.coalesce(lab["ref"], in_figure).alias("ref")))

    out = settle(out.withColumn("__r", F.transform(F.filter(grid, lambda r: F.size(r) > 0), row)))
    wide = F.filter("__r", lambda r: F.size(r["cells"]) >= 4)
    second = F.filter(F.transform(wide, lambda r: F.trim(F.get(r["cells"], F.lit(1)))), lambda v: ~F.coalesce(F.lower(v).isin("note", "notes"), F.lit(False)))
    out = settle(out.withColumn("__2", second).withColumn("__wide", F.size(wide)))
    like = lambda v: ~_filled(v) | F.coalesce(F.when(number(v).isNotNull(), (number(v) > 0) & (number(v) < 100) & (F.abs(number(v) * 10 - F.round(number(v) * 10)) < 1e-6)).otherwise(v.rlike(P.NOTE_MARK)), F.lit(False))
    n_like, n_refs = F.size(F.filter("__2", like)), F.size(F.filter("__2", lambda v: _filled(v) & F.coalesce(F.abs(number(v)) < 100, F.lit(True)) & (F.coalesce(number(v), F.lit(1.0)) != 0)))
    narrow = F.exists("__r", lambda r: (F.size(r["cells"]) == 3) & F.exists(F.slice(r["cells"], 2, 2), lambda v: number(v).isNotNull()))
    gone = (F.col("__wide") > 0) & (F.size("__r") >= 4) & ~F.exists("__2", lambda v: F.coalesce(F.abs(number(v)) >= 100, F.lit(False))) & (n_like >= F.size("__2") * 0.9) & ((n_refs >= 1) | narrow)
    out = settle(out.withColumn("__gone", gone).withColumn("__n", n_refs))
    key = lambda r: F.lower(normspace(F.get(r["cells"], F.lit(0))))
    pairs = lambda ref: F.filter(F.transform("__r", lambda r: F.struct(key(r).alias("key"), ref(r).alias("value"))), lambda p: (p["key"] != "") & p["value"].isNotNull())
    from_column = F.when(F.col("__gone") & (F.col("__n") >= 2), pairs(lambda r: F.when((F.size(r["cells"]) >= 4) & _filled(F.get(r["cells"], F.lit(1))), F.trim(F.get(r["cells"], F.lit(1))))))
    every = F.concat(F.coalesce(F.reverse(from_column), F.array().cast("array<struct<key:string,value:string>>")), pairs(lambda r: r["ref"]))
    # The first of each key: sorted by key and place, those that differ from the one before, so that long tables need no look back at all rows.
    placed = F.array_sort(F.transform(every, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value"))))
    unique = let(placed, lambda e: F.transform(F.filter(e, lambda p, i: (i == 0) | (p["key"] != F.get(e, i - 1)["key"])), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))))
    rows = F.transform("__r", lambda r: F.when(F.col("__gone") & (F.size(r["cells"]) >= 4), F.concat(F.slice(r["cells"], 1, 1), F.slice(r["cells"], 3, F.greatest(F.size(r["cells"]) - 2, F.lit(0))))).otherwise(r["cells"]))
    return out.withColumn(grid, rows).withColumn("note_refs", F.map_from_entries(unique)).drop("__r", "__2", "__wide", "__gone", "__n")


def clean(grid: Column) -> Column:
    """All steps on raw cells in their order; labels are the first cells."""

    def labels(r: Column) -> Column:
        rest = F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
        label = deprose(desection(F.get(r, F.lit(0))), F.exists(rest, lambda v: F.coalesce(F.abs(number(v)) >= 100, F.lit(False))))
        return F.concat(F.array(label), rest)

    return F.transform(drop_blank(merge_year_labels(merge_currency_columns(grid))), labels)
