"""Header rows and columns of typed rows: array<struct<txt, num>>, blank cells with neither."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import let

#: Words of running text, which no column header has; what a year, a unit and a reference look like.
PROSE_WORDS = ["for", "the", "ended", "as", "at", "on", "of", "to", "and", "in", "year"]
HEADER_MARK = r"\b(19|20)\d{2}\b|\b(?i:Notes?)\b|AED|USD|EGP|SAR|['’]000"
YEAR_AND_UNIT = r"(?i)^\s*\(?((?:19|20)\d{2})\)?\s+\(?((?:AED|USD|EGP|SAR)\s*['’]?\s*000\)?)\s*$"
NOTE_REF = r"^\d{1,2}(,\s*\d{1,2})*$"


def _shown(cell: Column) -> Column:
    """A cell as text; null for a blank one. Whole numbers have no point."""
    num = cell["num"]
    whole = F.when(num == F.floor(num), num.cast("decimal(38,0)").cast("string")).otherwise(num.cast("string"))
    return F.coalesce(F.when(F.trim(cell["txt"]) != "", F.trim(cell["txt"])), whole)


def is_title_row(row: Column) -> Column:
    """One filled cell, a text of one to ten words that doesn't end as a sentence or a list does."""
    filled = F.filter(row, lambda c: _shown(c).isNotNull())
    text = F.trim(F.get(filled, F.lit(0))["txt"])
    return F.coalesce((F.size(filled) == 1) & (text != "") & (F.size(F.split(text, r"\s+")) <= 10) & ~text.rlike("[.,;]$"), F.lit(False))


def looks_like_header(row: Column) -> Column:
    """At most eight words with a year, a unit or Notes among them, without words of running text and with less than two figures from 1000 on."""
    large = F.filter(row, lambda c: F.abs(c["num"]) >= 1000)
    words = F.filter(F.split(F.array_join(F.array_compact(F.transform(row, _shown)), " "), r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[,.]+|[,.]+$", ""))
    text = F.array_join(words, " ")
    return (F.size(large) < 2) & F.size(words).between(1, 8) & ~F.arrays_overlap(plain, F.array(*map(F.lit, PROSE_WORDS))) & text.rlike(HEADER_MARK)


def split_year_unit(grid: Column) -> Column:
    """A first row with a year and a unit in one cell as two rows of texts; other grids (array<array<string>>) as they are."""

    def of(first: Column) -> Column:
        years = F.transform(first, lambda c: F.when(c.rlike(YEAR_AND_UNIT), F.regexp_extract(c, YEAR_AND_UNIT, 1)).otherwise(c))
        units = F.transform(first, lambda c: F.when(c.rlike(YEAR_AND_UNIT), F.regexp_extract(c, YEAR_AND_UNIT, 2)))
        return F.when(F.exists(first, lambda c: F.coalesce(c.rlike(YEAR_AND_UNIT), F.lit(False))), F.concat(F.array(years, units), F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))))).otherwise(grid)

    return F.when(F.size(grid) > 0, let(F.get(grid, F.lit(0)), of)).otherwise(grid)


def shift_missing_notes(rows: Column, numbers_refer: bool = True) -> Column:
    """Where some row has a note reference behind its label, rows without one that end in a blank take a blank there, so that figures line up.

    numbers_refer: whether whole numbers below 100 are references too, as where cells were typed by their look; else only texts are, and small figures are figures."""
    is_ref = lambda c: F.coalesce((_shown(c) if numbers_refer else F.trim(c["txt"])).rlike(NOTE_REF), F.lit(False))
    is_value = lambda c: F.coalesce(c["num"].isNotNull() | (F.trim(c["txt"]) == "-"), F.lit(False))
    at = lambda r, i: F.get(r, F.lit(i))

    def shifted(r: Column) -> Column:
        open_end = _shown(F.element_at(r, -1)).isNull()
        blank = F.transform(F.slice(r, 1, 1), lambda c: F.struct(F.lit(None).cast("string").alias("txt"), F.lit(None).cast("double").alias("num")))
        moved = F.concat(F.slice(r, 1, 1), blank, F.slice(r, 2, F.greatest(F.size(r) - 2, F.lit(0))))
        return F.when((F.size(r) >= 3) & open_end & ~is_ref(at(r, 1)) & is_value(at(r, 1)) & is_value(at(r, 2)), moved).otherwise(r)

    has_refs = F.exists(rows, lambda r: (F.size(r) > 1) & is_ref(at(r, 1)))
    return F.when(has_refs, F.transform(rows, shifted)).otherwise(rows)


def is_financial(cells: Column, share: float = 0.35) -> Column:
    """Whether of the filled ones among typed cells so large a share are figures."""
    filled = F.filter(cells, lambda c: F.coalesce(c["txt"] != "", F.lit(False)) | c["num"].isNotNull())
    return (F.size(filled) > 0) & (F.size(F.filter(filled, lambda c: c["num"].isNotNull())) >= share * F.size(filled))


def dressing(cell: Column) -> Column:
    """(p, s, n) of a CELL: prefix, suffix and whether parentheses made it negative; null where there is none of them."""
    prefix, suffix = F.coalesce(cell["prefix"], F.lit("")), F.coalesce(cell["suffix"], F.lit(""))
    return F.when((prefix != "") | (suffix != "") | cell["paren_neg"], F.struct(prefix.alias("p"), suffix.alias("s"), cell["paren_neg"].alias("n")))


def clean_cell(raw: Column) -> Column:
    """struct(txt, num): the plain reading of a cell, a number only if it is one after , $ % and parentheses (either way round) are taken off."""
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[  -​  　]", " "), "\n", " "))
    bare = F.trim(F.regexp_replace(text, "[,$%]", ""))
    negative = bare.rlike(r"(?s)^\(.*\)$|^\).*\($")
    inner = F.when(negative, F.trim(F.regexp_replace(bare, r"(?s)^[()](.*)[()]$", "$1"))).otherwise(bare)
    number = F.when(inner.rlike(r"^-?\d+(\.\d+)?$"), inner.cast("double") * F.when(negative, F.lit(-1.0)).otherwise(1.0) + F.lit(0.0))
    return F.struct(F.when(number.isNull() & (text != ""), text).alias("txt"), number.alias("num"))


# --- columns of a table as a reader arranges them ------------------------------------------------


def select_columns(rows: Column, order: list[int]) -> Column:
    """Rows with the cells of those columns, in that order; also moves columns and leaves some out."""
    return F.transform(rows, lambda r: F.transform(F.array(*map(F.lit, order)), lambda i: F.get(r, i)))


def swap_columns(rows: Column, a: int, b: int) -> Column:
    """Rows with two columns in one another's place, as when two years stand the wrong way round."""
    return F.transform(rows, lambda r: F.transform(r, lambda c, i: F.when(i == a, F.get(r, F.lit(b))).when(i == b, F.get(r, F.lit(a))).otherwise(c)))


def rename_column(rows: Column, header: int, column: int, name: str) -> Column:
    """Rows (array<array<string>>) with that text in a header's cell."""
    return F.transform(rows, lambda r, i: F.transform(r, lambda c, j: F.when((i == header) & (j == column), F.lit(name)).otherwise(c)))
