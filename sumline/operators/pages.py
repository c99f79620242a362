"""Pages: what is in a box, printed page numbers, the order in which pages are looked at, labels left of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least size of a table in points, the share of a page that no table covers, the least share of filled cells, and
#: for tables of few rows the least share of the words in the box that the cells hold.
MIN_WIDTH, MIN_HEIGHT, WHOLE_PAGE, MIN_FILLED, FEW_ROWS, MIN_CAPTURED = 45, 8, 0.9, 0.15, 3, 0.6


def box_has_text(boxes: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """boxes (by, box_id, x0, y0, x1, y1) with has_text: whether a word (by, wx, wy: its centre) lies in the box.

    Boxes and words of a page meet on by; both are bounded by the page."""
    inside = F.col("wx").between(F.col("x0"), F.col("x1")) & F.col("wy").between(F.col("y0"), F.col("y1"))
    hit = boxes.join(words.select(*by, "wx", "wy"), by).filter(inside).select(*by, "box_id").distinct().withColumn("has_text", F.lit(True))
    return boxes.join(hit, [*by, "box_id"], "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))


def display_page(label: Column, page: Column) -> Column:
    """The printed page number, with the page of the file where they differ; else the file's."""
    number = page.cast("string")
    return F.when(label.isNotNull() & (label != "") & (label != number), F.concat(label, F.lit(" (PDF page "), number, F.lit(")"))).otherwise(number)


def scan_order(pages: DataFrame, by: list[str], page: str, hint: Column) -> DataFrame:
    """pages with place, from 0: the hinted page (clipped to the file) first and then outwards, the lower page first; without a hint in order."""
    whole = Window.partitionBy(*by)
    centre = F.greatest(F.min(page).over(whole), F.least(F.max(page).over(whole), hint))
    away = F.when(hint.isNull() | (hint == 0), F.col(page)).otherwise(F.abs(F.col(page) - centre))
    out = pages.withColumn("__away", away)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("__away", page)) - 1).drop("__away")


def is_junk(grid: Column, width: Column, height: Column, page_width: Column, page_height: Column, words_in_box: Column) -> Column:
    """Whether a found table is none: too small, the whole page, nearly empty, or of few rows that miss most words of its box."""
    cells = F.flatten(grid)
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    captured = F.aggregate(filled, F.lit(0), lambda n, c: n + F.size(F.split(F.trim(c), r"\s+")))
    small = (width < MIN_WIDTH) | (height < MIN_HEIGHT)
    whole = (width >= page_width * WHOLE_PAGE) & (height >= page_height * WHOLE_PAGE)
    empty = F.size(filled) < MIN_FILLED * F.size(cells)
    missed = (F.size(grid) <= FEW_ROWS) & (words_in_box > 0) & (captured < MIN_CAPTURED * words_in_box)
    return small | whole | (F.size(cells) == 0) | empty | missed


def left_labels(rows: DataFrame, words: DataFrame, by: list[str], reach: float = 5.0, slack: float = 1.0) -> DataFrame:
    """rows (by, row_idx, top, bot, search_x0, region_x0) with label: the words (by, text, x0, top) in the row's band and left of its
    region, line by line from the top and each line from the left; null where there is none."""
    band = F.col("w_top").between(F.col("top") - slack, F.col("bot") + slack)
    left = (F.col("w_x0") >= F.col("search_x0") - reach) & (F.col("w_x0") < F.col("region_x0"))
    named = words.select(*by, F.col("text").alias("w_text"), F.col("x0").alias("w_x0"), F.col("top").alias("w_top"))
    found = rows.select(*by, "row_idx", "top", "bot", "search_x0", "region_x0").join(named, by).filter(band & left)
    ordered = F.array_sort(F.collect_list(F.struct(F.bround("w_top").alias("line"), F.col("w_x0").alias("x"), F.col("w_text").alias("text"))))
    labels = found.groupBy(*by, "row_idx").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("label"))
    return rows.join(labels, [*by, "row_idx"], "left")


def spanned(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, row_idx, col_idx, text): every place that a cell (row_nums, column_nums, text) covers; of two cells on one place the later (ord) stands."""
    places = cells.withColumn("row_idx", F.explode("row_nums")).withColumn("col_idx", F.explode("column_nums"))
    text = F.trim("text")
    last = F.max_by(F.struct(F.when(text != "", text).alias("text")), "ord")
    return places.groupBy(*by, "row_idx", "col_idx").agg(last.alias("__c")).select(*by, "row_idx", "col_idx", F.col("__c.text").alias("text"))


def sample_tables(tables: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n tables in an order that the seed decides."""
    return tables.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
