"""Finding text and tables: page search, statement finder, scan guard, inventory."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import patterns as P

#: What the quick finder looks for, in the order of its answer.
FINDERS = {
    "income statement": r"(?i)statement of (profit or loss|income|comprehensive income)|income statement",
    "statement of financial position": r"(?i)statement of financial position|balance sheet",
    "statement of cash flows": r"(?i)statement of cash flows?|cash flow statement",
    "statement of changes in equity": r"(?i)statement of changes in (shareholders' )?equity",
}


def search(pages: DataFrame, words: str, page: str, text: str, max_hits: int = 300, around: int = 40) -> DataFrame:
    """(page, hits, snippet) of the first max_hits pages that hold words, which needs two characters; case is ignored."""
    low, needle = F.lower(text), words.lower()
    if len(needle) < 2:
        return pages.select(F.col(page).alias("page"), F.lit(0).alias("hits"), F.lit("").alias("snippet")).filter("false")
    at = F.instr(low, needle)
    begin = F.greatest(at - around, F.lit(1))
    found = pages.filter(at > 0).select(F.col(page).alias("page"), F.regexp_count(low, F.lit(re.escape(needle))).alias("hits"), F.substr(text, begin, at - begin + len(needle) + around).alias("snippet"))
    return found.orderBy("page").limit(max_hits)


def quick_find(pages: DataFrame, by: str, page: str, text: str) -> DataFrame:
    """(by, label, page): the first page of each statement."""
    marks = F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in FINDERS.items()])
    return pages.select(by, page, F.explode(F.array_compact(marks)).alias("label")).groupBy(by, "label").agg(F.min(page).alias("page"))


def scanned_files(pages: DataFrame, by: str, page: str, length: Column, config: Config = DEFAULT) -> DataFrame:
    """(by, mean_chars, scanned): files whose first twelve pages hold little text."""
    first = pages.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(page))).filter("__n <= 12")
    return first.groupBy(by).agg((F.sum(length) / F.count("*")).alias("mean_chars")).withColumn("scanned", F.col("mean_chars") < config.scanned_chars_per_page)


#: Words that only a statement holds.
STATEMENT_WORDS = ["profit for the year", "total assets", "total equity", "cash flows from operating", "total comprehensive income", "net profit for the year", "total income"]


def shape(rows: Column) -> Column:
    """statement where any cell's text holds STATEMENT_WORDS; else mostly-text, table or small/other by the shares of long texts and figures
    among all cells below the first row (of a single row: in it), blank ones included."""
    body = F.when(F.size(rows) > 1, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows)
    cells = F.flatten(F.transform(body, lambda r: r["cells"]))
    texts = F.flatten(F.transform(rows, lambda r: F.transform(r["cells"], lambda c: c["txt"])))
    words = F.lower(F.array_join(F.array_compact(texts), " "))
    n = F.greatest(F.size(cells), F.lit(1))
    long_texts = F.size(F.filter(cells, lambda c: F.length(c["txt"]) > 40))
    figures = F.size(F.filter(cells, lambda c: c["num"].isNotNull()))
    named = words.rlike("|".join(STATEMENT_WORDS))
    return F.when(named, "statement").when(long_texts > 0.35 * n, "mostly-text").when(figures / n >= 0.25, "table").otherwise("small/other")


def inventory(tables: DataFrame) -> DataFrame:
    """Tables without mostly-text and small ones, but for statements and notes."""
    known = F.col("kind").isin([*P.STATEMENTS, "note"])
    return tables.filter(known | ((F.col("shape") != "mostly-text") & (F.size("rows") >= 3)))
