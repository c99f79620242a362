"""Labels, years and text predicates, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import FIRST_YEAR, LABEL_ALIASES, LAST_YEAR


def norm_label(s: Column) -> Column:
    """The key under which differently worded labels of a line meet."""
    s = F.regexp_replace(s, r"(?i)\(notes?\s*[\d.,\s]+\)", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9 ]", " "), " +", " "))
    aliases = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABEL_ALIASES.items())])
    return F.coalesce(F.try_element_at(aliases, s), s)


def years_in(s: Column) -> Column:
    """Distinct plausible years in order of first appearance."""
    found = F.transform(F.regexp_extract_all(s, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_distinct(F.filter(found, lambda y: y.between(FIRST_YEAR, LAST_YEAR)))


def is_label(s: Column) -> Column:
    return s.rlike("[A-Za-z]{2,}")


def selection(spec: str, n: int) -> list[int]:
    """"1,3,5-8" as the sorted numbers within 1 to n."""
    out: set[int] = set()
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        if a.isdigit() and (not b or b.isdigit()):
            out.update(range(int(a), int(b or a) + 1))
    return sorted(x for x in out if 1 <= x <= n)


def safe_file_name(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N} .()-]", "_")


def doc_years(file: Column) -> Column:
    """The last year in a file's name and the one before; null without any."""
    last = F.array_max(years_in(F.regexp_replace(file, r"\.[^.]*$", "")))
    return F.when(last.isNotNull(), F.array(last, last - 1))
