"""Finding a known table among candidates: share of its known labels, and the order in which candidates are preferred."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIKE = 0.72


def _like(a: str, b: str) -> bool:
    """Whether two upper-cased labels match. The cheap upper bounds are tried first; they never refuse a match."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= LIKE and m.quick_ratio() >= LIKE and m.ratio() >= LIKE


def match_score(labels: Column, known: list[str], foreign: list[str] = ()) -> Column:
    """Share of the known labels that some label of the table resembles, less a half for each foreign one that does.

    Null without known labels; 0 for a table without labels."""
    plain = lambda s: " ".join(s.split()).upper()
    known, foreign = [plain(k) for k in known], [plain(k) for k in foreign]
    if not known:
        return F.lit(None).cast("double")

    @F.pandas_udf("double")
    def of(lists: pd.Series) -> pd.Series:
        out = []
        for labs in lists:
            rows = [plain(x) for x in (labs if labs is not None else []) if x and x.strip()]
            found = lambda k: any(_like(k, r) for r in rows)
            out.append(sum(map(found, known)) / len(known) - 0.5 * sum(map(found, foreign)) if rows else 0.0)
        return pd.Series(out, dtype="float64")

    return of(labels)


def anchored(labels: Column, anchors: list[str], least: int = 2) -> Column:
    """Whether at least that many anchors resemble a label; true without anchors."""
    if not anchors:
        return F.lit(True)
    return F.coalesce(match_score(labels, anchors) * len(anchors) > least - 0.5, F.lit(False))


def plausible(candidates: DataFrame, by: list[str], floor: float = 0.20) -> DataFrame:
    """Candidates (by, page, top, n_rows, score, reconciles, anchored) with three rows or more, one of each page, height and
    length (the first by candidate_id), that score enough or add up over ten rows with some known labels and their anchors."""
    score = F.coalesce(F.col("score"), F.lit(1.0))
    good = (score >= floor) | (F.coalesce(F.col("reconciles"), F.lit(False)) & (F.col("n_rows") >= 10) & (score >= 0.08) & F.col("anchored"))
    one = Window.partitionBy(*by, "page", F.rint(F.coalesce(F.col("top"), F.lit(0.0))), "n_rows").orderBy("candidate_id")
    found = candidates.filter((F.col("n_rows") >= 3) & good).withColumn("score", score)
    return found.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n")


def ranked(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Candidates with place, 1 for the best: its cut-off row found, adds up, anchored, up to two value columns, labelled rows (one decimal),
    score (two), length; ties by candidate_id."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").desc()
    order = [yes("cut_found"), yes("reconciles"), yes("anchored"), F.least(F.col("n_values"), F.lit(2)).desc(), F.bround("labelled", 1).desc(), F.bround("score", 2).desc(), F.desc("n_rows"), F.col("candidate_id")]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
