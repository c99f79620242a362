"""Accuracy of extracted tables against hand-made ones: cell similarity and alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_similarity(a: Column, b: Column, num_a: Column, num_b: Column) -> Column:
    """1 or 0 for two figures, 0 for a figure and a text, 1 for two blanks, else 1 - edit distance / longer length."""
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    text = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.when(num_a.isNotNull() & num_b.isNotNull(), (num_a == num_b).cast("double")).when(num_a.isNotNull() | num_b.isNotNull(), 0.0).when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(text)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b) -> float:
    """cell_similarity for cells as (text, number)."""
    (ta, na), (tb, nb) = a, b
    if na is not None and nb is not None:
        return float(na == nb)
    if na is not None or nb is not None:
        return 0.0
    x, y = (ta or "").strip(), (tb or "").strip()
    if not x or not y:
        return float(x == y)
    return 1 - _distance(x, y) / max(len(x), len(y))


def align(a: list, b: list, alike) -> tuple[float, list[tuple[int | None, int | None]]]:
    """Global alignment with free gaps at the ends: the sum of alike over matches per match or inner gap, and the pairs."""
    n, m = len(a), len(b)
    if not n and not m:
        return 1.0, []
    sims = [[alike(x, y) for y in b] for x in a]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            up = best[i - 1][j] - (j < m)
            left = best[i][j - 1] - (i < n)
            best[i][j] = max(best[i - 1][j - 1] + sims[i - 1][j - 1], up, left)
    i, j, pairs = n, m, []
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + sims[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif i and (not j or best[i][j] == best[i - 1][j] - (j < m)):
            i -= 1
            pairs.append((i, None))
        else:
            j -= 1
            pairs.append((None, j))
    pairs.reverse()
    hits = [k for k, (x, y) in enumerate(pairs) if x is not None and y is not None]
    if not hits:
        return 0.0, pairs
    inner = sum(1 for k in range(hits[0], hits[-1]) if None in pairs[k])
    return sum(sims[x][y] for x, y in (pairs[k] for k in hits)) / (len(hits) + inner), pairs


def score_tables(cases: DataFrame) -> DataFrame:
    """cases: case, side (truth or found), row_idx, col_idx, txt, num. (case, score, missing, extra): rows are aligned by the score
    of their aligned cells. One case is one group, a table each side."""

    def grid(pdf: pd.DataFrame) -> list:
        rows: dict = {}
        for r in pdf.sort_values(["row_idx", "col_idx"]).itertuples():
            rows.setdefault(r.row_idx, []).append((r.txt, None if pd.isna(r.num) else r.num))
        return list(rows.values())

    def of_case(pdf: pd.DataFrame) -> pd.DataFrame:
        truth, found = grid(pdf[pdf["side"] == "truth"]), grid(pdf[pdf["side"] == "found"])
        score, pairs = align(truth, found, lambda x, y: align(x, y, similarity)[0])
        return pd.DataFrame([(pdf["case"].iloc[0], score, sum(y is None for _, y in pairs), sum(x is None for x, _ in pairs))], columns=["case", "score", "missing", "extra"])

    return cases.groupBy("case").applyInPandas(of_case, "case string, score double, missing long, extra long")
