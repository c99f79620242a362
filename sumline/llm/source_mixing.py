"""Mixing sources to target weights by iterative proportional fitting.

Method. Tokens are summed by cell, a combination of source, language and topic. Raking multiplies
the cells' weights in turn so that the weighted tokens of each source, language and topic meet
their target shares. The weights are calibrated to keeping probabilities by raking on under the cap of one, until
the expected kept tokens of each category are its goal, and a document stays if a seeded hash of it falls below
the probability of its cell. So it is the sample that meets the targets, as far as that can be done without
repeating documents; goals that can't be met are reported.

Topics are told by form, from counts alone, as the documents have no topic of their own; a caller with topics
gives docs with n_tokens and topic to mixed() instead.

The driver holds one row per cell, at most max_cells (else an error); sums are over all documents.

Defined cases. A null source, language or topic is a category of its own. Null and empty texts
have no tokens and share their cell's probability; a cell without tokens keeps all. Rows that repeat id
and text share one fate, and so do ties, as nothing is ranked. Texts may be of any length. An empty table gives an
empty result. sample_mix() passes all columns through, whatever their names; measured() and mixed() replace columns
named as those they add.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import put_back, set_aside

MARGINS = ["source", "lang", "topic"]
OWN = ["n_tokens", "topic", "weight", "probability", "kept"]
#: Topics by form, told from counts alone: at most so many words, or so many words a line or bars a word.
SHORT, LONG, TERSE, BARS = 60, 1200, 6, 0.2
_BAR = np.arange(256) == ord("|")
_LINE = np.arange(256) == 10


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_tokens (words) and topic (the form of the text: table, list, note, article, essay)."""
    docs = docs.drop("n_tokens", "topic")

    def measure(batches):
        for batch in batches:
            for piece, raw, offs in tk.slices(batch, "text"):
                solid = tk.SOLID[raw]
                begins = solid.copy()
                begins[1:] &= ~solid[:-1]
                inner = offs[1:-1][offs[1:-1] < len(raw)]
                begins[inner] = solid[inner]
                count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offs])
                n, bars, lines = count(begins), count(_BAR[raw]), count(_LINE[raw]) + 1
                names = np.array(["table", "list", "note", "essay", "article"])
                topic = names[np.select([bars > BARS * np.maximum(n, 1), (n < TERSE * lines) & (n > SHORT), n <= SHORT, n >= LONG], [0, 1, 2, 3], 4)]
                yield pa.record_batch([*piece.columns, pa.array(n, pa.int64()), pa.array(topic.tolist(), pa.string())], names=[*piece.schema.names, "n_tokens", "topic"])

    return docs.mapInArrow(measure, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("topic", T.StringType())]))


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, error: float = 1e-10) -> np.ndarray:
    """Weights of the cells whose weighted tokens meet each margin's target shares. codes: each cell's category per margin."""
    total, weights = tokens.sum(), np.ones(len(tokens))
    if not total:
        return weights
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, weights * tokens, len(target)) / total
            factor = np.divide(target, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(factor - 1)[target > 0].max(initial=0)))
            weights = weights * factor[code]
        if worst < error:
            break
    return weights


def _filled(total: np.ndarray, wish: np.ndarray, budget: float) -> np.ndarray:
    """min(total, c * wish) with the c at which the sum is the budget."""
    if budget >= total.sum():
        return total.astype(float)
    low, high = 0.0, 1.0
    while np.minimum(total, high * wish).sum() < budget:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(total, mid * wish).sum() < budget else (low, mid)
    return np.minimum(total, high * wish)


def calibrated(weights: np.ndarray, tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], rounds: int = 300, error: float = 1e-6) -> np.ndarray:
    """Keeping probabilities of the cells, at most 1, whose expected tokens meet every margin's goals.

    Raking goes on under the cap: each step scales one category until its capped expectation is its goal. A goal
    above what the category can give leaves all of it."""
    total = tokens.sum()
    if not total:
        return np.ones(len(tokens))
    u = weights * (goals[0].sum() / max((weights * tokens).sum(), 1e-300))
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals):
            held = lambda f: np.bincount(code, np.minimum(1, f[code] * u) * tokens, len(goal))  # noqa: E731, B023
            worst = max(worst, float(np.abs(held(np.ones(len(goal))) - goal).max()) / total)
            low, high = np.zeros(len(goal)), np.full(len(goal), 1e9)
            for _ in range(100):
                mid = np.sqrt(np.maximum(low, 1e-12) * high)
                under = held(mid) < goal
                low, high = np.where(under, mid, low), np.where(under, high, mid)
            u = np.clip(u * high[code], 1e-30, 1e30)
        if worst < error:
            break
    return np.minimum(1, u)


@dataclass
class Mix:
    """What is decided for each cell, and which goals can't be met: (margin, category, goal, expected tokens)."""

    cells: list
    weights: np.ndarray
    chance: np.ndarray
    unmet: list[tuple]


def plan_mix(docs: DataFrame, share: float = 0.8, targets: dict[str, dict] | None = None, power: float = 0.7, max_cells: int = 1_000_000) -> Mix:
    """Weights and probabilities for docs (with n_tokens and the MARGINS).

    targets: shares by margin and category. Categories of other margins get tokens ** power, but never more than they have, so
    that such goals can be met within a margin; what the margins ask for together may still not be, and is reported."""
    cells = docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).limit(max_cells + 1).collect()
    if len(cells) > max_cells:
        raise ValueError(f"more than {max_cells} cells of {MARGINS}")
    cells.sort(key=lambda r: tuple((r[m] is None, r[m] or "") for m in MARGINS))
    tokens, codes, goals, labels = np.array([r.tokens or 0 for r in cells], float), [], [], []
    budget = share * tokens.sum()
    for m in MARGINS:
        names = list(dict.fromkeys(r[m] for r in cells))
        place = {k: i for i, k in enumerate(names)}
        code = np.array([place[r[m]] for r in cells], np.int64)
        sums = np.bincount(code, tokens, len(names))
        asked = (targets or {}).get(m)
        if asked:  # a category that isn't named keeps its own share
            wish = np.array([asked.get(k, sums[i] / max(tokens.sum(), 1)) if sums[i] else 0.0 for i, k in enumerate(names)])
            goal = budget * wish / max(wish.sum(), 1e-300)
        else:
            goal = _filled(sums, np.where(sums > 0, sums, 1) ** power * (sums > 0), budget)
        codes.append(code)
        goals.append(goal)
        labels.append(names)
    if not cells:
        return Mix([], np.empty(0), np.empty(0), [])
    weights = rake(tokens, codes, [g / max(g.sum(), 1e-300) for g in goals])
    chance = np.where(tokens > 0, calibrated(weights, tokens, codes, goals), 1.0)
    unmet = []
    for m, code, goal, names in zip(MARGINS, codes, goals, labels):
        got = np.bincount(code, chance * tokens, len(names))
        unmet += [(m, names[i], goal[i], got[i]) for i in np.flatnonzero(np.abs(got - goal) > 0.01 * np.maximum(goal, 1)).tolist()]
    return Mix(cells, np.where(tokens > 0, weights, weights.max(initial=1)), chance, unmet)


def mixed(docs: DataFrame, share: float = 0.8, targets: dict[str, dict] | None = None, seed: int = 23, **options) -> DataFrame:
    """docs (with n_tokens and the MARGINS) with weight, probability and kept. Goals that can't be met are warned of."""
    spark = docs.sparkSession
    docs = docs.drop("weight", "probability", "kept")
    mix = plan_mix(docs, share, targets, **options)
    if mix.unmet:
        warnings.warn("not to be met without repeating rows: " + ", ".join(f"{m} {k}: {got:.0f} of {goal:.0f} tokens" for m, k, goal, got in mix.unmet[:20]), stacklevel=2)
    rates = spark.createDataFrame([(*(r[m] for m in MARGINS), float(w), float(p)) for r, w, p in zip(mix.cells, mix.weights, mix.chance)], ", ".join([*(f"__{m} string" for m in MARGINS), "weight double", "probability double"]))
    same = [F.col(f"`{m}`").eqNullSafe(F.col(f"__{m}")) for m in MARGINS]
    out = docs.join(F.broadcast(rates), same, "left").drop(*[f"__{m}" for m in MARGINS])  # at most max_cells rows
    # 53 bits of a hash as a number from 0 to 1.
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    return out.withColumn("kept", draw < F.col("probability"))


def sample_mix(docs: DataFrame, share: float = 0.8, **options) -> DataFrame:
    """The sampled rows of docs, unchanged."""
    out = mixed(measured(set_aside(docs, OWN)), share, **options)
    return put_back(out.filter("kept"), docs.columns)
