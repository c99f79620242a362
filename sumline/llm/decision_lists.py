"""Quality rules as learned decision lists.

Method. Statistics of whole texts are computed for every document. A bounded sample of labelled
rows (the max_labelled smallest hashes of the id, 20,000 by default) trains the list by sequential
covering: a rule grows threshold by threshold by FOIL gain on two thirds of the sample, is pruned
on the other third, and is kept while its precision there holds; covered rows leave, and the next
rule grows. The list comes out as ordered Spark conditional expressions whose first true condition
decides, so that it can be read and applied to any table with the same columns.

Defined cases. Null and empty texts have no words and all statistics zero. Label rows without a
quality are left out; a document with several labels counts by the lowest. Without labels of both
kinds the list is empty and keeps everything that the base rules keep. Repeated rows give repeated
results. An empty table gives an empty result. Columns of the input are untouched by stats().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_pipes", "n_marks", "n_echoes"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLASSES = {"n_symbols": _SYMBOL}
for _name, _chars in (("n_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("n_digits", "0123456789"), ("n_pipes", "|"), ("n_marks", "!?")):
    _CLASSES[_name] = np.zeros(256, bool)
    _CLASSES[_name][[ord(c) for c in _chars]] = True
REPEAT = 8


def _sums(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[cuts[1:]] - total[cuts[:-1]]


def text_counts(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text of a slice."""
    starts, ends, first = tk.words(raw, offs)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _sums(tk.SOLID[raw] & ((raw & 0xC0) != 0x80), offs)
    for name, of in _CLASSES.items():
        out[name] = _sums(of[raw], offs)
    w = tk.word_hashes(raw, starts, ends)
    own = tk.owners(first)
    echo = np.zeros(len(w), bool)
    echo[1:] = (w[1:] == w[:-1]) & (own[1:] == own[:-1])
    out["n_echoes"] = _sums(echo, first)
    # Words in windows that occur twice in their own text.
    h, ok = tk.run_hashes(w, REPEAT), np.flatnonzero(tk.inside(first, REPEAT))
    covered = np.zeros(len(w) + 1, np.int32)
    if len(ok):
        key = h[ok] + tk.mix(own[ok].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(ok), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at = ok[twice]
        covered[at] += 1
        np.add.at(covered, at + REPEAT, -1)
    out["n_repeat_words"] = _sums(np.cumsum(covered)[:-1] > 0, first)
    dup, lines, data = [], [], raw.tobytes()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        full = [x for x in data[a:b].split(b"\n") if x.strip()]
        lines.append(len(full))
        dup.append(len(full) - len(set(full)))
    out["n_lines"], out["n_dup_lines"] = np.array(lines, np.int64), np.array(dup, np.int64)
    return out


def with_counts(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of that name, a struct of COUNTS."""

    def measure(batches):
        for batch in batches:
            for piece, raw, offs in tk.slices(batch, "text"):
                got = text_counts(raw, offs)
                counts = pa.StructArray.from_arrays([pa.array(got[c], pa.int64()) for c in COUNTS], names=COUNTS)
                yield pa.record_batch([*piece.columns, counts], names=[*piece.schema.names, name])

    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return docs.mapInArrow(measure, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def stats(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_counts(rows, "counts").select("doc_id", "counts.*")


#: The features of the rules, each a numerator over a denominator (None: the plain count).
FEATURES = {
    "n_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "words_per_line": ("n_words", "n_lines"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "pipes_per_word": ("n_pipes", "n_words"), "marks_per_word": ("n_marks", "n_words"), "echo_share": ("n_echoes", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # else at or below
    threshold: float

    def of(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, of: str = "") -> Column:
        x = feature_column(self.feature, of)
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def feature_column(name: str, of: str = "") -> Column:
    """of: what stands before the counts' names, as "counts."."""
    over, under = FEATURES[name]
    x = F.col(of + over).cast("double")
    return x if under is None else F.when(F.col(of + under) > 0, x / F.col(of + under).cast("double")).otherwise(F.lit(0.0))


def feature_arrays(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (over, under) in FEATURES.items():
        x = counts[over].astype(float)
        out[name] = x if under is None else np.divide(x, counts[under], out=np.zeros_like(x), where=counts[under] > 0)
    return out


def _covers(rule: list[Condition], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.of(table)
    return hit


def _thresholds(x: np.ndarray, n: int = 40) -> np.ndarray:
    values = np.unique(np.quantile(x, np.linspace(0, 1, n))) if len(x) else x
    return (values[1:] + values[:-1]) / 2


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    rule, hit = [], np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if not n or not p:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for f, x in table.items():
            for t in np.unique(np.concatenate((_thresholds(x[hit & bad]), _thresholds(x[hit])))):
                for above in (True, False):
                    sub = hit & ((x > t) if above else (x <= t))
                    q, m = (sub & bad).sum(), (sub & ~bad).sum()
                    if q and (gain := q * (np.log2(q / (q + m)) - now)) > best[0]:
                        best = (gain, Condition(f, above, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= best[1].of(table)
    return rule


def learn(table: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4, precision: float = 0.95, support: int = 5) -> list[list[Condition]]:
    """Rules that pick bad rows, in the order in which they were found. Every third row prunes; the others grow."""
    turn = np.arange(len(bad)) % 3 == 2
    grow, prune = np.flatnonzero(~turn), np.flatnonzero(turn)
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and bad[grow].any():
        pick = lambda rows: ({f: x[rows] for f, x in table.items()}, bad[rows])
        (tg, bg), (tp, bp) = pick(grow), pick(prune)
        rule = _grow(tg, bg, max_conditions)
        if not rule:
            break

        def worth(r):
            hit = _covers(r, tp, len(bp))
            p, n = (hit & bp).sum(), (hit & ~bp).sum()
            return (p - n) / max(p + n, 1), int(p + n)

        best = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        hit = _covers(best, tp, len(bp))
        p, n = (hit & bp).sum(), (hit & ~bp).sum()
        if p < support or p / max(p + n, 1) < precision:
            break
        rules.append(best)
        grow, prune = grow[~_covers(best, tg, len(bg))], prune[~hit]
    return rules


def rules_column(rules: list[list[Condition]], of: str = "") -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules):
        test = rule[0].column(of)
        for c in rule[1:]:
            test = test & c.column(of)
        out = F.when(test, i + 1) if out is None else out.when(test, i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **options) -> list[list[Condition]]:
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_labelled)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("labelled_id")), F.col("doc_id") == F.col("labelled_id"), "left_semi")
    # Rows that repeat an id are told apart by nothing that matters to a rule; the sample's rows are bounded by max_labelled ids.
    measured = stats(chosen).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in COUNTS])
    rows = measured.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).orderBy(F.xxhash64("doc_id"), "doc_id").select("quality", *COUNTS).toPandas()
    bad = (rows["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    return learn(feature_arrays({c: rows[c].to_numpy() for c in COUNTS}), bad, **options)


def base_failed(of: str = "") -> Column:
    return (F.col(of + "n_words") < 20) | (100 * F.col(of + "n_repeat_words") > 30 * F.col(of + "n_words"))


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, the counts, base_failed, rule (0: none) and kept for each row of docs."""
    rules = fit(docs, labels, **options)
    out = stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", rules_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that neither the base rules nor the learned list reject, unchanged."""
    at = "__counts"
    rules = fit(docs, labels, **options)
    measured = with_counts(docs, at)
    return measured.filter(~base_failed(at + ".") & (rules_column(rules, at + ".") == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
