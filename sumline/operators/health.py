"""How far labels and figures of a table can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import patterns as P
from ..functions.numbers import let, settle
from .statements import numbers


def label_reason(row: Column) -> Column:
    """Why a row's label is suspect; null if it isn't."""
    label = row["label"]
    figures = F.exists(numbers(row), lambda v: F.abs(v) >= 100)
    words = F.when(label == "", 0).otherwise(F.size(F.split(label, r"\s+")))
    known = label.rlike(P.KNOWN_LINE)
    return (
        F.when(figures & (label == ""), "figures with no label")
        .when(~figures & label.rlike(P.PROSE) & ~known & (words >= 8), "reads as a prose sentence")
        .when(words >= 14, "very long label (probably merged text)")
        .when(label.rlike("^[a-z]") & ~label.rlike(r"^[a-z]+\)") & ~known, "starts lower-case (leading word clipped?)")
        .when(label.rlike("[A-Z]{5,}") & label.rlike("[a-z]"), "embedded ALL-CAPS run (section header welded in)")
    )


def _score(scored: Column, suspect: Column) -> Column:
    return F.when(scored == 0, F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1 - suspect / scored), 3))


def with_health(tables: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Tables (from read_tables) with health_labels and health_figures (score, suspect, scored) and health, the lower score."""
    scored = F.filter("data", lambda r: (r["label"] != "") | F.exists(numbers(r), lambda v: F.abs(v) >= 100))
    bad = F.filter(F.transform(scored, lambda r: F.struct(r["row_idx"].alias("row_idx"), r["label"].alias("label"), label_reason(r).alias("why"))), lambda x: x["why"].isNotNull())
    out = settle(tables).withColumn("health_labels", F.struct(_score(F.size(scored), F.size(bad)).alias("score"), bad.alias("suspect"), F.size(scored).alias("scored")))

    def of_column(c):
        sizes = F.sort_array(F.filter(F.transform("data", lambda r: F.abs(F.get(r["cells"], c)["num"])), lambda v: v > 0), asc=False)
        logs = F.transform(sizes, F.log10)
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        mean = total(logs) / F.size(logs)
        spread = let(mean, lambda m: F.when(F.size(logs) >= 2, F.sqrt(total(F.transform(logs, lambda x: (x - m) * (x - m))) / (F.size(logs) - 1))).otherwise(0.0))
        return F.struct(c.alias("c"), F.when(F.size(logs) > 0, mean).otherwise(0.0).alias("mean"), spread.alias("sd"), F.coalesce(F.get(sizes, F.lit(1)), F.get(sizes, F.lit(0)), F.lit(0.0)).alias("second"))

    out = settle(settle(out).withColumn("__s", F.transform("value_cols", of_column)))

    def why(r, i):
        vals = F.transform("__s", lambda s: F.struct(F.get(r["cells"], s["c"])["num"].alias("v"), s.alias("s")))
        vals = F.filter(vals, lambda x: x["v"].isNotNull())
        plain = ~F.array_contains("total_rows", (i + F.col("data_start")).cast("int")) & ~r["label"].rlike(P.HARD_TOTAL)
        far = F.exists(vals, lambda x: (x["v"] != 0) & (x["s"]["sd"] > 0) & (F.log10(F.abs(x["v"])) > x["s"]["mean"] + config.figure_outlier_sd * x["s"]["sd"]) & (F.abs(x["v"]) > 8 * x["s"]["second"]))
        sizes = F.filter(F.transform(vals, lambda x: F.abs(x["v"])), lambda v: v > 0)
        apart = (F.size(vals) >= 2) & (F.size(sizes) >= 2) & (F.array_max(sizes) / F.array_min(sizes) >= 100)
        return F.struct(r["row_idx"].alias("row_idx"), r["label"].alias("label"), (F.size(vals) > 0).alias("scored"), F.when(plain & far, "magnitude outlier for its column (extra digit?)").when(apart, "one year is ~100x the other, mis-read?").alias("why"))

    judged = F.transform("data", why)
    out = settle(out.withColumn("__j", judged))
    out = settle(out.withColumn("__j", F.filter("__j", lambda x: x["scored"])))
    suspect = F.transform(F.filter("__j", lambda x: x["why"].isNotNull()), lambda x: F.struct(x["row_idx"].alias("row_idx"), x["label"].alias("label"), x["why"].alias("why")))
    out = out.withColumn("health_figures", F.struct(_score(F.size("__j"), F.size(suspect)).alias("score"), suspect.alias("suspect"), F.size("__j").alias("scored")))
    return out.withColumn("health", F.least("health_labels.score", "health_figures.score")).drop("__s", "__j")
