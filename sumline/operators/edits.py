"""Edits as an append-only log, and row and grid actions as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "table_id", order: str = "edit_id") -> DataFrame:
    """The last entry of each key; keys whose last entry is a delete are gone, a restore brings back the last entry before the delete."""
    w = Window.partitionBy(key).orderBy(order)
    content = F.last(F.when(~F.col("op").isin("delete", "restore"), F.col("payload")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("payload", content).withColumn("__n", F.row_number().over(last)).filter("__n = 1 and op <> 'delete'").drop("__n")


def insert_after(rows: Column, i: int, blank: Column) -> Column:
    return F.concat(F.slice(rows, 1, i + 1), F.array(blank), F.slice(rows, i + 2, F.greatest(F.size(rows) - i - 1, F.lit(0))))


def delete_row(rows: Column, i: int) -> Column:
    return F.concat(F.slice(rows, 1, i), F.slice(rows, i + 2, F.greatest(F.size(rows) - i - 1, F.lit(0))))


def split_label(label: Column) -> Column:
    """A label as two, the first with half of the words or one more."""
    words = F.split(F.trim(label), r"\s+")
    half = F.ceil(F.size(words) / 2).cast("int")
    return F.array(F.array_join(F.slice(words, 1, half), " "), F.array_join(F.slice(words, half + 1, F.greatest(F.size(words) - half, F.lit(0))), " "))


def insert_line(bands: Column, at: float) -> Column:
    """Bands (array of lo, hi) with the one around at split there."""
    return F.flatten(F.transform(bands, lambda b: F.when((b["lo"] < at) & (b["hi"] > at), F.array(F.struct(b["lo"].alias("lo"), F.lit(at).alias("hi")), F.struct(F.lit(at).alias("lo"), b["hi"].alias("hi")))).otherwise(F.array(b))))


def move_line(bands: Column, old: float, new: float, tol: float = 0.5) -> Column:
    """Bands with their edges within tol of old moved to new."""
    at = lambda x: F.when(F.abs(x - old) <= tol, F.lit(new)).otherwise(x)
    return F.transform(bands, lambda b: F.struct(at(b["lo"]).alias("lo"), at(b["hi"]).alias("hi")))


def remove_line(bands: Column, at: float, tol: float = 0.5) -> Column:
    """Bands with the two that meet within tol of at merged; an outer edge takes its band away, but the last band stays."""
    ends = F.filter(bands, lambda b: F.abs(b["hi"] - at) <= tol)
    starts = F.filter(bands, lambda b: F.abs(b["lo"] - at) <= tol)
    inner = (F.size(ends) == 1) & (F.size(starts) == 1)
    merged = F.array_sort(F.concat(F.filter(bands, lambda b: (F.abs(b["hi"] - at) > tol) & (F.abs(b["lo"] - at) > tol)), F.array(F.struct(F.get(ends, F.lit(0))["lo"].alias("lo"), F.get(starts, F.lit(0))["hi"].alias("hi")))))
    outer = F.filter(bands, lambda b: (F.abs(b["hi"] - at) > tol) & (F.abs(b["lo"] - at) > tol))
    return F.when(F.size(bands) < 2, bands).when(inner, merged).when(F.size(ends) + F.size(starts) == 1, outer).otherwise(bands)
