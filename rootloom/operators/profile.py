"""Choosing symptoms from profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalised_weight


def top_by_mass(report: DataFrame, run: str = "run", share: Column | None = None, most: int = 15, mass: float = 99.0, least: float = 1.0) -> DataFrame:
    """report(run, pos, func, pct): rows in report order until pct * share is at most `least`, `most` rows are taken, or the mass reached; the row that crosses it is kept."""
    weighted = F.col("pct") * (F.lit(1.0) if share is None else share)
    w = Window.partitionBy(run).orderBy("pos")
    rows = report.withColumn("weighted", weighted).withColumn("_n", F.row_number().over(w)).withColumn("_mass", F.coalesce(F.sum("pct").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("_stop", F.max((F.col("weighted") <= least).cast("int")).over(w))
    return rows.filter((F.col("_n") <= most) & (F.col("_mass") < mass) & (F.col("_stop") == 0)).drop("_n", "_mass", "_stop")


def top_by_share(report: DataFrame, k: int = 20) -> DataFrame:
    return report.orderBy(F.desc("pct"), "func").limit(k)


def time_shares(totals: DataFrame) -> DataFrame:
    """totals(run, seconds): each run's share of the time; two rows."""
    return totals.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy(F.lit(0))))


def common(reports: DataFrame) -> DataFrame:
    """Functions in every run's report."""
    n = reports.agg(F.count_distinct("run").alias("n"))
    have = reports.groupBy("func").agg(F.count_distinct("run").alias("have"))
    return have.join(F.broadcast(n), F.col("have") == F.col("n")).select("func")  # one row


def without_common_low(top: DataFrame, reports: DataFrame, k: int = 20) -> DataFrame:
    """top less functions common to all runs that are not among the first k of any."""
    best = reports.withColumn("_r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("pct"), "func"))).filter(F.col("_r") <= k).select("func").distinct()
    return top.join(common(reports).join(best, "func", "left_anti"), "func", "left_anti")


def symptoms(top: DataFrame, symbols: DataFrame) -> DataFrame:
    """Functions with their addresses: one row an address, weights are never summed."""
    return top.join(symbols.select("func", "addr").distinct(), "func")


def normalise(symptoms: DataFrame, counts: DataFrame) -> DataFrame:
    """weight / count * 1000; 0 without a count."""
    return symptoms.join(counts, "insn", "left").withColumn("weight", normalised_weight(F.col("weight"), F.coalesce("n", F.lit(0)))).drop("n")
