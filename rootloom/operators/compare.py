"""Comparing the relations of two runs: matching, equality up to noise, impact and ranking.

Left is the slow run, right the fast one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import backward_impact, boosted, forward_impact, negative_event
from ..storage import stored
from .graph import reach

#: Samples up to which the Kolmogorov-Smirnov test is exact; above, its limit serves.
KS_EXACT = 10_000


def match_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """left/right(key, weight): full outer, with the rounded weight difference, or a lone side's own weight."""
    j = left.select("key", F.col("weight").alias("w_left")).join(right.select("key", F.col("weight").alias("w_right")), "key", "full")
    return j.withColumn("delta", F.when(F.col("w_left").isNotNull() & F.col("w_right").isNotNull(), F.bround(F.abs(F.col("w_left") - F.col("w_right")))).otherwise(F.coalesce("w_left", "w_right")))


def top_group(groups: DataFrame) -> DataFrame:
    """The group with the greatest difference (then key): one row."""
    return groups.orderBy(F.desc("delta"), F.desc("key")).limit(1)


def changed_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """match_groups() with the run that alone has the group."""
    return match_groups(left, right).withColumn("only", F.when(F.col("w_right").isNull(), "left").when(F.col("w_left").isNull(), "right"))


def match_relations(left: DataFrame, right: DataFrame, translated: DataFrame, least: float = 5.0) -> DataFrame:
    """left/right(insn, perc, equal columns...), translated(insn, other_insn): pairs and lone relations.

    Left relations first, then rights that none of them met.  Lone ones need `least` percent, pairs a mean of it.
    """
    r = right.select(F.col("insn").alias("r_insn"), F.col("perc").alias("r_perc"))
    a = left.select("insn", "perc").join(translated, "insn", "left").join(r, F.col("other_insn") == F.col("r_insn"), "left").select(F.col("insn").alias("l_insn"), F.col("perc").alias("l_perc"), "r_insn", "r_perc")
    b = r.join(a.filter("r_insn is not null").select("r_insn").distinct(), "r_insn", "left_anti").select(F.lit(None).cast(dict(left.dtypes)["insn"]).alias("l_insn"), F.lit(None).cast("double").alias("l_perc"), "r_insn", "r_perc")
    keep = F.when(F.col("l_insn").isNull() | F.col("r_insn").isNull(), F.coalesce("l_perc", "r_perc") >= least).otherwise((F.col("l_perc") + F.col("r_perc")) / 2 >= least)
    return a.unionByName(b).filter(keep)


def one_sided(relations: DataFrame, symptom: str = "symptom") -> DataFrame:
    """Where only one run has the group: the symptom's own relation."""
    return relations.filter(F.col("insn") == F.col(symptom))


def ks_distance(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left/right(keys, c, n) histograms: the two-sample Kolmogorov-Smirnov distance d, and the sizes.

    The distributions are merged as histograms, so a key costs its number of different counts, not of events.
    """
    both = left.select(*keys, "c", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).union(right.select(*keys, "c", F.lit(0).cast("long"), F.col("n")))
    both = both.groupBy(*keys, "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*keys).orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(w) / F.nullif(F.sum("a").over(every), F.lit(0)) - F.sum("b").over(w) / F.nullif(F.sum("b").over(every), F.lit(0)))
    return both.withColumn("_g", gap).groupBy(*keys).agg(F.max("_g").alias("d"), F.sum("a").alias("n_left"), F.sum("b").alias("n_right"))


@lru_cache(maxsize=65_536)
def ks_p(h: int, n: int, m: int) -> float:
    """Two-sided p-value of the distance h / (n m) between samples of n and m: exact up to KS_EXACT, else the limit.

    Exact: the share of lattice paths from (0, 0) to (n, m) that leave |i m - j n| < h, diagonal by diagonal, as the
    chance that a random path does.
    """
    if h <= 0:
        return 1.0
    if max(n, m) > KS_EXACT:
        en = n * m / (n + m)
        x = h / (n * m) * math.sqrt(en)
        x += 1 / (6 * math.sqrt(en)) + (x - 1) / (4 * en)
        if x <= 0:
            return 1.0
        if x < 1:
            return 1 - math.sqrt(2 * math.pi) / x * sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
        return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 20))
    inside, first = np.ones(1), 0  # chances of i = first, first + 1, ...
    for s in range(1, n + m + 1):
        left = n + m - s + 1
        i = np.arange(first, first + len(inside))
        wide = np.zeros(len(inside) + 1)
        wide[1:] = inside * (n - i) / left
        wide[:-1] += inside * (m - (s - 1 - i)) / left
        low = max(first, s - m, 0, (s * n - h) // (n + m) + 1)
        high = min(first + len(inside), s, n, -((-s * n - h) // (n + m)) - 1)
        if high < low:
            return 1.0
        inside, first = wide[low - first : high - first + 1], low
    return float(1 - inside.sum())


def ks_equal(v: Sequence, n: Sequence, w: Sequence, m: Sequence, least: float = 0.95) -> bool:
    """Whether two samples, values v and w, n and m times each, are equal: p above `least`."""
    total_n, total_m = int(np.sum(n)), int(np.sum(m))
    if not total_n or not total_m:
        return False
    at = np.union1d(v, w)
    a, b = (np.zeros(len(at), np.int64) for _ in range(2))
    np.add.at(a, np.searchsorted(at, v), n)
    np.add.at(b, np.searchsorted(at, w), m)
    h = int(np.abs(a.cumsum() * total_m - b.cumsum() * total_n).max())
    return ks_p(h, total_n, total_m) > least


def ks_test(distances: DataFrame, least: float = 0.95) -> DataFrame:
    """distances from ks_distance() with p, and equal: p above `least`."""

    @F.pandas_udf("double")
    def test(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([ks_p(round(x * int(a) * int(b)), int(a), int(b)) if a and b else None for x, a, b in zip(d, n, m, strict=True)], dtype="float64")

    return distances.withColumn("p", test("d", "n_left", "n_right")).withColumn("equal", F.coalesce(F.col("p") > least, F.lit(False)))


def pass_rates(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """counts(node, succ, n), nodes(node, total): n / total; zero and missing ones go."""
    return counts.join(nodes, "node").filter("n > 0 and total > 0").withColumn("rate", F.col("n") / F.col("total"))


def def_use_rates(flow: DataFrame, counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(def, use, branch, target, rate): for each data-flow edge, the pass rates of the use and of all that it flows on to.

    flow(src, dst): data flow between instructions; counts(branch, target, n): control flow passed; nodes(node, total).
    The walk goes through instructions that have counts, from executed definitions.
    """
    known = stored(counts.select(F.col("branch").alias("node")).distinct())
    ran = nodes.filter("total > 0")
    pairs = flow.select(F.col("src").alias("def"), F.col("dst").alias("use")).distinct().join(ran.select(F.col("node").alias("def")), "def", "left_semi")
    within = flow.select("src", "dst").join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    uses = pairs.select(F.col("use").alias("node")).distinct().join(known, "node", "left_semi")
    met = reach(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), uses, True)  # (node, target): from the use on to the node
    rates = pass_rates(counts.select(F.col("branch").alias("node"), F.col("target").alias("succ"), "n"), ran).select("node", "succ", "rate")
    return pairs.join(met.withColumnRenamed("target", "use"), "use").join(rates, "node").select("def", "use", F.col("node").alias("branch"), F.col("succ").alias("target"), "rate")


def pass_rate_impact(left: DataFrame, right: DataFrame, keys: list[str], points: float = 5.0) -> DataFrame:
    """(keys, impact) of the left's rates that exceed the right's by more than so many points; a rate that the right lacks is 0."""
    j = left.select(*keys, F.col("rate").alias("l")).join(right.select(*keys, F.col("rate").alias("r")), keys, "left")
    return j.withColumn("r", F.coalesce("r", F.lit(0.0))).withColumn("impact", (F.col("l") - F.col("r")) * 100).filter(F.col("impact") > points)


def children_differ(pairs: DataFrame) -> DataFrame:
    """pairs(node, l_perc, r_perc, relaxed_equal, rate_equal): whether a node's one-level relations differ."""
    lone = (F.col("l_perc").isNull() | F.col("r_perc").isNull()) & (F.coalesce("l_perc", "r_perc") >= 5)
    both = F.col("l_perc").isNotNull() & F.col("r_perc").isNotNull() & ~(F.coalesce("relaxed_equal", F.lit(False)) | F.coalesce("rate_equal", F.lit(False)))
    return pairs.groupBy("node").agg(F.bool_or(lone | both).alias("differ"))


def impacts(pairs: DataFrame) -> DataFrame:
    """pairs(l_w, r_w, l_perc, r_perc, l_actual, r_actual): forward impact, and backward impact where it may count."""
    f = forward_impact(F.col("l_w"), F.col("r_w"), F.col("l_perc"))
    b = F.when(negative_event(F.col("l_w"), F.col("r_w"), F.col("l_actual"), F.col("r_actual")), backward_impact(F.col("l_perc"), F.col("r_perc"))).otherwise(F.lit(0.0))
    return pairs.withColumn("forward", f).withColumn("backward", F.when(b > f, b).otherwise(F.lit(0.0)))


def accumulate(nodes: DataFrame, successors: DataFrame, keys: list[str], own: str = "own", forward: str = "forward") -> DataFrame:
    """nodes(keys, own, forward), successors(keys, impact, weight): (keys, new_weight), the weight that the successors explain.

    By falling impact they add impact * weight / 100 until the sum exceeds own, which then caps it.  If the weights met so
    far are less than the forward impact, the rest of it is added; without successors it is the forward impact.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("impact"), F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("impact") * F.col("weight") / 100
    rows = successors.join(nodes.select(*keys, own), keys).withColumn("_part", part).withColumn("_before", F.coalesce(F.sum("_part").over(w), F.lit(0.0)))
    met = rows.filter(F.col("_before") <= F.col(own)).groupBy(*keys).agg(F.sum("_part").alias("_s"), F.sum("weight").alias("_w"))
    capped = F.least(F.col("_s"), F.col(own))
    new = F.when(F.col("_s").isNull(), F.col(forward)).otherwise(capped + F.greatest(F.col(forward) - F.col("_w"), F.lit(0.0)))
    return nodes.join(met, keys, "left").select(*keys, new.alias("new_weight"))


def final_impact(rows: DataFrame) -> DataFrame:
    return rows.withColumn("impact", F.when(F.col("backward") > F.col("forward"), F.least(F.lit(100.0), F.col("backward") + F.col("weight"))).otherwise(F.col("weight")))


def ranked(rows: DataFrame, score, tie: str, top: int | None = None) -> DataFrame:
    """rank 1 is the greatest score, ties by `tie`; top: a report of so many rows, which needs no global window."""
    rows = rows.withColumn("score", score)
    if top is not None:
        rows = rows.orderBy(F.desc("score"), tie).limit(top)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), tie)))


def complex_score(impact, timestamp_perc, corr_perc):
    return (impact + timestamp_perc + corr_perc) / 3


def simple_score(weight_perc, timestamp_perc):
    return (weight_perc + timestamp_perc) / 2


def corr_score(corr):
    return boosted(corr) * 100


def relaxed_dedupe(rows: DataFrame, keys: list[str], order: str = "score", tolerance: float = 0.1) -> DataFrame:
    """rows(keys, insn, score, ratio, prop): by descending score, a row goes if it equals an earlier kept one up to noise.

    Relaxed equality is not transitive, so each key's report is walked in order; rows of other ratios never meet.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "insn"], ascending=[False, True])
        prop = pdf["prop"].to_numpy(float)
        kept, held = [], np.zeros(0)
        for k, p in enumerate(prop):
            gap = np.abs(held - p)
            if not ((gap < 0.01) | ((p > 0) & (gap < tolerance * p))).any():
                kept.append(k)
                held = np.append(held, p)
        return pdf.iloc[kept]

    return rows.groupBy(*keys, "ratio").applyInPandas(run, rows.schema)


def converged(analyse, left: DataFrame, right: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """analyse(run, other) until the difference of the groups stays the same: (left, right, difference); an error if it does not."""
    diff = None
    for _ in range(most):
        left = stored(analyse(left, right))
        right = stored(analyse(right, left))
        new = stored(changed_groups(left, right))
        if diff is not None and new.exceptAll(diff).limit(1).count() == 0 and diff.exceptAll(new).limit(1).count() == 0:
            return left, right, new
        diff = new
    raise RuntimeError(f"the groups still change after {most} rounds")
