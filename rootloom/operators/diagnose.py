"""Comparing two runs from end to end: groups of relations, the relations in them, their impact, and a ranked report.

Left is the slow run, right the fast one.  Tables, all of which may hold many groups at once:

* relations(grp, insn, key, perc, actual, ts, duplicate, fwd, bwd): `key` names the instruction in both builds; fwd and bwd
  are structs SIDE.  A side without `v` is an invariance: `ratio`, under a condition if `prop` is given.  With `v` it is
  a distribution of the values v, n times each, of mean `ratio`; wv and wn are the weighted one.
* children(parent, insn, key, perc, fwd, bwd): one-level relations of parent's own group.
* successors(grp, insn, succ), counts(insn, n), rates(def, use, branch, target, rate).

Everything is joins and windows on (grp, instruction); Python only judges pairs of relations for equality up to noise,
batch by batch, and walks the one-sided relations of a report, which are kept or not in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import backward_impact, correlation, forward_impact
from ..storage import stored
from .compare import accumulate, ks_equal, match_groups

SIDE = "struct<ratio:double,prop:double,v:array<double>,n:array<long>,wv:array<double>,wn:array<long>>"
RELATION = ["insn", "key", "perc", "actual", "ts", "duplicate", "fwd", "bwd"]
LEAST = 5.0


def _none(x) -> bool:
    return x is None or (isinstance(x, float) and x != x)


def sides_equal(a: dict, b: dict, n_a: float | None = None, n_b: float | None = None) -> bool:
    """Relaxed equality of two sides; counts, if given, may excuse different proportions.  Neither symmetric nor transitive."""
    if _none(a["ratio"]) and _none(b["ratio"]):
        return True
    if (a["v"] is None) != (b["v"] is None):
        return False
    if a["v"] is not None:
        if ks_equal(a["v"], a["n"], b["v"], b["n"]):
            return True
        weighted = all(x["wv"] is not None and len(x["wv"]) for x in (a, b))
        return bool(weighted) and ks_equal(a["wv"], a["wn"], b["wv"], b["wn"])
    if a["ratio"] != b["ratio"]:
        return False
    p, q = a["prop"], b["prop"]
    if _none(p) or _none(q):
        return _none(p) == _none(q) or (q if _none(p) else p) >= 0.99
    gap = abs(p - q)
    if p == q or gap / p < 0.1 or gap < 0.01:
        return True
    return not _none(n_a) and not _none(n_b) and round(n_a * p) == round(n_b * q)


def _records(side: pd.DataFrame) -> list[dict]:
    return side.to_dict("records")


def relations_equal(l_fwd: Column, r_fwd: Column, l_bwd: Column, r_bwd: Column, l_n: Column | None = None, r_n: Column | None = None) -> Column:
    """Both directions equal up to noise; counts bear on the backward one alone."""
    none = F.lit(None).cast("double")

    @F.pandas_udf("boolean")
    def equal(lf: pd.DataFrame, rf: pd.DataFrame, lb: pd.DataFrame, rb: pd.DataFrame, ln: pd.Series, rn: pd.Series) -> pd.Series:
        rows = zip(_records(lf), _records(rf), _records(lb), _records(rb), ln, rn, strict=True)
        return pd.Series([sides_equal(a, b) and sides_equal(c, d, n, m) for a, b, c, d, n, m in rows], dtype="bool")

    return equal(l_fwd, r_fwd, l_bwd, r_bwd, none if l_n is None else l_n.cast("double"), none if r_n is None else r_n.cast("double"))


def _as(df: DataFrame, prefix: str, cols=RELATION) -> DataFrame:
    return df.select("grp", *[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def _lone(df: DataFrame, prefix: str) -> DataFrame:
    """One-sided relations worth a row."""
    return df.filter((F.col(f"{prefix}_perc") >= LEAST) & ~F.coalesce(f"{prefix}_duplicate", F.lit(False)))


def _differing(pairs: DataFrame) -> DataFrame:
    """Pairs that contribute and are not equal up to noise."""
    some = pairs.filter((F.col("l_perc") + F.col("r_perc")) / 2 >= LEAST)
    return some.filter(~relations_equal(F.col("l_fwd"), F.col("r_fwd"), F.col("l_bwd"), F.col("r_bwd")))


def pair_relations(left: DataFrame, right: DataFrame, to_right: DataFrame | None = None, to_left: DataFrame | None = None) -> DataFrame:
    """(grp, l_*, r_*) of relations to examine in groups that both runs have.

    to_right(insn, other_insn) and to_left name an instruction's match in the other build; without them keys must agree.
    Lefts look for their right; rights that no kept pair has then look for their left, so several may share a match.
    """
    a, b = _as(left, "l"), _as(right, "r")

    def met(x: DataFrame, own: str, y: DataFrame, other: str, table: DataFrame | None) -> DataFrame:
        if table is None:
            return x.join(y, (x["grp"] == y["grp"]) & (x[f"{own}_key"] == y[f"{other}_key"]), "left").drop(y["grp"])
        named = x.join(table.select(F.col("insn").alias(f"{own}_insn"), F.col("other_insn").alias("_o")), f"{own}_insn", "left")
        return named.join(y, (named["grp"] == y["grp"]) & (named["_o"] == y[f"{other}_insn"]), "left").drop(y["grp"]).drop("_o")

    order = ["grp", *[f"l_{c}" for c in RELATION], *[f"r_{c}" for c in RELATION]]
    first = met(a, "l", b, "r", to_right).select(*order)
    paired = stored(_differing(first.filter("r_insn is not null")), "pairs")
    seen = paired.select("grp", "r_insn").distinct()
    second = met(b.join(seen, ["grp", "r_insn"], "left_anti"), "r", a, "l", to_left).select(*order)
    again = _differing(second.filter("l_insn is not null"))
    return paired.unionByName(_lone(first.filter("r_insn is null"), "l")).unionByName(_lone(second.filter("l_insn is null"), "r")).unionByName(again)


def _translated(df: DataFrame, column: str, table: DataFrame | None, to: str) -> DataFrame:
    if table is None:
        return df.withColumn(to, F.col(column))
    return df.join(table.select(F.col("insn").alias(column), F.col("other_insn").alias(to)), column, "left")


def rates_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """left/right(pair, branch, target, rate) of pairs of (definition, use): those whose rates have the same edges, within LEAST points each."""
    a, b = (x.select("pair", "branch", "target", F.col("rate").alias(n)) for x, n in ((left, "l"), (right, "r")))
    both = a.join(b, ["pair", "branch", "target"], "full")
    near = F.coalesce(F.abs(F.col("l") - F.col("r")) * 100 <= LEAST, F.lit(False))
    return both.groupBy("pair").agg(F.bool_and(near).alias("ok"), F.count("l").alias("nl"), F.count("r").alias("nr")).filter("ok and nl > 0 and nr > 0").select("pair")


def children_differ(lone: DataFrame, side: str, left: DataFrame, right: DataFrame, successors: DataFrame, l_counts: DataFrame, r_counts: DataFrame, rates: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """lone(grp, l, r: the instruction in both builds), of relations that `side` ('l' or 'r') alone has: those whose children differ.

    Without children in either run, or a match in the other build, they count as different.  Only children among the
    lone relation's successors are compared, with their own children's key in the other run.
    """
    own, other = (left, right) if side == "l" else (right, left)
    this, that = side, "r" if side == "l" else "l"
    cols = ["insn", "key", "perc", "fwd", "bwd"]
    mine = own.select(F.col("parent").alias(this), *[F.col(c).alias(f"{this}_{c}") for c in cols])
    theirs = other.select(F.col("parent").alias(that), *[F.col(c).alias(f"{that}_{c}") for c in cols])
    known = mine.select(this).distinct().withColumn("_a", F.lit(True))
    known2 = theirs.select(that).distinct().withColumn("_b", F.lit(True))
    seen = lone.join(known, this, "left").join(known2, that, "left")
    no_children = seen.filter(F.col(that).isNull() | (F.col("_a").isNull() & F.col("_b").isNull())).select("grp", "l", "r")
    rows = lone.join(mine, this).join(successors.select("grp", F.col("insn").alias(this), F.col("succ").alias(f"{this}_insn")).distinct(), ["grp", this, f"{this}_insn"])
    rows = rows.join(theirs, (rows[that] == theirs[that]) & (rows[f"{this}_key"] == theirs[f"{that}_key"]), "left").drop(theirs[that])
    alone = rows.filter(F.col(f"{that}_insn").isNull() & (F.col(f"{this}_perc") >= LEAST)).select("grp", "l", "r")
    both = rows.filter(F.col(f"{that}_insn").isNotNull())
    both = both.join(l_counts.select(F.col("insn").alias("l_insn"), F.col("n").alias("_ln")), "l_insn", "left").join(r_counts.select(F.col("insn").alias("r_insn"), F.col("n").alias("_rn")), "r_insn", "left")
    both = both.filter(~relations_equal(F.col("l_fwd"), F.col("r_fwd"), F.col("l_bwd"), F.col("r_bwd"), F.col("_ln"), F.col("_rn")))
    if rates is not None:
        pair = F.struct("l", "r", "l_insn", "r_insn").alias("pair")
        a = both.select(pair, F.col("l").alias("def"), F.col("l_insn").alias("use")).distinct().join(rates[0], ["def", "use"])
        b = both.select(pair, F.col("r").alias("def"), F.col("r_insn").alias("use")).distinct().join(rates[1], ["def", "use"])
        same = rates_equal(a, b).select("pair.*")
        both = both.join(same, ["l", "r", "l_insn", "r_insn"], "left_anti")
    return no_children.union(alone).union(both.select("grp", "l", "r")).distinct()


def successor_impacts(pairs: DataFrame, weights: DataFrame, r_weights: DataFrame, left: DataFrame, right: DataFrame, successors: DataFrame, rates: tuple[DataFrame, DataFrame] | None = None, to_right: DataFrame | None = None) -> DataFrame:
    """pairs(grp, l_insn, r_insn, l_perc): (grp, l_insn, r_insn, impact, weight) of each pair's successors on the left.

    A successor counts if it has a one-level relation; it weighs its own contribution in the group, else its parent's,
    times the proportion of a conditional backward relation.  Its impact is the forward impact between the runs, 100
    if the right lacks it, 0 if equal.  Where pass rates are known they take the place of an impact that is not 0.
    """
    kid = ["insn", "key", "perc", "fwd", "bwd"]
    a = left.select(F.col("parent").alias("l_insn"), *[F.col(c).alias(f"a_{c}") for c in kid])
    b = right.select(F.col("parent").alias("r_insn"), *[F.col(c).alias(f"b_{c}") for c in kid])
    have = successors.select("grp", F.col("insn").alias("l_insn"), F.col("succ").alias("a_insn")).distinct()
    rows = pairs.select("grp", "l_insn", "r_insn", "l_perc").join(a, "l_insn").filter("a_insn <> l_insn").join(have, ["grp", "l_insn", "a_insn"])
    rows = rows.join(b, (rows["r_insn"] == b["r_insn"]) & (rows["a_key"] == b["b_key"]), "left").drop(b["r_insn"])
    own = weights.select("grp", F.col("insn").alias("a_insn"), F.col("perc").alias("_w"))
    weight = F.coalesce("_w", "l_perc") * F.when(F.col("a_bwd.v").isNull() & F.col("a_bwd.prop").isNotNull(), F.col("a_bwd.prop")).otherwise(F.lit(1.0))
    rows = rows.join(own, ["grp", "a_insn"], "left").withColumn("weight", weight)
    both = rows.filter("b_insn is not null").withColumn("equal", relations_equal(F.col("a_fwd"), F.col("b_fwd"), F.col("a_bwd"), F.col("b_bwd")))
    both = both.withColumn("impact", F.when(F.col("equal"), F.lit(0.0)).otherwise(forward_impact(F.col("a_fwd.ratio"), F.col("b_fwd.ratio"), F.col("a_perc"))))
    rows = both.drop("equal").unionByName(rows.filter("b_insn is null").withColumn("impact", F.lit(100.0)))
    out = ["grp", "l_insn", "r_insn", "impact", "weight"]
    if rates is None:
        return rows.select(*out)
    # with one build a successor that the right lacks goes by the left's instruction
    use = F.coalesce("b_insn", "a_insn") if to_right is None else F.col("b_insn")
    rows = stored(rows.withColumn("_use", use).select(*out, "a_insn", "_use"), "successors")
    keys = [(x.select("def", "use").distinct().withColumn(f"_h{k}", F.lit(True))) for k, x in enumerate(rates)]
    rows = rows.join(keys[0].select(F.col("def").alias("l_insn"), F.col("use").alias("a_insn"), "_h0"), ["l_insn", "a_insn"], "left")
    rows = rows.join(keys[1].select(F.col("def").alias("r_insn"), F.col("use").alias("_use"), "_h1"), ["r_insn", "_use"], "left")
    asked = (F.col("impact") != 0) & (F.col("_h0").isNotNull() | F.col("_h1").isNotNull())
    kept = rows.filter(~asked).select(*out)
    swap = rows.filter(asked)
    lt = rates[0].select(F.col("def").alias("l_insn"), F.col("use").alias("a_insn"), "branch", "target", F.col("rate").alias("l"))
    edges = swap.filter("_h0 and _h1").join(lt, ["l_insn", "a_insn"]).join(weights.select("grp", F.col("insn").alias("target"), F.col("perc").alias("_t")), ["grp", "target"])
    edges = _translated(_translated(edges, "branch", to_right, "_branch"), "target", to_right, "_target")
    if to_right is not None:
        edges = edges.join(r_weights.select("grp", F.col("insn").alias("_target")).distinct(), ["grp", "_target"], "left_semi")
    rt = rates[1].select(F.col("def").alias("r_insn"), F.col("use").alias("_use"), F.col("branch").alias("_branch"), F.col("target").alias("_target"), F.col("rate").alias("r"))
    gone = (F.col("l") - F.coalesce("r", F.lit(0.0))) * 100
    edges = edges.join(rt, ["r_insn", "_use", "_branch", "_target"], "left").filter(gone > LEAST).select("grp", "l_insn", "r_insn", "a_insn", gone.alias("impact"), F.col("_t").alias("weight"))
    edges = stored(edges, "rate-impacts")
    none = swap.join(edges.select("grp", "l_insn", "r_insn", "a_insn").distinct(), ["grp", "l_insn", "r_insn", "a_insn"], "left_anti").select("grp", "l_insn", "r_insn", F.lit(0.0).alias("impact"), F.lit(100.0).alias("weight"))
    return kept.unionByName(edges.select(*out)).unionByName(none)


def _first_of_equals(rows: DataFrame) -> DataFrame:
    """One-sided rows by falling impact: one that equals an earlier kept one goes.  A report's walk: equality is not transitive."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        side = "l" if pd.notna(pdf["l_insn"].iloc[0]) else "r"
        pdf = pdf.sort_values(["impact", f"{side}_insn"], ascending=[False, True], kind="stable")
        fwd, bwd = pdf[f"{side}_fwd"].tolist(), pdf[f"{side}_bwd"].tolist()
        kept: list[int] = []
        for k in range(len(pdf)):
            if pdf["whole"].iloc[k] and not any(sides_equal(fwd[k], fwd[q]) and sides_equal(bwd[k], bwd[q]) for q in kept):
                kept.append(k)
        return pdf.iloc[kept]

    return rows.groupBy("grp", F.col("l_insn").isNull()).applyInPandas(walk, rows.schema)


def compare_relations(
    left: DataFrame, right: DataFrame, symptoms: DataFrame, l_children: DataFrame, r_children: DataFrame, l_successors: DataFrame, r_successors: DataFrame, l_counts: DataFrame, r_counts: DataFrame,
    lone_children: tuple[DataFrame, DataFrame] | None = None, rates: tuple[DataFrame, DataFrame] | None = None, to_right: DataFrame | None = None, to_left: DataFrame | None = None,
) -> DataFrame:
    """(grp, l_insn, r_insn, impact, ts_perc, weight, ts, corr, rank) of all groups that both runs have: the report, rank 1 first.

    symptoms(grp, l, r): each group's starting instruction in both runs.  lone_children: the children that decide on
    relations which one run alone has (those of the whole program, not of the group); without them all such stay.
    """
    rows = stored(pair_relations(left, right, to_right, to_left), "examined")
    mean = F.when(F.col("l_insn").isNotNull() & F.col("r_insn").isNotNull(), (F.col("l_ts") + F.col("r_ts")) / 2).otherwise(F.coalesce("l_ts", "r_ts").cast("double"))
    rows = rows.withColumn("ts", mean).withColumn("weight", F.when(F.col("l_insn").isNotNull() & F.col("r_insn").isNotNull(), F.abs(F.col("l_perc") - F.col("r_perc"))).otherwise(F.coalesce("l_perc", "r_perc")))
    pairs = rows.filter("l_insn is not null and r_insn is not null")
    top = pairs.groupBy("grp").agg(F.greatest(F.max("ts"), F.lit(1.0)).alias("max_ts"))
    weights = stored(rows.filter("l_insn is not null").select("grp", F.col("l_insn").alias("insn"), F.col("l_perc").alias("perc")).dropDuplicates(["grp", "insn"]), "left-weights")
    r_weights = pairs.select("grp", F.col("r_insn").alias("insn"), F.col("r_perc").alias("perc")).dropDuplicates(["grp", "insn"])

    lone = []
    for side, that, table, succ, back in (("l", "r", to_right, l_successors, to_right), ("r", "l", to_left, r_successors, to_left)):
        mine = rows.filter(F.col(f"{that}_insn").isNull())
        if lone_children is not None:
            named = _translated(mine.select("grp", F.col(f"{side}_insn").alias(side)), side, table, that)
            differ = children_differ(named, side, *lone_children, succ, l_counts, r_counts, rates)
            mine = mine.join(differ.select("grp", F.col(side).alias(f"{side}_insn")).distinct(), ["grp", f"{side}_insn"], "left_semi")
        if back is None:
            mine = mine.withColumn("whole", F.lit(True))
        else:  # a relation with a successor that the other build lacks has no place in the report
            lost = succ.join(back.filter("other_insn is not null").select(F.col("insn").alias("succ")), "succ", "left_anti").select("grp", F.col("insn").alias(f"{side}_insn")).distinct().withColumn("_lost", F.lit(True))
            mine = mine.join(lost, ["grp", f"{side}_insn"], "left").withColumn("whole", F.col("_lost").isNull()).drop("_lost")
        lone.append(mine.withColumn("impact", F.col("weight")).withColumn("corr", correlation(F.col(f"{side}_fwd.ratio")) * 100).select("impact", "corr", "whole", *rows.columns))
    lone = _first_of_equals(lone[0].unionByName(lone[1])).drop("whole")

    n = lambda df, c: df.select(F.col("insn").alias(c), F.col("n").alias(f"{c}_n"))
    full = symptoms.join(n(l_counts, "l"), "l", "left").join(n(r_counts, "r"), "r", "left").select("grp", "l_n", "r_n")
    judged = pairs.join(F.broadcast(full), "grp")  # a row for each group
    forward = forward_impact(F.col("l_fwd.ratio"), F.col("r_fwd.ratio"), F.col("l_perc"))
    lw, rw = F.col("l_perc") * F.col("l_n") / 100, F.col("r_perc") * F.col("r_n") / 100
    negative = (lw < rw) & ((rw - lw) / rw * 100 >= 20) & ~(F.col("l_actual") > F.col("r_actual"))
    back = backward_impact(F.col("l_perc"), F.col("r_perc"))
    judged = judged.withColumn("forward", forward).withColumn("backward", F.when((back > forward) & ~F.coalesce(negative, F.lit(False)), F.lit(0.0)).otherwise(back))
    judged = stored(judged, "judged")
    impacts = successor_impacts(judged, weights, r_weights, l_children, r_children, l_successors, rates, to_right)
    keys = ["grp", "l_insn", "r_insn"]
    new = accumulate(judged.select(*keys, F.col("l_perc").alias("own"), "forward"), impacts, keys)
    judged = judged.join(new, keys)
    impact = F.when(F.col("backward") > F.col("forward"), F.least(F.lit(100.0), F.col("backward") + F.col("new_weight"))).otherwise(F.col("new_weight"))
    judged = judged.withColumn("impact", impact).withColumn("corr", correlation(F.col("l_fwd.ratio")) * 100)
    out = judged.select("impact", "corr", *rows.columns).unionByName(lone).join(F.broadcast(top), "grp", "left")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("impact"), "l_insn", "r_insn"))
    return out.withColumn("rank", rank).select(*keys, "impact", (F.col("ts") / F.coalesce("max_ts", F.lit(1.0)) * 100).alias("ts_perc"), "weight", "ts", "corr", "rank")


def one_sided(relations: DataFrame, symptoms: DataFrame, side: str) -> DataFrame:
    """relations of groups that one run alone has: the symptom's own, as report rows; symptoms(grp, insn)."""
    own = relations.join(symptoms.select("grp", "insn"), ["grp", "insn"])
    insn = {"l": F.lit(None).cast("long"), "r": F.lit(None).cast("long"), side: F.col("insn")}
    return own.select("grp", insn["l"].alias("l_insn"), insn["r"].alias("r_insn"), F.col("perc").alias("impact"), F.col("ts").cast("double").alias("ts_perc"), F.col("perc").alias("weight"), F.col("ts").cast("double").alias("ts"), correlation(F.col("fwd.ratio")).alias("corr"), F.lit(1).alias("rank"))


def compare_groups(left: DataFrame, right: DataFrame, l_relations: DataFrame, r_relations: DataFrame, compare: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], highest_only: bool = False) -> DataFrame:
    """left/right(grp, insn, weight): groups of both runs, and the report of each, with the group's difference as `delta`.

    compare(l_relations, r_relations, symptoms) is compare_relations() with its other tables.  Groups of one run give the
    symptom's own relation.  highest_only: the group with the greatest difference (then key) alone.
    """
    a, b = left.select(F.col("grp").alias("key"), F.col("weight")), right.select(F.col("grp").alias("key"), F.col("weight"))
    delta = match_groups(a, b).select(F.col("key").alias("grp"), F.bround("delta").alias("delta"))
    delta = delta.join(left.select("grp", F.col("insn").alias("l")), "grp", "left").join(right.select("grp", F.col("insn").alias("r")), "grp", "left")
    if highest_only:
        delta = delta.orderBy(F.desc("delta"), F.desc("grp")).limit(1)
    delta = stored(delta, "groups")
    both = delta.filter("l is not null and r is not null")
    pick = lambda df, of: df.join(of.select("grp"), "grp", "left_semi")
    reports = compare(pick(l_relations, both), pick(r_relations, both), both.select("grp", "l", "r"))
    for side, relations, that in (("l", l_relations, "r"), ("r", r_relations, "l")):
        alone = delta.filter(F.col(that).isNull())
        reports = reports.unionByName(one_sided(pick(relations, alone), alone.select("grp", F.col(side).alias("insn")), side))
    return reports.join(delta.select("grp", "delta"), "grp").select("delta", *reports.columns)


def side_of(values: np.ndarray, weighted: np.ndarray | None = None) -> dict:
    """A SIDE of the counts that each execution (or target) has: invariance, conditional, or distribution."""
    v, n = np.unique(np.asarray(values, float), return_counts=True)
    out = {"ratio": float(v[-1]), "prop": None, "v": None, "n": None, "wv": None, "wn": None}
    if len(v) == 2 and v[0] == 0:
        out["prop"] = float(n[1] / n.sum())
    elif len(v) > 1:
        out.update(ratio=float((v * n).sum() / n.sum()), v=v.tolist(), n=n.tolist())
        if weighted is not None:
            w, m = np.unique(np.asarray(weighted, float), return_counts=True)
            out.update(wv=w.tolist(), wn=m.tolist())
    return out
