"""Relations of one run: how many symptom events each execution of a static instruction leads to, and the reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import relation_class, weight_order


def base_weight(targets: DataFrame, least: float = 0.99) -> DataFrame:
    """targets(weight, valid): total of valid weights; null if fewer than that share are valid."""
    ok = F.col("valid") & F.col("weight").isNotNull()
    return targets.agg(F.when(F.avg(ok.cast("double")) >= least, F.sum(F.when(ok, F.col("weight")))).alias("base_weight"))


def forward_counts(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """nodes(node, static), reach(node, target): per execution its number of different targets, zero kept."""
    n = reach.groupBy("node").agg(F.count_distinct("target").alias("c"))
    return nodes.join(n, "node", "left").withColumn("c", F.coalesce("c", F.lit(0)))


def backward_counts(nodes: DataFrame, reach: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (target, static): executions of static that lead to the target; zero kept, and a target counts itself once more."""
    n = reach.join(nodes, "node").groupBy("target", "static").agg(F.count(F.lit(1)).alias("c"))
    own = targets.select(F.col("node").alias("target")).join(nodes.withColumnRenamed("node", "target"), "target").withColumn("self", F.lit(1))
    statics = nodes.select("static").distinct()
    grid = targets.select(F.col("node").alias("target")).join(F.broadcast(statics))  # statics: 65,535 codes at most, a limit of the trace format
    full = grid.join(n, ["target", "static"], "left").join(own, ["target", "static"], "left")
    return full.select("target", "static", (F.coalesce("c", F.lit(0)) + F.coalesce("self", F.lit(0))).alias("c"))


def weighted_forward(nodes: DataFrame, reach: DataFrame, weights: DataFrame) -> DataFrame:
    """Per execution the sum of the valid weights(target, weight) of its targets."""
    s = reach.distinct().join(weights.filter("weight is not null"), "target").groupBy("node").agg(F.sum("weight").alias("w"))
    return nodes.join(s, "node", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def weighted_backward(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """counts(target, static, c) times the weight of weights(target, weight); 0 where that is not valid."""
    return counts.join(weights.select("target", "weight"), "target", "left").withColumn("w", F.col("c") * F.coalesce("weight", F.lit(0.0))).drop("weight")


def weighted_fit(values: DataFrame, keys: list[str], w: str = "w") -> DataFrame:
    """Mean and population deviation of weighted counts; null if some have no weight."""
    whole = F.count(w) == F.count(F.lit(1))
    return values.groupBy(*keys).agg(F.when(whole, F.avg(w)).alias("w_mu"), F.when(whole, F.stddev_pop(w)).alias("w_sd"))


def prune_small(groups: DataFrame, keys: list[str], other: DataFrame | None = None, share: float = 0.01, order: str = "seq") -> DataFrame:
    """groups(keys, insn, seq, weight) in order of seq: one goes if it weighs less than `share` of the heaviest before it, unless other(insn) has it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = groups.withColumn("_max", F.coalesce(F.max("weight").over(w), F.lit(0.0)))
    small = F.col("weight") < share * F.col("_max")
    if other is not None:
        rows = rows.join(other.select("insn").distinct().withColumn("_o", F.lit(True)), "insn", "left")
        small = small & F.col("_o").isNull()
    return rows.filter(~small).select(*groups.columns)


def report_scale(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest timestamp and weight of each report, 1 at least."""
    return rows.groupBy(*keys).agg(F.greatest(F.max("ts"), F.lit(1.0)).alias("max_ts"), F.greatest(F.max("weight"), F.lit(1.0)).alias("max_weight"))


def ordered(relations: DataFrame, keys: list[str]) -> DataFrame:
    """relations(keys, file, lines, perc, corr) numbered in report order: by place, then weight to two places and correlation."""
    place = F.concat(F.col("file"), F.lit(":"), F.array_join(F.col("lines").cast("array<string>"), ","))
    w = Window.partitionBy(*keys).orderBy(place, weight_order(F.col("perc"), F.col("corr")))
    return relations.withColumn("pos", F.row_number().over(w))


def reached_events(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """Per static node: its executions and the number of different targets that any of them reaches."""
    return nodes.join(reach, "node", "left").groupBy("static").agg(F.count_distinct("node").alias("executions"), F.count_distinct("target").alias("reachable"))


def individual_weight(events: DataFrame, n_targets: Column) -> DataFrame:
    """Share of the targets reached, in percent, and specificity min(r, 1/r) of r = executions / reachable."""
    r = F.when(F.col("reachable") > 0, F.col("executions") / F.col("reachable"))
    return events.withColumn("perc", F.col("reachable") / n_targets * 100).withColumn("corr", F.coalesce(F.least(r, 1 / r), F.lit(0.0)))


def classes(counts: DataFrame, keys: list[str], c: str = "c", prefix: str = "") -> DataFrame:
    """Per key: class of the counts, their ratio (the greatest), share of non-zero ones, mean and population deviation."""
    c = F.col(c)
    out = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("d"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg((c != 0).cast("double")).alias("prop"), F.avg(c).alias("mu"), F.stddev_pop(c).alias("sd"))
    return out.select(*keys, F.col("n").alias(f"{prefix}n"), relation_class(F.col("d"), F.col("lo"), F.col("hi")).alias(f"{prefix}class"), F.col("hi").alias(f"{prefix}ratio"), F.col("prop").alias(f"{prefix}prop"), F.col("mu").alias(f"{prefix}mu"), F.col("sd").alias(f"{prefix}sd"))


def histogram(counts: DataFrame, keys: list[str], c: str = "c") -> DataFrame:
    """The empirical distribution of counts as rows (keys, c, n)."""
    return counts.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n"))


def relevant_relations(relations: DataFrame) -> DataFrame:
    return relations.filter(~((F.col("fwd_class") == "irrelevant") & (F.col("bwd_class") == "irrelevant")))


def fully_explained(relations: DataFrame, counts: DataFrame) -> DataFrame:
    """Statics related invariantly both ways with all their executions."""
    both = relations.filter(F.col("fwd_class").isin("invariant", "conditional") & F.col("bwd_class").isin("invariant", "conditional"))
    return both.join(counts, "static").filter(F.col("n") == F.col("prede_count")).select("static").distinct()


def duplicates(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations equal to that of a static successor, edges(src, dst)."""
    cols = [c for c in relations.columns if c.startswith(("fwd_", "bwd_"))]
    succ = relations.select(F.col("static").alias("dst"), *[F.col(c).alias(f"s_{c}") for c in cols])
    same = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"s_{c}"))
        same = e if same is None else same & e
    hit = relations.join(edges.select(F.col("src").alias("static"), "dst").distinct(), "static").join(succ, "dst").filter(same).select("static").distinct()
    return relations.join(hit.withColumn("duplicate", F.lit(True)), "static", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def wavefront(relations: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Statics variable in some direction and no duplicate, lightest first; only those that the other run has, if given."""
    w = relations.filter(~F.col("duplicate") & ((F.col("fwd_class") == "variable") | (F.col("bwd_class") == "variable")))
    if other is not None:
        w = w.join(other.select("static").distinct(), "static", "left_semi")
    return w.select("static", "perc").distinct().orderBy("perc", "static")


def trim_variable_chains(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Drops relations variable both ways whose successors are variable, every one."""
    var = relations.withColumn("_v", (F.col("fwd_class") == "variable") & (F.col("bwd_class") == "variable"))
    succ = edges.select(F.col("src").alias("static"), "dst").distinct().join(var.select(F.col("static").alias("dst"), F.col("_v").alias("_sv")), "dst").groupBy("static").agg(F.bool_and("_sv").alias("_all"))
    return var.join(succ, "static", "left").filter(~(F.col("_v") & F.coalesce("_all", F.lit(False)))).drop("_v", "_all")


def upsert_weights(relations: DataFrame) -> DataFrame:
    """Of several groups' weights of a static, the heaviest (total to two places, then corr)."""
    return relations.groupBy("static").agg(F.max(F.struct(F.bround("perc", 2).alias("perc"), "corr")).alias("w")).select("static", "w.perc", "w.corr")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Get-or-make: the first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
