"""Dependence edges of an execution: nearest definitions by thread or by address, and bit masks.

Every matcher is one window over the union of definitions and uses keyed by (thread or address, using static node), so
there is no product of uses and definitions; the order-free form is used: each use finds the nearest earlier
definition among its own static predecessors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import BEFORE


def nearest_definition(trace: DataFrame, static: DataFrame, keys: Sequence[str] = ("tid",), defines: Column | None = None, uses: Column | None = None, width: bool = False) -> DataFrame:
    """(keys, dst_t, dst, src_t, src): each use with its nearest earlier definition under the same keys.

    static(src, dst): a definition's code and the using code.  Key by thread for control flow and registers, by address
    for memory.  width: only definitions with the use's width column, or where either is null.
    """
    defines, uses = (F.lit(True) if c is None else c for c in (defines, uses))
    more = ["width"] if width else []
    marks = trace.filter(defines).join(static.select(F.col("src").alias("code"), "dst"), "code").select(*keys, *more, F.col("dst").alias("_for"), "t", F.col("code").alias("_src"), F.lit(0).alias("_use"))
    needs = trace.filter(uses).join(static.select(F.col("dst").alias("code")).distinct(), "code", "left_semi").select(*keys, *more, F.col("code").alias("_for"), "t", F.lit(None).cast(dict(trace.dtypes)["code"]).alias("_src"), F.lit(1).alias("_use"))
    w = Window.partitionBy(*keys, "_for").orderBy("t", F.col("_use").desc()).rowsBetween(*BEFORE)
    mark = F.struct(F.col("t").alias("t"), F.col("_src").alias("src"))
    rows = marks.union(needs)
    if not width:
        found = rows.withColumn("_d", F.last(F.when(F.col("_use") == 0, mark), ignorenulls=True).over(w))
    else:
        any_ = F.last(F.when((F.col("_use") == 0) & F.col("width").isNull(), mark), ignorenulls=True).over(w)
        same = F.last(F.when(F.col("_use") == 0, mark), ignorenulls=True).over(Window.partitionBy(*keys, "_for", "width").orderBy("t", F.col("_use").desc()).rowsBetween(*BEFORE))
        every = F.last(F.when(F.col("_use") == 0, mark), ignorenulls=True).over(w)
        found = rows.withColumn("_d", F.when(F.col("width").isNull(), every).otherwise(F.greatest(any_, same)))
    return found.filter("_use = 1 and _d is not null").select(*keys, F.col("t").alias("dst_t"), F.col("_for").alias("dst"), F.col("_d.t").alias("src_t"), F.col("_d.src").alias("src"))


def mask_cover(log: DataFrame, is_load: Column, is_store: Column, mask: Column, keys: Sequence[str] = ("addr",), bits: int = 64) -> DataFrame:
    """(keys, load, mask, store_t, store_mask, rest): the stores a masked load depends on; rest, what nearer stores have left of its mask.

    A load depends on a store if that is the nearest earlier one to write one of its bits; so each bit's last store comes from
    one window, and loads meet no stores that are not theirs.
    """
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(*BEFORE)
    rows = log.filter(is_load | is_store).select(*keys, "t", is_load.alias("_l"), is_store.alias("_s"), mask.alias("mask"))
    bit = lambda b: F.col("mask").bitwiseAND(F.lit(1 << b if b < 63 else -(1 << 63))) != 0
    last = [F.last(F.when(F.col("_s") & bit(b), F.struct("t", F.col("mask").alias("m"))), ignorenulls=True).over(w) for b in range(bits)]
    mine = F.array(*[F.when(bit(b), x) for b, x in enumerate(last)])
    loads = rows.withColumn("_d", mine).filter("_l").withColumn("_d", F.array_sort(F.array_distinct(F.array_compact("_d"))))
    # the nearest come last in order of time; what a store finds is the mask without all later ones
    each = loads.select(*keys, F.col("t").alias("load"), "mask", F.col("_d").alias("_all"), F.posexplode("_d").alias("_p", "_x"))
    later = F.aggregate(F.slice("_all", F.col("_p") + 2, F.size("_all")), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["m"]))
    return each.select(*keys, "load", "mask", F.col("_x.t").alias("store_t"), F.col("_x.m").alias("store_mask"), F.col("mask").bitwiseAND(F.bitwise_not(later)).alias("rest"))


def attach_operands(trace: DataFrame, operand: Column, target: Column, after: bool, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """(keys, t, target_t): each operand record with the nearest target record of its thread, after or before it."""
    w = Window.partitionBy(*keys).orderBy("t")
    hit = F.first(F.when(target, F.col("t")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) if after else F.last(F.when(target, F.col("t")), ignorenulls=True).over(w.rowsBetween(*BEFORE))
    return trace.withColumn("target_t", hit).filter(operand & F.col("target_t").isNotNull()).select(*keys, "t", "target_t")


def consumed_writes(log: DataFrame, is_write: Column, keys: Sequence[str] = ("addr",)) -> DataFrame:
    """(keys, read_t, write_t): a write pairs with the first following read of its address only."""
    w = Window.partitionBy(*keys).orderBy("t")
    before = F.lag(is_write).over(w)
    rows = log.withColumn("_w", is_write).withColumn("_p", before).withColumn("write_t", F.lag("t").over(w))
    return rows.filter(~F.col("_w") & F.col("_p")).select(*keys, F.col("t").alias("read_t"), "write_t")


def known_writes(log: DataFrame, is_write: Column, keys: Sequence[str] = ("addr",)) -> DataFrame:
    """Each read with whether its value is known: as last written; otherwise unknown, unless it is zero and never written."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(*BEFORE)
    rows = log.withColumn("_w", is_write).withColumn("last_value", F.last(F.when(F.col("_w"), F.col("value")), ignorenulls=True).over(w))
    state = F.when(F.col("last_value") == F.col("value"), "known").when(F.col("last_value").isNotNull() | (F.col("value") != 0), "unknown").otherwise("neither")
    return rows.filter(~F.col("_w")).withColumn("state", state).drop("_w")


def last_other_writer(points: DataFrame, keys: Sequence[str] = ("addr", "shift")) -> DataFrame:
    """points(keys, t, point): the nearest earlier row of another point at the same place, by islands of one point."""
    w = Window.partitionBy(*keys).orderBy("t")
    new = F.coalesce((F.lag("point").over(w) != F.col("point")).cast("int"), F.lit(1))
    rows = points.withColumn("_n", new).withColumn("_i", F.sum("_n").over(w)).withColumn("_p", F.struct(F.lag("t").over(w).alias("t"), F.lag("point").over(w).alias("point")))
    first = F.first("_p").over(Window.partitionBy(*keys, "_i").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_f", first).withColumn("other_t", F.col("_f.t")).withColumn("other", F.col("_f.point")).drop("_n", "_i", "_p", "_f")


def shadow_flags(points: DataFrame, positive: Column, keys: Sequence[str] = ("addr", "shift")) -> DataFrame:
    """Per negative point: does it overwrite a positive, ever a non-positive (partial), and itself (double)?"""
    w = Window.partitionBy(*keys).orderBy("t")
    rows = points.withColumn("_pos", positive).withColumn("_was", F.lag("_pos").over(w)).withColumn("_pp", F.lag("point").over(w))
    neg = rows.filter(~F.col("_pos"))
    return neg.groupBy("point").agg(F.coalesce(F.bool_or("_was"), F.lit(False)).alias("overwrites"), F.bool_or(~F.coalesce("_was", F.lit(False))).alias("partial"), F.coalesce(F.bool_or(F.col("_pp") == F.col("point")), F.lit(False)).alias("double"))


def in_all(rows: DataFrame, item: str, group: str) -> DataFrame:
    """Items that occur in every group."""
    total = rows.agg(F.count_distinct(group).alias("n"))
    have = rows.groupBy(item).agg(F.count_distinct(group).alias("have"))
    return have.join(F.broadcast(total), F.col("have") == F.col("n")).select(item)  # one row


def candidate_stores(trace: DataFrame, pending: DataFrame, starts: Column) -> DataFrame:
    """Stores at a pending address, or that are starts."""
    return trace.join(pending.select("addr").distinct().withColumn("_p", F.lit(True)), "addr", "left").filter(F.col("_p") | starts).drop("_p")


def relevant(trace: DataFrame, reach: DataFrame, starts: Column) -> DataFrame:
    """Records that are starts or in the backward slice: a semi join with its fix-point."""
    return trace.join(reach.select("t").distinct().withColumn("_r", F.lit(True)), "t", "left").filter(F.coalesce("_r", F.lit(False)) | starts).drop("_r")


def indirect_callsites(sites: DataFrame) -> DataFrame:
    """sites(insn, regs array): those whose target has exactly one register."""
    return sites.filter(F.size("regs") == 1)


def callsite_targets(log: DataFrame) -> DataFrame:
    """log(code, reg): the set of targets each callsite was seen to call, by callee."""
    return log.select("code", "reg").distinct().groupBy(F.col("reg").alias("callee")).agg(F.array_sort(F.collect_set("code")).alias("callers"))


def definition_class(slices: DataFrame) -> DataFrame:
    """slices(use, kind, func, use_func, same_as_write): local, intermediate or remote, and its group where one use has several."""
    where = F.when(F.col("kind") == "empty", "explained").when(F.col("same_as_write"), "intermediate").when(F.col("func") == F.col("use_func"), "local").otherwise("remote")
    n = F.count(F.lit(1)).over(Window.partitionBy("use"))
    return slices.withColumn("where", where).withColumn("or_group", F.when(n > 1, F.col("use")))


def executed(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """nodes(insn) that ran: those that counts(insn, n) lacks or counts as 0 go."""
    return nodes.join(counts.filter("n > 0").select("insn").distinct(), "insn", "left_semi")


def nonzero(rows: DataFrame, addr: str = "addr") -> DataFrame:
    """Rows with an address other than 0."""
    return rows.filter(F.col(addr).isNotNull() & (F.col(addr) != 0))


def watchable(pending: DataFrame, keys: Sequence[str], most: int = 1000) -> DataFrame:
    """pending(keys, addr) of keys with at most so many different addresses; the others are given up whole."""
    few = pending.groupBy(*keys).agg(F.count_distinct("addr").alias("_n")).filter(F.col("_n") <= most)
    return pending.join(few.select(*keys), list(keys), "left_semi")


def next_watched(pending: DataFrame, keys: Sequence[str], most: int = 2) -> DataFrame:
    """The addresses that each key watches next: its least ones, as many as there are watchpoints."""
    w = Window.partitionBy(*keys).orderBy("addr")
    return pending.select(*keys, "addr").distinct().withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def static_writers(pending: DataFrame, writes: DataFrame) -> DataFrame:
    """pending(addr) that are statically known to be written, with writes(addr, ...)."""
    return pending.join(writes, "addr")


def nonlocal_requests(loads: DataFrame, explored: DataFrame) -> DataFrame:
    """loads(insn, func, same_as_write) to ask for definitions elsewhere: not those that read their own write, nor explored(insn, func)."""
    return loads.filter(~F.coalesce("same_as_write", F.lit(False))).join(explored.select("insn", "func").distinct(), ["insn", "func"], "left_anti")


def first_common(rows: DataFrame, item: str, group: str, pos: str = "pos") -> DataFrame:
    """The item common to all groups that the first group (by name) meets first: one row, or none."""
    least = rows.agg(F.min(group).alias("_g"))
    first = rows.join(F.broadcast(least), F.col(group) == F.col("_g"))  # one row
    return first.join(in_all(rows, item, group), item, "left_semi").orderBy(pos, item).limit(1).select(item)
