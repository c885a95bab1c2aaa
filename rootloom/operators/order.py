"""Ordered-log operators.

A trace is a DataFrame with tid (thread), t (rising in execution order) and code; other columns pass through.  Keys name
the columns within which order holds, so the same functions serve several runs at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

SAMPLE, HOT = 500, 100_000
#: Records of a trace that are numbered as one stretch, about.
SPLIT = 4_000_000
BEFORE = (Window.unboundedPreceding, -1)
AFTER = (1, Window.unboundedFollowing)


def thread_of_records(raw: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """raw(t, code, mark): a switch record (code 0) names in `mark` the thread that ran up to it; each record gets that tid."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    return raw.withColumn("tid", F.first(F.when(F.col("code") == 0, F.col("mark")), ignorenulls=True).over(w)).filter("code <> 0").drop("mark")


def occurrence(trace: DataFrame, keys: Sequence[str] = ("code",), descending: bool = False, rows: int = SPLIT) -> DataFrame:
    """trace with occurrence, its number among the records of its keys in order of t, from 1.

    The records of a key are numbered in stretches of t, of about `rows` records of the whole trace each, and shifted by
    the counts of earlier stretches: no key, however hot, is one task.
    """
    low, high, n = trace.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
    parts = 1 if not n else max(1, -(-n // rows))
    w = Window.partitionBy(*keys, "_s").orderBy(F.col("t").desc() if descending else F.col("t"))
    if parts == 1:
        return trace.withColumn("_s", F.lit(0)).withColumn("occurrence", F.row_number().over(w)).drop("_s")
    width = max(1, -(-(high - low + 1) // parts))
    split = trace.withColumn("_s", F.floor((F.col("t") - F.lit(low)) / F.lit(width)).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy(F.desc("_s") if descending else F.col("_s")).rowsBetween(*BEFORE)
    before = split.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = None
    for k in (*keys, "_s"):
        e = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = e if same is None else same & e
    numbered = split.withColumn("occurrence", F.row_number().over(w)).alias("a").join(before.alias("b"), same)
    return numbered.select(*[F.col(f"a.{c}") for c in trace.columns], (F.col("a.occurrence") + F.col("b._before")).alias("occurrence"))


def systematic_sample(trace: DataFrame, keys: Sequence[str] = ("code",), period: int = SAMPLE, accepted: Column | None = None, counts: DataFrame | None = None, least: int = 100) -> DataFrame:
    """Every period-th occurrence of a code, counted from the end of the trace.

    accepted: only such rows take a number (a rejected record does not use its slot).  counts(keys, n): codes with
    fewer than `least` are not sampled.
    """
    rows = trace if accepted is None else trace.filter(accepted)
    rows = occurrence(rows, keys, descending=True)
    keep = (F.col("occurrence") - 1) % period == 0
    if counts is not None:
        rows = rows.join(counts, list(keys), "left")
        keep = keep | (F.coalesce("n", F.lit(0)) < least)
        return rows.filter(keep).drop("n", "occurrence")
    return rows.filter(keep).drop("occurrence")


def hot_codes(trace: DataFrame, keys: Sequence[str] = ("code",), cutoff: int = HOT) -> DataFrame:
    return trace.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cutoff)


def without_hot(trace: DataFrame, keys: Sequence[str] = ("code",), cutoff: int = HOT) -> DataFrame:
    """trace without codes that occur more often than cutoff: dropped whole."""
    return trace.join(hot_codes(trace, keys, cutoff).select(*keys), list(keys), "left_anti")


def node_count(trace: DataFrame, keys: Sequence[str] = ("code",), period: int = SAMPLE) -> DataFrame:
    """Occurrences, stored as sampled: n div period + 1."""
    return trace.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("sampled", F.expr(f"n div {period} + 1"))


def fold_average(trace: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """(keys, avg_t): running mean with truncating division, in order of t.

    Each step rounds, so the fold has to follow the order; it runs over sorted records that stream through, and holds
    one mean at a time.
    """
    fields = [f for f in trace.schema.fields if f.name in keys]
    schema = StructType([*fields, StructField("avg_t", LongType())])

    def run(batches):
        import pyarrow as pa

        at, avg, n = None, 0, 0
        for batch in batches:
            out = []
            for *key, t in zip(*(batch.column(c).to_pylist() for c in (*names, "t")), strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, avg))
                    at, avg, n = key, 0, 0
                avg += (t - avg) // (n + 1)
                n += 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip((*names, "avg_t"), r, strict=True)) for r in out], schema=arrow)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*names, "avg_t"), (*at, avg), strict=True))], schema=arrow)

    names = [f.name for f in fields]
    arrow = to_arrow_schema(schema)
    return trace.select(*names, F.col("t").cast("long").alias("t")).repartition(*names).sortWithinPartitions(*names, "t").mapInArrow(run, schema)


def float_average(trace: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    return trace.groupBy(*keys).agg(F.avg("t").alias("avg_t"))


def sums_in_order(trace: DataFrame, keys: Sequence[str], value: str, *others: Column) -> DataFrame:
    """(keys, sum, n, others): the sum of the values, added one by one in order of t (then value), how many there are, and other aggregates.

    A sum of doubles depends on its order, and with it what is rounded or ranked by it; partial sums come in the order of
    files and tasks.  This one is the same for any partitions: that of SQL which reads the log on one thread.
    """
    w = Window.partitionBy(*keys).orderBy("t", value).rowsBetween(Window.unboundedPreceding, 0)
    rows = trace.withColumn("_sum", F.sum(value).over(w)).withColumn("_at", F.count(F.lit(1)).over(w))
    return rows.groupBy(*keys).agg(F.max_by("_sum", "_at").alias("sum"), F.count(value).alias("n"), *others)


def nearest_before(test: Column, value: Column, keys: Sequence[str], order: str = "t") -> Column:
    """value of the nearest earlier row of the key that passes test."""
    return F.last(F.when(test, value), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*BEFORE))


def nearest_after(test: Column, value: Column, keys: Sequence[str], order: str = "t") -> Column:
    return F.first(F.when(test, value), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*AFTER))


def branch_split(trace: DataFrame, branch, target, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """Rows of the branch with taken: whether the very next record of the thread is the target."""
    nxt = F.lead("code").over(Window.partitionBy(*keys).orderBy("t"))
    return trace.withColumn("taken", F.coalesce(nxt == F.lit(target), F.lit(False))).filter(F.col("code") == F.lit(branch))


def branch_outcome(trace: DataFrame, branch, target, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """The carry-forward form: of the records of branch and target alone, a branch is taken if a target comes next."""
    return branch_split(trace.filter(F.col("code").isin(branch, target)), branch, target, keys)


def islands(trace: DataFrame, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """Runs of consecutive equal codes: keys, code, island, start_t, end_t, length."""
    w = Window.partitionBy(*keys).orderBy("t")
    new = (F.lag("code").over(w) != F.col("code")) | F.lag("code").over(w).isNull()
    rows = trace.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w))
    return rows.groupBy(*keys, "island", "code").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count(F.lit(1)).alias("length"))


def register_pairs(trace: DataFrame, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """One row for each run of records of one instruction, with its registers in order."""
    w = Window.partitionBy(*keys).orderBy("t")
    new = F.coalesce((F.lag("code").over(w) != F.col("code")).cast("int"), F.lit(1))
    rows = trace.withColumn("_n", new).withColumn("island", F.sum("_n").over(w))
    regs = F.transform(F.array_sort(F.collect_list(F.struct("t", "reg"))), lambda x: x["reg"])
    return rows.groupBy(*keys, "island", "code").agg(F.min("t").alias("t"), regs.alias("regs"))


def predictive_ratio(trace: DataFrame, pred, succ, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """For each run of pred followed by a run of succ: same, less or more, and the ratio of the lengths."""
    runs = islands(trace.filter(F.col("code").isin(pred, succ)), keys)
    w = Window.partitionBy(*keys).orderBy("island")
    pairs = runs.withColumn("n_succ", F.lead("length").over(w)).filter(F.col("code") == F.lit(pred)).withColumn("n_succ", F.coalesce("n_succ", F.lit(0)))
    kind = F.when(F.col("n_succ") == F.col("length"), "same").when(F.col("n_succ") < F.col("length"), "less").otherwise("more")
    return pairs.select(*keys, "island", F.col("length").alias("n_pred"), "n_succ", kind.alias("kind"), (F.col("n_succ") / F.col("length")).alias("ratio"))


def always_followed(trace: DataFrame, code, by, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """Per key: whether every occurrence of code is followed at once by `by`; the key's last record passes."""
    nxt = F.lead("code").over(Window.partitionBy(*keys).orderBy("t"))
    ok = trace.withColumn("_ok", F.coalesce(nxt == F.lit(by), F.lit(True))).filter(F.col("code") == F.lit(code))
    return ok.groupBy(*keys).agg(F.bool_and("_ok").alias("always"))


def invocations(trace: DataFrame, start, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """Number of the invocation each record belongs to: a start record opens one; earlier records are in none (0)."""
    return trace.withColumn("invocation", F.sum((F.col("code") == F.lit(start)).cast("int")).over(Window.partitionBy(*keys).orderBy("t")))


def pass_counts(trace: DataFrame, edges: DataFrame, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """edges(branch, target): executions of branch whose next relevant record is that target and whose target has that branch as nearest (mutually nearest)."""
    marks = trace.join(edges.select(F.col("branch").alias("code"), F.col("branch").alias("b"), F.col("target").alias("s")), "code").select(*keys, "t", "code", "b", "s", F.lit("branch").alias("role"))
    hits = trace.join(edges.select(F.col("target").alias("code"), F.col("branch").alias("b"), F.col("target").alias("s")), "code").select(*keys, "t", "code", "b", "s", F.lit("target").alias("role"))
    both = marks.union(hits).distinct()
    # of a branch: its nearest target of any kind
    by_branch = Window.partitionBy(*keys, "b").orderBy("t", "role").rowsBetween(*AFTER)
    by_target = Window.partitionBy(*keys, "s").orderBy("t", "role").rowsBetween(*BEFORE)
    near = both.withColumn("next_t", F.first(F.when(F.col("role") == "target", F.col("t")), ignorenulls=True).over(by_branch)).withColumn("prev_t", F.last(F.when(F.col("role") == "branch", F.col("t")), ignorenulls=True).over(by_target))
    a = near.filter("role = 'branch'").select(*keys, "b", "s", F.col("t").alias("tb"), F.col("next_t").alias("tt"))
    z = near.filter("role = 'target'").select(*keys, "b", "s", F.col("t").alias("tt"), F.col("prev_t").alias("tb"))
    return a.join(z, [*keys, "b", "s", "tb", "tt"]).groupBy(F.col("b").alias("branch"), F.col("s").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def registers_before(trace: DataFrame, branch, points: Sequence, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """For each branch record, the last value of each point before it and after the branch record before."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    rows = trace.filter(F.col("code").isin(branch, *points)).withColumn("_k", F.coalesce(F.sum((F.col("code") == F.lit(branch)).cast("int")).over(w), F.lit(0)))
    last = [F.max_by(F.when(F.col("code") == F.lit(p), F.col("reg")), F.when(F.col("code") == F.lit(p), F.col("t"))).alias(f"at_{p}") for p in points]
    return rows.groupBy(*keys, "_k").agg(F.max(F.when(F.col("code") == F.lit(branch), F.col("t"))).alias("t"), *last).filter("t is not null").drop("_k")


def writes_before_branch(trace: DataFrame, branch, n: int, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """Other records that come before the n-th execution of branch."""
    seen = F.sum((F.col("code") == F.lit(branch)).cast("int")).over(Window.partitionBy(*keys).orderBy("t"))
    return trace.withColumn("_seen", seen).filter((F.col("_seen") < n) & (F.col("code") != F.lit(branch))).drop("_seen")


def last_outcomes(split: DataFrame, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """The last taken and the last not taken record of each key."""
    return split.groupBy(*keys, "taken").agg(F.max("t").alias("t"))


def trace_points(trace: DataFrame, keys: Sequence[str] = ("run",), codes: Sequence = ()) -> DataFrame:
    """Per key, how often each of codes was seen, in columns n_<code>."""
    return trace.groupBy(*keys).agg(*[F.count_if(F.col("code") == F.lit(c)).alias(f"n_{c}") for c in codes])


def sample_outcomes(split: DataFrame, n: int, keys: Sequence[str] = ("tid",), seed: int = 0) -> DataFrame:
    """Of each key n taken and n not taken records, drawn by a seeded hash of their time."""
    w = Window.partitionBy(*keys, "taken").orderBy(F.xxhash64(F.lit(seed), "t"), "t")
    return split.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def values_before(trace: DataFrame, branch, point, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """(keys, t, reg_t): for each branch record the nearest earlier record of point, unless one without an address lies between."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(*BEFORE)
    is_point = F.col("code") == F.lit(point)
    last = F.last(F.when(is_point | F.col("addr").isNull(), F.struct("t", is_point.alias("hit"), F.col("addr").isNotNull().alias("ok"))), ignorenulls=True).over(w)
    rows = trace.withColumn("_l", last).filter(F.col("code") == F.lit(branch))
    return rows.select(*keys, "t", F.when(F.col("_l.hit") & F.col("_l.ok"), F.col("_l.t")).alias("reg_t"))
