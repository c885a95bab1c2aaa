"""Graph operators over edge tables.

Edges are (src, dst).  Frontier loops are semi-naive: only new rows join the edges, each round is written to the
shared folder, and the driver sees one row a round.  Graphs of one function are small and independent, so those
analyses run grouped by function.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def reach(edges: DataFrame, targets: DataFrame, through_targets: bool = False) -> DataFrame:
    """(node, target) for every node with a path to target(node); a target passes nothing on but itself, unless through_targets.

    Rounds go on until one finds no new pair, so cycles end too.
    """
    e = stored(edges.select("src", "dst").distinct())
    seeds = stored(targets.select("node").distinct())
    found = stored(seeds.select("node", F.col("node").alias("target")))
    front = found
    for k in count():
        step = e.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "target")
        if not through_targets:
            step = step.join(seeds, "node", "left_anti")
        front = stored(step.distinct().join(found, ["node", "target"], "left_anti"))
        if not _some(front):
            return found
        found = found.union(front) if k % 8 != 7 else stored(found.union(front))


def forward_slice(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes reachable from starts(node)."""
    e = stored(edges.select("src", "dst").distinct())
    found = front = stored(starts.select("node").distinct())
    for k in count():
        front = stored(e.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti"))
        if not _some(front):
            return found
        found = found.union(front) if k % 8 != 7 else stored(found.union(front))


def backward_slice(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes from which some target is reached; back edges (is_backedge) are left out."""
    e = edges.filter("not is_backedge") if "is_backedge" in edges.columns else edges
    return forward_slice(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets)


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph: the longest path to a sink; a node's successors have lower levels.

    Only nodes whose level rose join the edges again.  A path longer than there are nodes is a cycle, an error.
    """
    e = stored(edges.select("src", "dst").distinct())
    best = stored(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("level", F.lit(0)))
    most, front = best.count(), best
    for _ in range(most):
        up = e.join(front.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((F.max("level") + 1).alias("up"))
        new = stored(best.join(up, "node", "left").select("node", F.greatest("level", "up").alias("level"), F.coalesce(F.col("up") > F.col("level"), F.lit(False)).alias("rose")))
        best, front = new.select("node", "level"), new.filter("rose").select("node", "level")
        if not _some(front):
            return best
    if not most:
        return best
    raise ValueError("the graph has a cycle")


def ends(nodes: DataFrame, edges: DataFrame, is_target: Column) -> DataFrame:
    """nodes with is_entry (no predecessor), is_exit (no successor) and is_target."""
    have = lambda c: edges.select(F.col(c).alias("node")).distinct().withColumn(f"_{c}", F.lit(True))
    out = nodes.join(have("dst"), "node", "left").join(have("src"), "node", "left")
    return out.withColumn("is_entry", F.col("_dst").isNull()).withColumn("is_exit", F.col("_src").isNull()).withColumn("is_target", is_target).drop("_dst", "_src")


def trim(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges between nodes that reach a target."""
    keep = backward_slice(edges, targets)
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def peel(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges left after sinks that are not targets are taken off again and again."""
    left = stored(edges.select("src", "dst").distinct())
    while True:
        sinks = left.select(F.col("dst").alias("node")).join(left.select(F.col("src").alias("node")), "node", "left_anti").join(targets.select("node"), "node", "left_anti").distinct()
        sinks = stored(sinks)
        if not _some(sinks):
            return left
        left = stored(left.join(sinks.withColumnRenamed("node", "dst"), "dst", "left_anti"))


def asymmetric(preds: DataFrame, succs: DataFrame) -> DataFrame:
    """Edges that one of the two lists has and the other lacks."""
    a, b = preds.select("src", "dst").distinct(), succs.select("src", "dst").distinct()
    return a.exceptAll(b).withColumn("only", F.lit("pred")).union(b.exceptAll(a).withColumn("only", F.lit("succ")))


def differing_predecessors(left: DataFrame, right: DataFrame, node) -> DataFrame:
    return asymmetric(left.filter(F.col("dst") == F.lit(node)), right.filter(F.col("dst") == F.lit(node)))


def paths(edges: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """All simple paths (array) from starts to targets; they are as many as the graph has, so trim it first."""
    e, t = edges.select("src", "dst").distinct(), targets.select(F.col("node").alias("dst")).distinct()
    front = starts.select(F.array("node").alias("path"), F.col("node").alias("src"))
    done = None
    while True:
        front = stored(front.join(e, "src").filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src")))
        hit = front.join(t, front["src"] == t["dst"], "left_semi").select("path")
        done = hit if done is None else done.union(hit)
        front = front.join(t, front["src"] == t["dst"], "left_anti")
        if not _some(front):
            return done


def propagate_weights(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, weight, is_aggregate): a node takes the one weight that all its successors have; several, or an aggregate one, make it aggregate (null)."""
    lv = stored(levels(edges))
    top = lv.agg(F.max("level")).first()[0] or 0
    known = stored(lv.filter("level = 0").join(weights.select("node", "weight"), "node", "left").select("node", "weight", F.lit(False).alias("is_aggregate")))
    for k in range(1, top + 1):
        here = lv.filter(F.col("level") == k).select("node")
        got = here.join(edges.select(F.col("src").alias("node"), "dst").distinct(), "node").join(known.select(F.col("node").alias("dst"), "weight", "is_aggregate"), "dst")
        new = got.groupBy("node").agg(F.count_distinct("weight").alias("n"), F.max("weight").alias("w"), F.bool_or("is_aggregate").alias("a"))
        mixed = F.col("a") | (F.col("n") > 1)
        own = weights.select("node", F.col("weight").alias("own"))
        new = new.join(own, "node", "left").select("node", F.coalesce("own", F.when(~mixed, F.col("w"))).alias("weight"), (mixed & F.col("own").isNull()).alias("is_aggregate"))
        known = stored(known.union(new))
    return known


def one_level(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Per start instruction its own small graph: edges into executions of starts(node, insn), with the insn."""
    return edges.join(starts.select(F.col("node").alias("dst"), "insn"), "dst").select("insn", "src", "dst")


def relation_search(static: DataFrame, start, admitted: DataFrame | None = None) -> DataFrame:
    """(node, depth): breadth-first over static predecessors of the symptom; only admitted(node) are expanded."""
    spark = static.sparkSession
    seen = stored(spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("depth")))
    front = seen
    for k in count(1):
        grown = front if admitted is None or k == 1 else front.join(admitted.select("node"), "node", "left_semi")
        new = static.join(grown.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(k))
        front = stored(new)
        if not _some(front):
            return seen
        seen = stored(seen.union(front))
    return seen


def merge_control(static: DataFrame, blocks: DataFrame) -> DataFrame:
    """Control edges of data-flow nodes: static(node, bb, is_cf, is_df) take those of their block's control predecessors, blocks(bb, pred_node)."""
    return static.filter("is_df").join(blocks, "bb").filter(F.col("pred_node") != F.col("node")).select(F.col("pred_node").alias("src"), F.col("node").alias("dst"), F.lit("cf").alias("kind")).distinct()


def callsite_edges(entries: DataFrame, callsites: DataFrame) -> DataFrame:
    """entries(func, node) get their callers(func, insn) as predecessors."""
    return entries.join(callsites, "func").select(F.col("insn").alias("src"), F.col("node").alias("dst"), F.lit("call").alias("kind"))


def dependent_branch(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks(bb, ends_in_branch, postorder, is_target): per block the last branch among its successors, and its first reachable target, in post-order."""
    last = edges.join(blocks.filter("ends_in_branch").select(F.col("bb").alias("dst"), "postorder"), "dst").groupBy(F.col("src").alias("bb")).agg(F.max_by("dst", "postorder").alias("branch"))
    r = reach(edges, blocks.filter("is_target").select(F.col("bb").alias("node")), True)
    far = r.join(blocks.select(F.col("bb").alias("target"), "postorder"), "target").filter("node <> target").groupBy(F.col("node").alias("bb")).agg(F.min_by("target", "postorder").alias("farthest_target"))
    return blocks.select("bb").join(last, "bb", "left").join(far, "bb", "left")


def converge(step, state: DataFrame, most: int = 100) -> tuple[DataFrame, int]:
    """(rows, rounds): step applied until the rows stay the same; an error if they still change after `most` rounds."""
    state = stored(state)
    for k in range(1, most + 1):
        new = stored(step(state))
        if not _some(new.exceptAll(state)) and not _some(state.exceptAll(new)):
            return new, k
        state = new
    raise RuntimeError(f"the rows still change after {most} rounds")


def wavefront_search(analyse, start: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Relations of the symptoms, then of their wavefronts, and so on: (relations, node with its round).

    analyse(front) gives (relations, next front(node)) of one round; a node is a symptom once.  most: rounds at most,
    as a bound on the report (1: the symptoms alone).
    """
    seen = stored(start.select("node").distinct().withColumn("round", F.lit(0)))
    front, found = seen, None
    for k in count(1):
        rows, grown = analyse(front.select("node"))
        rows = stored(rows.withColumn("round", F.lit(k - 1)))
        found = rows if found is None else found.unionByName(rows)
        front = stored(grown.select("node").distinct().join(seen, "node", "left_anti").withColumn("round", F.lit(k)))
        if k == most or not _some(front):
            return found, seen
        seen = stored(seen.union(front))


def slice_worklist(answers: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """(insn, func, round): the requests of an interprocedural slice, until none is new or after `limit` rounds.

    answers(insn, func, def_insn, def_func, explained): a request's definitions; those not explained are requests in turn.
    """
    a = stored(answers.filter("not explained").select("insn", "func", "def_insn", "def_func").distinct())
    seen = front = stored(starts.select("insn", "func").distinct().withColumn("round", F.lit(0)))
    for k in count(1):
        if limit is not None and k > limit:
            return seen
        new = a.join(front.select("insn", "func"), ["insn", "func"]).select(F.col("def_insn").alias("insn"), F.col("def_func").alias("func")).distinct()
        front = stored(new.join(seen, ["insn", "func"], "left_anti").withColumn("round", F.lit(k)))
        if not _some(front):
            return seen
        seen = stored(seen.union(front))


def definitions_before(edges: DataFrame, definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """(use, node): the first definitions(node) met on each path backwards from uses(node), over edges within and between functions."""
    e = stored(edges.select("src", "dst").distinct())
    d = stored(definitions.select("node").distinct())
    seen = None
    front = stored(uses.select(F.col("node").alias("use"), "node").distinct())
    while True:
        step = e.join(front.withColumnRenamed("node", "dst"), "dst").select("use", F.col("src").alias("node")).distinct()
        step = stored(step if seen is None else step.join(seen, ["use", "node"], "left_anti"))
        if not _some(step):
            break
        seen = step if seen is None else stored(seen.union(step))
        front = step.join(d, "node", "left_anti")
    return (front.limit(0) if seen is None else seen).join(d, "node", "left_semi").select("use", "node")


# analyses of single functions, which are small: one group each


def _postorder(succ: dict, roots: list) -> list:
    seen, out = set(), []
    for r in roots:
        stack = [(r, iter(succ.get(r, ())))] if r not in seen else []
        seen.add(r)
        while stack:
            n, it = stack[-1]
            for m in it:
                if m not in seen:
                    seen.add(m)
                    stack.append((m, iter(succ.get(m, ()))))
                    break
            else:
                out.append(n)
                stack.pop()
    return out


def _maps(pdf) -> tuple[dict, dict, list]:
    succ, pred = {}, {}
    for a, b in sorted(set(zip(pdf["src"], pdf["dst"], strict=True))):
        succ.setdefault(int(a), []).append(int(b))
        pred.setdefault(int(b), []).append(int(a))
    nodes = sorted(succ.keys() | pred.keys())
    return succ, pred, nodes


def control_order(edges: DataFrame) -> DataFrame:
    """edges(func, src, dst): (func, node, postorder), and per edge whether it closes a loop: (func, src, dst, is_backedge)."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        succ, pred, nodes = _maps(pdf)
        order = _postorder(succ, [n for n in nodes if n not in pred] + nodes)
        at = {n: k for k, n in enumerate(order)}
        rows = [(pdf["func"].iloc[0], a, b, at[a], at[b], at[b] >= at[a]) for a in nodes for b in succ.get(a, ())]
        return pd.DataFrame(rows, columns=["func", "src", "dst", "src_order", "dst_order", "is_backedge"])

    return edges.groupBy("func").applyInPandas(run, "func string, src long, dst long, src_order int, dst_order int, is_backedge boolean")


def post_dominators(edges: DataFrame) -> DataFrame:
    """edges(func, src, dst): (func, node, pdoms array, ipdom) of each function, to the fix-point."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        succ, pred, nodes = _maps(pdf)
        order = _postorder(succ, [n for n in nodes if n not in pred] + nodes)
        every = set(nodes)
        dom = {n: {n} if not succ.get(n) else set(every) for n in nodes}
        changed = True
        while changed:
            changed = False
            for n in order:
                if succ.get(n):
                    new = {n} | set.intersection(*(dom[m] for m in succ[n]))
                    if new != dom[n]:
                        dom[n], changed = new, True
        rows = []
        for n in nodes:
            strict = dom[n] - {n}
            ip = max(strict, key=lambda m: (len(dom[m]), -m), default=None)
            rows.append((pdf["func"].iloc[0], n, sorted(dom[n]), ip))
        return pd.DataFrame(rows, columns=["func", "node", "pdoms", "ipdom"]).astype({"ipdom": "Int64"})

    return edges.groupBy("func").applyInPandas(run, "func string, node long, pdoms array<long>, ipdom long")


def simplify_slice(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Regions between a branching block and its immediate post-dominator with no target(func, node) are cut out: edges(func, src, dst) relinked."""
    import pandas as pd

    both = edges.select("func", "src", "dst", F.lit(False).alias("t")).union(targets.select("func", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("t")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = set(map(int, pdf.loc[pdf["t"], "src"]))
        succ, pred, nodes = _maps(pdf[~pdf["t"]])
        live = {n: list(s) for n, s in succ.items()}
        order = _postorder(succ, [n for n in nodes if n not in pred] + nodes)

        def dominators():
            every = set(nodes)
            dom = {n: {n} if not live.get(n) else set(every) for n in nodes}
            while True:
                new = {n: ({n} | set.intersection(*(dom[m] for m in live[n]))) if live.get(n) else {n} for n in order}
                if all(new[n] == dom[n] for n in order):
                    return new
                dom.update(new)

        dom = dominators()
        for n in reversed(order):  # from the entry on
            if len(live.get(n, ())) < 2:
                continue
            strict = dom[n] - {n}
            if not strict:
                continue
            join = max(strict, key=lambda m: (len(dom[m]), -m))
            inside, stack = set(), [m for m in live[n] if m != join]
            while stack:
                m = stack.pop()
                if m not in inside and m != join:
                    inside.add(m)
                    stack += live.get(m, [])
            if n not in inside and not inside & keep:
                live[n] = [join]
        roots = [n for n in nodes if n not in pred] or nodes[:1]
        alive = set(_postorder(live, roots))
        rows = [(pdf["func"].iloc[0], a, b) for a in sorted(alive) for b in live.get(a, ())]
        return pd.DataFrame(rows, columns=["func", "src", "dst"])

    return both.groupBy("func").applyInPandas(run, "func string, src long, dst long")


def stack_heights(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """edges(func, src, dst), deltas(func, node, delta): height on entry to each node; of conflicting ones the first holds."""
    import pandas as pd

    both = edges.select("func", "src", "dst", F.lit(None).cast("long").alias("d")).union(deltas.select("func", F.col("node").alias("src"), F.col("node").alias("dst"), F.col("delta").cast("long").alias("d")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {int(a): int(d) for a, d in zip(pdf["src"], pdf["d"], strict=True) if d == d and d is not None}
        succ, pred, nodes = _maps(pdf[pdf["d"].isna()])
        nodes = sorted({*nodes, *own})
        height: dict = {}
        for n in reversed(_postorder(succ, [n for n in nodes if n not in pred] + nodes)):
            height.setdefault(n, 0)
            for m in succ.get(n, ()):
                height.setdefault(m, height[n] + own.get(n, 0))
        return pd.DataFrame([(pdf["func"].iloc[0], n, h) for n, h in sorted(height.items())], columns=["func", "node", "height"])

    return both.groupBy("func").applyInPandas(run, "func string, node long, height long")


def reaching_stores(edges: DataFrame, stores: DataFrame) -> DataFrame:
    """edges(func, src, dst), stores(func, node, place): (func, node, place, store) stores that reach a node's entry; a later store to a place kills earlier ones."""
    import pandas as pd

    both = edges.select("func", "src", "dst", F.lit(None).cast("string").alias("p")).union(stores.select("func", F.col("node").alias("src"), F.col("node").alias("dst"), F.col("place").cast("string").alias("p")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gen: dict = {}
        for a, p in zip(pdf["src"], pdf["p"], strict=True):
            if isinstance(p, str):
                gen.setdefault(int(a), set()).add(p)
        succ, pred, nodes = _maps(pdf[pdf["p"].isna()])
        nodes = sorted({*nodes, *gen})
        into: dict = {n: set() for n in nodes}
        work = list(nodes)
        while work:
            n = work.pop()
            mine = gen.get(n, set())
            out = {(p, s) for p, s in into[n] if p not in mine} | {(p, n) for p in mine}
            for m in succ.get(n, ()):
                if not out <= into[m]:
                    into[m] |= out
                    work.append(m)
        return pd.DataFrame([(pdf["func"].iloc[0], n, p, s) for n in nodes for p, s in sorted(into[n])], columns=["func", "node", "place", "store"])

    return both.groupBy("func").applyInPandas(run, "func string, node long, place string, store long")


def taint(log: DataFrame) -> DataFrame:
    """log(tid, t, dst, srcs array, origin): the origins each written place holds, in order of t within a thread."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        rows = []
        for tid, t, dst, srcs, origin in pdf.sort_values("t")[["tid", "t", "dst", "srcs", "origin"]].itertuples(index=False):
            new = set().union(*(held.get(s, set()) for s in srcs)) if srcs is not None else set()
            if origin is not None and origin == origin:
                new = new | {origin}
            held[dst] = new
            rows.append((tid, t, dst, sorted(new)))
        return pd.DataFrame(rows, columns=["tid", "t", "dst", "origins"])

    return log.groupBy("tid").applyInPandas(run, "tid long, t long, dst string, origins array<string>")


def attributed(reached: DataFrame, backedges: DataFrame) -> DataFrame:
    """Reach counts with loop exclusion: reached(static, uid, target, via_loop) in order of uid within a static node.

    A target that an execution got through a loop edge is dropped if an earlier finalised execution of the same
    static node holds it already.  Only static nodes in backedges(static) are looked at in order; the rest pass.
    """
    import pandas as pd

    rows = reached.join(backedges.select("static").distinct().withColumn("_b", F.lit(True)), "static", "left")
    free, bound = rows.filter("_b is null").drop("_b"), rows.filter("_b").drop("_b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: set = set()
        keep = []
        for uid, group in pdf.sort_values("uid").groupby("uid", sort=True):
            ok = [not (v and t in held) for t, v in zip(group["target"], group["via_loop"], strict=True)]
            mine = group[ok]
            held |= set(mine["target"])
            keep.append(mine)
        return pd.concat(keep) if keep else pdf

    return free.unionByName(bound.groupBy("static").applyInPandas(run, bound.schema))
