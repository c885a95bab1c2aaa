"""Graph operators on small graphs, against answers worked out by hand or by a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootloom.operators import align, graph, order
from rootloom.operators import edges as edges_

PAIR = "src long, dst long"


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), PAIR)


def flow(spark, *pairs, func="f"):
    return spark.createDataFrame([(func, a, b) for a, b in pairs], "func string, src long, dst long")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_paths(spark):
    e = edges(spark, (1, 2), (2, 3), (1, 3), (3, 1), (2, 4), (4, 4))
    assert sorted(r.path for r in graph.paths(e, nodes(spark, 1), nodes(spark, 3, 4)).collect()) == [[1, 2, 3], [1, 2, 4], [1, 3]]
    assert graph.paths(e, nodes(spark, 1), nodes(spark, 9)).collect() == []


def test_propagate_weights(spark):
    # 5 and 6 are sinks; 3 has one weight, 2 two different ones, 1 an aggregate successor, 4 a weight of its own
    e = edges(spark, (3, 5), (2, 3), (2, 6), (1, 2), (4, 2), (7, 4))
    w = spark.createDataFrame([(5, 2.0), (6, 3.0), (4, 9.0)], "node long, weight double")
    assert rows(graph.propagate_weights(e, w)) == [(1, None, True), (2, None, True), (3, 2.0, False), (4, 9.0, False), (5, 2.0, False), (6, 3.0, False), (7, 9.0, False)]


def test_stack_heights(spark):
    e = flow(spark, (1, 2), (2, 3), (1, 4), (4, 3))
    d = spark.createDataFrame([("f", 1, -8), ("f", 2, -16), ("f", 4, 8)], "func string, node long, delta int")
    got = {r.node: r.height for r in graph.stack_heights(e, d).collect()}
    assert got[1] == 0 and got[2] == -8 and got[4] == -8 and got[3] in (-24, 0)


def brute_stores(pairs, stores):
    """(node, place, store) for each path from a store to a node's entry without another store to that place between."""
    out = set()
    for s, p in stores:
        seen, front = set(), [b for a, b in pairs if a == s]
        while front:
            n = front.pop()
            if n in seen:
                continue
            seen.add(n)
            out.add((n, p, s))
            if (n, p) not in stores:
                front += [b for a, b in pairs if a == n]
    return out


def test_reaching_stores(spark):
    rnd = random.Random(3)
    for k in range(3):
        pairs = sorted({(rnd.randrange(8), rnd.randrange(8)) for _ in range(14)})
        stores = sorted({(rnd.randrange(8), rnd.choice("xy")) for _ in range(5)})
        got = graph.reaching_stores(flow(spark, *pairs), spark.createDataFrame([("f", *s) for s in stores], "func string, node long, place string"))
        assert set(rows(got, "node", "place", "store")) == brute_stores(pairs, set(stores)), k


def test_taint(spark):
    log = [(1, 1, "a", None, "in"), (1, 2, "b", ["a"], None), (2, 2, "b", ["a"], None), (1, 3, "c", ["b", "z"], "x"), (1, 4, "a", [], None), (1, 5, "d", ["a", "c"], None)]
    df = spark.createDataFrame(log, "tid long, t long, dst string, srcs array<string>, origin string")
    assert rows(graph.taint(df)) == sorted([(1, 1, "a", ["in"]), (1, 2, "b", ["in"]), (2, 2, "b", []), (1, 3, "c", ["in", "x"]), (1, 4, "a", []), (1, 5, "d", ["in", "x"])], key=repr)


def test_attributed(spark):
    reached = [(7, 1, 100, False), (7, 2, 100, True), (7, 2, 101, True), (7, 3, 101, False), (8, 1, 100, True), (8, 2, 100, True)]
    df = spark.createDataFrame(reached, "static long, uid long, target long, via_loop boolean")
    got = graph.attributed(df, spark.createDataFrame([(7,)], "static long"))
    assert rows(got) == sorted([(7, 1, 100, False), (7, 2, 101, True), (7, 3, 101, False), (8, 1, 100, True), (8, 2, 100, True)], key=repr)


def brute_post_dominators(pairs):
    """m post-dominates n if each way from n to an exit meets it: without m no exit is reached."""
    every = {x for p in pairs for x in p}
    exits = every - {a for a, _ in pairs}

    def leaves(n, without):
        seen, front = set(), [n] if n != without else []
        while front:
            x = front.pop()
            if x in exits:
                return True
            if x not in seen:
                seen.add(x)
                front += [b for a, b in pairs if a == x and b != without]
        return False

    return {n: sorted(m for m in every if not leaves(n, m)) for n in every if leaves(n, None)}


def test_post_dominators(spark):
    rnd = random.Random(5)
    for k in range(3):
        pairs = sorted({tuple(sorted(rnd.sample(range(9), 2))) for _ in range(13)})  # acyclic: every node leads to an exit
        got = {r.node: r.pdoms for r in graph.post_dominators(flow(spark, *pairs)).collect()}
        assert got == brute_post_dominators(pairs), k


def test_simplify_slice(spark):
    e = flow(spark, (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7))
    t = spark.createDataFrame([("f", 5)], "func string, node long")
    assert rows(graph.simplify_slice(e, t), "src", "dst") == [(1, 4), (4, 5), (4, 6), (5, 7), (6, 7)]
    two = e.union(flow(spark, (1, 2), func="g"))
    assert {r.func for r in graph.simplify_slice(two, t).collect()} == {"f", "g"}


def test_control_order(spark):
    got = graph.control_order(flow(spark, (1, 2), (2, 3), (3, 2), (2, 4)))
    assert rows(got.filter("is_backedge"), "src", "dst") == [(3, 2)]
    assert got.filter("not is_backedge and src_order <= dst_order").count() == 0


def brute_reach(pairs, targets, through):
    out = set()
    for t in targets:
        out.add((t, t))
        seen, front = {t}, [t]
        while front:
            x = front.pop()
            for a, b in pairs:
                if b == x and a not in seen and (through or a not in targets):
                    seen.add(a)
                    front.append(a)
                    out.add((a, t))
    return out


def test_reach_and_slices(spark):
    rnd = random.Random(7)
    pairs = sorted({(rnd.randrange(12), rnd.randrange(12)) for _ in range(16)})
    e, t = edges(spark, *pairs), nodes(spark, 2, 5)
    for through in (False, True):
        assert set(rows(graph.reach(e, t, through))) == brute_reach(pairs, {2, 5}, through)
    keep = {a for a, _ in brute_reach(pairs, {2, 5}, True)}
    assert {r.node for r in graph.backward_slice(e, t).collect()} == keep
    assert set(rows(graph.trim(e, t), "src", "dst")) == {p for p in pairs if set(p) <= keep}


def test_levels_and_peel(spark):
    e = edges(spark, (1, 2), (2, 3), (1, 3), (3, 4), (5, 4), (2, 6))
    assert rows(graph.levels(e)) == [(1, 3), (2, 2), (3, 1), (4, 0), (5, 1), (6, 0)]
    assert rows(graph.peel(e, nodes(spark, 3)), "src", "dst") == [(1, 2), (1, 3), (2, 3)]
    try:
        graph.levels(edges(spark, (1, 2), (2, 1)))
        raise AssertionError("a cycle has no levels")
    except ValueError:
        pass


def test_small_operators(spark):
    e = edges(spark, (1, 2), (2, 3), (4, 2))
    n = nodes(spark, 1, 2, 3, 9)
    assert rows(graph.ends(n, e, F.col("node") == 3), "node", "is_entry", "is_exit", "is_target") == [(1, True, False, False), (2, False, False, False), (3, False, True, True), (9, True, True, False)]
    assert rows(graph.asymmetric(e, edges(spark, (1, 2), (7, 8)))) == [(2, 3, "pred"), (4, 2, "pred"), (7, 8, "succ")]
    assert rows(graph.differing_predecessors(e, edges(spark, (1, 2)), 2)) == [(4, 2, "pred")]
    assert rows(graph.one_level(e, spark.createDataFrame([(2, 50)], "node long, insn long"))) == [(50, 1, 2), (50, 4, 2)]
    assert rows(graph.relation_search(e, 3)) == [(1, 2), (2, 1), (3, 0), (4, 2)]
    assert rows(graph.relation_search(e, 3, nodes(spark, 1))) == [(2, 1), (3, 0)]
    static = spark.createDataFrame([(1, 7, True, False), (2, 7, False, True), (3, 7, True, True)], "node long, bb long, is_cf boolean, is_df boolean")
    assert rows(graph.merge_control(static, spark.createDataFrame([(7, 1), (7, 3)], "bb long, pred_node long"))) == [(1, 2, "cf"), (1, 3, "cf"), (3, 2, "cf")]
    assert rows(graph.callsite_edges(spark.createDataFrame([("f", 1)], "func string, node long"), spark.createDataFrame([("f", 40), ("g", 41)], "func string, insn long"))) == [(40, 1, "call")]
    blocks = spark.createDataFrame([(1, False, 4, False), (2, True, 3, False), (3, True, 2, True), (4, False, 1, True)], "bb long, ends_in_branch boolean, postorder int, is_target boolean")
    assert rows(graph.dependent_branch(edges(spark, (1, 2), (1, 3), (2, 4), (3, 4)), blocks)) == [(1, 2, 4), (2, None, 4), (3, None, 4), (4, None, None)]


def test_converge(spark):
    halve = lambda df: df.select((F.col("x") / 2).cast("long").alias("x"))
    out, n = graph.converge(halve, spark.createDataFrame([(9,), (2,)], "x long"))
    assert rows(out) == [(0,), (0,)] and n == 5
    with pytest.raises(RuntimeError):
        graph.converge(halve, spark.createDataFrame([(9,)], "x long"), most=2)


def test_long_paths_are_whole(spark):
    """Nothing stops at a number of rounds or edges: a chain of 60, which the operators follow to its end."""
    n = 60
    chain = edges(spark, *[(k, k + 1) for k in range(n)])
    assert rows(graph.paths(chain, nodes(spark, 0), nodes(spark, n))) == [(list(range(n + 1)),)]
    assert graph.levels(chain).filter(f"level = {n} and node = 0").count() == 1


def test_levels_find_cycles(spark):
    with pytest.raises(ValueError):
        graph.levels(edges(spark, (1, 2), (2, 3), (3, 1), (3, 4)))
    assert rows(graph.levels(edges(spark, (1, 2), (1, 3), (3, 2)))) == [(1, 2), (2, 0), (3, 1)]
    assert graph.levels(edges(spark, (1, 2)).limit(0)).count() == 0


def test_occurrence_in_stretches(spark):
    rng = np.random.default_rng(3)
    data = [(int(c), int(t), f"x{t}") for t, c in zip(rng.permutation(500) * 3, rng.integers(0, 4, 500) ** 2)]
    df = spark.createDataFrame(data, "code long, t long, more string")
    for desc in (False, True):
        whole, split = (sorted(order.occurrence(df, descending=desc, rows=n).select("t", "code", "more", "occurrence").collect()) for n in (10**6, 40))
        assert whole == split and len(whole) == 500


def test_containing_over_wide_ranges(spark):
    rng = np.random.default_rng(4)
    ranges = [(int(a), int(a) + int(w)) for a, w in zip(rng.integers(0, 1 << 40, 60), 2 ** rng.integers(0, 41, 60))] + [(5, 4), (-100, 100), (7, 7)]
    points = [int(x) for x in rng.integers(0, 1 << 40, 200)] + [a for a, _ in ranges] + [b for _, b in ranges]
    got = align.containing(spark.createDataFrame([(x,) for x in points], "insn long"), spark.createDataFrame(ranges, "first long, last long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, a, b) for x in points for a, b in ranges if a <= x <= b)


def test_mask_cover_against_loops(spark):
    rng = np.random.default_rng(5)
    log = [(t, int(rng.integers(0, 3)), bool(rng.random() < 0.4), int(rng.integers(-(1 << 62), 1 << 62) | (int(rng.random() < 0.5) << 62)) * (1 if rng.random() < 0.5 else -1)) for t in range(80)]
    df = spark.createDataFrame(log, "t long, addr long, load boolean, m long")
    got = {tuple(r) for r in edges_.mask_cover(df, F.col("load"), ~F.col("load"), F.col("m")).select("load", "store_t", "rest").collect()}
    want = set()
    for t, addr, load, m in log:
        rest = m
        for s, a, other, w in reversed(log[:t]):
            if load and a == addr and not other:
                if rest & w:
                    want.add((t, s, rest))
                rest &= ~w
    assert got == want and len(want) > 20


def test_sample_outcomes(spark):
    df = spark.createDataFrame([(k % 3, k, k % 2 == 0) for k in range(60)], "tid long, t long, taken boolean")
    out = order.sample_outcomes(df, 4)
    assert out.groupBy("tid", "taken").count().filter("count <> 4").count() == 0 and rows(out) == rows(order.sample_outcomes(df, 4))
