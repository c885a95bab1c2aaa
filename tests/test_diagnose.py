"""The comparison of two runs against loops over small random runs."""

import itertools

import numpy as np
import pytest

from rootloom.operators import compare, diagnose
from rootloom.operators.diagnose import SIDE, side_of, sides_equal

REL = f"grp string, insn long, key long, perc double, actual double, ts double, duplicate boolean, fwd {SIDE}, bwd {SIDE}"
KID = f"parent long, insn long, key long, perc double, fwd {SIDE}, bwd {SIDE}"


def equal(a, b, n=None, m=None):
    return sides_equal(a["fwd"], b["fwd"]) and sides_equal(a["bwd"], b["bwd"], n, m)


def random_side(rng):
    kind = rng.integers(0, 4)
    if kind == 0:
        return side_of([float(rng.integers(1, 3))] * 4)
    if kind == 1:
        return side_of([0.0] * int(rng.integers(1, 4)) + [float(rng.integers(1, 3))] * int(rng.integers(1, 4)))
    return side_of(rng.integers(0, 3 if kind == 2 else 5, 12), rng.integers(0, 9, 12))


def random_run(rng, groups=3, insns=9):
    rows, kids, succ, rates = [], [], [], []
    for g in range(groups):
        for i in range(insns):
            if rng.random() < 0.75:
                rows.append((f"g{g}", i, i, float(rng.integers(1, 60)), float(rng.integers(1, 9)), float(rng.integers(1, 90)), bool(rng.random() < 0.1), random_side(rng), random_side(rng)))
            succ += [(f"g{g}", i, j) for j in range(insns) if rng.random() < 0.4]
    for p in range(insns):
        if rng.random() < 0.8:
            kids += [(p, k, k, float(rng.integers(1, 40)), random_side(rng), random_side(rng)) for k in range(insns) if rng.random() < 0.5]
            rates += [(p, u, b, t, float(rng.integers(0, 5)) / 4) for u in range(insns) if rng.random() < 0.5 for b, t in ((u, 1), (u, 4)) if rng.random() < 0.8]
    counts = [(i, int(rng.integers(1, 12))) for i in range(insns)]
    return rows, kids, succ, rates, counts


def as_maps(run):
    names = ("grp", "insn", "key", "perc", "actual", "ts", "duplicate", "fwd", "bwd")
    rel = {}
    for r in run[0]:
        rel.setdefault(r[0], {})[r[1]] = dict(zip(names, r))
    kids = {}
    for p, k, key, perc, f, b in run[1]:
        kids.setdefault(p, {})[k] = {"perc": perc, "fwd": f, "bwd": b}
    succ, rates = {}, {}
    for g, i, j in run[2]:
        succ.setdefault((g, i), set()).add(j)
    for d, u, b, t, x in run[3]:
        rates.setdefault((d, u), {})[b, t] = x
    return rel, kids, succ, rates, dict(run[4])


def children_same(l, r, side, g, insn, counts, rates):  # noqa: E741
    """Whether the children of a relation that one run alone has are the same in both."""
    if insn not in l[1] and insn not in r[1]:
        return False
    own, other = (l, r) if side == "l" else (r, l)
    for k, a in own[1].get(insn, {}).items():
        if k not in own[2].get((g, insn), ()):
            continue
        b = other[1].get(insn, {}).get(k)
        if b is None:
            if a["perc"] >= 5:
                return False
            continue
        x, y = (a, b) if side == "l" else (b, a)
        if equal(x, y, counts[0].get(k), counts[1].get(k)):
            continue
        p, q = l[3].get((insn, k)), r[3].get((insn, k))
        if rates and p and q and p.keys() == q.keys() and all(abs(p[e] - q[e]) * 100 <= 5 for e in p):
            continue
        return False
    return True


def slow_report(left, right, symptoms, rates):
    l, r = as_maps(left), as_maps(right)  # noqa: E741
    out = set()
    for g in set(l[0]) & set(r[0]):
        a, b = l[0][g], r[0][g]
        pairs, lone = [], []
        for i in sorted(a.keys() | b.keys()):
            if i in a and i in b:
                if not equal(a[i], b[i]) and (a[i]["perc"] + b[i]["perc"]) / 2 >= 5:
                    pairs.append(i)
            else:
                x = a.get(i) or b[i]
                if x["perc"] >= 5 and not x["duplicate"]:
                    lone.append((i, "l" if i in a else "r"))
        weight = {i: a[i]["perc"] for i in pairs} | {i: a[i]["perc"] for i, s in lone if s == "l"}
        top = max([(a[i]["ts"] + b[i]["ts"]) / 2 for i in pairs], default=1)
        found = []
        for i, s in lone:
            if not children_same(l, r, s, g, i, (l[4], r[4]), rates):
                x = (a if s == "l" else b)[i]
                found.append((x["perc"], i if s == "l" else None, i if s == "r" else None, x["perc"], x))
        kept = []
        for row in sorted((x for x in found), key=lambda x: (-x[0], x[1] if x[1] is not None else x[2])):
            if not any(equal(row[4], q[4]) for q in kept if (q[1] is None) == (row[1] is None)):
                kept.append(row)
        for i in pairs:
            x, y = a[i], b[i]
            gain = x["fwd"]["ratio"] - y["fwd"]["ratio"]
            forward = gain / x["fwd"]["ratio"] * x["perc"] if gain > 0 else 0
            back = max(y["perc"] - x["perc"], 0)
            if back > forward:
                lw, rw = x["perc"] * l[4][symptoms[g][0]] / 100, y["perc"] * r[4][symptoms[g][1]] / 100
                if not (lw < rw and (rw - lw) / rw * 100 >= 20 and x["actual"] <= y["actual"]):
                    back = 0
            parts = []
            for k, c in l[1].get(i, {}).items():
                if k == i or k not in l[2].get((g, i), ()):
                    continue
                w = weight.get(k, x["perc"])
                d = r[1].get(i, {}).get(k)
                gain = c["fwd"]["ratio"] - d["fwd"]["ratio"] if d else 0
                impact = 100 if d is None else 0 if equal(c, d) or gain <= 0 else gain / c["fwd"]["ratio"] * c["perc"]
                if c["bwd"]["v"] is None and c["bwd"]["prop"] is not None:
                    w *= c["bwd"]["prop"]
                if impact and rates:
                    p, q = l[3].get((i, k)), r[3].get((i, k))
                    if p or q:
                        more = [((p[e] - q.get(e, 0)) * 100, weight[e[1]]) for e in p if e[1] in weight and (p[e] - q.get(e, 0)) * 100 > 5] if p and q else []
                        parts += more or [(0, 100)]
                        continue
                parts.append((impact, w))
            new, met = 0, 0
            for impact, w in sorted(parts, reverse=True):
                met += w
                new += impact * w / 100
                if new > x["perc"]:
                    new = x["perc"]
                    break
            if not parts:
                new = forward
            elif met < forward:
                new += forward - met
            kept.append((min(100, back + new) if back > forward else new, i, i, abs(x["perc"] - y["perc"]), x, (x["ts"] + y["ts"]) / 2))
        for row in kept:
            m, ts = row[4]["fwd"]["ratio"], row[5] if len(row) > 5 else row[4]["ts"]
            out.add((g, row[1], row[2], round(row[0], 6), round(ts / max(top, 1) * 100, 6), round(row[3], 6), round(min(m, 1 / m) * 100 if m else 0, 6)))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rates", [False, True])
def test_report_equals_loops(spark, seed, rates):
    rng = np.random.default_rng(seed)
    left, right = random_run(rng), random_run(rng)
    # what both runs have in common is often equal
    right = ([x if rng.random() < 0.5 else y for x in right[0] for y in [next((z for z in left[0] if z[:2] == x[:2]), x)]], [x if rng.random() < 0.5 else next((z for z in left[1] if z[:2] == x[:2]), x) for x in right[1]], *right[2:])
    symptoms = {f"g{g}": (g, g + 1) for g in range(3)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    run = lambda x: (frame(x[0], REL), frame(x[1], KID), frame(x[2], "grp string, insn long, succ long"), frame(x[3], "def long, use long, branch long, target long, rate double"), frame(x[4], "insn long, n long"))
    a, b = run(left), run(right)
    s = frame([(g, *x) for g, x in symptoms.items()], "grp string, l long, r long")
    out = diagnose.compare_relations(a[0], b[0], s, a[1], b[1], a[2], b[2], a[4], b[4], (a[1], b[1]), (a[3], b[3]) if rates else None)
    got = {(r.grp, r.l_insn, r.r_insn, round(r.impact, 6), round(r.ts_perc, 6), round(r.weight, 6), round(r["corr"], 6)) for r in out.collect()}
    want = slow_report(left, right, symptoms, rates)
    assert got == want and len(want) > 5
    # the same through a table of matches, when that is the identity: only relations with lost successors may go
    same = frame([(i, i) for i in range(9)], "insn long, other_insn long")
    again = diagnose.compare_relations(a[0], b[0], s, a[1], b[1], a[2], b[2], a[4], b[4], (a[1], b[1]), None, same, same)
    if not rates:
        assert {(r.grp, r.l_insn, r.r_insn, round(r.impact, 6)) for r in again.collect()} == {x[:4] for x in want}


def test_lost_successors_and_matches(spark):
    """A relation with a successor that the other build lacks is not reported; instructions match through the table."""
    one = side_of([2.0, 2.0])
    left = [("g", 1, 1, 50.0, 1.0, 1.0, False, one, one), ("g", 2, 2, 30.0, 1.0, 1.0, False, side_of([3.0]), one), ("g", 5, 5, 20.0, 1.0, 4.0, False, side_of([4.0]), one)]
    right = [("g", 101, 9, 10.0, 1.0, 1.0, False, side_of([1.0]), one)]
    none = spark.createDataFrame([], KID)
    links = spark.createDataFrame([("g", 2, 7), ("g", 5, 1)], "grp string, insn long, succ long")
    counts = spark.createDataFrame([(1, 5), (101, 5)], "insn long, n long")
    to_right = spark.createDataFrame([(1, 101), (2, 102), (5, 105)], "insn long, other_insn long")
    to_left = spark.createDataFrame([(101, 1)], "insn long, other_insn long")
    s = spark.createDataFrame([("g", 1, 101)], "grp string, l long, r long")
    out = diagnose.compare_relations(spark.createDataFrame(left, REL), spark.createDataFrame(right, REL), s, none, none, links, links.limit(0), counts, counts, None, None, to_right, to_left)
    assert [(r.l_insn, r.r_insn, r.impact, r.rank) for r in out.orderBy("rank").collect()] == [(1, 101, 25.0, 1), (5, None, 20.0, 2)]


def test_groups(spark):
    one = side_of([2.0, 2.0])
    rel = spark.createDataFrame([(g, i, i, 10.0 * i, 1.0, 1.0, False, one, one) for g in ("a", "b", "c") for i in (1, 2)], REL)
    groups = lambda *x: spark.createDataFrame(x, "grp string, insn long, weight double")
    left, right = groups(("a", 1, 10.0), ("b", 2, 3.0)), groups(("b", 2, 4.5), ("c", 1, 70.0))
    compare_ = lambda l, r, s: diagnose.one_sided(l, s.select("grp", s.l.alias("insn")), "l").limit(0)  # noqa: E731, E741
    out = diagnose.compare_groups(left, right, rel, rel, compare_)
    assert sorted((r.grp, r.delta, r.l_insn, r.r_insn, r.impact) for r in out.collect()) == [("a", 10.0, 1, None, 10.0), ("c", 70.0, None, 1, 10.0)]
    assert [r.grp for r in diagnose.compare_groups(left, right, rel, rel, compare_, True).collect()] == ["c"]


def brute_p(n, m, h):
    hit = total = 0
    for c in itertools.combinations(range(n + m), n):
        x = y = most = 0
        for i in range(n + m):
            x, y = x + (i in c), y + (i not in c)
            most = max(most, abs(x * m - y * n))
        hit, total = hit + (most >= h), total + 1
    return hit / total


def test_ks_p():
    for n, m in ((3, 4), (4, 4), (2, 5), (5, 3), (1, 1), (6, 2)):
        for h in range(n * m + 1):
            assert abs(compare.ks_p(h, n, m) - brute_p(n, m, h)) < 1e-9, (n, m, h)
    # at the size where the limit takes over both agree
    for h in (20_000, 60_000, 100_000):
        exact = compare.ks_p(h, 3000, 2900)
        compare.ks_p.cache_clear()
        least, compare.KS_EXACT = compare.KS_EXACT, 10
        assert abs(compare.ks_p(h, 3000, 2900) - exact) < 0.003
        compare.KS_EXACT = least
        compare.ks_p.cache_clear()


def test_sides():
    inv, cond = side_of([2, 2]), side_of([0, 2, 2, 2])
    assert inv["prop"] is None and cond["prop"] == 0.75 and side_of([1, 2, 2])["v"] == [1.0, 2.0]
    assert not sides_equal(inv, cond) and sides_equal(inv, {**cond, "prop": 0.995}) and sides_equal(cond, {**cond, "prop": 0.70})
    assert not sides_equal(cond, {**cond, "prop": 0.5}) and sides_equal(cond, {**cond, "prop": 0.5}, 4, 6)
    a, b = side_of(range(9), [1] * 9), side_of(range(50, 59), [1] * 9)
    assert not sides_equal(a, inv) and sides_equal(a, a) and sides_equal(a, b) and not sides_equal({**a, "wv": None, "wn": None}, b)
