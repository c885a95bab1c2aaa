"""Queries of the comparison of two runs, of matching between builds, and of the smaller operators on logs and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    canonical_register, caller_prefix, correlation, event_key, file_of, line_of, little_endian, magnitude_difference, parse_expression, register_width, shift_mask, shifted_address, strip_prefix, unpack_write,
)
from ..operators import align, compare, diagnose, edges, graph, order, profile, relate
from .catalog import EDGES, EV, QUADS, ST, _rounded, dynamic, quads, query, static, trace

_T = f"WITH {EV}, u AS (SELECT tid, count(*) AS n FROM ev GROUP BY tid)"
_SPLIT = "l AS (SELECT * FROM q WHERE flag <> 'R'), r AS (SELECT * FROM q WHERE flag <> 'A')"


def _threads(spark, sf):
    return trace(spark, sf).groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


def _sides(spark, sf):
    q = quads(spark, sf)
    return q.filter("flag <> 'R'"), q.filter("flag <> 'A'")


# comparing two runs


def _relations(spark, sf, run):
    """Groups are remainders of the address, instructions threads; a conditional forward side for two thirds of them."""
    tr = trace(spark, sf).filter(F.col("run") == run).withColumn("grp", (F.col("addr") % 4).cast("string"))
    big = F.avg((F.col("value") > 50).cast("double"))
    none = F.lit(None).cast("array<double>")
    g = order.sums_in_order(tr, ["grp", "tid"], "value", F.count(F.lit(1)).alias("rows"), F.avg("t").alias("ts"), big.alias("prop"))
    g = g.select("grp", F.col("tid").alias("insn"), F.col("rows").alias("n"), F.try_divide("sum", "n").alias("perc"), "ts", "prop")
    side = lambda ratio, prop: F.struct(ratio.cast("double").alias("ratio"), prop.alias("prop"), none.alias("v"), none.cast("array<long>").alias("n"), none.alias("wv"), none.cast("array<long>").alias("wn"))
    prop = F.when((F.col("insn") % 3 != 0) & (F.col("prop") > 0), F.col("prop"))
    return g.select("grp", "insn", F.col("insn").alias("key"), "perc", F.col("n").cast("double").alias("actual"), "ts", (F.col("insn") % 11 == 0).alias("duplicate"), side(F.col("n"), prop).alias("fwd"), side(F.col("insn"), F.lit(None).cast("double")).alias("bwd"))


_REL = f"""{EV}, g AS (SELECT run, CAST(addr % 4 AS VARCHAR) AS grp, tid AS insn, count(*) * 1.0E0 AS ratio, avg(value) AS perc, avg(t) AS ts, avg(CASE WHEN value > 50 THEN 1.0E0 ELSE 0 END) AS p0, tid % 11 = 0 AS dup FROM ev GROUP BY ALL),
h AS (SELECT *, CASE WHEN insn % 3 <> 0 AND p0 > 0 THEN p0 END AS prop FROM g), cn AS (SELECT run, tid, count(*) AS n FROM ev GROUP BY ALL),
sy AS (SELECT run, grp, min(insn) AS insn FROM h GROUP BY ALL), fw AS (SELECT sy.run, grp, n FROM sy JOIN cn ON cn.run = sy.run AND cn.tid = sy.insn),
j AS (SELECT coalesce(l.grp, r.grp) AS grp, l.insn AS li, r.insn AS ri, l.perc AS lp, r.perc AS rp, l.ratio AS lr, r.ratio AS rr, l.prop AS lq, r.prop AS rq, l.ts AS lt, r.ts AS rt, coalesce(l.dup, r.dup) AS dup
  FROM (SELECT * FROM h WHERE run = 'bad') l FULL JOIN (SELECT * FROM h WHERE run = 'good') r ON l.grp = r.grp AND l.insn = r.insn),
b AS (SELECT *, (lt + rt) / 2 AS ts FROM j WHERE li = ri AND (lp + rp) / 2 >= 5 AND NOT (lr = rr AND CASE WHEN lq IS NULL AND rq IS NULL THEN true WHEN lq IS NULL OR rq IS NULL THEN coalesce(lq, rq) >= 0.99 ELSE lq = rq OR abs(lq - rq) / lq < 0.1 OR abs(lq - rq) < 0.01 END)),
top AS (SELECT grp, greatest(max(ts), 1) AS top FROM b GROUP BY grp),
w AS (SELECT b.*, CASE WHEN lr > rr THEN (lr - rr) / lr * lp ELSE 0 END AS f, greatest(rp - lp, 0) AS k0, lp * fl.n / 100 AS lw, rp * fr.n / 100 AS rw FROM b JOIN fw fl ON fl.run = 'bad' AND fl.grp = b.grp JOIN fw fr ON fr.run = 'good' AND fr.grp = b.grp),
k AS (SELECT *, CASE WHEN k0 > f AND NOT (lw < rw AND (rw - lw) / rw * 100 >= 20 AND NOT lr > rr) THEN 0 ELSE k0 END AS k FROM w),
o AS (SELECT grp, li AS l_insn, ri AS r_insn, CASE WHEN k > f THEN least(100, k + f) ELSE f END AS impact, ts, abs(lp - rp) AS weight, least(lr, 1 / lr) * 100 AS corr FROM k
  UNION ALL SELECT grp, li, ri, coalesce(lp, rp), coalesce(lt, rt), coalesce(lp, rp), least(coalesce(lr, rr), 1 / coalesce(lr, rr)) * 100 FROM j WHERE (li IS NULL OR ri IS NULL) AND coalesce(lp, rp) >= 5 AND NOT dup)"""


@query(f"WITH {_REL} SELECT grp, l_insn, r_insn, round(impact, 6) AS impact, round(ts / coalesce(top, 1) * 100, 4) AS ts_perc, round(weight, 6) AS weight, round(corr, 6) AS corr, row_number() OVER (PARTITION BY grp ORDER BY impact DESC, l_insn NULLS FIRST, r_insn NULLS FIRST) AS rank FROM o LEFT JOIN top USING (grp)")
def relation_report(spark, sf):
    """All groups of both runs compared, from matching relations to the ranked report."""
    none = spark.createDataFrame([], f"parent long, insn long, key long, perc double, fwd {diagnose.SIDE}, bwd {diagnose.SIDE}")
    links = spark.createDataFrame([], "grp string, insn long, succ long")
    counts = lambda run: trace(spark, sf).filter(F.col("run") == run).groupBy(F.col("tid").alias("insn")).agg(F.count(F.lit(1)).alias("n"))
    left, right = (_relations(spark, sf, run) for run in ("bad", "good"))
    first = lambda df, c: df.groupBy("grp").agg(F.min("insn").alias(c))
    out = diagnose.compare_relations(left, right, first(left, "l").join(first(right, "r"), "grp"), none, none, links, links, counts("bad"), counts("good"))
    return _rounded(out.withColumn("ts_perc", F.round("ts_perc", 4)).drop("ts"))


@query(f"""WITH {EV}, a AS (SELECT code AS grp, sum(value) AS w FROM ev WHERE run = 'bad' AND code <> 'error' GROUP BY code), b AS (SELECT code AS grp, sum(value) AS w FROM ev WHERE run = 'good' AND code <> 'view' GROUP BY code)
  SELECT coalesce(a.grp, b.grp) AS grp, round_even(CASE WHEN a.w IS NULL THEN b.w WHEN b.w IS NULL THEN a.w ELSE abs(a.w - b.w) END, 0) AS delta, a.w IS NOT NULL AS l, b.w IS NOT NULL AS r FROM a FULL JOIN b ON a.grp = b.grp""")
def group_reports(spark, sf):
    """Groups of both runs by their difference, with the symptom's own relation where one run lacks the group."""
    tr = trace(spark, sf)
    groups = lambda run, but: tr.filter((F.col("run") == run) & (F.col("code") != but)).groupBy(F.col("code").alias("grp")).agg(F.lit(7).cast("long").alias("insn"), F.sum("value").alias("weight"))
    side = F.from_json(F.lit('{"ratio": 2.0}'), diagnose.SIDE)
    rel = lambda g: g.select("grp", F.explode(F.array(F.lit(7).cast("long"), F.lit(8).cast("long"))).alias("insn")).select("grp", "insn", F.col("insn").alias("key"), F.lit(50.0).alias("perc"), F.lit(1.0).alias("actual"), F.lit(3.0).alias("ts"), F.lit(False).alias("duplicate"), side.alias("fwd"), side.alias("bwd"))
    report = lambda l, r, s: s.select("grp", "l", "r").withColumn("x", F.lit(1.0)).select("grp", F.col("l").alias("l_insn"), F.col("r").alias("r_insn"), *[F.col("x").alias(c) for c in ("impact", "ts_perc", "weight", "ts", "corr")], F.lit(1).alias("rank"))  # noqa: E731, E741
    left, right = groups("bad", "error"), groups("good", "view")
    out = diagnose.compare_groups(left, right, rel(left), rel(right), report)
    return out.select("grp", "delta", F.col("l_insn").isNotNull().alias("l"), F.col("r_insn").isNotNull().alias("r"))


@query(f"WITH {EV}, w AS (SELECT run, addr AS key, sum(value) AS weight FROM ev GROUP BY ALL), d AS (SELECT key, CASE WHEN count(*) = 2 THEN round_even(abs(max(weight) FILTER (run = 'bad') - max(weight) FILTER (run = 'good')), 0) ELSE max(weight) END AS delta FROM w GROUP BY key) SELECT key, round(delta, 4) AS delta FROM d ORDER BY delta DESC, key DESC LIMIT 1")
def greatest_difference(spark, sf):
    w = trace(spark, sf).groupBy("run", F.col("addr").alias("key")).agg(F.sum("value").alias("weight"))
    return compare.top_group(compare.match_groups(w.filter("run = 'bad'"), w.filter("run = 'good'"))).select("key", F.round("delta", 4).alias("delta"))


@query(f"{_T} SELECT tid AS insn, n % 8 AS n FROM u WHERE tid % 8 = n % 8")
def symptoms_own(spark, sf):
    return compare.one_sided(_threads(spark, sf).select(F.col("tid").alias("insn"), (F.col("n") % 8).alias("n"), (F.col("tid") % 8).alias("m")).withColumnRenamed("insn", "_i").withColumnRenamed("m", "insn"), "n").select(F.col("_i").alias("insn"), "n")


@query(f"WITH {EV}, w AS (SELECT run, addr % 16 AS key, CAST(least(count(*), 40) AS BIGINT) AS weight FROM ev GROUP BY ALL) SELECT key, abs(max(weight) FILTER (run = 'bad') - max(weight) FILTER (run = 'good')) AS delta FROM (SELECT run, key, weight // 2 // 2 // 2 // 2 // 2 // 2 AS weight FROM w) GROUP BY key")
def converging_runs(spark, sf):
    """Both analyses, here halving weights, repeated until the difference stays: all are zero then."""
    w = trace(spark, sf).groupBy("run", (F.col("addr") % 16).alias("key")).agg(F.least(F.count(F.lit(1)), F.lit(40)).alias("weight"))
    halve = lambda own, other: own.select("key", F.floor(F.col("weight") / 2).alias("weight"))
    left, right = (w.filter(F.col("run") == run).select("key", "weight") for run in ("bad", "good"))
    _, _, diff = compare.converged(halve, left, right)
    return diff.select("key", F.col("delta").cast("long").alias("delta"))


# relations of one run


@query(f"{_T} SELECT tid FROM u WHERE tid % 3 <> 0 OR n % 2 <> 0")
def relations_kept(spark, sf):
    kind = lambda c: F.when(c, "irrelevant").otherwise("variable")
    return relate.relevant_relations(_threads(spark, sf).select("tid", kind(F.col("tid") % 3 == 0).alias("fwd_class"), kind(F.col("n") % 2 == 0).alias("bwd_class"))).select("tid")


@query(f"WITH {EV} SELECT tid, addr, row_number() OVER (PARTITION BY tid ORDER BY addr % 5 || '.c:' || addr % 3 || ',9', round_even(value, 2), t) AS pos FROM ev")
def relations_in_order(spark, sf):
    rows = trace(spark, sf).withColumn("file", F.concat((F.col("addr") % 5).cast("string"), F.lit(".c"))).withColumn("lines", F.array(F.col("addr") % 3, F.lit(9).cast("long")))
    return relate.ordered(rows.withColumn("perc", F.col("value")).withColumn("corr", F.col("t")), ["tid"]).select("tid", "addr", "pos")


@query(f"WITH {EV}, m AS (SELECT run, t, value, coalesce(max(value) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM ev) SELECT run, t, value AS weight FROM m WHERE value >= 0.01 * top OR t IN (SELECT t FROM ev WHERE code = 'view')")
def pruned_groups(spark, sf):
    tr = trace(spark, sf)
    rows = tr.select("run", F.col("t").alias("insn"), F.col("t").alias("seq"), F.col("value").alias("weight"))
    return relate.prune_small(rows, ["run"], tr.filter("code = 'view'").select(F.col("t").alias("insn"))).select("run", F.col("insn").alias("t"), "weight")


@query(f"WITH {EV}, c AS (SELECT tid AS target, code AS static, count(*) AS c FROM ev GROUP BY ALL), v AS (SELECT tid AS target, max(value) AS w FROM ev WHERE tid % 2 = 0 GROUP BY tid) SELECT static, round(avg(c * coalesce(w, 0)), 4) AS w_mu, round(stddev_pop(c * coalesce(w, 0)), 4) AS w_sd FROM c LEFT JOIN v USING (target) GROUP BY static")
def weighted_backward_fit(spark, sf):
    tr = trace(spark, sf)
    c = tr.groupBy(F.col("tid").alias("target"), F.col("code").alias("static")).agg(F.count(F.lit(1)).alias("c"))
    w = tr.filter("tid % 2 = 0").groupBy(F.col("tid").alias("target")).agg(F.max("value").alias("weight"))
    fit = relate.weighted_fit(relate.weighted_backward(c, w), ["static"])
    return fit.select("static", F.round("w_mu", 4).alias("w_mu"), F.round("w_sd", 4).alias("w_sd"))


@query(f"WITH {EV} SELECT tid, greatest(max(t - 5000) * 1.0E0, 1) AS max_ts, greatest(max(value - 90), 1) AS max_weight FROM ev GROUP BY tid")
def report_scales(spark, sf):
    return relate.report_scale(trace(spark, sf).select("tid", (F.col("t") - 5000).cast("double").alias("ts"), (F.col("value") - 90).alias("weight")), ["tid"])


# logs


@query(f"WITH {EV}, s AS (SELECT tid, t, code, addr % 4 AS m, max(t) OVER w AS x FROM ev WINDOW w AS (PARTITION BY tid)) SELECT t, CAST((SELECT min(b.t) FROM ev b WHERE b.tid = s.tid AND b.t >= s.t AND b.code = 'error') AS BIGINT) AS tid FROM s WHERE code <> 'error'")
def threads_by_marks(spark, sf):
    """A mark (here an error) names, by its time, the thread that ran up to it; here each user is a run."""
    raw = trace(spark, sf).select(F.col("tid").alias("run"), "t", F.when(F.col("code") == "error", 0).otherwise(1).alias("code"), F.col("t").alias("mark"))
    return order.thread_of_records(raw).select("t", "tid")


@query(f"WITH {EV}, n AS (SELECT tid, t, code, coalesce(lead(code) OVER (PARTITION BY tid ORDER BY t) = 'purchase', false) AS taken FROM ev) SELECT tid, taken, max(t) AS t FROM n WHERE code = 'click' GROUP BY ALL")
def last_branch_outcomes(spark, sf):
    return order.last_outcomes(order.branch_split(trace(spark, sf), "click", "purchase"))


@query(f"WITH {EV}, n AS (SELECT tid, t, code, (SELECT max(b.t) FROM ev b WHERE b.tid = a.tid AND b.t < a.t AND b.code = 'view') AS before, (SELECT min(b.t) FROM ev b WHERE b.tid = a.tid AND b.t > a.t AND b.code = 'view') AS after FROM ev a WHERE code = 'click') SELECT tid, t, before AS target_t, 'before' AS side FROM n WHERE before IS NOT NULL UNION ALL SELECT tid, t, after, 'after' FROM n WHERE after IS NOT NULL")
def operands_attached(spark, sf):
    tr, operand, target = trace(spark, sf), F.col("code") == "click", F.col("code") == "view"
    one = lambda after, name: edges.attach_operands(tr, operand, target, after).withColumn("side", F.lit(name))
    return one(False, "before").union(one(True, "after"))


@query(f"WITH {EV}, z AS (SELECT tid, t, code, CASE WHEN t % 7 <> 0 THEN addr END AS addr FROM ev), n AS (SELECT a.tid, a.t, (SELECT max(b.t) FROM z b WHERE b.tid = a.tid AND b.t < a.t AND (b.code = 'view' OR b.addr IS NULL)) AS p FROM z a WHERE code = 'click') SELECT n.tid, n.t, CASE WHEN b.addr IS NOT NULL THEN n.p END AS reg_t FROM n LEFT JOIN z b ON b.t = n.p")
def values_before_branch(spark, sf):
    return order.values_before(trace(spark, sf).withColumn("addr", F.when(F.col("t") % 7 != 0, F.col("addr"))), "click", "view")


@query(f"WITH {EV} SELECT run, count(*) FILTER (code = 'click') AS n_click, count(*) FILTER (code = 'view') AS n_view FROM ev GROUP BY run")
def trace_point_counts(spark, sf):
    return order.trace_points(trace(spark, sf), ("run",), ("click", "view"))


@query(f"WITH {EV} SELECT addr FROM ev GROUP BY addr HAVING count(DISTINCT code) = (SELECT count(DISTINCT code) FROM ev)")
def common_points(spark, sf):
    return edges.in_all(trace(spark, sf), "addr", "code")


@query(f"WITH {EV}, k AS (SELECT addr FROM ev GROUP BY addr HAVING count(DISTINCT code) = (SELECT count(DISTINCT code) FROM ev)), f AS (SELECT addr, min(t) AS t FROM ev WHERE code = (SELECT min(code) FROM ev) AND addr IN (SELECT addr FROM k) GROUP BY addr) SELECT addr FROM f ORDER BY t LIMIT 1")
def first_common_point(spark, sf):
    return edges.first_common(trace(spark, sf), "addr", "code", "t")


@query(f"WITH {EV} SELECT t FROM ev WHERE code = 'click' OR addr IN (SELECT addr FROM ev WHERE code = 'error' AND tid % 5 = 0)")
def stores_to_look_at(spark, sf):
    tr = trace(spark, sf)
    return edges.candidate_stores(tr, tr.filter("code = 'error' and tid % 5 = 0"), F.col("code") == "click").select("t")


@query(f"WITH RECURSIVE {EV}, {ST}, {EDGES}, b AS (SELECT t FROM ev WHERE code = 'purchase' UNION SELECT edge.src_t FROM b JOIN edge ON edge.dst_t = b.t) SELECT t FROM ev WHERE code = 'error' OR t IN (SELECT t FROM b)")
def records_in_the_slice(spark, sf):
    tr = trace(spark, sf)
    g = dynamic(spark, sf).select(F.col("src_t").alias("src"), F.col("dst_t").alias("dst"))
    inside = graph.backward_slice(g, tr.filter("code = 'purchase'").select(F.col("t").alias("node")))
    return edges.relevant(tr, inside.withColumnRenamed("node", "t"), F.col("code") == "error").select("t")


@query(f"{_T} SELECT tid AS insn FROM u WHERE tid % 3 = 1")
def indirect_calls(spark, sf):
    regs = F.slice(F.array(F.lit("rax"), F.lit("rbx")), F.lit(1), (F.col("tid") % 3).cast("int"))
    return edges.indirect_callsites(_threads(spark, sf).select(F.col("tid").alias("insn"), regs.alias("regs"))).select("insn")


@query(f"WITH {EV}, d AS (SELECT tid AS use, t, CASE WHEN code = 'error' THEN 'explained' WHEN addr % 2 = 0 THEN 'intermediate' WHEN addr % 3 = 0 THEN 'local' ELSE 'remote' END AS w FROM ev) SELECT use, t, w AS \"where\", CASE WHEN count(*) OVER (PARTITION BY use) > 1 THEN use END AS or_group FROM d")
def definition_classes(spark, sf):
    c = F.col
    rows = trace(spark, sf).select(c("tid").alias("use"), "t", F.when(c("code") == "error", "empty").otherwise("memread").alias("kind"), F.when(c("addr") % 3 == 0, "f").otherwise("g").alias("func"), F.lit("f").alias("use_func"), (c("addr") % 2 == 0).alias("same_as_write"))
    return edges.definition_class(rows).select("use", "t", "where", "or_group")


@query(f"{_T}, a AS (SELECT tid, n FROM u WHERE n > 8) SELECT u.tid, ev.addr FROM u JOIN ev USING (tid) WHERE u.n > 8 AND ev.addr <> 0 GROUP BY u.tid, ev.addr")
def executed_and_nonzero(spark, sf):
    counts = _threads(spark, sf).select(F.col("tid").alias("insn"), F.greatest(F.col("n") - 8, F.lit(0)).alias("n"))
    rows = edges.nonzero(trace(spark, sf)).select(F.col("tid").alias("insn"), "addr").distinct()
    return edges.executed(rows, counts).select(F.col("insn").alias("tid"), "addr")


@query(f"WITH {EV}, f AS (SELECT tid FROM ev GROUP BY tid HAVING count(DISTINCT addr) <= 50), d AS (SELECT DISTINCT tid, addr FROM ev WHERE tid IN (SELECT tid FROM f)), k AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY addr) AS k FROM d) SELECT tid, addr FROM k WHERE k <= 2")
def watched_addresses(spark, sf):
    return edges.next_watched(edges.watchable(trace(spark, sf), ("tid",), 50), ("tid",))


@query(f"WITH {EV}, p AS (SELECT DISTINCT addr FROM ev WHERE code = 'click'), w AS (SELECT addr, count(*) AS n FROM ev WHERE code = 'view' GROUP BY addr) SELECT addr, n FROM p JOIN w USING (addr)")
def static_writers_of_pending(spark, sf):
    tr = trace(spark, sf)
    return edges.static_writers(tr.filter("code = 'click'").select("addr").distinct(), tr.filter("code = 'view'").groupBy("addr").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {EV} SELECT t FROM ev WHERE NOT (addr % 2 = 0) AND (addr, code) NOT IN (SELECT addr, code FROM ev WHERE tid % 9 = 0)")
def requests_elsewhere(spark, sf):
    loads = trace(spark, sf).select("t", F.col("addr").alias("insn"), F.col("code").alias("func"), (F.col("addr") % 2 == 0).alias("same_as_write"), "tid")
    return edges.nonlocal_requests(loads, loads.filter("tid % 9 = 0")).select("t")


# places in two builds


@query(f"WITH {QUADS}, {_SPLIT} SELECT insn, EXISTS (SELECT 1 FROM r WHERE r.file = l.file AND r.line = l.line AND (r.idx = l.idx OR r.total <> l.total)) AS present FROM l")
def present_in_other(spark, sf):
    left, right = _sides(spark, sf)
    index = align.index_build(right)
    return align.present(left, index).select("insn", F.lit(True).alias("present")).union(align.absent(left, index).select("insn", F.lit(False)))


@query(f"WITH {QUADS}, {_SPLIT}, e AS (SELECT insn AS src, insn + 8 AS dst FROM l), m AS (SELECT l.insn FROM l JOIN r ON l.file = r.file AND l.line = r.line AND l.total = r.total AND l.idx = r.idx) SELECT insn FROM l WHERE insn NOT IN (SELECT src FROM e WHERE dst NOT IN (SELECT insn FROM m))")
def successors_in_other(spark, sf):
    left, right = _sides(spark, sf)
    e = left.select(F.col("insn").alias("src"), (F.col("insn") + 8).alias("dst"))
    return align.all_successors_present(left, e, align.translate(left.select("insn"), left, right)).select("insn")


@query(f"WITH {EV}, s AS (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY t) - 1 AS pos, t, code FROM ev) SELECT tid, pos, t, code FROM s")
def zipped_lists(spark, sf):
    lists = trace(spark, sf).groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("t", "code"))).alias("x"))
    return align.zipped(lists.select("tid", F.col("x.t").alias("t"), F.col("x.code").alias("code")), "t", "code")


@query(f"WITH {QUADS} SELECT insn, row_number() OVER (PARTITION BY file, line ORDER BY insn) AS rank FROM q")
def rank_of_blocks(spark, sf):
    q = quads(spark, sf).select("insn", F.col("file").alias("func"), F.col("line").alias("line_key"), F.col("insn").alias("start_insn"))
    return align.rank_in_function(q).select("insn", "rank")


@query("WITH p AS (SELECT o_orderkey, o_custkey FROM orders), r AS (SELECT l_suppkey % 50 AS k, l_linenumber * 1000 AS first, max(l_linenumber * 1000 + 400) AS last FROM lineitem GROUP BY ALL), j AS (SELECT o_orderkey, first, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN o_custkey BETWEEN first AND last THEN -1 ELSE abs(first - o_custkey) END, first) AS n FROM p JOIN r ON r.k = o_orderkey % 50) SELECT o_orderkey, first FROM j WHERE n = 1")
def nearest_ranges(spark, sf):
    from .catalog import _table

    points = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("k"), F.col("o_custkey").alias("insn"))
    first = (F.col("l_linenumber") * 1000).cast("long")
    ranges = _table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("k"), first.alias("first")).agg(F.max(first + 400).alias("last"))
    found = align.nearest_range(points.select("k", "insn").distinct(), ranges, ["k"])
    return points.join(found, ["k", "insn"]).select(F.col("id").alias("o_orderkey"), "first")


_FILES = "a AS (SELECT l_suppkey AS file, l_orderkey * 8 + l_linenumber AS x, l_returnflag AS flag FROM lineitem), b AS (SELECT file, x, row_number() OVER (PARTITION BY file, side ORDER BY x) AS line, side FROM (SELECT file, x, 0 AS side FROM a WHERE flag <> 'R' UNION SELECT file, x, 1 FROM a WHERE flag <> 'A')), cl AS (SELECT l.file, CAST(l.line AS INTEGER) AS left_line, CAST(r.line AS INTEGER) AS right_line FROM b l JOIN b r ON l.file = r.file AND l.x = r.x AND l.side = 0 AND r.side = 1)"


def _files(spark, sf):
    from pyspark.sql import Window

    from .catalog import _table

    a = _table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("x"), F.col("l_returnflag").alias("flag"))
    w = Window.partitionBy("file").orderBy("x")
    return [a.filter(F.col("flag") != out).select("file", "x").distinct().select("file", F.row_number().over(w).alias("line"), F.col("x").cast("string").alias("text")) for out in ("R", "A")]


@query(f"WITH {_FILES} SELECT CAST(file AS VARCHAR) AS file, left_line, right_line FROM cl")
def unchanged_lines(spark, sf):
    """Lines in rising order on both sides, so those that both have are the ones a difference leaves."""
    return align.common_lines(*_files(spark, sf))


@query(f"WITH {_FILES}, l AS (SELECT * FROM b WHERE side = 0), r AS (SELECT * FROM b WHERE side = 1) SELECT l.x AS insn, r.x AS other_insn FROM cl JOIN l ON l.file = cl.file AND l.line = cl.left_line JOIN r ON r.file = cl.file AND r.line = cl.right_line")
def instructions_by_line(spark, sf):
    left, right = _files(spark, sf)
    insns = lambda df: df.select(F.col("text").cast("long").alias("insn"), "file", "line")
    return align.match_lines(insns(left), insns(right), align.common_lines(left, right))


@query(f"{_T} SELECT 'f' || tid AS hot, 'f' || tid || '.cold.' || n AS cold FROM u WHERE tid % 2 = 0")
def hot_and_cold_parts(spark, sf):
    name = F.concat(F.lit("f"), F.col("tid").cast("string"))
    parts = F.when(F.col("tid") % 2 == 0, F.array(name, F.concat(name, F.lit(".cold."), F.col("n").cast("string")))).otherwise(F.array(name))
    return align.paired_parts(_threads(spark, sf).select(F.explode(parts).alias("func")))


@query(f"WITH {QUADS}, {_SPLIT}, g AS (SELECT file, line, min(idx) AS idx, max(total) AS total, min(insn) AS grp FROM l GROUP BY ALL), o AS (SELECT insn AS other, * FROM r), m AS (SELECT grp, other, row_number() OVER (PARTITION BY grp ORDER BY g.total <> o.total, o.idx, other) AS n FROM g JOIN o ON g.file = o.file AND g.line = o.line AND (g.total <> o.total OR g.idx = o.idx)) SELECT g.grp, m.other FROM g LEFT JOIN m ON m.grp = g.grp AND n = 1")
def groups_by_line(spark, sf):
    left, right = _sides(spark, sf)
    groups = left.groupBy("file", "line").agg(F.min("idx").alias("idx"), F.max("total").alias("total"), F.min("insn").alias("grp"))
    return align.match_groups_by_line(groups, right.withColumnRenamed("insn", "grp"))


@query(f"WITH {QUADS}, d AS (SELECT DISTINCT file, insn FROM q) SELECT file, insn, lead(insn) OVER (PARTITION BY file ORDER BY insn) AS next, min(insn) OVER (PARTITION BY file) AS first, max(insn) OVER (PARTITION BY file) AS last FROM d")
def facts_of_blocks(spark, sf):
    return align.block_facts(quads(spark, sf).select(F.col("file").alias("bb"), "insn").distinct()).withColumnRenamed("bb", "file")


# symptoms


@query(f"{_T} SELECT 'f' || tid AS func, n * 1.0E0 AS pct FROM u ORDER BY n DESC, 'f' || tid LIMIT 20")
def heaviest_functions(spark, sf):
    return profile.top_by_share(_threads(spark, sf).select(F.concat(F.lit("f"), F.col("tid").cast("string")).alias("func"), F.col("n").cast("double").alias("pct")))


@query(f"{_T} SELECT DISTINCT u.tid AS func, n, ev.addr FROM u JOIN ev USING (tid) WHERE n > 5")
def symptoms_with_addresses(spark, sf):
    top = _threads(spark, sf).filter("n > 5").withColumnRenamed("tid", "func")
    return profile.symptoms(top, trace(spark, sf).select(F.col("tid").alias("func"), "addr"))


# graphs whose nodes are instructions of the program


@query(f"{_T}, e AS (SELECT tid AS src, tid + 1 AS dst FROM u UNION SELECT tid, tid + 5 FROM u WHERE tid % 3 = 0) SELECT a.dst AS src, min(a.src) AS first, count(*) AS n FROM e a GROUP BY a.dst")
def call_edges(spark, sf):
    u = _threads(spark, sf)
    sites = u.select((F.col("tid") + 1).alias("func"), F.col("tid").alias("insn")).union(u.filter("tid % 3 = 0").select(F.col("tid") + 5, "tid"))
    entries = sites.select("func").distinct().select("func", F.col("func").alias("node"))
    return graph.callsite_edges(entries, sites).groupBy(F.col("dst").alias("src")).agg(F.min("src").alias("first"), F.count(F.lit(1)).alias("n"))


_G = f"WITH RECURSIVE {EV}, u AS (SELECT DISTINCT tid FROM ev), e AS (SELECT tid AS src, tid * 2 + 1 + tid % 3 AS dst FROM u UNION SELECT tid, tid * 2 + 5 FROM u WHERE tid % 4 = 0)"


def _calls(spark, sf):
    """Edges between threads, rising, as many as threads: a graph that grows with the table, and in depth with its logarithm."""
    u = trace(spark, sf).select("tid").distinct()
    twice = F.col("tid") * 2
    return u.select(F.col("tid").alias("src"), (twice + 1 + F.col("tid") % 3).alias("dst")).union(u.filter("tid % 4 = 0").select("tid", twice + 5)).distinct()


@query(f"{_G}, w AS (SELECT 0 AS insn, 0 AS round UNION SELECT e.dst, 0 FROM e JOIN w ON e.src = w.insn WHERE e.dst % 7 <> 0) SELECT DISTINCT insn FROM w")
def worklist_of_requests(spark, sf):
    answers = _calls(spark, sf).select(F.col("src").alias("insn"), F.lit("f").alias("func"), F.col("dst").alias("def_insn"), F.lit("f").alias("def_func"), (F.col("dst") % 7 == 0).alias("explained"))
    return graph.slice_worklist(answers, spark.createDataFrame([(0, "f")], "insn long, func string")).select("insn")


@query(f"{_G}, b AS (SELECT e.dst AS use, e.src AS node FROM e WHERE e.dst % 10 = 0 UNION SELECT b.use, e.src FROM b JOIN e ON e.dst = b.node WHERE b.node % 6 <> 0) SELECT use, node FROM b WHERE node % 6 = 0")
def definitions_on_paths(spark, sf):
    e = _calls(spark, sf)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graph.definitions_before(e, nodes.filter("node % 6 = 0"), nodes.filter("node % 10 = 0"))


@query(f"{_G}, f AS (SELECT 0 AS node UNION SELECT e.dst FROM e JOIN f ON f.node = e.src WHERE e.dst % 5 <> 0) SELECT DISTINCT e.src, e.dst FROM e JOIN f ON f.node = e.src")
def wavefronts_of_wavefronts(spark, sf):
    e = _calls(spark, sf)

    def analyse(front):
        rows = e.join(front.withColumnRenamed("node", "src"), "src").select("src", "dst")
        return rows, rows.filter("dst % 5 <> 0").select(F.col("dst").alias("node"))

    found, _ = graph.wavefront_search(analyse, spark.createDataFrame([(0,)], "node long"))
    return found.select("src", "dst")


@query(f"{_G}, a AS (SELECT * FROM e WHERE dst % 2 = 1), b AS (SELECT src + src % 2 AS src, dst FROM a) (SELECT *, 'pred' AS only FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'succ' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
def differing_edges(spark, sf):
    a = _calls(spark, sf).filter("dst % 2 = 1")
    return graph.asymmetric(a, a.select((F.col("src") + F.col("src") % 2).alias("src"), "dst"))


@query(f"{_G}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), l AS (SELECT node, 0 AS level FROM n UNION SELECT e.src, l.level + 1 FROM l JOIN e ON e.dst = l.node) SELECT node, max(level) AS level FROM l GROUP BY node")
def levels_of_calls(spark, sf):
    return graph.levels(_calls(spark, sf))


# functions of values


@query(f"""{_T}, nm(i, name, whole, width) AS (VALUES (0, 'EAX', 'rax', 4), (1, 'r11w', 'r11', 2), (2, 'sil', 'rsi', 1), (3, 'rbp', 'rbp', 8), (4, 'XMM1', 'xmm1', 8), (5, 'ah', 'rax', 1), (6, 'r8d', 'r8', 4))
  SELECT tid, whole, width FROM u JOIN nm ON i = tid % 7""")
def register_names(spark, sf):
    names = F.array(*[F.lit(x) for x in ("EAX", "r11w", "sil", "rbp", "XMM1", "ah", "r8d")])
    name = F.element_at(names, (F.col("tid") % 7 + 1).cast("int"))
    return _threads(spark, sf).select("tid", canonical_register(name).alias("whole"), register_width(name).alias("width"))


@query(f"WITH {EV} SELECT t, addr * 8 + 16 AS shifted, abs(addr - tid) AS gap, round(CASE WHEN addr > 1 THEN 1.0E0 / addr ELSE addr END, 6) AS corr, CASE WHEN addr % 2 = 0 THEN (tid + 1) << 3 ELSE (tid + 1) >> 2 END AS mask, addr % 256 + tid % 256 * 256 + 65536 AS word FROM ev")
def number_functions(spark, sf):
    c = F.col
    by = F.when(c("addr") % 2 == 0, F.lit(3)).otherwise(F.lit(-2))
    return trace(spark, sf).select("t", shifted_address(c("addr"), 3, F.lit(16)).alias("shifted"), magnitude_difference(c("addr"), c("tid")).alias("gap"), F.round(correlation(c("addr").cast("double")), 6).alias("corr"), shift_mask(c("tid") + 1, by).alias("mask"), little_endian(F.array(c("addr") % 256, c("tid") % 256, F.lit(1))).alias("word"))


@query(f"{_T} SELECT tid, 'b.c:2|a.c:' || tid || '|' AS callers, CASE WHEN tid % 2 = 0 THEN 'x/f' || tid || '.c' ELSE '/lib/f' || tid || '.c' END AS path, 'f' || tid || '.c' AS file, CASE WHEN tid % 3 <> 0 THEN CAST(n AS INTEGER) END AS line, 'f_' || tid || '_' || n AS key FROM u")
def text_functions(spark, sf):
    tid, n = F.col("tid").cast("string"), F.col("n").cast("string")
    path = F.concat(F.when(F.col("tid") % 2 == 0, "/src/x/f").otherwise("/lib/f"), tid, F.lit(".c"))
    where = F.concat(F.lit("a/f.c:"), F.when(F.col("tid") % 3 == 0, "?").otherwise(n))
    return _threads(spark, sf).select("tid", caller_prefix(F.array(F.concat(F.lit("a.c:"), tid), F.lit("b.c:2"))).alias("callers"), strip_prefix(path, "/src/").alias("path"), file_of(path).alias("file"), line_of(where).alias("line"), event_key(F.lit("f"), F.col("tid"), F.col("n")).alias("key"))


@query(f"{_T} SELECT tid, CASE WHEN tid % 2 = 0 THEN 'rax' ELSE '' END AS reg, lower(printf('%X', n)) AS off, CASE WHEN tid % 3 = 0 THEN '8' ELSE '0' END AS shift FROM u")
def writes_unpacked(spark, sf):
    reg, off, shift = unpack_write(F.when(F.col("tid") % 2 == 0, "RAX"), F.col("n"), F.when(F.col("tid") % 3 == 0, F.lit(8)))
    return _threads(spark, sf).select("tid", reg.alias("reg"), off.alias("off"), shift.alias("shift"))


@query(f"""{_T}, x AS (SELECT tid, n, lower(printf('%x', n)) AS h, tid % 8 AS k FROM u) SELECT tid, 'memread' AS kind, CASE WHEN k IN (2, 3) THEN 'RDX' ELSE 'RBP' END AS reg, CASE k WHEN 2 THEN n WHEN 3 THEN 16 ELSE 0 END AS shift,
  CASE k WHEN 0 THEN n WHEN 1 THEN -n WHEN 4 THEN 4 WHEN 5 THEN n WHEN 6 THEN n WHEN 7 THEN 16 ELSE 0 END AS off, CASE WHEN k >= 4 THEN 'RAX' END AS off_reg, CASE WHEN k = 4 THEN n WHEN k = 7 THEN n END AS off1 FROM x""")
def expressions_parsed(spark, sf):
    """Numbers are hex; a factor beside a register takes the offset's place."""
    h = F.lower(F.hex("n"))
    text = F.when(F.col("tid") % 8 == 0, F.concat(F.lit("RBP + 0x"), h)).when(F.col("tid") % 8 == 1, F.concat(F.lit("RBP-0x"), h)).when(F.col("tid") % 8 == 2, F.concat(h, F.lit("*RDX"))).when(F.col("tid") % 8 == 3, "RDX*0x10")
    text = text.when(F.col("tid") % 8 == 4, F.concat(F.lit("RBP + "), h, F.lit(" + 0x4*RAX"))).when(F.col("tid") % 8 == 5, F.concat(F.lit("RBP + 1*RAX + 0x"), h)).when(F.col("tid") % 8 == 6, F.concat(F.lit("RBP + RAX*0x"), h)).otherwise(F.concat(F.lit("0x"), h, F.lit(" + RBP + RAX*10")))
    return _threads(spark, sf).select("tid", parse_expression(F.concat(F.lit("memread|"), text)).alias("e")).select("tid", "e.*")
