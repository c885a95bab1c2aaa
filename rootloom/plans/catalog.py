"""The queries of the analysis operators over the driver's tables, and the SQL that checks them.

events is the execution log: event_id is time, user_id the thread, event_type the instruction, value a register; floor(value)
is an address, and the middle of the period parts a fast (good) from a slow (bad) run.  lineitem gives instructions' source
positions: part is the file, supplier the line, line number the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    backward_impact, boosted, count_tolerance, effective_address, forward_impact, invariance_equal, load_mask, mask_bits, negative_event, normalised_disassembly,
    normalised_weight, quad_key, remaining_mask, short_key, signed_offset, store_mask,
)
from ..operators import align, compare, edges, graph, order, profile, relate

CODES = ["click", "error", "purchase", "signup", "view"]
#: Static dependences (definition, use) between event types; acyclic, purchase is the symptom.
STATIC = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "purchase"), ("error", "purchase")]
SYMPTOM = "purchase"

EV = """ev AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'good' ELSE 'bad' END AS run, user_id AS tid, event_id AS t, event_type AS code,
  CAST(floor(value) AS BIGINT) AS addr, value FROM events)"""
ST = "st(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in STATIC) + ")"
EDGES = """marks AS (SELECT e.tid, s.dst AS f, e.t, e.code AS src, 0 AS u FROM ev e JOIN st s ON e.code = s.src
  UNION ALL SELECT e.tid, e.code, e.t, NULL, 1 FROM ev e WHERE e.code IN (SELECT dst FROM st)),
ed AS (SELECT tid, t AS dst_t, f AS dst, max(CASE WHEN u = 0 THEN t END) OVER (PARTITION BY tid, f ORDER BY t, u DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src_t, u FROM marks),
edge AS (SELECT ed.tid, ed.dst_t, ed.dst, ed.src_t, e.code AS src FROM ed JOIN ev e ON e.t = ed.src_t WHERE ed.u = 1)"""
REACH = """reach AS (SELECT t AS node, t AS target FROM ev WHERE code = 'purchase' UNION
  SELECT g.src_t, r.target FROM reach r JOIN edge g ON g.dst_t = r.node WHERE g.src <> 'purchase')"""
QUADS = "q AS (SELECT l_partkey AS file, l_suppkey AS line, l_linenumber AS idx, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS total, l_orderkey * 8 + l_linenumber AS insn, l_linestatus AS text, l_returnflag AS flag FROM lineitem)"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trace(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    run = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "good").otherwise("bad")
    return e.select(run.alias("run"), F.col("user_id").alias("tid"), F.col("event_id").alias("t"), F.col("event_type").alias("code"), F.floor("value").alias("addr"), "value")


def static(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATIC, "src string, dst string")


def dynamic(spark: SparkSession, sf: str) -> DataFrame:
    return edges.nearest_definition(trace(spark, sf), F.broadcast(static(spark)))  # a handful of static edges


def quads(spark: SparkSession, sf: str) -> DataFrame:
    li = _table(spark, sf, "lineitem")
    from pyspark.sql import Window

    return li.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("line"), F.col("l_linenumber").alias("idx"), F.count(F.lit(1)).over(Window.partitionBy("l_partkey", "l_suppkey")).alias("total"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("insn"), F.col("l_linestatus").alias("text"), F.col("l_returnflag").alias("flag"))


def reached(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, targets, reach) of the symptom."""
    tr = trace(spark, sf)
    g = dynamic(spark, sf).select(F.col("src_t").alias("src"), F.col("dst_t").alias("dst"))
    nodes = tr.select(F.col("t").alias("node"), F.col("code").alias("static"))
    targets = nodes.filter(F.col("static") == SYMPTOM).select("node")
    return nodes, targets, graph.reach(g, targets)


QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _pairs(spark, sf):
    """Per (prede, target) and event of prede: how many targets have it as their nearest."""
    tr = trace(spark, sf).select("tid", "t", "code")
    from pyspark.sql import Window

    w = Window.partitionBy("tid", "prede").orderBy("t").rowsBetween(*order.BEFORE)
    rows = tr.withColumn("prede", F.explode(F.array(*[F.lit(c) for c in CODES])))
    m = rows.withColumn("prede_t", F.last(F.when(F.col("code") == F.col("prede"), F.col("t")), ignorenulls=True).over(w)).filter(F.col("code") != F.col("prede"))
    return tr, m.select("prede", F.col("code").alias("target"), "t", "prede_t")


_M = f"""WITH {EV}, k AS (SELECT DISTINCT code AS prede FROM ev),
m AS (SELECT e.t, e.code AS target, k.prede, max(CASE WHEN e.code = k.prede THEN e.t END) OVER (PARTITION BY e.tid, k.prede ORDER BY e.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prede_t FROM ev e CROSS JOIN k),
pairs AS (SELECT a.prede, b.prede AS target FROM k a CROSS JOIN k b WHERE a.prede <> b.prede)"""
_CLASS = """CASE WHEN count(DISTINCT c) = 1 AND max(c) = 0 THEN 'irrelevant' WHEN count(DISTINCT c) = 1 THEN 'invariant' WHEN count(DISTINCT c) = 2 AND min(c) = 0 THEN 'conditional' ELSE 'variable' END"""
_STATS = f"count(*) AS n_inst, {_CLASS} AS class, max(c) AS ratio, round(avg(CASE WHEN c <> 0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS prop, round(avg(c), 6) AS mu, round(stddev_pop(c), 6) AS sd"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{_M}, f0 AS (SELECT p.prede, p.target, e.t, count(m.t) AS c FROM pairs p JOIN ev e ON e.code = p.prede LEFT JOIN m ON m.prede = p.prede AND m.target = p.target AND m.prede_t = e.t GROUP BY p.prede, p.target, e.t) SELECT prede, target, {_STATS} FROM f0 GROUP BY prede, target")
def relation_forward(spark, sf):
    tr, m = _pairs(spark, sf)
    n = m.filter("prede_t is not null").groupBy("prede", "target", F.col("prede_t").alias("t")).agg(F.count(F.lit(1)).alias("c"))
    grid = tr.select(F.col("code").alias("prede"), "t").withColumn("target", F.explode(F.array(*[F.lit(c) for c in CODES]))).filter("prede <> target")
    counts = grid.join(n, ["prede", "target", "t"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return _rounded(relate.classes(counts, ["prede", "target"]).withColumnRenamed("n", "n_inst"))


@query(f"{_M}, b AS (SELECT p.prede, p.target, e.t, count(m.prede_t) AS c FROM pairs p JOIN ev e ON e.code = p.target LEFT JOIN m ON m.prede = p.prede AND m.t = e.t GROUP BY p.prede, p.target, e.t) SELECT prede, target, {_STATS} FROM b GROUP BY prede, target")
def relation_backward(spark, sf):
    _, m = _pairs(spark, sf)
    counts = m.withColumn("c", F.when(F.col("prede_t").isNull(), 0).otherwise(1).cast("long"))
    return _rounded(relate.classes(counts, ["prede", "target"]).withColumnRenamed("n", "n_inst"))


@query(f"WITH {EV}, {ST}, {EDGES} SELECT tid, dst_t, dst, src_t, src FROM edge")
def nearest_multi_pred(spark, sf):
    return dynamic(spark, sf)


@query(f"WITH RECURSIVE {EV}, {ST}, {EDGES}, {REACH}, c AS (SELECT e.code, e.t, count(DISTINCT r.target) AS c FROM ev e LEFT JOIN reach r ON r.node = e.t GROUP BY e.code, e.t) SELECT code AS static, {_STATS} FROM c GROUP BY code")
def reach_forward(spark, sf):
    nodes, _, r = reached(spark, sf)
    return _rounded(relate.classes(relate.forward_counts(nodes, r), ["static"]).withColumnRenamed("n", "n_inst"))


@query(f"WITH RECURSIVE {EV}, {ST}, {EDGES}, {REACH}, g AS (SELECT x.t AS target, k.code AS static FROM ev x CROSS JOIN (SELECT DISTINCT code FROM ev) k WHERE x.code = 'purchase'), n AS (SELECT r.target, e.code AS static, count(*) AS n FROM reach r JOIN ev e ON e.t = r.node GROUP BY ALL), c AS (SELECT g.target, g.static, coalesce(n.n, 0) + CASE WHEN g.static = 'purchase' THEN 1 ELSE 0 END AS c FROM g LEFT JOIN n ON n.target = g.target AND n.static = g.static) SELECT static, {_STATS} FROM c GROUP BY static")
def reach_backward(spark, sf):
    nodes, targets, r = reached(spark, sf)
    return _rounded(relate.classes(relate.backward_counts(nodes, r, targets), ["static"]).withColumnRenamed("n", "n_inst"))


@query(f"WITH RECURSIVE {EV}, {ST}, {EDGES}, {REACH}, e2 AS (SELECT e.code AS static, count(DISTINCT e.t) AS executions, count(DISTINCT r.target) AS reachable FROM ev e LEFT JOIN reach r ON r.node = e.t GROUP BY e.code) SELECT static, executions, reachable, round(reachable * 100.0E0 / (SELECT count(*) FROM ev WHERE code = 'purchase'), 6) AS perc, round(CASE WHEN reachable = 0 THEN 0.0E0 ELSE least(executions * 1.0E0 / reachable, reachable * 1.0E0 / executions) END, 6) AS corr FROM e2")
def relation_weighted(spark, sf):
    nodes, targets, r = reached(spark, sf)
    ev = relate.reached_events(nodes, r).crossJoin(F.broadcast(targets.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return _rounded(relate.individual_weight(ev, F.col("n")).drop("n"))


@query(f"WITH RECURSIVE {EV}, {ST}, {EDGES}, {REACH}, w AS (SELECT e.code AS static, e.t AS node, coalesce(sum(x.value), 0) AS w FROM ev e LEFT JOIN (SELECT DISTINCT node, target FROM reach) r ON r.node = e.t LEFT JOIN ev x ON x.t = r.target GROUP BY e.code, e.t) SELECT static, count(*) AS n, round(sum(w), 4) AS total FROM w GROUP BY static")
def weighted_forward(spark, sf):
    nodes, _, r = reached(spark, sf)
    w = trace(spark, sf).select(F.col("t").alias("target"), F.col("value").alias("weight"))
    return relate.weighted_forward(nodes, r, w).groupBy("static").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"))


@query(f"WITH {EV} SELECT round(sum(value) FILTER (WHERE value > 0.05), 4) AS base_weight FROM ev WHERE code = 'purchase' HAVING avg(CASE WHEN value > 0.05 THEN 1.0 ELSE 0 END) >= 0.5")
def base_weight(spark, sf):
    t = trace(spark, sf).filter(F.col("code") == SYMPTOM).select(F.col("value").alias("weight"), (F.col("value") > 0.05).alias("valid"))
    return relate.base_weight(t, 0.5).select(F.round("base_weight", 4).alias("base_weight"))


@query(f"WITH RECURSIVE {EV}, {ST}, {EDGES}, {REACH}, k AS (SELECT DISTINCT node FROM reach) SELECT dst_t, src_t FROM edge WHERE dst_t IN (SELECT node FROM k) AND src_t IN (SELECT node FROM k)")
def trim_unreachable(spark, sf):
    tr = trace(spark, sf)
    g = dynamic(spark, sf).select(F.col("src_t").alias("src"), F.col("dst_t").alias("dst"))
    out = graph.trim(g, tr.filter(F.col("code") == SYMPTOM).select(F.col("t").alias("node")))
    return out.select(F.col("dst").alias("dst_t"), F.col("src").alias("src_t"))


@query(f"WITH {EV}, {ST}, {EDGES} SELECT e.t AS node, e.t NOT IN (SELECT dst_t FROM edge) AS is_entry, e.t NOT IN (SELECT src_t FROM edge) AS is_exit, e.code = 'purchase' AS is_target FROM ev e")
def entry_exit_target(spark, sf):
    g = dynamic(spark, sf).select(F.col("src_t").alias("src"), F.col("dst_t").alias("dst"))
    nodes = trace(spark, sf).select(F.col("t").alias("node"), "code")
    return graph.ends(nodes, g, F.col("code") == SYMPTOM).drop("code")


@query(f"WITH RECURSIVE {EV}, {ST}, {EDGES}, lv AS (SELECT t AS node, 0 AS level FROM ev WHERE t IN (SELECT dst_t FROM edge) OR t IN (SELECT src_t FROM edge) UNION SELECT g.src_t, lv.level + 1 FROM lv JOIN edge g ON g.dst_t = lv.node) SELECT node, max(level) AS level FROM lv GROUP BY node")
def topological_levels(spark, sf):
    return graph.levels(dynamic(spark, sf).select(F.col("src_t").alias("src"), F.col("dst_t").alias("dst")))


@query(f"WITH {EV} SELECT code, count(*) AS n, count(*) // 500 + 1 AS sampled FROM ev GROUP BY code")
def node_count_sampled(spark, sf):
    return order.node_count(trace(spark, sf))


@query(f"WITH {EV} SELECT code, list_reduce(list_prepend({{'a': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)}}, list_transform(list_sort(list(t)), lambda x: {{'a': x, 'n': CAST(0 AS BIGINT)}})), lambda s, x: {{'a': s.a + CAST(floor((x.a - s.a) / (s.n + 1)) AS BIGINT), 'n': s.n + 1}}).a AS avg_t FROM ev GROUP BY code")
def avg_timestamp_fold(spark, sf):
    return order.fold_average(trace(spark, sf))


@query(f"WITH {EV} SELECT code, round(avg(t), 6) AS avg_t FROM ev GROUP BY code")
def avg_timestamp_float(spark, sf):
    return _rounded(order.float_average(trace(spark, sf)))


@query(f"WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY t DESC) AS k FROM ev) SELECT tid, t, code FROM o WHERE (k - 1) % 50 = 0")
def systematic_sample(spark, sf):
    return order.systematic_sample(trace(spark, sf), period=50).select("tid", "t", "code")


@query(f"WITH {EV}, c AS (SELECT tid, code, count(*) AS n FROM ev GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY tid, code ORDER BY t DESC) AS k FROM ev WHERE value >= 1) SELECT o.tid, o.t, o.code FROM o JOIN c USING (tid, code) WHERE (k - 1) % 5 = 0 OR n < 12")
def adaptive_sample(spark, sf):
    tr = trace(spark, sf)
    counts = tr.groupBy("tid", "code").agg(F.count(F.lit(1)).alias("n"))
    return order.systematic_sample(tr, ("tid", "code"), 5, F.col("value") >= 1, counts, 12).select("tid", "t", "code")


@query(f"WITH {EV}, h AS (SELECT tid, code FROM ev GROUP BY ALL HAVING count(*) > 15) SELECT tid, t, code FROM ev WHERE (tid, code) NOT IN (SELECT (tid, code) FROM h)")
def hot_code_cutoff(spark, sf):
    return order.without_hot(trace(spark, sf), ("tid", "code"), 15).select("tid", "t", "code")


_ADDR = "max(CASE WHEN code = 'click' THEN t END) OVER (PARTITION BY addr ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {EV}, d AS (SELECT addr, t, code, {_ADDR} AS d FROM ev) SELECT addr, t AS dst_t, code AS dst, d AS src_t, 'click' AS src FROM d WHERE code = 'purchase' AND d IS NOT NULL")
def def_use_by_address(spark, sf):
    st = F.broadcast(spark.createDataFrame([("click", "purchase")], "src string, dst string"))
    return edges.nearest_definition(trace(spark, sf), st, ("addr",))


@query(f"WITH {EV}, v AS (SELECT *, CASE WHEN tid % 3 = 0 THEN NULL WHEN t % 2 = 0 THEN 4 ELSE 8 END AS width FROM ev) SELECT u.addr, u.t AS dst_t, 'purchase' AS dst, max(d.t) AS src_t, 'click' AS src FROM v u JOIN v d ON d.addr = u.addr AND d.code = 'click' AND d.t < u.t AND (u.width IS NULL OR d.width IS NULL OR u.width = d.width) WHERE u.code = 'purchase' GROUP BY u.addr, u.t")
def width_tolerant_def(spark, sf):
    st = F.broadcast(spark.createDataFrame([("click", "purchase")], "src string, dst string"))
    width = F.when(F.col("tid") % 3 == 0, None).when(F.col("t") % 2 == 0, 4).otherwise(8)
    return edges.nearest_definition(trace(spark, sf).withColumn("width", width), st, ("addr",), width=True)


@query(f"WITH {EV}, p AS (SELECT u.t AS load, (u.t % 255) + 1 AS mask, d.t AS store_t, d.t % 256 AS store_mask FROM ev u JOIN ev d ON d.addr = u.addr AND d.tid = u.tid AND d.code = 'click' AND d.t < u.t WHERE u.code = 'purchase'), r AS (SELECT *, mask & ~coalesce(bit_or(store_mask) OVER (PARTITION BY load ORDER BY store_t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM p) SELECT load, store_t, mask, store_mask, rest FROM r WHERE (rest & store_mask) <> 0")
def mask_coverage(spark, sf):
    load = F.col("code") == "purchase"
    mask = F.when(load, F.col("t") % 255 + 1).otherwise(F.col("t") % 256)
    return edges.mask_cover(trace(spark, sf), load, F.col("code") == "click", mask, ("addr", "tid"), 8).select("load", "store_t", "mask", "store_mask", "rest")


@query(f"WITH {EV}, w AS (SELECT addr, t, code, lag(code) OVER x AS p, lag(t) OVER x AS pt FROM ev WHERE code IN ('click', 'view') WINDOW x AS (PARTITION BY addr ORDER BY t)) SELECT addr, t AS read_t, pt AS write_t FROM w WHERE code = 'view' AND p = 'click'")
def last_write_consumed(spark, sf):
    return edges.consumed_writes(trace(spark, sf).filter(F.col("code").isin("click", "view")), F.col("code") == "click")


@query(f"WITH {EV}, w AS (SELECT tid, t, code, addr % 4 AS v, last_value(CASE WHEN code = 'click' THEN addr % 4 END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM ev WHERE code IN ('click', 'view')) SELECT t, CASE WHEN l = v THEN 'known' WHEN l IS NOT NULL OR v <> 0 THEN 'unknown' ELSE 'neither' END AS state FROM w WHERE code = 'view'")
def known_unknown_writes(spark, sf):
    log = trace(spark, sf).filter(F.col("code").isin("click", "view")).withColumn("value", F.col("addr") % 4)
    return edges.known_writes(log, F.col("code") == "click", ("tid",)).select("t", "state")


@query(f"WITH {EV} SELECT a.t, max(b.t) AS other_t FROM ev a LEFT JOIN ev b ON b.addr = a.addr AND b.tid % 4 = a.tid % 4 AND b.t < a.t AND b.code <> a.code GROUP BY a.t")
def last_other_writer(spark, sf):
    p = trace(spark, sf).select("addr", (F.col("tid") % 4).alias("shift"), "t", F.col("code").alias("point"))
    return edges.last_other_writer(p).select("t", "other_t")


@query(f"WITH {EV}, w AS (SELECT code, lag(code) OVER (PARTITION BY addr, tid % 4 ORDER BY t) AS p FROM ev) SELECT code AS point, coalesce(bool_or(p IN ('click', 'purchase')), false) AS overwrites, bool_or(NOT coalesce(p IN ('click', 'purchase'), false)) AS partial, coalesce(bool_or(p = code), false) AS double FROM w WHERE code NOT IN ('click', 'purchase') GROUP BY code")
def shadow_flags(spark, sf):
    p = trace(spark, sf).select("addr", (F.col("tid") % 4).alias("shift"), "t", F.col("code").alias("point"))
    return edges.shadow_flags(p, F.col("point").isin("click", "purchase"))


@query(f"WITH {EV} SELECT tid, t, coalesce(lead(code) OVER (PARTITION BY tid ORDER BY t) = 'purchase', false) AS taken, code FROM ev QUALIFY code = 'click'")
def branch_split(spark, sf):
    return order.branch_split(trace(spark, sf), "click", "purchase").select("tid", "t", "taken", "code")


@query(f"WITH {EV} SELECT tid, t, coalesce(lead(code) OVER (PARTITION BY tid ORDER BY t) = 'purchase', false) AS taken, code FROM ev WHERE code IN ('click', 'purchase') QUALIFY code = 'click'")
def branch_outcome(spark, sf):
    return order.branch_outcome(trace(spark, sf), "click", "purchase").select("tid", "t", "taken", "code")


_ISL = f"""WITH {EV}, a AS (SELECT tid, t, code, CASE WHEN lag(code) OVER (PARTITION BY tid ORDER BY t) = code THEN 0 ELSE 1 END AS n FROM ev), b AS (SELECT *, sum(n) OVER (PARTITION BY tid ORDER BY t) AS island FROM a)"""


@query(f"{_ISL} SELECT tid, CAST(island AS BIGINT) AS island, code, min(t) AS start_t, max(t) AS end_t, count(*) AS length FROM b GROUP BY tid, island, code")
def code_islands(spark, sf):
    return order.islands(trace(spark, sf))


@query(f"{_ISL.replace('FROM ev)', 'FROM ev WHERE code IN (' + chr(39) + 'click' + chr(39) + ', ' + chr(39) + 'view' + chr(39) + '))')}, i AS (SELECT tid, island, code, count(*) AS length FROM b GROUP BY ALL), l AS (SELECT *, coalesce(lead(length) OVER (PARTITION BY tid ORDER BY island), 0) AS s FROM i) SELECT tid, CAST(island AS BIGINT) AS island, length AS n_pred, s AS n_succ, CASE WHEN s = length THEN 'same' WHEN s < length THEN 'less' ELSE 'more' END AS kind, round(s * 1.0E0 / length, 6) AS ratio FROM l WHERE code = 'click'")
def predictive_ratio(spark, sf):
    return _rounded(order.predictive_ratio(trace(spark, sf), "click", "view"))


@query(f"WITH {EV}, n AS (SELECT tid, code, coalesce(lead(code) OVER (PARTITION BY tid ORDER BY t) = 'view', true) AS ok FROM ev) SELECT tid, bool_and(ok) AS always FROM n WHERE code = 'signup' GROUP BY tid")
def always_followed(spark, sf):
    return order.always_followed(trace(spark, sf), "signup", "view")


@query(f"WITH {EV}, {ST}, b AS (SELECT e.tid, e.t, s.src, s.dst, (SELECT min(x.t) FROM ev x WHERE x.tid = e.tid AND x.t > e.t AND x.code IN (SELECT dst FROM st s2 WHERE s2.src = s.src)) AS nt FROM ev e JOIN st s ON e.code = s.src), c AS (SELECT e.tid, e.t, s.src, s.dst, (SELECT max(x.t) FROM ev x WHERE x.tid = e.tid AND x.t < e.t AND x.code IN (SELECT src FROM st s2 WHERE s2.dst = s.dst)) AS pt FROM ev e JOIN st s ON e.code = s.dst) SELECT b.src AS branch, b.dst AS target, count(*) AS n FROM b JOIN c ON b.tid = c.tid AND b.src = c.src AND b.dst = c.dst AND b.nt = c.t AND c.pt = b.t GROUP BY b.src, b.dst")
def cf_pass_counts(spark, sf):
    st = F.broadcast(static(spark).select(F.col("src").alias("branch"), F.col("dst").alias("target")))
    return order.pass_counts(trace(spark, sf), st)


@query(f"WITH {EV}, {ST}, {EDGES}, c AS (SELECT src AS node, dst AS succ, count(*) AS n FROM edge GROUP BY ALL), t AS (SELECT code AS node, count(*) AS total FROM ev GROUP BY code) SELECT c.node, c.succ, round(n * 1.0E0 / total, 6) AS rate FROM c JOIN t ON c.node = t.node")
def static_pass_rates(spark, sf):
    c = dynamic(spark, sf).groupBy(F.col("src").alias("node"), F.col("dst").alias("succ")).agg(F.count(F.lit(1)).alias("n"))
    t = trace(spark, sf).groupBy(F.col("code").alias("node")).agg(F.count(F.lit(1)).alias("total"))
    return _rounded(compare.pass_rates(c, t).select("node", "succ", "rate"))


@query(f"""WITH RECURSIVE {EV}, {ST}, {EDGES}, cf AS (SELECT src AS branch, dst AS target, count(*) AS n FROM edge GROUP BY ALL), total AS (SELECT code, count(*) AS n FROM ev GROUP BY code),
  go AS (SELECT DISTINCT src AS def, dst AS use, dst AS at FROM st WHERE src IN (SELECT code FROM total) AND dst IN (SELECT branch FROM cf) UNION SELECT go.def, go.use, st.dst FROM go JOIN st ON st.src = go.at WHERE st.dst IN (SELECT branch FROM cf))
  SELECT go.def, go.use, cf.branch, cf.target, round(cf.n * 1.0E0 / total.n, 6) AS rate FROM go JOIN cf ON cf.branch = go.at JOIN total ON total.code = go.at""")
def def_use_pass_rates(spark, sf):
    c = dynamic(spark, sf).groupBy(F.col("src").alias("branch"), F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    t = trace(spark, sf).groupBy(F.col("code").alias("node")).agg(F.count(F.lit(1)).alias("total"))
    return _rounded(compare.def_use_rates(static(spark), c, t))


@query(f"WITH {EV} SELECT t, CAST(CASE WHEN tid % 7 = 0 THEN 0 ELSE CASE WHEN tid % 3 <> 0 THEN addr * (tid % 3) ELSE addr END + CASE WHEN code = 'error' THEN 0 ELSE tid * coalesce(CASE WHEN t % 2 = 0 THEN 2 END, 1) + 16 END END AS BIGINT) AS ea FROM ev")
def effective_addresses(spark, sf):
    c = F.col
    ea = effective_address(F.when(c("tid") % 7 != 0, c("addr")), c("tid") % 3, c("tid"), F.when(c("t") % 2 == 0, F.lit(2)), F.lit(16), F.when(c("code") == "error", "ES"))
    return trace(spark, sf).select("t", ea.alias("ea"))


@query(f"WITH {EV} SELECT t, CASE WHEN tid % 5 = 0 THEN 0 ELSE ((t % 256) << 4) | (addr % 64) END AS load_mask, CASE WHEN tid % 4 = 0 THEN NULL ELSE (~(t % 256)) | (addr % 64) END AS store_mask, CAST(bit_count(t) AS BIGINT) AS bits, t & ~((addr & t)) AS rest FROM ev")
def masks(spark, sf):
    op = lambda name, v: F.struct(F.lit(name).alias("operation"), v.cast("long").alias("operand"))
    c = F.col
    ops = F.array(F.array(op("and", c("t") % 256), op("shr", F.lit(4))), F.array(op("and", c("addr") % 64)))
    st = F.array(op("and", c("t") % 256), F.struct(F.when(c("tid") % 4 == 0, "xor").otherwise("or").alias("operation"), (c("addr") % 64).cast("long").alias("operand")))
    return trace(spark, sf).select("t", load_mask(ops, c("tid") % 5 == 0).alias("load_mask"), store_mask(st).alias("store_mask"), mask_bits(c("t")).cast("long").alias("bits"), remaining_mask(c("t"), c("addr")).alias("rest"))


@query(f"WITH {EV} SELECT t, concat_ws('_', code, tid, 9, t) AS quad, concat_ws('_', code, tid) AS short, CASE WHEN t % 2 = 0 THEN -1 - t ELSE t END AS off, code || ' ,()' AS norm, round(CASE WHEN value > 1 THEN (value - 1) / value * 100 ELSE 0 END, 6) AS fwd, round(greatest(value - 1, 0), 6) AS bwd, round(CASE WHEN addr = 0 THEN 0 ELSE value / addr * 1000 END, 4) AS norm_weight FROM ev")
def scalar_functions(spark, sf):
    c = F.col
    text = F.when(c("t") % 2 == 0, F.lower(F.hex(-1 - c("t")))).otherwise(F.lower(F.hex("t")))
    return trace(spark, sf).select("t", quad_key(c("code"), c("tid"), F.lit(9), c("t")).alias("quad"), short_key(c("code"), c("tid")).alias("short"), signed_offset(text).alias("off"), normalised_disassembly(F.concat(c("code"), F.lit(" rax,(éß9)"))).alias("norm"), F.round(forward_impact(c("value"), F.lit(1.0), F.lit(100.0)), 6).alias("fwd"), F.round(backward_impact(F.lit(1.0), c("value")), 6).alias("bwd"), F.round(normalised_weight(c("value"), c("addr")), 4).alias("norm_weight"))


@query(f"WITH {EV}, {ST}, {EDGES} SELECT src AS insn, string_agg(DISTINCT dst, ',' ORDER BY dst) AS succs FROM edge GROUP BY src")
def summary_successors(spark, sf):
    d = dynamic(spark, sf).select("src", "dst").distinct()
    return d.groupBy(F.col("src").alias("insn")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("succs"))


@query(f"WITH {EV}, d AS (SELECT DISTINCT addr, code FROM ev) SELECT addr AS callee, string_agg(code, ',' ORDER BY code) AS callers FROM d GROUP BY addr")
def callee_to_callers(spark, sf):
    log = trace(spark, sf).select("code", F.col("addr").alias("reg"))
    return edges.callsite_targets(log).select("callee", F.array_join("callers", ",").alias("callers"))


_L = "SELECT file, line, idx, total, insn, text FROM q WHERE flag <> 'R'"
_R = "SELECT file, line, idx, total, insn, text FROM q WHERE flag <> 'A'"


@query(f"WITH {QUADS}, d AS (SELECT DISTINCT file, line, idx FROM q) SELECT q.file, q.line, max(q.total) AS total, (SELECT string_agg(idx, ',' ORDER BY idx) FROM d WHERE d.file = q.file AND d.line = q.line) AS indices FROM q GROUP BY q.file, q.line")
def index_build(spark, sf):
    return align.index_build(quads(spark, sf)).withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ","))


@query(f"WITH {QUADS}, l AS ({_L}), r AS (SELECT file, line, max(total) AS total FROM ({_R}) GROUP BY file, line) SELECT l.insn, CASE WHEN r.total IS NULL THEN NULL WHEN l.total <> r.total THEN 'short' WHEN EXISTS (SELECT 1 FROM ({_R}) x WHERE x.file = l.file AND x.line = l.line AND x.idx = l.idx) THEN 'exact' END AS how FROM l LEFT JOIN r ON l.file = r.file AND l.line = r.line")
def index_lookup(spark, sf):
    q = quads(spark, sf)
    return align.index_lookup(q.filter("flag <> 'R'"), align.index_build(q.filter("flag <> 'A'"))).select("insn", "how")


@query(f"WITH {QUADS}, l AS ({_L}), r AS ({_R}), s(p, d) AS (VALUES (0, 0), (1, 1), (2, -1), (3, 2), (4, -2)), m AS (SELECT l.insn, r.insn AS o, r.idx AS oi, CASE WHEN l.text = r.text THEN s.p WHEN s.d = 0 THEN 5 END AS k FROM l CROSS JOIN s JOIN r ON r.file = l.file AND r.line = l.line AND r.total = l.total AND r.idx = l.idx + s.d), b AS (SELECT insn, o, oi, row_number() OVER (PARTITION BY insn ORDER BY k, o) AS n FROM m WHERE k IS NOT NULL) SELECT l.insn, b.o AS other_insn, b.oi AS other_idx FROM l LEFT JOIN b ON b.insn = l.insn AND b.n = 1")
def exact_or_neighbour(spark, sf):
    q = quads(spark, sf)
    return align.exact_or_neighbour(q.filter("flag <> 'R'"), q.filter("flag <> 'A'")).select("insn", "other_insn", "other_idx")


@query(f"WITH {QUADS}, l AS ({_L}), r AS ({_R}) SELECT a.insn, r.insn AS other_insn FROM l a LEFT JOIN l ON l.insn = a.insn LEFT JOIN r ON l.file = r.file AND l.line = r.line AND l.total = r.total AND l.idx = r.idx")
def translate_insn(spark, sf):
    q = quads(spark, sf)
    left = q.filter("flag <> 'R'")
    return align.translate(left.select("insn"), left, q.filter("flag <> 'A'"))


@query(f"WITH {QUADS}, l AS ({_L}), r AS ({_R}), m AS (SELECT l.insn, r.insn AS o, row_number() OVER (PARTITION BY l.insn ORDER BY abs(l.idx * 1.0E0 / l.total - r.idx * 1.0E0 / r.total), r.insn) AS n FROM l JOIN r ON l.file = r.file AND l.line = r.line WHERE abs(l.idx * 1.0E0 / l.total - r.idx * 1.0E0 / r.total) <= 0.05) SELECT l.insn, m.o AS other_insn FROM l LEFT JOIN m ON m.insn = l.insn AND m.n = 1")
def nearest_ratio(spark, sf):
    q = quads(spark, sf)
    return align.nearest_ratio(q.filter("flag <> 'R'"), q.filter("flag <> 'A'")).select("insn", "other_insn")


@query(f"WITH {EV}, w AS (SELECT run, addr AS key, sum(value) AS weight FROM ev GROUP BY ALL), a AS (SELECT * FROM w WHERE run = 'bad'), b AS (SELECT * FROM w WHERE run = 'good') SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN round_even(abs(a.weight - b.weight), 0) ELSE round(coalesce(a.weight, b.weight), 4) END AS delta, CASE WHEN b.key IS NULL THEN 'left' WHEN a.key IS NULL THEN 'right' END AS only FROM a FULL JOIN b ON a.key = b.key")
def group_match_diff(spark, sf):
    w = order.sums_in_order(trace(spark, sf), ["run", "addr"], "value").select("run", F.col("addr").alias("key"), F.col("sum").alias("weight"))
    return compare.changed_groups(w.filter("run = 'bad'"), w.filter("run = 'good'")).select("key", F.round("delta", 4).alias("delta"), "only")


@query(f"WITH {EV}, w AS (SELECT run, tid AS insn, avg(value) AS perc FROM ev WHERE (run = 'bad' OR tid % 10 <> 1) AND (run = 'good' OR tid % 10 <> 2) GROUP BY ALL), a AS (SELECT * FROM w WHERE run = 'bad'), b AS (SELECT * FROM w WHERE run = 'good') SELECT a.insn AS l_insn, b.insn AS r_insn, round(a.perc, 6) AS l_perc, round(b.perc, 6) AS r_perc FROM a FULL JOIN b ON a.insn = b.insn WHERE CASE WHEN a.insn IS NULL OR b.insn IS NULL THEN coalesce(a.perc, b.perc) >= 40 ELSE (a.perc + b.perc) / 2 >= 40 END")
def relation_match_diff(spark, sf):
    w = trace(spark, sf).filter("(run = 'bad' or tid % 10 <> 1) and (run = 'good' or tid % 10 <> 2)").groupBy("run", F.col("tid").alias("insn")).agg(F.avg("value").alias("perc"))
    left, right = w.filter("run = 'bad'"), w.filter("run = 'good'")
    same = left.select("insn", F.col("insn").alias("other_insn"))
    return _rounded(compare.match_relations(left, right, same, 40.0).select("l_insn", "r_insn", "l_perc", "r_perc"))


@query(f"WITH {EV}, h AS (SELECT code, addr AS c, count(*) FILTER (WHERE run = 'bad') AS a, count(*) FILTER (WHERE run = 'good') AS b FROM ev GROUP BY ALL), s AS (SELECT code, abs(sum(a) OVER (PARTITION BY code ORDER BY c) * 1.0E0 / sum(a) OVER (PARTITION BY code) - sum(b) OVER (PARTITION BY code ORDER BY c) * 1.0E0 / sum(b) OVER (PARTITION BY code)) AS g, sum(a) OVER (PARTITION BY code) AS na, sum(b) OVER (PARTITION BY code) AS nb FROM h) SELECT code, round(max(g), 6) AS d, CAST(max(na) AS BIGINT) AS n_left, CAST(max(nb) AS BIGINT) AS n_right, max(g) * sqrt(max(na) * max(nb) * 1.0E0 / (max(na) + max(nb))) < 0.51961 AS equal FROM s GROUP BY code")
def ks_two_sample(spark, sf):
    h = relate.histogram(trace(spark, sf).withColumn("c", F.col("addr")), ["run", "code"])
    return _rounded(compare.ks_test(compare.ks_distance(h.filter("run = 'bad'"), h.filter("run = 'good'"), ["code"])).drop("p"))


@query(f"WITH {EV}, i AS (SELECT tid, run, count(*) AS n, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS ratio, avg(CASE WHEN value > 50 THEN 1.0E0 ELSE 0 END) AS p FROM ev GROUP BY ALL) SELECT l.tid, l.ratio = r.ratio AND CASE WHEN l.p < 1 AND r.p < 1 THEN CASE WHEN l.p = r.p THEN true WHEN l.p > 0 AND abs(l.p - r.p) / l.p < 0.1 THEN true WHEN abs(l.p - r.p) < 0.01 THEN true ELSE round_even(l.n * l.p, 0) = round_even(r.n * r.p, 0) END WHEN (l.p < 1) <> (r.p < 1) THEN CASE WHEN l.p < 1 THEN l.p ELSE r.p END >= 0.99 ELSE true END AS equal FROM i l JOIN i r ON l.tid = r.tid AND l.run = 'bad' AND r.run = 'good'")
def invariance_relaxed_equal(spark, sf):
    big = F.when(F.col("value") > 50, 1).otherwise(0)
    i = trace(spark, sf).groupBy("tid", "run").agg(F.count(F.lit(1)).alias("n"), F.max(big).alias("ratio"), F.avg(big.cast("double")).alias("p"))
    j = i.filter("run = 'bad'").alias("l").join(i.filter("run = 'good'").alias("r"), "tid")
    c = F.col
    return j.select("tid", invariance_equal(c("l.ratio"), c("l.p") < 1, c("l.p"), c("l.n"), c("r.ratio"), c("r.p") < 1, c("r.p"), c("r.n")).alias("equal"))


_IMP = f"WITH {EV}, w AS (SELECT tid, sum(value) FILTER (WHERE run = 'bad') AS l, sum(value) FILTER (WHERE run = 'good') AS r, count(*) FILTER (WHERE run = 'bad') AS nl, count(*) FILTER (WHERE run = 'good') AS nr, avg(t) AS ts FROM ev GROUP BY tid), p AS (SELECT *, l / (l + r) * 100 AS lp, r / (l + r) * 100 AS rp FROM w), i AS (SELECT *, CASE WHEN l > r AND l <> 0 THEN (l - r) / l * lp ELSE 0 END AS f, CASE WHEN l < r AND (r - l) / r >= 0.2 AND NOT nl > nr THEN greatest(rp - lp, 0) ELSE 0 END AS b0 FROM p)"


def _impacts(spark, sf):
    bad, good = F.col("run") == "bad", F.col("run") == "good"
    w = trace(spark, sf).groupBy("tid").agg(F.sum(F.when(bad, F.col("value"))).alias("l_w"), F.sum(F.when(good, F.col("value"))).alias("r_w"), F.count_if(bad).alias("l_actual"), F.count_if(good).alias("r_actual"), F.avg("t").alias("ts"))
    total = F.col("l_w") + F.col("r_w")
    return compare.impacts(w.withColumn("l_perc", F.col("l_w") / total * 100).withColumn("r_perc", F.col("r_w") / total * 100))


@query(_IMP + ", z AS (SELECT tid, CASE WHEN b0 > f THEN least(100.0E0, b0 + f) ELSE f END AS s FROM i) SELECT tid, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, tid) AS rank FROM z ORDER BY s DESC, tid LIMIT 20")
def impact_rank(spark, sf):
    rows = compare.final_impact(_impacts(spark, sf).withColumn("weight", F.col("forward")))
    return compare.ranked(rows, F.col("impact"), "tid", 20).select("tid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_IMP + ", z AS (SELECT tid, (f + ts / 100 + lp) / 3 AS s FROM i WHERE l IS NOT NULL AND r IS NOT NULL) SELECT tid, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, tid) AS rank FROM z ORDER BY s DESC, tid LIMIT 20")
def complex_rank(spark, sf):
    rows = _impacts(spark, sf).filter("l_w is not null and r_w is not null")
    return compare.ranked(rows, compare.complex_score(F.col("forward"), F.col("ts") / 100, F.col("l_perc")), "tid", 20).select("tid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_IMP + ", z AS (SELECT tid, (lp + ts / 100) / 2 AS s FROM i WHERE l IS NOT NULL AND r IS NOT NULL) SELECT tid, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, tid) AS rank FROM z ORDER BY s DESC, tid LIMIT 20")
def simple_rank(spark, sf):
    rows = _impacts(spark, sf).filter("l_w is not null and r_w is not null")
    return compare.ranked(rows, compare.simple_score(F.col("l_perc"), F.col("ts") / 100), "tid", 20).select("tid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_IMP + " SELECT tid, l < r AND (r - l) / r >= 0.2 AND NOT nl > nr AS negative, CASE WHEN nl + nr <= 10 THEN abs(nl - nr) * 1.0E0 / greatest(nl, nr) <= 0.5 ELSE abs(nl - nr) * 1.0E0 / greatest(nl, nr) <= 0.25 END AS alike, round(lp / 100 + (abs(1 - lp / 100) - abs(1 - lp / 100) * abs(1 - lp / 100)), 6) AS boosted FROM i")
def impact_tests(spark, sf):
    c = F.col
    return _impacts(spark, sf).select("tid", negative_event(c("l_w"), c("r_w"), c("l_actual"), c("r_actual")).alias("negative"), count_tolerance(c("l_actual"), c("r_actual")).alias("alike"), F.round(boosted(c("l_perc") / 100), 6).alias("boosted"))


@query(f"""WITH {EV}, s AS (SELECT tid, code, avg(value) AS impact, count(*) * 1.0E0 AS weight FROM ev GROUP BY ALL), c AS (SELECT *, impact * weight / 100 AS part FROM s),
  w AS (SELECT *, coalesce(sum(part) OVER (PARTITION BY tid ORDER BY impact DESC, weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
  SELECT tid, round(least(sum(part), 2.0E0) + greatest(9.0E0 - sum(weight), 0), 6) AS new_weight FROM w WHERE before <= 2 GROUP BY tid""")
def successor_discount(spark, sf):
    s = trace(spark, sf).groupBy("tid", "code").agg(F.avg("value").alias("impact"), F.count(F.lit(1)).cast("double").alias("weight"))
    nodes = s.select("tid").distinct().withColumn("own", F.lit(2.0)).withColumn("forward", F.lit(9.0))
    return _rounded(compare.accumulate(nodes, s, ["tid"]))


_REP = f"WITH {EV}, c AS (SELECT run, addr AS func, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT run, func, n * 100.0E0 / sum(n) OVER (PARTITION BY run) AS pct, row_number() OVER (PARTITION BY run ORDER BY n DESC, func) AS pos FROM c)"


def _report(spark, sf):
    from pyspark.sql import Window

    c = trace(spark, sf).groupBy("run", F.col("addr").alias("func")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("run", "func", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("run"))).alias("pct"), F.row_number().over(Window.partitionBy("run").orderBy(F.desc("n"), "func")).cast("long").alias("pos"))


@query(f"{_REP}, m AS (SELECT *, coalesce(sum(pct) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass, max(CASE WHEN pct <= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY pos) AS stop FROM p) SELECT run, func, pos, round(pct, 6) AS pct FROM m WHERE pos <= 15 AND mass < 99 AND stop = 0")
def symptom_topk_mass(spark, sf):
    return profile.top_by_mass(_report(spark, sf), least=0.5).select("run", "func", "pos", F.round("pct", 6).alias("pct"))


@query(f"{_REP} SELECT func FROM p GROUP BY func HAVING count(DISTINCT run) = 2")
def common_in_all(spark, sf):
    return profile.common(_report(spark, sf))


@query(f"{_REP}, k AS (SELECT func FROM p GROUP BY func HAVING count(DISTINCT run) = 2 EXCEPT SELECT func FROM p WHERE pos <= 20) SELECT run, func FROM p WHERE func NOT IN (SELECT func FROM k)")
def set_ops(spark, sf):
    r = _report(spark, sf)
    return profile.without_common_low(r, r).select("run", "func")


@query(f"WITH {EV} SELECT run, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM ev GROUP BY run")
def profile_share(spark, sf):
    return profile.time_shares(trace(spark, sf).groupBy("run").agg(F.sum("value").alias("seconds"))).select("run", F.round("share", 6).alias("share"))


@query(f"WITH {EV}, c AS (SELECT tid AS insn, count(*) AS n FROM ev WHERE code = 'click' GROUP BY tid), s AS (SELECT tid AS insn, sum(value) AS w FROM ev GROUP BY tid) SELECT s.insn, round(CASE WHEN coalesce(c.n, 0) = 0 THEN 0 ELSE w / c.n * 1000 END, 4) AS weight FROM s LEFT JOIN c ON c.insn = s.insn")
def symptom_weight_norm(spark, sf):
    tr = trace(spark, sf)
    n = tr.filter("code = 'click'").groupBy(F.col("tid").alias("insn")).agg(F.count(F.lit(1)).alias("n"))
    return profile.normalise(tr.groupBy(F.col("tid").alias("insn")).agg(F.sum("value").alias("weight")), n).select("insn", F.round("weight", 4).alias("weight"))


@query(f"WITH {QUADS}, u AS (SELECT insn, file, min(line) AS line FROM q GROUP BY insn, file) SELECT insn, row_number() OVER (PARTITION BY file, line ORDER BY insn) AS index, row_number() OVER (PARTITION BY file ORDER BY insn) - 1 AS ordinal, count(*) OVER (PARTITION BY file) AS n FROM u")
def block_index_per_line(spark, sf):
    q = quads(spark, sf).groupBy("insn", F.col("file").alias("bb")).agg(F.min("line").alias("line_key"))
    return align.ordinal(align.index_in_block(q), ["bb"], 0).select("insn", F.col("index").cast("long").alias("index"), F.col("ordinal").cast("long").alias("ordinal"), "n")


@query("WITH r AS (SELECT o_orderkey, o_orderkey * 8 AS a, o_orderkey * 8 + 7 AS b FROM orders) SELECT l.l_orderkey * 8 + l.l_linenumber AS insn, r.o_orderkey FROM lineitem l JOIN r ON l.l_orderkey * 8 + l.l_linenumber BETWEEN r.a AND r.b")
def interval_containment(spark, sf):
    r = _table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 8).alias("first"), (F.col("o_orderkey") * 8 + 7).alias("last"))
    return align.containing(quads(spark, sf).select("insn"), r).select("insn", "o_orderkey")


@query(f"WITH {EV}, b AS (SELECT tid, t, row_number() OVER (PARTITION BY tid ORDER BY t) AS n FROM ev WHERE code = 'click') SELECT e.tid, e.t, e.code FROM ev e WHERE e.code <> 'click' AND NOT EXISTS (SELECT 1 FROM b WHERE b.tid = e.tid AND b.n = 3 AND b.t < e.t)")
def writes_before_branch(spark, sf):
    return order.writes_before_branch(trace(spark, sf), "click", 3).select("tid", "t", "code")


@query(f"WITH {EV} SELECT t, sum(CASE WHEN code = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY t) AS invocation FROM ev")
def invocations(spark, sf):
    return order.invocations(trace(spark, sf), "signup").select("t", F.col("invocation").cast("long").alias("invocation"))


@query()
def post_dominators(spark, sf):
    e = _table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("func"), (F.col("l_suppkey") % 40).alias("src"), (F.col("l_suppkey") % 40 + F.col("l_linenumber") % 3 + 1).alias("dst")).distinct()
    return graph.post_dominators(e)


@query()
def relaxed_dedupe(spark, sf):
    rows = trace(spark, sf).groupBy("run", F.col("tid").alias("insn")).agg(F.sum("value").alias("score"), F.max((F.col("value") > 50).cast("int")).alias("ratio"), F.avg((F.col("value") > 50).cast("double")).alias("prop"))
    return compare.relaxed_dedupe(rows, ["run"])


# relations, graphs and searches on stand-in tables

#: An acyclic graph: suppliers' remainders, each with edges to one of the next three.
DAG = "e AS (SELECT DISTINCT l_suppkey % 12 AS src, l_suppkey % 12 + l_linenumber % 3 + 1 AS dst FROM lineitem)"
#: Relations of a thread: forward, its events a day; backward, its events of a type; both capped so that all classes occur.
RELATIONS = """f AS (SELECT user_id AS static, least(count(*), 1 + user_id % 3) AS c FROM events GROUP BY user_id, day(ts)),
b AS (SELECT user_id AS static, least(count(*), 9 + user_id % 3 * 9) AS c FROM events GROUP BY user_id, event_type),
fw AS (SELECT static, {klass} AS fwd_class, max(c) AS fwd_ratio FROM f GROUP BY static), bw AS (SELECT static, {klass} AS bwd_class, max(c) AS bwd_ratio FROM b GROUP BY static),
w AS (SELECT user_id AS static, count(*) AS perc FROM events GROUP BY user_id), rel AS (SELECT * FROM fw JOIN bw USING (static) JOIN w USING (static)),
se AS (SELECT DISTINCT user_id AS src, user_id + k AS dst FROM events, (VALUES (1), (6)) v(k))""".replace("{klass}", _CLASS)
#: Relations equal to a successor's.
_DUP = "EXISTS (SELECT 1 FROM se JOIN rel x ON x.static = se.dst WHERE se.src = rel.static AND x.fwd_class = rel.fwd_class AND x.fwd_ratio = rel.fwd_ratio AND x.bwd_class = rel.bwd_class AND x.bwd_ratio = rel.bwd_ratio)"


def _dag(spark, sf):
    src = F.col("l_suppkey") % 12
    return _table(spark, sf, "lineitem").select(src.alias("src"), (src + F.col("l_linenumber") % 3 + 1).alias("dst")).distinct()


def _relations(spark, sf):
    """(relations, edges between their statics)."""
    ev = _table(spark, sf, "events").withColumn("static", F.col("user_id"))
    capped = lambda key, cap: ev.groupBy("static", key).agg(F.count(F.lit(1)).alias("n")).select("static", F.least(F.col("n"), cap).alias("c"))
    third = F.col("static") % 3
    sides = [relate.classes(capped(key, cap), ["static"], prefix=p).select("static", f"{p}class", f"{p}ratio") for key, cap, p in ((F.dayofmonth("ts"), 1 + third, "fwd_"), ("event_type", 9 + third * 9, "bwd_"))]
    rel = sides[0].join(sides[1], "static").join(ev.groupBy("static").agg(F.count(F.lit(1)).alias("perc")), "static")
    e = ev.select(F.col("static").alias("src"), F.explode(F.array(F.col("static") + 1, F.col("static") + 6)).alias("dst")).distinct()
    return rel, e


@query(f"WITH {RELATIONS} SELECT static, fwd_class, fwd_ratio, bwd_class, bwd_ratio, perc, {_DUP} AS duplicate FROM rel")
def duplicate_relations(spark, sf):
    rel, e = _relations(spark, sf)
    return relate.duplicates(rel.select("static", "fwd_class", "fwd_ratio", "bwd_class", "bwd_ratio", "perc"), e)


@query(f"WITH {RELATIONS} SELECT static, perc FROM rel WHERE (fwd_class = 'variable' OR bwd_class = 'variable') AND NOT {_DUP}")
def wavefront(spark, sf):
    return relate.wavefront(relate.duplicates(*_relations(spark, sf)))


@query(f"WITH {RELATIONS}, v AS (SELECT *, fwd_class = 'variable' AND bwd_class = 'variable' AS va FROM rel) SELECT static, fwd_class, bwd_class FROM v WHERE NOT (va AND EXISTS (SELECT 1 FROM se JOIN v x ON x.static = se.dst WHERE se.src = v.static) AND NOT EXISTS (SELECT 1 FROM se JOIN v x ON x.static = se.dst WHERE se.src = v.static AND NOT x.va))")
def variable_chain_trim(spark, sf):
    return relate.trim_variable_chains(*_relations(spark, sf)).select("static", "fwd_class", "bwd_class")


@query(f"WITH {RELATIONS} SELECT static FROM rel WHERE fwd_class IN ('invariant', 'conditional') AND bwd_class IN ('invariant', 'conditional') AND perc = (SELECT count(*) FROM events WHERE user_id = static AND event_type IS NOT NULL)")
def fully_explained(spark, sf):
    rel, _ = _relations(spark, sf)
    counts = _table(spark, sf, "events").filter("event_type is not null").groupBy(F.col("user_id").alias("static")).agg(F.count(F.lit(1)).alias("n"))
    return relate.fully_explained(rel.withColumn("prede_count", F.col("perc")), counts)


@query("SELECT static, perc, corr FROM (SELECT l_suppkey AS static, l_extendedprice AS perc, l_quantity AS corr, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1")
def weight_upsert(spark, sf):
    return relate.upsert_weights(_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("static"), F.col("l_extendedprice").alias("perc"), F.col("l_quantity").alias("corr")))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def first_wins(spark, sf):
    return relate.first_wins(_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query(f"WITH {EV}, k AS (SELECT run, tid, code, sum(CASE WHEN addr > 50 THEN 1 ELSE 0 END) AS n, count(*) AS total FROM ev GROUP BY run, tid, code), r AS (SELECT *, n * 1.0E0 / total AS rate FROM k WHERE n > 0) SELECT a.tid, a.code, round((a.rate - coalesce(b.rate, 0)) * 100, 6) AS impact FROM (SELECT * FROM r WHERE run = 'good') a LEFT JOIN (SELECT * FROM r WHERE run = 'bad') b ON a.tid = b.tid AND a.code = b.code WHERE round((a.rate - coalesce(b.rate, 0)) * 100, 6) > 5")
def pass_rate_impact(spark, sf):
    tr = trace(spark, sf).withColumn("node", F.concat_ws("/", "run", "tid", "code"))
    nodes = tr.groupBy("node").agg(F.count(F.lit(1)).alias("total"))
    counts = tr.groupBy("node", "run", "tid", "code").agg(F.count_if(F.col("addr") > 50).alias("n"))
    rates = compare.pass_rates(counts, nodes)
    out = compare.pass_rate_impact(rates.filter("run = 'good'"), rates.filter("run = 'bad'"), ["tid", "code"], 4.9)
    return _rounded(out.select("tid", "code", "impact")).filter("impact > 5")


@query(f"WITH {EV}, g AS (SELECT tid, code, count(*) * 1.0E0 AS perc, max(addr) AS hi FROM ev WHERE run = 'good' GROUP BY tid, code), h AS (SELECT tid, code, count(*) * 1.0E0 AS perc, max(addr) AS hi FROM ev WHERE run = 'bad' GROUP BY tid, code), p AS (SELECT coalesce(g.tid, h.tid) AS node, g.perc AS l, h.perc AS r, coalesce(g.perc = h.perc, false) AS q, coalesce(abs(g.hi - h.hi) < 20, false) AS s FROM g FULL JOIN h ON g.tid = h.tid AND g.code = h.code) SELECT node, bool_or(CASE WHEN l IS NULL OR r IS NULL THEN coalesce(l, r) >= 5 ELSE NOT (q OR s) END) AS differ FROM p GROUP BY node")
def children_differ(spark, sf):
    side = lambda run, p: trace(spark, sf).filter(F.col("run") == run).groupBy("tid", "code").agg(F.count(F.lit(1)).cast("double").alias(f"{p}_perc"), F.max("addr").alias(f"{p}_hi"))
    pairs = side("good", "l").join(side("bad", "r"), ["tid", "code"], "full").withColumn("relaxed_equal", F.col("l_perc") == F.col("r_perc")).withColumn("rate_equal", F.abs(F.col("l_hi") - F.col("r_hi")) < 20)
    return compare.children_differ(pairs.withColumnRenamed("tid", "node"))


@query(f"WITH {EV}, i AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY tid ORDER BY t) = code THEN 0 ELSE 1 END AS x FROM ev), j AS (SELECT *, sum(x) OVER (PARTITION BY tid ORDER BY t) AS island FROM i) SELECT tid, code, min(t) AS t, string_agg(CAST(addr AS VARCHAR), ',' ORDER BY t) AS regs FROM j GROUP BY tid, island, code")
def register_pairs(spark, sf):
    out = order.register_pairs(trace(spark, sf).withColumn("reg", F.col("addr").cast("string")))
    return out.select("tid", "code", "t", F.concat_ws(",", "regs").alias("regs"))


@query(f"WITH {EV}, k AS (SELECT *, coalesce(sum(CASE WHEN code = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ev WHERE code IN ('purchase', 'click', 'view')) SELECT tid, max(t) FILTER (code = 'purchase') AS t, arg_max(addr, t) FILTER (code = 'click') AS at_click, arg_max(addr, t) FILTER (code = 'view') AS at_view FROM k GROUP BY tid, k.k HAVING count(*) FILTER (code = 'purchase') > 0")
def registers_before(spark, sf):
    return order.registers_before(trace(spark, sf).withColumn("reg", F.col("addr")), "purchase", ["click", "view"])


@query("SELECT l_partkey, l_orderkey * 8 + l_linenumber AS insn, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) AS ordinal, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem")
def ordinal_in_range(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("insn"))
    return align.ordinal(rows, ["l_partkey"])


_FUNCTIONS = "fn AS (SELECT DISTINCT l_returnflag AS func, l_orderkey // 100 * 800 AS first, l_orderkey // 100 * 800 + 400 AS last FROM lineitem)"


def _functions(spark, sf):
    first = F.expr("l_orderkey div 100 * 800")
    return _table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("func"), first.alias("first"), (first + 400).alias("last")).distinct()


@query(f"WITH {_FUNCTIONS} SELECT func, l_orderkey * 8 + l_linenumber AS insn, first, last FROM lineitem JOIN fn ON func = l_returnflag AND l_orderkey * 8 + l_linenumber BETWEEN first AND last")
def resolve_function(spark, sf):
    names = _table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("func"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("insn"))
    return align.resolve_function(names, _functions(spark, sf)).select("func", "insn", "first", "last")


@query(f"WITH RECURSIVE {DAG}, p AS (SELECT CAST(0 AS BIGINT) AS node, '0' AS path UNION ALL SELECT e.dst, p.path || ',' || e.dst FROM p JOIN e ON e.src = p.node WHERE p.node < 11) SELECT path FROM p WHERE node >= 11")
def path_enumeration(spark, sf):
    node = spark.createDataFrame([(k,) for k in (11, 12, 13, 14)], "node long")
    out = graph.paths(_dag(spark, sf), spark.createDataFrame([(0,)], "node long"), node)
    return out.select(F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


@query(f"WITH RECURSIVE {DAG}, r AS (SELECT CAST(5 AS BIGINT) AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def forward_slice(spark, sf):
    return graph.forward_slice(_dag(spark, sf), spark.createDataFrame([(5,)], "node long"))


@query(f"WITH RECURSIVE {DAG}, r AS (SELECT CAST(9 AS BIGINT) AS node UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT src, dst FROM e WHERE dst IN (SELECT node FROM r)")
def peel_sinks(spark, sf):
    return graph.peel(_dag(spark, sf), spark.createDataFrame([(9,)], "node long"))


@query(f"WITH RECURSIVE {DAG}, r AS (SELECT CAST(11 AS BIGINT) AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def relation_search(spark, sf):
    return graph.relation_search(_dag(spark, sf), 11)


@query(f"WITH {DAG}, o AS (SELECT DISTINCT l_suppkey % 12 AS src, l_suppkey % 12 + l_linenumber % 4 + 1 AS dst FROM lineitem) (SELECT *, 'pred' AS only FROM (SELECT * FROM e EXCEPT SELECT * FROM o)) UNION ALL (SELECT *, 'succ' FROM (SELECT * FROM o EXCEPT SELECT * FROM e))")
def edge_symmetry(spark, sf):
    src = F.col("l_suppkey") % 12
    other = _table(spark, sf, "lineitem").select(src.alias("src"), (src + F.col("l_linenumber") % 4 + 1).alias("dst"))
    return graph.asymmetric(_dag(spark, sf), other)


@query(f"WITH {EV}, {ST}, {EDGES} SELECT dst AS insn, src_t AS src, dst_t AS dst FROM edge WHERE dst IN ('purchase', 'click')")
def one_level_graphs(spark, sf):
    g = dynamic(spark, sf).select(F.col("src_t").alias("src"), F.col("dst_t").alias("dst"))
    starts = trace(spark, sf).filter(F.col("code").isin("purchase", "click")).select(F.col("t").alias("node"), F.col("code").alias("insn"))
    return graph.one_level(g, starts)


_STORES = """e AS (SELECT DISTINCT l_returnflag AS func, l_suppkey % 12 AS src, (l_suppkey % 12 + l_linenumber % 2 * 4 + 1) % 12 AS dst FROM lineitem),
s AS (SELECT DISTINCT l_returnflag AS func, l_suppkey % 12 AS node, 'p' || l_suppkey % 3 AS place FROM lineitem)"""


@query(f"WITH RECURSIVE {_STORES}, r AS (SELECT s.func, e.dst AS node, s.place, s.node AS store FROM s JOIN e ON e.func = s.func AND e.src = s.node UNION SELECT r.func, e.dst, r.place, r.store FROM r JOIN e ON e.func = r.func AND e.src = r.node WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.func = r.func AND s.node = r.node AND s.place = r.place)) SELECT func, node, place, store FROM r")
def reaching_stores(spark, sf):
    li, src = _table(spark, sf, "lineitem"), F.col("l_suppkey") % 12
    e = li.select(F.col("l_returnflag").alias("func"), src.alias("src"), ((src + F.col("l_linenumber") % 2 * 4 + 1) % 12).alias("dst")).distinct()
    s = li.select(F.col("l_returnflag").alias("func"), src.alias("node"), F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string")).alias("place")).distinct()
    return graph.reaching_stores(e, s)


@query("WITH n AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS node, CAST(l_quantity AS BIGINT) AS delta FROM lineitem) SELECT CAST(l_suppkey AS VARCHAR) AS func, node, CAST(coalesce(sum(delta) OVER (PARTITION BY l_suppkey ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS height FROM n")
def stack_heights(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    n = _table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("func"), F.row_number().over(w).cast("long").alias("node"), F.col("l_quantity").cast("long").alias("delta"))
    links = n.filter("node > 1").select("func", (F.col("node") - 1).alias("src"), F.col("node").alias("dst"))
    return graph.stack_heights(links, n)


from . import artefacts_catalog, relations_catalog  # noqa: E402, F401 - they add their queries


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
