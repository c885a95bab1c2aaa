"""Queries that write an artefact in the format the analysis exchanges, and read it again; SQL works on the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..sources import trace as binary
from ..storage import scratch
from . import catalog
from .catalog import EV, query, trace


def _at(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, *order) -> str:
    """The column `value` of df as lines of one file, as these formats are; they hold a row for each instruction at most."""
    path = _at(df.sparkSession, "lines")
    (df.orderBy(*order) if order else df).select("value").coalesce(1).write.text(path)
    return path


def _document(df: DataFrame, value) -> str:
    """One JSON document, an aggregate over df."""
    return _text(df.agg(value.alias("value")))


def _hex(c):
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def _threads(spark, sf):
    return trace(spark, sf).groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


def _places(spark, sf):
    return trace(spark, sf).groupBy("code", "addr").agg(F.count(F.lit(1)).alias("n"))


_T = f"WITH {EV}, u AS (SELECT tid, count(*) AS n FROM ev GROUP BY tid)"
_P = f"WITH {EV}, p AS (SELECT code, addr, count(*) AS n FROM ev GROUP BY code, addr)"


@query(f"{_T} SELECT tid AS insn, n AS value FROM u")
def scan_node_info(spark, sf):
    path = _at(spark, "counts")
    sources.write_counts(_threads(spark, sf).select(F.col("tid").alias("insn"), F.col("n").alias("value")), path)
    return sources.node_info(spark, path)


@query(f"WITH {EV} SELECT tid AS branch, addr AS target, count(*) AS n FROM ev GROUP BY ALL")
def scan_pass_counts(spark, sf):
    path = _at(spark, "passes")
    sources.write_pass_counts(trace(spark, sf).groupBy(F.col("tid").alias("branch"), F.col("addr").alias("target")).agg(F.count(F.lit(1)).alias("n")), path)
    return sources.pass_counts(spark, path)


@query(f"{_P} SELECT 'f ' || code AS file, CAST(addr AS INTEGER) AS line, CAST(1 AS INTEGER) AS idx, CAST(n AS INTEGER) AS total FROM p")
def scan_index_quads(spark, sf):
    quad = F.concat(F.lit('["f '), "code", F.lit('",'), F.col("addr").cast("string"), F.lit(",1,"), F.col("n").cast("string"), F.lit("]"))
    path = _document(_places(spark, sf), F.concat(F.lit("["), F.array_join(F.collect_list(quad), ","), F.lit("]")))
    return sources.index_quads(spark, path).drop("pos")


@query(f"WITH {EV} SELECT DISTINCT tid AS insn, addr AS succ FROM ev")
def scan_summary(spark, sf):
    each = trace(spark, sf).groupBy("tid").agg(F.collect_set("addr").alias("s"))
    return sources.summary(spark, _document(each, F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("tid").cast("string"), "s"))))))


@query(f"{_P} SELECT addr AS def, addr + 1 AS use, addr + 2 AS branch, length(code) AS target, n / 4.0E0 AS rate FROM (SELECT addr, code, max(n) OVER (PARTITION BY addr, length(code)) AS n, row_number() OVER (PARTITION BY addr, length(code) ORDER BY n DESC) AS k FROM p) WHERE k = 1")
def scan_pass_rates(spark, sf):
    p = _places(spark, sf).groupBy("addr", F.length("code").alias("target")).agg((F.max("n") / 4).alias("rate"))
    name = F.concat_ws("_", _hex(F.col("addr") + 2), _hex("target"))
    uses = p.groupBy("addr").agg(F.map_from_entries(F.collect_list(F.struct(name, "rate"))).alias("m"))
    uses = uses.select(F.col("addr").cast("string").alias("def"), F.create_map((F.col("addr") + 1).cast("string"), "m").alias("u"))
    return sources.pass_rates(spark, _document(uses, F.to_json(F.map_from_entries(F.collect_list(F.struct("def", "u"))))))


@query(f"{_T} SELECT tid AS insn FROM u")
def scan_insn_list(spark, sf):
    return sources.insn_list(spark, _text(_threads(spark, sf).select(F.concat(F.lit(" "), F.col("tid").cast("string")).alias("value"))))


@query(f"{_T} SELECT n * 0.25E0 AS pct, 'f' || tid AS func FROM u WHERE tid % 5 <> 0")
def scan_profile(spark, sf):
    obj = F.when(F.col("tid") % 5 == 0, "[unknown]").otherwise("prog")
    rows = _threads(spark, sf).select("tid", F.concat_ws("  ", F.concat((F.col("n") * 0.25).cast("string"), F.lit("%")), F.lit("cmd"), obj, F.lit("[.]"), F.concat(F.lit("f"), F.col("tid").cast("string"))).alias("value"))
    head = spark.createDataFrame([(-2, "# overhead"), (-1, "")], "tid long, value string")
    return sources.profile(spark, _text(head.union(rows), "tid")).drop("pos")


@query(f"{_T} SELECT tid AS addr, 'f' || tid || '.cold' AS func FROM u")
def scan_symbols(spark, sf):
    name = F.concat(F.lit("<f"), F.col("tid").cast("string"), F.lit(".cold>:"))
    line = F.concat_ws(" ", F.lpad(F.lower(F.hex("tid")), 16, "0"), name)
    rows = _threads(spark, sf).select(F.explode(F.array(line, F.lit("  12:\taa bb  mov x"))).alias("value"))
    return sources.symbols(spark, _text(rows))


@query(f"{_T}, l AS (SELECT tid AS addr, lead(tid) OVER (ORDER BY tid) AS next_addr, n FROM u) SELECT addr, next_addr, 'mov r' || n || ',%rax' AS text FROM l WHERE next_addr IS NOT NULL")
def scan_disassembly(spark, sf):
    from pyspark.sql import Window

    rows = _threads(spark, sf).withColumn("next", F.lead("tid").over(Window.orderBy("tid")))  # a row for each instruction
    size = F.coalesce(F.col("next") - F.col("tid"), F.lit(1)).cast("int")
    line = F.concat(F.lit("  "), F.lower(F.hex("tid")), F.lit(":\t"), F.repeat(F.lit("9a "), size), F.lit("\tmov r"), F.col("n").cast("string"), F.lit(",%rax"))
    return sources.disassembly(spark, _text(rows.select("tid", line.alias("value")), "tid"))


@query(f"{_T} SELECT CASE WHEN tid % 4 <> 0 THEN 'rax' END AS reg, tid AS insn, 'f' || tid AS func, n * 1.5E0 AS weight FROM u")
def scan_symptoms(spark, sf):
    path = _at(spark, "symptoms")
    rows = _threads(spark, sf).select(F.when(F.col("tid") % 4 != 0, "rax").alias("reg"), F.col("tid").alias("insn"), F.concat(F.lit("f"), F.col("tid").cast("string")).alias("func"), (F.col("n") * 1.5).alias("weight"))
    sources.write_symptoms(rows, path)
    return sources.symptom_list(spark, path).drop("pos")


@query(f"{_T} SELECT tid AS insn, 'a.c' AS file, CAST(n AS INTEGER) AS line, CASE WHEN tid % 2 = 0 THEN 'b.h:' || tid ELSE '' END AS callers FROM u")
def line_lookup_frames(spark, sf):
    own = F.concat(F.lit("a.c:"), F.col("n").cast("string"), F.lit(" (discriminator 3)"))
    frames = F.when(F.col("tid") % 2 == 0, F.array(own, F.concat(F.lit("b.h:"), F.col("tid").cast("string")))).otherwise(F.array(own))
    found = sources.line_lookup(_threads(spark, sf).select(F.col("tid").alias("insn"), frames.alias("lines")))
    return found.withColumn("callers", F.array_join("callers", ","))


@query(f"{_T} SELECT 'a.c' AS file, tid AS line, CASE WHEN tid % 3 < 2 THEN tid * 16 END AS first, CASE WHEN tid % 3 = 0 THEN tid * 16 + n END AS last FROM u")
def address_ranges_of_lines(spark, sf):
    a = _hex(F.col("tid") * 16)
    whole = F.concat(F.lit("Line 1 of \"a.c\" starts at address "), a, F.lit(" <f+4> and ends at "), _hex(F.col("tid") * 16 + F.col("n")), F.lit(" <f+8>."))
    empty = F.concat(F.lit("Line 1 of \"a.c\" is at address "), a, F.lit(" <f> but contains no code."))
    info = F.when(F.col("tid") % 3 == 0, whole).when(F.col("tid") % 3 == 1, empty).otherwise("Line number 1 is out of range")
    return sources.address_ranges(_threads(spark, sf).select(F.lit("a.c").alias("file"), F.col("tid").alias("line"), info.alias("info")))


@query(f"""{_T} SELECT tid AS use, tid + 1 AS insn, CASE WHEN tid % 5 = 4 THEN 'empty' ELSE 'memread' END AS kind, CASE tid % 5 WHEN 4 THEN NULL WHEN 2 THEN 'RAX' ELSE 'RBP' END AS reg,
  CASE tid % 5 WHEN 4 THEN NULL WHEN 2 THEN 8 ELSE 0 END AS shift, CASE tid % 5 WHEN 0 THEN n WHEN 1 THEN 4 WHEN 2 THEN n WHEN 3 THEN n END AS off, CASE WHEN tid % 5 IN (1, 3) THEN 'RCX' END AS off_reg, CASE WHEN tid % 5 = 1 THEN n END AS off1 FROM u""")
def scan_slices(spark, sf):
    n, k = _hex("n"), F.col("tid") % 5
    expr = F.when(k == 0, F.concat(F.lit("memread|RBP + "), n)).when(k == 1, F.concat(F.lit("memread|RBP + "), n, F.lit(" + 0x4*RCX"))).when(k == 2, F.concat(F.lit("memread|RAX*8 + "), n)).when(k == 3, F.concat(F.lit("memread|RBP + RCX*1 + "), n)).otherwise("")
    path = _at(spark, "slices")
    rows = _threads(spark, sf).select(F.col("tid").alias("use"), F.lit("f").alias("func"), (F.col("tid") + 1).alias("insn"), expr.alias("expr"), F.lit(False).alias("read_same_as_write"), F.lit(False).alias("is_bit_var"))
    rows.write.json(path)
    return sources.slice_results(spark, path).select("use", "insn", "kind", "reg", "shift", "off", "off_reg", "off1")


@query(f"{_P} SELECT 'g' || addr AS callee, string_agg(length(code) * 100 + n || '@' || code, ',' ORDER BY length(code) * 100 + n, code) AS callers FROM p GROUP BY addr")
def scan_callsites(spark, sf):
    path = _at(spark, "callsites")
    insn = F.length("code") * 100 + F.col("n")
    _places(spark, sf).select(insn.alias("insn"), F.col("code").alias("func"), F.concat(F.lit("g"), F.col("addr").cast("string")).alias("callee")).write.json(path)
    return sources.callsites(spark, path).withColumn("callers", F.array_join(F.transform("callers", lambda x: F.concat_ws("@", x["insn"].cast("string"), x["func"])), ","))


@query(f"{_P} SELECT addr, string_agg(n || '@' || code, ',' ORDER BY n, code) AS writers FROM p GROUP BY addr")
def scan_static_writes(spark, sf):
    path = _at(spark, "writes")
    _places(spark, sf).select(_hex("addr").alias("expr"), F.col("n").alias("insn"), F.col("code").alias("func")).write.json(path)
    return sources.static_writes(spark, path).withColumn("writers", F.array_join(F.transform("writers", lambda x: F.concat_ws("@", x["insn"].cast("string"), x["func"])), ","))


@query(f"{_P} SELECT dense_rank() OVER (ORDER BY code) AS invocation, addr AS insn FROM p")
def scan_function_trace(spark, sf):
    p = _places(spark, sf)
    body = p.select("code", F.lit(1).alias("k"), "addr", _hex("addr").alias("value"))
    marks = p.select("code").distinct().select("code", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("start").alias("v")), F.struct(F.lit(2).alias("k"), F.lit("# eof").alias("v")))).alias("m"))
    marks = marks.select("code", "m.k", F.lit(None).cast("long").alias("addr"), F.col("m.v").alias("value"))
    return sources.function_trace(spark, _text(body.union(marks), "code", "k", "addr")).select("invocation", "insn")


@query(f"{_P} SELECT addr, n AS insn, CASE WHEN n % 2 = 0 THEN code END AS func FROM p")
def scan_watch_log(spark, sf):
    triple = F.concat(F.lit('["'), _hex("addr"), F.lit('","'), _hex("n"), F.lit('",'), F.when(F.col("n") % 2 == 0, F.concat(F.lit('"'), "code", F.lit('"'))).otherwise("null"), F.lit("]"))
    path = _document(_places(spark, sf), F.concat(F.lit("["), F.array_join(F.collect_list(triple), ","), F.lit("]")))
    return sources.watch_log(spark, path).drop("seq")


@query(f"{_P} SELECT code AS insn_name, addr AS addr, CASE WHEN n % 2 = 0 THEN n END AS value FROM p")
def scan_break_log(spark, sf):
    triple = F.concat(F.lit("["), F.length("code").cast("string"), F.lit(',"'), _hex("addr"), F.lit('",'), F.when(F.col("n") % 2 == 0, F.concat(F.lit('"'), _hex("n"), F.lit('"'))).otherwise("null"), F.lit("]"))
    places = _places(spark, sf)
    parts = None
    for code in catalog.CODES:
        path = _document(places.filter(F.col("code") == code), F.concat(F.lit("["), F.array_join(F.collect_list(triple), ","), F.lit("]")))
        one = sources.watch_log(spark, path, "break").select(F.lit(code).alias("insn_name"), "addr", "value")
        parts = one if parts is None else parts.union(one)
    return parts


@query(f"WITH {EV} SELECT CASE WHEN code IN ('click', 'view') THEN 'watch' ELSE 'run' END AS phase, count(*) * 0.5E0 AS seconds FROM ev WHERE code <> 'error' GROUP BY 1")
def scan_durations(spark, sf):
    n = trace(spark, sf).groupBy("code").agg((F.count(F.lit(1)) * 0.5).alias("s"))
    at = F.concat_ws(":", F.floor(F.col("s") / 3600).cast("string"), F.floor(F.col("s") % 3600 / 60).cast("string"), F.round(F.col("s") % 60, 1).cast("string"))
    phrase = F.when(F.col("code").isin("click", "view"), "watching took ").when(F.col("code") == "error", "neither took ").otherwise("running took ")
    path = _text(n.select(F.concat(phrase, at).alias("value")))
    return sources.phase_durations(spark, path, {"watch": "watching", "run": "running"})


@query(f"{_T} SELECT 'k' || (tid % 9) AS name, CAST(max(tid) AS VARCHAR) AS value FROM u GROUP BY tid % 9")
def scan_config(spark, sf):
    line = F.concat(F.lit("k"), (F.col("tid") % 9).cast("string"), F.lit(" = "), F.col("tid").cast("string"), F.lit("  # note=1"))
    found = sources.config(spark, _text(_threads(spark, sf).select("tid", line.alias("value")), "tid"))
    return spark.createDataFrame(sorted(found.items()), "name string, value string")


_RAW = "z AS (SELECT 'r' || (tid % 8) AS run, CAST(tid % 8 + tid // 8 % 5 AS INTEGER) AS tid, t, CASE code WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS code, addr FROM ev)"


def _coded(spark, sf):
    code = F.array_position(F.array(*[F.lit(c) for c in catalog.CODES]), F.col("code")).cast("int")
    rows = trace(spark, sf).select(F.concat(F.lit("r"), (F.col("tid") % 8).cast("string")).alias("run"), (F.col("tid") % 8 + F.expr("tid div 8") % 5).cast("int").alias("tid"), "t", code.alias("code"), "addr")
    return rows.withColumn("reg", F.when(F.col("code") == 1, F.col("addr")))


@query(f"""WITH {EV}, {_RAW}, e AS (SELECT *, CASE WHEN lead(tid) OVER w IS DISTINCT FROM tid THEN 1 ELSE 0 END AS stop FROM z WINDOW w AS (PARTITION BY run ORDER BY t))
  SELECT run, count(*) OVER w - 1 + sum(stop) OVER w AS uid, tid, code, CASE WHEN code = 1 THEN addr END AS reg FROM e WINDOW w AS (PARTITION BY run ORDER BY t DESC)""")
def scan_raw_trace(spark, sf):
    binary.register(spark)
    path = _at(spark, "raw")
    binary.write_raw(_coded(spark, sf), path)
    return spark.read.format("rootloom_trace").option("registers", "1").load(path).withColumn("reg", F.col("reg").cast("long"))


@query(f"WITH {EV}, {_RAW} SELECT run, t AS uid, tid, code, CASE WHEN code = 1 THEN -addr END AS reg FROM z")
def scan_parsed_trace(spark, sf):
    binary.register(spark)
    path = _at(spark, "parsed")
    binary.write_parsed(_coded(spark, sf).withColumn("reg", -F.col("reg")).withColumnRenamed("t", "uid"), path)
    found = spark.read.format("rootloom_trace").option("registers", "1").option("mode", "parsed").load(path)
    return found.withColumn("reg", F.col("reg").cast("long"))


@query(f"{_T}, e AS (SELECT tid - 1 AS src, tid AS dst, 'cf' AS kind FROM u UNION SELECT tid, tid + 7, 'df' FROM u) SELECT * FROM e WHERE src IN (SELECT tid FROM u) AND dst IN (SELECT tid FROM u)")
def scan_static_graph(spark, sf):
    tid = F.col("tid")
    node = F.struct(tid.alias("id"), tid.alias("insn"), F.lit("f").alias("function"), F.array(tid - 1).alias("cf_predes"), F.array(tid + 7).alias("df_succes"))
    groups = _threads(spark, sf).groupBy((tid % 7).alias("g")).agg(F.collect_list(node).alias("id_to_node"))
    path = _document(groups, F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("f"), F.col("g").cast("string")).alias("func"), "id_to_node")).alias("out_result"))))
    return sources.static_graph(spark, path)[1]


@query(f"{_T} SELECT tid AS id, CASE WHEN tid % 3 = 0 THEN 4 WHEN tid % 3 = 1 THEN 8 END AS load_width FROM u")
def static_node_widths(spark, sf):
    reg = F.when(F.col("tid") % 3 == 0, "EAX").when(F.col("tid") % 3 == 1, "XMM9").otherwise("")
    nodes = _threads(spark, sf).select(F.col("tid").alias("id"), reg.alias("reg_load"), F.lit(None).cast("string").alias("reg_store"))
    return sources.with_widths(nodes).select("id", "load_width")


@query(f"{_T} SELECT tid AS id, n * 1.0E0 AS weight, tid % 2 = 0 AS is_entry, tid % 3 = 0 AS is_target FROM u")
def scan_dynamic_graph(spark, sf):
    tid = F.col("tid")
    node = F.struct(tid.alias("id"), tid.alias("insn_id"), F.lit("f").alias("func"), F.col("n").cast("double").alias("weight"), F.array(tid - 1).alias("cf_predes"))
    ids = lambda k: F.collect_list(F.when(tid % k == 0, tid)).alias
    doc = F.to_json(F.struct(F.collect_list(node).alias("dynamic_nodes"), ids(2)("entry_nodes"), ids(5)("exit_nodes"), ids(3)("target_nodes")))
    return sources.dynamic_graph(spark, _document(_threads(spark, sf), doc))[0].select("id", "weight", "is_entry", "is_target")


@query(f"{_P} SELECT length(code) AS insn, code AS file, CAST(addr AS INTEGER) AS line, n * 1.0E0 AS perc, n + 0.5E0 AS ratio FROM p")
def relation_groups_round_trip(spark, sf):
    quad = lambda file, line: F.struct(file.alias("file"), line.cast("int").alias("line"), F.lit(0).alias("idx"), F.lit(1).alias("total"))
    from ..sources.artefacts import RELATION, WEIGHT
    from pyspark.sql import Window

    weight = F.struct(F.lit(1.0).alias("actual_weight"), F.lit(1.0).alias("base_weight"), F.col("n").cast("double").alias("perc_contrib"), F.lit(0.5).alias("corr"), F.lit(0.0).alias("order")).cast(WEIGHT)
    none = F.lit(None).cast("array<double>")
    way = F.struct(F.lit(True).alias("is_invariant"), (F.col("n") + 0.5).alias("ratio"), F.lit(None).cast("double").alias("conditional_proportion"), none.alias("distribution"), none.alias("weighted_distribution")).cast(RELATION)
    relation = F.struct(weight.alias("weight"), way.alias("forward"), way.alias("backward"), F.lit(1.0).alias("timestamp"), F.col("addr").alias("insn"), F.col("code").alias("func"), F.lit(False).alias("duplicate"))
    pos = F.row_number().over(Window.partitionBy("code").orderBy("addr")) - 1
    rows = _places(spark, sf).select(
        quad(F.col("code"), F.lit(1)).alias("symptom"), F.length("code").cast("long").alias("insn"), F.lit(True).alias("use_weight"), F.length("code").cast("double").alias("group_weight"),
        F.array(quad(F.lit("w"), F.lit(2))).alias("wavefront"), pos.alias("pos"), quad(F.col("code"), F.col("addr")).alias("prede"), F.col("addr").alias("prede_insn"), relation.alias("relation"),
    )
    path = _at(spark, "groups")
    sources.write_relation_groups(rows, path)
    found = sources.relation_groups(spark, path, lines=True)
    return found.select(F.col("insn").cast("int").alias("insn"), "prede.file", "prede.line", F.col("relation.weight.perc_contrib").alias("perc"), F.col("relation.forward.ratio").alias("ratio"))


@query(f"{_P} SELECT addr AS insn, code AS func, n AS prede_count, n * 2.0E0 AS perc FROM p")
def scan_full_groups(spark, sf):
    place = F.concat_ws("@", F.col("addr").cast("string"), F.col("code"))
    relation = F.struct(place.alias("target_node"), place.alias("prede_node"), F.col("n").alias("prede_count"), F.struct((F.col("n") * 2.0).alias("perc_contrib")).alias("weight"), F.lit("a.c").alias("file"))
    group = F.struct(place.alias("starting_node"), F.lit(1.0).alias("weight"), F.lit(True).alias("finished"), F.array(relation).alias("relations"))
    path = _document(_places(spark, sf), F.to_json(F.collect_list(group)))
    return sources.full_relation_groups(spark, path).select("insn", "func", "prede_count", F.col("weight.perc_contrib").alias("perc"))


@query(f"WITH {EV}, h AS (SELECT run, code, count(*) AS n FROM ev GROUP BY ALL) SELECT run, code, 'large' AS part, n FROM h WHERE n > 100 UNION ALL SELECT run, code, 'trace', n FROM h WHERE n <= 100 UNION ALL SELECT run, 'purchase', 'starts', n FROM h WHERE code = 'purchase'")
def parsed_trace_written(spark, sf):
    path = _at(spark, "trace")
    tr = trace(spark, sf).withColumnRenamed("t", "uid")
    sources.write_parsed(tr, path, spark.createDataFrame([("purchase",)], "code string"), 100)
    large = spark.read.parquet(f"{path}/large").select("run", "code", F.lit("large").alias("part"), "n")
    kept = spark.read.schema(tr.schema).parquet(f"{path}/trace").groupBy("run", "code").agg(F.count(F.lit(1)).alias("n")).select("run", "code", F.lit("trace").alias("part"), "n")
    starts = spark.read.parquet(f"{path}/starting_uids").groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", F.lit("purchase").alias("code"), F.lit("starts").alias("part"), "n")
    return large.union(kept).union(starts)


@query(f"{_T} SELECT tid AS id, tid % 4 <> 1 OR tid - 1 NOT IN (SELECT tid FROM u) AS inner FROM u")
def indices_written(spark, sf):
    path = _at(spark, "indices")
    nodes = _threads(spark, sf).select(F.col("tid").alias("id"), (F.col("tid") % 4 != 0).alias("explained"))
    sources.write_indices(nodes, nodes.select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")), path)
    return spark.read.parquet(path).select("id", "inner")


@query(f"{_T} SELECT CAST(row_number() OVER (ORDER BY n DESC, tid) AS VARCHAR) || chr(9) || tid AS line FROM u ORDER BY n DESC, tid LIMIT 20")
def report_written(spark, sf):
    from ..operators import compare

    path = _at(spark, "report")
    sources.write_report(compare.ranked(_threads(spark, sf), F.col("n"), "tid", 20), path, "tid")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {EV}, {catalog.ST}, {catalog.EDGES} SELECT 'node' AS part, count(*) AS n FROM ev UNION ALL SELECT 'edge', count(*) FROM edge UNION ALL SELECT 'left', count(DISTINCT tid) FROM ev WHERE run = 'good' UNION ALL SELECT 'right', count(DISTINCT tid) FROM ev WHERE run = 'bad'")
def graph_and_candidates_written(spark, sf):
    path, tr = _at(spark, "graph"), trace(spark, sf)
    sources.write_graph(tr.select("t", "code"), catalog.dynamic(spark, sf).select("src_t", "dst_t"), path)
    side = lambda run: tr.filter(F.col("run") == run).select(F.col("tid").alias("insn"))
    sources.write_candidates(side("good"), side("bad"), path)
    out = None
    for part, at in (("node", "nodes"), ("edge", "edges"), ("left", "left"), ("right", "right")):
        one = spark.read.parquet(f"{path}/{at}").agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out
