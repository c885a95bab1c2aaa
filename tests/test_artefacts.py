"""Readers and writers of artefacts, on small files in the formats that the analysis exchanges."""

import json

import pytest
from pyspark.sql import functions as F

from rootloom.sources import artefacts, sinks, trace

INVARIANT = {"is_invariant": True, "ratio": 2, "conditional_proportion": 0.5}
VARIABLE = {"is_invariant": False, "distribution": [1, 2, 2], "weighted_distribution": [0.5, 1.0, 1.0]}
WEIGHT = {"actual_weight": 3.0, "base_weight": 12.0, "perc_contrib": 25.0, "corr": 0.5, "order": 0}


@pytest.fixture
def put(tmp_path):
    def write(data, name="a"):
        f = tmp_path / name
        f.write_text(data if isinstance(data, str) else json.dumps(data, indent=4))
        return f.as_uri()

    return write


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_text_lists(spark, put, tmp_path):
    assert rows(artefacts.node_info(spark, put("0x10 3\nff 4\n"))) == [(16, 3), (255, 4)]
    assert artefacts.node_info(spark, f"{tmp_path.as_uri()}/none") is None
    assert rows(artefacts.insn_list(spark, put("12\n\n 7\n"))) == [(12,), (7,)]
    assert artefacts.config(spark, put("# all\nlimit=10 # most\nprog = a=b\nlimit=11\nnothing\n")) == {"limit": "11", "prog": "a=b"}
    assert rows(artefacts.symptom_list(spark, put("rdi 0x409daa sweep\n_ 0x10 f 2.5\n")), "reg", "insn", "func", "weight") == [("rdi", 0x409DAA, "sweep", None), (None, 16, "f", 2.5)]


def test_index_quads(spark, put, tmp_path):
    at = put([["x.c:3|a.c", 7, 0, 2], ["a.c", None, None, None]])
    assert rows(artefacts.index_quads(spark, at)) == [(0, "x.c:3|a.c", 7, 0, 2), (1, "a.c", None, None, None)]
    assert artefacts.index_quads(spark, f"{tmp_path.as_uri()}/none") is None


def _group(**more):
    one = {"weight": WEIGHT, "forward": INVARIANT, "backward": VARIABLE, "timestamp": 4.5, "insn": 17, "func": "f", "duplicate": False}
    return {
        "starting_node": ["s.c", 1, 0, 1], "use_weight": True, "weight": 9.5, "insn": 16, "predes": [["p\"q.c", 2, 1, 3], ["??", None, None, None], ["r.c", 5, 0, 1]],
        "predes_insns": ["0x11", "0x12", "0x13"], "relations": [one, one, {**one, "forward": None, "insn": 19}], "wavefront": [["w.c", 8, 0, 1]], **more,
    }


def test_relation_groups_round_trip(spark, put, tmp_path):
    df = artefacts.relation_groups(spark, put([_group(), _group(weight=20.0, starting_node=["t.c", 1, 0, 1]), {"starting_node": ["u.c", 1, 0, 1], "use_weight": False}]))
    assert rows(df, "symptom.file", "group_weight", "pos", "prede.file", "prede.line", "prede.idx", "prede.total", "prede_insn") == [
        ("s.c", 9.5, 0, 'p"q.c', 2, 1, 3, 17), ("s.c", 9.5, 2, "r.c", 5, 0, 1, 19), ("t.c", 20.0, 0, 'p"q.c', 2, 1, 3, 17), ("t.c", 20.0, 2, "r.c", 5, 0, 1, 19),
    ]
    r = df.filter("pos = 0 and symptom.file = 's.c'").first()
    assert r.relation.forward.ratio == 2 and r.relation.forward.conditional_proportion == 0.5 and r.relation.backward.distribution == [1, 2, 2] and r.relation.weight.perc_contrib == 25
    assert [tuple(q) for q in r.wavefront] == [("w.c", 8, 0, 1)] and r.use_weight and r.insn == 16
    out = f"{tmp_path.as_uri()}/out"
    sinks.write_relation_groups(df, out)
    again = artefacts.relation_groups(spark, out, lines=True)
    plain = [c for c in df.columns if c != "pos"]  # the unknown predecessor is gone, so positions close up
    assert rows(again, *plain) == rows(df, *plain)
    first = json.loads(spark.read.text(out).first()[0])
    assert first["weight"] == 20.0 and first["starting_node"] == ["t.c", 1, 0, 1] and first["predes"][0] == ['p"q.c', 2, 1, 3] and first["predes_insns"] == ["0x11", "0x13"]


def test_relation_groups_of_unequal_lists(spark, put):
    with pytest.raises(Exception, match="differ in length"):
        artefacts.relation_groups(spark, put([_group(predes=[["a", 1, 0, 1]])])).collect()


def test_full_relation_groups(spark, put):
    one = {"target_node": "16@f", "prede_node": "17@g", "prede_count": 6, "weight": WEIGHT, "forward": VARIABLE, "backward": None, "lines": [3, None], "file": "g.c", "timestamp": None, "duplicate": True}
    df = artefacts.full_relation_groups(spark, put([{"starting_node": "16@f", "weight": 2.0, "finished": True, "lines": [1], "file": "f.c", "relations": [one]}]))
    assert rows(df, "insn", "func", "group_weight", "use_weight", "pos", "prede_insn", "prede_func", "prede_count", "weight.corr", "forward.is_invariant", "file", "duplicate") == [(16, "f", 2.0, False, 0, 17, "g", 6, 0.5, False, "g.c", True)]


def _node(i, **more):
    return {"id": i, "insn": 100 + i, "function": "f", "explained": True, "is_cf": True, "is_df": False, "cf_predes": [], "cf_succes": [], "df_predes": [], "df_succes": [], "mem_load": None, "mem_store": None, **more}


def test_static_graph(spark, put):
    access = {"reg": "RBP", "shift": 0, "off": 8, "off1": None, "off_reg": None, "is_bit_var": False, "read_same_as_write": 1}
    own = [_node(1, cf_succes=[2]), _node(2, cf_predes=[1, 9], df_predes=[3], mem_load=access, bb=5)]
    pending = [_node(3, df_succes=[2]), _node(4, bb=7), _node(1, insn=0)]
    doc = {"starting_nodes": [2], "out_result": [{"func": "f", "prog": "p", "id_to_node": own}], "out_pending": [{"func": "g", "nodes": pending}]}
    nodes, edges = artefacts.static_graph(spark, put(doc))
    assert rows(nodes, "id", "insn", "pending", "mem_load.reg", "mem_load.read_same_as_write") == [(1, 101, False, None, None), (2, 102, False, "RBP", True), (3, 103, True, None, None)]
    assert rows(edges) == [(1, 2, "cf"), (3, 2, "df")]


def test_dynamic_graph(spark, put):
    nodes = [{"id": 1, "insn_id": 1, "static_node": 4, "weight": -1, "cf_predes": [], "df_predes": [], "thread_id": 2}, {"id": 2, "insn_id": 3, "static_node": 5, "weight": 2.5, "cf_predes": [1], "df_predes": [1], "bit_ops": {"7": 3}}]
    n, e = artefacts.dynamic_graph(spark, put({"dynamic_nodes": nodes, "entry_nodes": [1], "exit_nodes": [2], "target_nodes": [2]}))
    assert rows(n, "id", "static_node", "weight", "thread_id", "is_entry", "is_exit", "is_target") == [(1, 4, -1.0, 2, True, False, False), (2, 5, 2.5, None, False, True, True)]
    assert rows(e) == [(1, 2, "cf"), (1, 2, "df")]


def test_maps(spark, put, tmp_path):
    assert rows(artefacts.summary(spark, put({"16": [17, 18], "17": []}))) == [(16, 17), (16, 18)]
    assert rows(artefacts.pass_rates(spark, put({"16": {"17": {"0x1_0xff": 0.25}}}))) == [(16, 17, 1, 255, 0.25)]
    assert artefacts.pass_rates(spark, f"{tmp_path.as_uri()}/none") is None


def test_reports(spark, put):
    text = "# Overhead\n\n 12.50%  prog  a.out  [.] f\n 3.00%  prog  [unknown]  [.] g\n 1.00%  prog  a.out  [unknown] h\nx, continuing without symbols\n 2.00%  prog  lib  [.] f\n"
    assert rows(artefacts.profile(spark, put(text)), "func", "pct") == [("f", 2.0), ("h", 1.0)]
    code = "0000000000000010 <main>:\n  10:\t55 \tpush   %rbp\n  11:\t48 89 e5 \tmov    %rsp,%rbp\n  14:\tc3 \tret\n"
    assert rows(artefacts.symbols(spark, put(code))) == [(16, "main")]
    assert rows(artefacts.disassembly(spark, put(code))) == [(16, 17, "push %rbp"), (17, 20, "mov %rsp,%rbp")]
    log = "Running breakpoints took: 0:01:02.5\nother\nRunning watchpoints took: 1:00:00.25\nRunning breakpoints took: 0:00:01.0\n"
    assert rows(artefacts.phase_durations(spark, put(log), {"break": "Running breakpoints", "watch": "Running watchpoints"})) == [("break", 63.5), ("watch", 3600.25)]
    assert rows(artefacts.function_trace(spark, put("start\n0x1\n0x2\nstart\n0x1\n# eof\n")), "invocation", "insn") == [(1, 1), (1, 2), (2, 1)]


def test_logs(spark, put):
    assert rows(artefacts.watch_log(spark, put([["0x10", "0x20", "f"], ["0x11", "0x21", None]]))) == [(0, 16, 32, "f"), (1, 17, 33, None)]
    assert rows(artefacts.watch_log(spark, put([[32, "0x10", "0x5"], [33, None, None]]), "break")) == [(0, 32, 16, 5), (1, 33, None, None)]
    assert rows(artefacts.slice_results(spark, put('{"use": 1, "func": "f", "insn": 2, "expr": "rax", "is_bit_var": false}\n')), "use", "func", "insn") == [(1, "f", 2)]
    assert [(r.callee, [tuple(c) for c in r.callers]) for r in artefacts.callsites(spark, put('{"insn": 2, "func": "g", "callee": "f"}\n{"insn": 1, "func": "h", "callee": "f"}\n')).collect()] == [("f", [(1, "h"), (2, "g")])]
    assert [(r.addr, [tuple(c) for c in r.writers]) for r in artefacts.static_writes(spark, put('{"expr": "0x10", "insn": 2, "func": "g"}\n')).collect()] == [(16, [(2, "g")])]


def test_line_tables(spark):
    text = spark.createDataFrame([(1, ["/a/b.c:12 (discriminator 3)", "/a/c.c:7"]), (2, ["??:?"])], "insn long, lines array<string>")
    assert [(r.insn, r.file, r.line, r.callers) for r in artefacts.line_lookup(text).orderBy("insn").collect()] == [(1, "/a/b.c", 12, ["/a/c.c:7"]), (2, "??", None, [])]
    info = [("a.c", 1, 'Line 1 of "a.c" starts at address 0x10 <f> and ends at 0x1f <f+15>.'), ("a.c", 2, 'Line 2 of "a.c" is at address 0x20 <f+16> but contains no code.')]
    got = rows(artefacts.address_ranges(spark.createDataFrame(info, "file string, line int, info string")))
    assert got[0] == ("a.c", 1, 16, 31) and got[1][3] is None


def test_sinks(spark, tmp_path):
    at = tmp_path.as_uri()
    counts = spark.createDataFrame([(255, 3)], "insn long, value long")
    sinks.write_counts(counts, f"{at}/counts")
    assert rows(artefacts.node_info(spark, f"{at}/counts")) == [(255, 3)]
    sinks.write_pass_counts(spark.createDataFrame([(16, 17, 4)], "branch long, target long, n long"), f"{at}/pass")
    assert spark.read.text(f"{at}/pass").first()[0] == "10 11 4"
    sinks.write_symptoms(spark.createDataFrame([(None, 16, "f", 1.0), ("rax", 17, "g", 2.0)], "reg string, insn long, func string, weight double"), f"{at}/symptoms")
    assert [r[0] for r in spark.read.text(f"{at}/symptoms").collect()] == ["rax 0x11 g 2.0", "_ 0x10 f 1.0"]
    sinks.write_report(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "rank int, k string"), f"{at}/report", "k")
    assert [r[0].split("\t")[0] for r in spark.read.text(f"{at}/report").collect()] == ["3", "2", "1"]
    sinks.write_summary(spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "insn long, succ long"), f"{at}/summary")
    assert [(r.insn, r.succs) for r in spark.read.json(f"{at}/summary").collect()] == [(1, [2, 3])]
    nodes = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, explained boolean")
    edges = spark.createDataFrame([(1, 3), (2, 1)], "src long, dst long")
    sinks.write_indices(nodes, edges, f"{at}/indices")
    assert rows(spark.read.parquet(f"{at}/indices"), "id", "inner") == [(1, False), (2, True), (3, True)]
    sinks.write_graph(nodes, edges, f"{at}/graph")
    assert spark.read.parquet(f"{at}/graph/edges").count() == 2
    sinks.write_trace(spark.range(3).withColumn("run", F.lit("good")), f"{at}/trace")
    assert spark.read.parquet(f"{at}/trace").filter("run = 'good'").count() == 3
    sinks.write_candidates(counts, counts, f"{at}/candidates")
    assert spark.read.parquet(f"{at}/candidates/left").count() == 1


def test_parsed_trace(spark, tmp_path):
    import struct

    data = struct.pack("<HHqHHqq", 0, 3, 5, 0, 4, 6, -7)
    (tmp_path / "t").write_bytes(data)
    (tmp_path / f"t{trace.THREADS}").write_bytes(bytes([9, 2]))
    trace.register(spark)
    got = spark.read.format("rootloom_trace").option("registers", "4").option("mode", "parsed").load((tmp_path / "t").as_uri())
    assert [(r.tid, r.code, r.uid, r.reg) for r in got.orderBy("uid").collect()] == [(9, 3, 5, None), (2, 4, 6, -7)]
