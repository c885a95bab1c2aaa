"""Readers of the analysis' text and JSON artefacts.  All give DataFrames with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import from_hex, parse_expression, register_width

#: A relation one way: an invariant one has a ratio and a proportion, another the counts it was found from.
RELATION = "struct<is_invariant:boolean,ratio:double,conditional_proportion:double,distribution:array<double>,weighted_distribution:array<double>>"
WEIGHT = "struct<actual_weight:double,base_weight:double,perc_contrib:double,corr:double,order:double>"
UNKNOWN = "??"


def _lines(spark: SparkSession, path: str, skip_empty: bool = True) -> DataFrame:
    """(line number from 0, value); numbers rise within a file, so keep artefacts whose order matters in one file."""
    df = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return df.filter(F.trim("value") != "") if skip_empty else df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def node_info(spark: SparkSession, path: str) -> DataFrame | None:
    """`hex dec` lines to (insn, value); None if the file is not there."""
    if not _exists(spark, path):
        return None
    s = F.split("value", r"\s+")
    return _lines(spark, path).select(from_hex(s[0]).alias("insn"), s[1].cast("long").alias("value"))


def pass_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """`hex hex dec` lines to (branch, target, n); None if the file is not there."""
    if not _exists(spark, path):
        return None
    s = F.split("value", r"\s+")
    return _lines(spark, path).select(from_hex(s[0]).alias("branch"), from_hex(s[1]).alias("target"), s[2].cast("long").alias("n"))


def _quad(q):
    """struct(file, line, idx, total) of a quad [file, line, index, total_count], read as strings."""
    return F.struct(q[0].alias("file"), q[1].try_cast("int").alias("line"), q[2].try_cast("int").alias("idx"), q[3].try_cast("int").alias("total"))


def index_quads(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON array of [file, line, index, total_count] to (pos, file, line, idx, total); None if the file is not there."""
    if not _exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("pos", "q"))
    return rows.select("pos", _quad(F.col("q")).alias("q")).select("pos", "q.*")


def relation_groups(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Portable relation groups, a JSON list or (lines) an object a line: one row a relation, with its group.

    Row `pos` pairs predecessor and relation, whose lists must be equally long; predecessors of an unknown file go.
    A group without relations has no rows.
    """
    relation = f"struct<weight:{WEIGHT},forward:{RELATION},backward:{RELATION},timestamp:double,insn:long,func:string,duplicate:boolean>"
    schema = f"starting_node array<string>, use_weight boolean, weight double, insn long, predes array<array<string>>, predes_insns array<string>, prede_insns array<string>, wavefront array<array<string>>, relations array<{relation}>"
    g = spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
    n = F.size(F.coalesce("predes", F.array().cast("array<array<string>>")))
    even = F.when(n == F.size("relations"), F.col("predes")).otherwise(F.raise_error(F.lit("predes and relations differ in length")))
    insns = F.coalesce("predes_insns", "prede_insns", F.transform("predes", lambda _: F.lit(None).cast("string")))
    g = g.filter(F.col("relations").isNotNull()).withColumn("predes", even)
    rows = g.select(
        _quad(F.col("starting_node")).alias("symptom"), "insn", "use_weight", F.col("weight").alias("group_weight"), F.transform("wavefront", _quad).alias("wavefront"),
        F.posexplode(F.arrays_zip(F.col("predes").alias("prede"), insns.alias("prede_insn"), F.col("relations").alias("relation"))).alias("pos", "z"),
    ).filter(~F.array_contains("z.prede", UNKNOWN))
    return rows.select("symptom", "insn", "use_weight", "group_weight", "wavefront", "pos", _quad(F.col("z.prede")).alias("prede"), from_hex(F.col("z.prede_insn")).alias("prede_insn"), "z.relation")


def _place(text):
    """(insn, func) of `insn@func`."""
    return F.substring_index(text, "@", 1).try_cast("long"), F.regexp_extract(text, "^[^@]*@([^@]*)", 1)


def full_relation_groups(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON list of relation groups by `insn@func`: one row a relation; None if the file is not there."""
    if not _exists(spark, path):
        return None
    relation = f"struct<target_node:string,prede_node:string,prede_count:long,weight:{WEIGHT},forward:{RELATION},backward:{RELATION},lines:array<int>,file:string,timestamp:double,duplicate:boolean>"
    schema = f"starting_node string, weight double, finished boolean, lines array<int>, file string, use_weight boolean, relations array<{relation}>"
    g = spark.read.schema(schema).option("multiLine", "true").json(path)
    (insn, func), (prede, prede_func) = _place(F.col("starting_node")), _place(F.col("r.prede_node"))
    rows = g.select(insn.alias("insn"), func.alias("func"), F.col("weight").alias("group_weight"), "finished", F.coalesce("use_weight", F.lit(False)).alias("use_weight"), F.posexplode("relations").alias("pos", "r"))
    return rows.select("insn", "func", "group_weight", "finished", "use_weight", "pos", prede.alias("prede_insn"), prede_func.alias("prede_func"), "r.prede_count", "r.weight", "r.forward", "r.backward", "r.lines", "r.file", "r.timestamp", F.coalesce("r.duplicate", F.lit(False)).alias("duplicate"))


ACCESS = "struct<reg:string,shift:long,off:long,off1:long,off_reg:string,is_bit_var:boolean,read_same_as_write:int>"
NODE = (
    "struct<id:long,insn:long,function:string,explained:boolean,is_cf:boolean,is_df:boolean,bb:long,lines:array<int>,cf_predes:array<long>,cf_succes:array<long>,df_predes:array<long>,df_succes:array<long>,"
    f"mem_load:{ACCESS},mem_store:{ACCESS},reg_load:string,reg_store:string,node_backedge_targets:array<long>,node_backedge_sources:array<long>,group_ids:array<long>,group_insns:array<long>,is_intermediate_node:boolean,"
    "file:string,line:int,caller_files:array<array<string>>,index:int,total_count:int>"
)


def static_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges(src, dst, kind)) of a static graph's JSON envelope.

    Nodes of all functions and pending ones that no block has been found for (pending); of an id that both have, the
    function's holds.  Id lists become rows, and edges of ids that no node has go.
    """
    schema = f"out_result array<struct<func:string,id_to_node:array<{NODE}>>>, out_pending array<struct<func:string,nodes:array<{NODE}>>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    own = doc.select(F.explode("out_result").alias("g")).select("g.func", F.explode("g.id_to_node").alias("n"), F.lit(False).alias("pending"))
    late = doc.select(F.explode("out_pending").alias("g")).select("g.func", F.explode("g.nodes").alias("n"), F.lit(True).alias("pending")).filter("n.bb is null")
    nodes = own.union(late).groupBy("n.id").agg(F.min_by(F.struct("func", "pending", "n"), "pending").alias("x")).select("x.func", "x.pending", "x.n.*")
    for c in ("mem_load", "mem_store"):
        nodes = nodes.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c).withField("read_same_as_write", F.col(f"{c}.read_same_as_write") != 0)))
    parts = None
    for kind in ("cf", "df"):
        for col, back in ((f"{kind}_predes", True), (f"{kind}_succes", False)):
            o = nodes.select("id", F.explode(col).alias("o"))
            e = o.select(F.col("o" if back else "id").alias("src"), F.col("id" if back else "o").alias("dst"), F.lit(kind).alias("kind"))
            parts = e if parts is None else parts.union(e)
    ids = nodes.select("id")
    edges = parts.distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, edges.select("src", "dst", "kind")


def with_widths(nodes: DataFrame) -> DataFrame:
    """Nodes of a static graph with load_width and store_width, the bytes of their register; 8 for one that is not known, null without."""
    width = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), register_width(F.col(c)))
    return nodes.withColumn("load_width", width("reg_load")).withColumn("store_width", width("reg_store"))


def dynamic_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges(src, dst, kind)) of an execution graph's JSON envelope; nodes have is_entry, is_exit and is_target."""
    node = "struct<id:long,insn_id:long,func:string,static_node:long,weight:double,is_valid_weight:boolean,is_aggregate_weight:boolean,cf_predes:array<long>,df_predes:array<long>,mem_load_addr:long,mem_store_addr:long,load_bit_mask:long,remaining_load_bit_mask:long,store_bit_mask:long,bit_ops:map<string,long>,input_sets:map<string,long>,output_set_count:long,output_weight:double,thread_id:int>"
    doc = spark.read.schema(f"dynamic_nodes array<{node}>, entry_nodes array<long>, exit_nodes array<long>, target_nodes array<long>").option("multiLine", "true").json(path)
    nodes = doc.select(F.explode("dynamic_nodes").alias("n")).select("n.*")
    edges = nodes.select(F.explode("cf_predes").alias("src"), F.col("id").alias("dst"), F.lit("cf").alias("kind")).union(nodes.select(F.explode("df_predes"), "id", F.lit("df")))
    for name in ("entry", "exit", "target"):
        marked = doc.select(F.explode(f"{name}_nodes").alias("id")).distinct().withColumn("_m", F.lit(True))
        nodes = nodes.join(marked, "id", "left").withColumn(f"is_{name}", F.col("_m").isNotNull()).drop("_m")
    return nodes.drop("cf_predes", "df_predes"), edges


def summary(spark: SparkSession, path: str) -> DataFrame:
    """JSON map insn -> successors to (insn, succ)."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<long>>")).alias("insn", "s"))
    return m.select(F.col("insn").cast("long").alias("insn"), F.explode("s").alias("succ"))


def pass_rates(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON def -> use -> {"hex_hex": rate} to (def, use, branch, target, rate); None if the file is not there."""
    if not _exists(spark, path):
        return None
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,map<string,double>>>")).alias("def", "u"))
    m = m.select("def", F.explode("u").alias("use", "r")).select("def", "use", F.explode("r").alias("k", "rate"))
    return m.select(F.col("def").cast("long").alias("def"), F.col("use").cast("long").alias("use"), from_hex(F.substring_index("k", "_", 1)).alias("branch"), from_hex(F.substring_index("k", "_", -1)).alias("target"), "rate")


def insn_list(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.trim("value").cast("long").alias("insn"))


def profile(spark: SparkSession, path: str) -> DataFrame:
    """Profiler report: (pos, pct, func); comments, blank lines, missing symbols and unknown objects go; a function's last line wins."""
    df = _lines(spark, path).filter(~F.trim("value").startswith("#") & ~F.col("value").contains("continuing without symbols"))
    s = F.split(F.trim("value"), r"\s+")
    df = df.filter(F.get(s, F.lit(2)) != "[unknown]")
    df = df.select("pos", F.regexp_replace(s[0], "%", "").try_cast("double").alias("pct"), F.element_at(s, -1).alias("func")).filter("pct is not null")
    return df.groupBy("func").agg(F.max_by("pct", "pos").alias("pct"), F.max("pos").alias("pos"))


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """Disassembly: lines of exactly two tokens, `addr <func>:`."""
    s = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).filter(F.size(s) == 2).filter(s[1].rlike("^<.*>:$")).select(from_hex(s[0]).alias("addr"), F.regexp_extract(s[1], "^<(.*)>:$", 1).alias("func"))


def disassembly(spark: SparkSession, path: str) -> DataFrame:
    """(addr, next_addr, text): the text starts after as many byte tokens as the next address is away; the last instruction has none and is left out."""
    rows = _lines(spark, path).filter(F.col("value").rlike(r"^\s*[0-9a-f]+:\s"))
    rows = rows.select("pos", F.input_file_name().alias("f"), from_hex(F.trim(F.substring_index("value", ":", 1))).alias("addr"), F.split(F.regexp_replace("value", r"^\s*[0-9a-f]+:\s*|\s+$", ""), r"\s+").alias("tokens"))
    rows = rows.withColumn("next_addr", F.lead("addr").over(Window.partitionBy("f").orderBy("pos"))).filter("next_addr is not null")
    n = (F.col("next_addr") - F.col("addr")).cast("int")
    return rows.select("addr", "next_addr", F.array_join(F.slice("tokens", n + 1, F.greatest(F.size("tokens") - n, F.lit(0))), " ").alias("text"))


def config(spark: SparkSession, path: str) -> dict[str, str]:
    """`k=v` lines; # starts a comment; a later line wins.  A file of settings, so its lines come to the driver."""
    out = {}
    for row in _lines(spark, path).orderBy("pos").collect():
        k, eq, v = row["value"].split("#")[0].partition("=")
        if eq:
            out[k.strip()] = v.strip()
    return out


def symptom_list(spark: SparkSession, path: str) -> DataFrame:
    """`reg insn func [weight]`; `_` is no register."""
    s = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select("pos", F.when(s[0] != "_", s[0]).alias("reg"), from_hex(s[1]).alias("insn"), s[2].alias("func"), F.get(s, F.lit(3)).cast("double").alias("weight"))


def line_lookup(text: DataFrame) -> DataFrame:
    """text(insn, lines array): `file:line` of the innermost frame and, outward, its inlined callers."""
    one = lambda x: F.regexp_replace(x, r"\s*\(discriminator \d+\)$", "")
    first = one(F.col("lines")[0])
    return text.select("insn", F.substring_index(first, ":", 1).alias("file"), F.substring_index(first, ":", -1).try_cast("int").alias("line"), F.transform(F.slice("lines", 2, F.size("lines")), one).alias("callers"))


def address_ranges(text: DataFrame) -> DataFrame:
    """text(file, line, info): addresses a line starts and ends at; null where there is no code."""
    at = lambda word: from_hex(F.nullif(F.regexp_extract("info", word + r"\s+at address (0x[0-9a-f]+)", 1), F.lit("")))
    starts = from_hex(F.nullif(F.regexp_extract("info", r"starts at address (0x[0-9a-f]+)", 1), F.lit("")))
    return text.select("file", "line", F.coalesce(starts, at("is")).alias("first"), from_hex(F.nullif(F.regexp_extract("info", r"ends at (0x[0-9a-f]+)", 1), F.lit(""))).alias("last"))


def slice_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of slice answers: (use, func, insn, read_same_as_write, is_bit_var, kind, reg, shift, off, off_reg, off1)."""
    df = spark.read.schema("use long, func string, insn long, expr string, read_same_as_write boolean, is_bit_var boolean").json(path)
    return df.withColumn("_e", parse_expression(F.col("expr"))).select("use", "func", "insn", "read_same_as_write", "is_bit_var", "_e.*")


def callsites(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (insn, func, callee): callers of each callee."""
    return spark.read.schema("insn long, func string, callee string").json(path).groupBy("callee").agg(F.array_sort(F.collect_list(F.struct("insn", "func"))).alias("callers"))


def static_writes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (expr, insn, func): writers of each static address."""
    return spark.read.schema("expr string, insn long, func string").json(path).groupBy(from_hex(F.col("expr")).alias("addr")).agg(F.array_sort(F.collect_list(F.struct("insn", "func"))).alias("writers"))


def function_trace(spark: SparkSession, path: str) -> DataFrame:
    """Lines of instructions between `start` and `# eof`: (invocation, pos, insn)."""
    rows = _lines(spark, path).withColumn("f", F.input_file_name())
    rows = rows.withColumn("invocation", F.sum((F.trim("value") == "start").cast("int")).over(Window.partitionBy("f").orderBy("pos")))
    return rows.filter(~F.trim("value").startswith("#") & (F.trim("value") != "start")).select("f", "invocation", "pos", from_hex(F.trim("value")).alias("insn"))


def watch_log(spark: SparkSession, path: str, kind: str = "watch") -> DataFrame:
    """JSON list of triples: watch (addr, insn, func) or break (insn, addr, value), with their position."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("seq", "x"))
    names = ("addr", "insn", "func") if kind == "watch" else ("insn", "addr", "value")
    return rows.select("seq", *[(F.col("x")[k] if n == "func" else F.coalesce(F.when(F.col("x")[k].startswith("0x"), from_hex(F.col("x")[k])), F.col("x")[k].try_cast("long"))).alias(n) for k, n in enumerate(names)])


def phase_durations(spark: SparkSession, path: str, phases: dict[str, str]) -> DataFrame:
    """Sum of `H:M:S.f` durations of lines that hold a phase's phrase: (phase, seconds)."""
    name = None
    for phase, phrase in phases.items():
        c = F.when(F.col("value").contains(phrase), F.lit(phase))
        name = c if name is None else F.coalesce(name, c)
    part = lambda k: F.regexp_extract("value", r"(\d+):(\d+):(\d+(?:\.\d+)?)", k).try_cast("double")
    return _lines(spark, path).withColumn("phase", name).filter("phase is not null").groupBy("phase").agg(F.sum(part(1) * 3600 + part(2) * 60 + part(3)).alias("seconds"))
