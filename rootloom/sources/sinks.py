"""Writers.  Tables go to Parquet; small reports and lists go to text or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import HOT, hot_codes


def write_trace(trace: DataFrame, path: str) -> None:
    """A parsed trace, partitioned by run."""
    trace.write.mode("overwrite").partitionBy("run").parquet(path)


def write_parsed(trace: DataFrame, path: str, starts: DataFrame, cutoff: int = HOT) -> None:
    """A parsed trace(run, code, uid, ...) without hot codes, the codes left out (`large`) and the uids of starts(code) (`starting_uids`)."""
    large = hot_codes(trace, ("run", "code"), cutoff)
    write_trace(trace.join(large.select("run", "code"), ["run", "code"], "left_anti"), f"{path}/trace")
    large.write.mode("overwrite").parquet(f"{path}/large")
    trace.join(starts.select("code").distinct(), "code", "left_semi").select("run", "uid").write.mode("overwrite").parquet(f"{path}/starting_uids")


def write_counts(counts: DataFrame, path: str) -> None:
    """(insn, value) as `hex dec` lines."""
    counts.select(F.concat_ws(" ", F.lower(F.hex("insn")), F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_pass_counts(counts: DataFrame, path: str) -> None:
    """(branch, target, n) as `hex hex dec` lines."""
    counts.select(F.concat_ws(" ", F.lower(F.hex("branch")), F.lower(F.hex("target")), F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(path)


def _quad_json(q):
    """JSON text of the quad [file, line, index, total_count]: a list of mixed types, which a column cannot be."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    name = F.regexp_extract(F.to_json(F.struct(F.coalesce(q["file"], F.lit("")).alias("f"))), r'(?s)^\{"f":(.*)\}$', 1)
    return F.concat(F.lit("["), F.concat_ws(",", name, number(q["line"]), number(q["idx"]), number(q["total"])), F.lit("]"))


def write_relation_groups(relations: DataFrame, path: str) -> None:
    """Relations as read by relation_groups() to JSON, an object a line, heaviest group first."""
    keys = ["symptom", "insn", "use_weight", "group_weight", "wavefront"]
    g = relations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "prede", "prede_insn", "relation"))).alias("r"))
    quads = lambda c, of: F.concat(F.lit("["), F.array_join(F.transform(c, of), ","), F.lit("]"))
    insns = F.transform("r", lambda x: F.concat(F.lit("0x"), F.lower(F.hex(x["prede_insn"]))))
    rest = F.to_json(F.struct("use_weight", F.col("group_weight").alias("weight"), "insn", insns.alias("predes_insns"), F.transform("r", lambda x: x["relation"]).alias("relations")), {"ignoreNullFields": "false"})
    head = F.concat(
        F.lit('{"starting_node":'), _quad_json(F.col("symptom")), F.lit(',"predes":'), quads("r", lambda x: _quad_json(x["prede"])),
        F.lit(',"wavefront":'), F.coalesce(quads("wavefront", _quad_json), F.lit("[]")), F.lit(","),
    )
    docs = g.withColumn("_rest", rest).withColumn("_head", head).orderBy(F.desc("group_weight")).select(F.concat("_head", F.substring("_rest", 2, 1 << 30)).alias("value"))
    docs.write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_indices(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Quads with instruction and text, one table; inner: all predecessors are explained."""
    open_ = edges.join(nodes.filter("not explained").select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().withColumn("_o", F.lit(True))
    nodes.join(open_, "id", "left").withColumn("inner", F.col("_o").isNull()).drop("_o").write.mode("overwrite").parquet(path)


def write_summary(edges: DataFrame, path: str) -> None:
    edges.groupBy("insn").agg(F.array_sort(F.collect_set("succ")).alias("succs")).write.mode("overwrite").json(path)


def write_report(ranked: DataFrame, path: str, *cols: str) -> None:
    """The ranked text report: rank 1 is printed last."""
    ranked.orderBy(F.desc("rank")).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("rank", *cols)]).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_candidates(left: DataFrame, right: DataFrame, path: str) -> None:
    left.select("insn").distinct().write.mode("overwrite").parquet(f"{path}/left")
    right.select("insn").distinct().write.mode("overwrite").parquet(f"{path}/right")


def write_symptoms(symptoms: DataFrame, path: str) -> None:
    """`reg insn func weight` lines, heaviest first."""
    cols = [F.coalesce("reg", F.lit("_")), F.concat(F.lit("0x"), F.lower(F.hex("insn"))), F.col("func"), F.coalesce(F.col("weight").cast("string"), F.lit(""))]
    symptoms.orderBy(F.desc("weight")).select(F.trim(F.concat_ws(" ", *cols)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
