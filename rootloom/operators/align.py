"""Aligning instructions of two builds by (file, line, index, total), source lines and address ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_FILE = "??"
QUAD = ["file", "line", "total", "idx"]


def index_build(quads: DataFrame) -> DataFrame:
    """quads(file, line, idx, total): per line the greatest total and the set of indices."""
    return quads.groupBy("file", "line").agg(F.max("total").alias("total"), F.array_sort(F.collect_set("idx")).alias("indices"))


def index_lookup(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked(file, line, idx, total): key found in index, and how: short (total unknown or different) or exact; else null."""
    other = index.select("file", "line", F.col("total").alias("o_total"), F.col("indices").alias("o_indices"))
    rows = asked.join(other, ["file", "line"], "left")
    exact = F.col("total").isNotNull() & (F.col("total") == F.col("o_total"))
    how = F.when(F.col("o_total").isNull(), None).when(~F.coalesce(exact, F.lit(False)), "short").when(F.array_contains("o_indices", F.col("idx")), "exact")
    return rows.withColumn("how", how).drop("o_total", "o_indices")


def present(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of asked whose line the other build has, and the index too where totals agree."""
    return index_lookup(asked, index).filter("how is not null").drop("how")


def absent(asked: DataFrame, index: DataFrame) -> DataFrame:
    return index_lookup(asked, index).filter("how is null").drop("how")


def exact_or_neighbour(left: DataFrame, right: DataFrame, reach: int = 2) -> DataFrame:
    """left/right(insn, file, line, idx, total, text): each left with its match in right.

    The same index if texts agree; else the first of +1, -1, +2, -2 whose text agrees; else the same index.
    """
    steps = [0] + [s * k for k in range(1, reach + 1) for s in (1, -1)]
    near = left.select("insn", "file", "line", "total", F.col("text").alias("l_text"), F.col("idx").alias("l_idx"), F.posexplode(F.array(*[F.lit(s) for s in steps])).alias("pref", "step"))
    near = near.withColumn("idx", F.col("l_idx") + F.col("step")).filter("step = 0 or idx >= 1")
    other = right.select(F.col("insn").alias("other_insn"), *QUAD, F.col("text").alias("r_text"))
    met = near.join(other, QUAD)
    agrees = F.col("l_text").isNull() | (F.col("l_text") == F.col("r_text"))
    rank = F.when(agrees & ((F.col("step") == 0) | F.col("l_text").isNotNull()), F.col("pref")).when(F.col("step") == 0, F.lit(2 * reach + 1))
    best = met.withColumn("_rank", rank).filter("_rank is not null").groupBy("insn").agg(F.min_by(F.struct("other_insn", "idx"), F.struct("_rank", "other_insn")).alias("m"))
    return left.join(best, "insn", "left").select(*left.columns, F.col("m.other_insn").alias("other_insn"), F.col("m.idx").alias("other_idx"))


def nearest_ratio(left: DataFrame, right: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Match by the nearest index / total on the same line, within tolerance."""
    other = right.select("file", "line", F.col("insn").alias("other_insn"), (F.col("idx") / F.col("total")).alias("_o"))
    d = F.abs(F.col("idx") / F.col("total") - F.col("_o"))
    best = left.join(other, ["file", "line"]).withColumn("_d", d).filter(F.col("_d") <= tolerance).groupBy("insn").agg(F.min_by("other_insn", F.struct("_d", "other_insn")).alias("other_insn"))
    return left.join(best, "insn", "left")


def translate(insns: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """insns(insn) to the other build: insn -> quad -> insn."""
    return insns.join(left.select("insn", *QUAD), "insn", "left").join(right.select(F.col("insn").alias("other_insn"), *QUAD), QUAD, "left").select("insn", "other_insn")


def all_successors_present(relations: DataFrame, edges: DataFrame, translated: DataFrame) -> DataFrame:
    """Relations(insn) none of whose successors, edges(src, dst), lacks a translation."""
    lost = edges.join(translated.filter("other_insn is not null").select(F.col("insn").alias("dst")), "dst", "left_anti").select(F.col("src").alias("insn")).distinct()
    return relations.join(lost, "insn", "left_anti")


def zipped(lists: DataFrame, *cols: str) -> DataFrame:
    """Positionally aligned arrays to rows (pos, cols); lengths must agree."""
    ok = None
    for c in cols[1:]:
        same = F.size(c) == F.size(cols[0])
        ok = same if ok is None else ok & same
    rows = lists if ok is None else lists.withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.lit("lists of different lengths")))).filter("_ok")
    keep = [c for c in lists.columns if c not in cols]
    return rows.select(*keep, F.posexplode(F.arrays_zip(*cols)).alias("pos", "_z")).select(*keep, "pos", *[F.col(f"_z.{c}").alias(c) for c in cols])


def rank_in_function(blocks: DataFrame) -> DataFrame:
    """blocks(func, line_key, start_insn): rank of a block among those of its function that have the line."""
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy("func", "line_key").orderBy("start_insn")))


def index_in_block(insns: DataFrame) -> DataFrame:
    """insns(bb, line_key, insn): index of an instruction among those of its block with its line."""
    return insns.withColumn("index", F.row_number().over(Window.partitionBy("bb", "line_key").orderBy("insn")))


def ordinal(insns: DataFrame, keys: list[str], start: int = 1) -> DataFrame:
    """Ordinal in a block or range, from start, and the number of instructions."""
    return insns.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("insn")) + F.lit(start - 1)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def containing(points: DataFrame, ranges: DataFrame, step: int = 4) -> DataFrame:
    """points(insn) with the ranges(first, last, ...) that hold them: an equi-join on address pages, then the test.

    A range's pages are as large as itself, to the next of every `step` powers of two, so it covers two at most; points
    are asked once for each size in use, 64 / step at most.
    """
    bits = F.ceil(F.log2((F.col("last") - F.col("first") + 1).cast("double")) / step).cast("int") * step
    r = ranges.filter(F.col("last") >= F.col("first")).withColumn("_bits", F.greatest(bits, F.lit(step)))
    r = r.withColumn("_page", F.explode(F.array_distinct(F.array(F.call_function("shiftright", F.col("first"), F.col("_bits")), F.call_function("shiftright", F.col("last"), F.col("_bits"))))))
    used = sorted(x["_bits"] for x in r.select("_bits").distinct().collect())  # 64 / step at most
    p = points.withColumn("_bits", F.explode(F.array(*[F.lit(b) for b in used]).cast("array<int>")))
    p = p.withColumn("_page", F.call_function("shiftright", F.col("insn"), F.col("_bits")))
    return p.join(r, ["_bits", "_page"]).filter(F.col("insn").between(F.col("first"), F.col("last"))).drop("_page", "_bits")


def nearest_range(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys, insn): under the same keys the range that holds the point, else the one that starts nearest."""
    d = F.when(F.col("insn").between(F.col("first"), F.col("last")), F.lit(-1)).otherwise(F.abs(F.col("first") - F.col("insn")))
    rest = [c for c in ranges.columns if c not in keys]
    best = points.join(ranges, keys).withColumn("_d", d).groupBy(*keys, "insn").agg(F.min_by(F.struct(*rest), F.struct("_d", "first")).alias("_r"))
    return best.select(*keys, "insn", *[F.col(f"_r.{c}").alias(c) for c in rest])


def resolve_function(names: DataFrame, functions: DataFrame) -> DataFrame:
    """names(func, insn): of functions(func, first, last) of one name, that whose range has the instruction."""
    return names.join(functions, "func").filter(F.col("insn").between(F.col("first"), F.col("last")))


def paired_parts(functions: DataFrame, name: str = "func") -> DataFrame:
    """Hot and cold parts of one function: (hot, cold) by the part before `.cold`."""
    hot = functions.filter(~F.col(name).contains(".cold")).select(F.col(name).alias("hot"))
    cold = functions.filter(F.col(name).contains(".cold")).select(F.col(name).alias("cold"), F.substring_index(name, ".cold", 1).alias("hot"))
    return hot.join(cold, "hot")


def common_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """left/right(file, line, text): lines of one file that a difference leaves unchanged: (file, left_line, right_line)."""
    import pandas as pd

    both = left.select("file", "line", "text", F.lit(0).alias("side")).union(right.select("file", "line", "text", F.lit(1).alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        sides = [pdf[pdf["side"] == s].sort_values("line") for s in (0, 1)]
        a, b = (s["text"].tolist() for s in sides)
        la, lb = (s["line"].tolist() for s in sides)
        rows = [(pdf["file"].iloc[0], la[m.a + k], lb[m.b + k]) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(m.size)]
        return pd.DataFrame(rows, columns=["file", "left_line", "right_line"])

    return both.groupBy("file").applyInPandas(run, "file string, left_line int, right_line int")


def known_files(rows: DataFrame, file: str | Column = "file") -> DataFrame:
    return rows.filter((F.col(file) if isinstance(file, str) else file) != UNKNOWN_FILE)


def match_lines(left: DataFrame, right: DataFrame, lines: DataFrame) -> DataFrame:
    """left/right(insn, file, line) by lines(file, left_line, right_line): (insn, other_insn) of instructions on matching lines."""
    a = left.select("insn", "file", F.col("line").alias("left_line")).join(lines, ["file", "left_line"])
    return a.join(right.select(F.col("insn").alias("other_insn"), "file", F.col("line").alias("right_line")), ["file", "right_line"]).select("insn", "other_insn")


def match_groups_by_line(left: DataFrame, right: DataFrame) -> DataFrame:
    """left/right(grp, file, line, idx, total): each left group with its right one (other), or null.

    The index must agree where the totals do; else the line alone decides, and of its groups the least index.
    """
    o = right.select("file", "line", F.col("grp").alias("other"), F.col("idx").alias("_i"), F.col("total").alias("_t"))
    same = F.col("total").eqNullSafe(F.col("_t")) & F.col("total").isNotNull()
    fits = ~same | (F.col("idx") == F.col("_i"))
    best = left.join(o, ["file", "line"]).filter(fits).groupBy("grp").agg(F.min_by("other", F.struct((~same).alias("short"), "_i", "other")).alias("other"))
    return left.join(best, "grp", "left").select("grp", "other")


def block_facts(insns: DataFrame) -> DataFrame:
    """insns(bb, insn): of each instruction the next in its block, and the block's first and last."""
    w = Window.partitionBy("bb")
    return insns.withColumn("next", F.lead("insn").over(w.orderBy("insn"))).withColumn("first", F.min("insn").over(w)).withColumn("last", F.max("insn").over(w))
