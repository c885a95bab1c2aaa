"""Shared plumbing of the training-data operators: shared storage, Arrow row maps, size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..storage import scratch, shared_dir, stored  # noqa: F401 - for the operators

#: Rows up to which a side may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Bytes of Arrow data turned into Python objects at a time; a single longer row still goes whole.
PART_BYTES = 4 << 20
#: Cells that a round of ranges() returns to the driver, at most, in powers of two.
CELL_BITS = 20


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before them until df has no such column (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of about PART_BYTES, a row at least: Spark bounds a batch's bytes, this the Python objects made of it."""
    step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def row_map(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """mapInArrow over df's columns as Python lists, some megabytes at a time.

    make() runs once per task and returns a function of one list per column, giving rows as tuples.
    """
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                rows = work(*(part.column(n).to_pylist() for n in names))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, fields)


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows at most that many rows (df should be stored); else df as it is."""
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), longs: one row (node, root) per node, root the least node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label (pointer
    jumping), until a round changes nothing.  Labels live in the shared folder; nothing but a count reaches the
    driver.  Joins only meet one row per node on one side, so a hot node can be split by adaptive execution.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("r"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        low = stored(low, "low")
        jump = low.alias("x").join(low.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        new = stored(jump.select("node", "was", F.least("root", "up").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.filter("root <> was").limit(1).count() == 0:
            return labels


class Ranges:
    """Consecutive ranges of (key, tie), both longs: their number, and the range of each row."""

    def __init__(self, firsts: list[tuple[int, int]]):
        """firsts: the sorted first keys of the ranges, each with the number of ranges that share this key alone."""
        self.keys = np.array([k for k, _ in firsts], np.int64)
        self.parts = np.array([n for _, n in firsts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.parts)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.base[-1])

    def of(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """A key with several ranges of its own is cut by tie, the order of unsigned hashes in equal widths."""
        at = np.maximum(np.searchsorted(self.keys, key, side="right") - 1, 0)
        n = self.parts[at]
        high = (tie.astype(np.int64).view(np.uint64) >> np.uint64(32)).astype(np.int64)
        return self.base[at] + (high * n >> 32)

    def column(self, key: Column, tie: Column) -> Column:
        @F.pandas_udf("int")
        def of(k: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series(self.of(k.to_numpy(np.int64), t.to_numpy(np.int64)).astype(np.int32))

        return of(key, tie)


def ranges(keys: DataFrame, parts: int) -> Ranges:
    """Ranges of about equal weight from keys(k long not null, w long), cut where the data alone says.

    A histogram over the leading bits of the keys is refined, heavy cell by heavy cell, until each cell weighs a quarter
    of a range at most or is one key; so neither outliers nor clumps of keys make a range heavy.  A key that outweighs
    a range by itself gets several, cut by a hash.  The driver sees 2^CELL_BITS cells a round at most.
    """
    low, high, total = keys.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if low is None:
        return Ranges([(0, 1)])
    each = max(1, -(-total // max(1, parts)))
    spark, sign = keys.sparkSession, 1 << 63
    word = F.col("k").bitwiseXOR(F.lit(-sign))  # the order of longs as that of unsigned words
    top = ((low + sign) ^ (high + sign)).bit_length()
    shift, rows, cells = max(0, top - max(4, min(CELL_BITS, (4 * parts).bit_length() + 1))), keys, []
    while True:
        found = rows.groupBy(F.shiftrightunsigned(word, shift).alias("c")).agg(F.sum("w").alias("w"), F.min("k").alias("k")).collect()
        heavy = [r["c"] for r in found if 4 * r["w"] > each] if shift else []
        cells += [(r["k"], r["w"], shift == 0) for r in found if not shift or 4 * r["w"] <= each]
        if not heavy:
            break
        marks = F.broadcast(spark.createDataFrame([(c,) for c in heavy], "_c long"))  # 4 x parts rows at most
        rows = keys.join(marks, F.shiftrightunsigned(word, shift) == F.col("_c"), "left_semi")
        shift = max(0, shift - max(2, CELL_BITS - len(heavy).bit_length()))
    firsts, run = [], 0
    for k, w, single in sorted(cells):
        if single and w > each:
            firsts.append((k, -(-w // each)))
            run = each  # the next cell begins a range
        elif not firsts or run + w // 2 >= each:
            firsts.append((k, 1))
            run = w
        else:
            run += w
    return Ranges(firsts)
