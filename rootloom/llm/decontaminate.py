"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Items are short and documents may be very long, so similarity is containment: the share of an item's distinct word
shingles that a document has.  Items are partitioned by their number of shingles q.  All items of a partition with
at most u shingles have a bottom-k MinHash sketch of k = u - ceil(t u) + 1 shingles, those with the least hashes.  An
item with containment of t or more lacks at most q - ceil(t q) of its shingles, fewer than k, so at least one of its
sketch is in the document: the search misses nothing.  Documents too short for a partition's least item do not meet
it.  Shingle hashes of documents are only compared with the sketches; candidates alone are verified, by exact
containment over all shingles of the item.

Words are runs of letters and digits, lower-cased; a shingle is five words, or the whole item if it has fewer.

Items and documents are told apart by a key of id and text, so neither repeated nor missing ids matter.

Cases: null and empty texts contain nothing, and an item without words is in no document; each text of a repeated or
missing doc_id or item_id is judged by itself, and equal rows once; find() then has a row for each pair of different
rows, in which ids may be null or repeated; texts of any length are read whole; empty tables give empty results; extra
columns are ignored by find() and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, stored, unused

WIDTH, SIMILARITY = 5, 0.8


def row_key(identity: str, text: str = "text") -> Column:
    """128 bits of an id, null or not, and a text."""
    own = [F.coalesce(F.col(identity).cast("long"), F.lit(0)), F.col(identity).isNull(), F.col(text)]
    return F.concat_ws("/", F.xxhash64(*own).cast("string"), F.xxhash64(F.lit("second"), *own).cast("string"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column, width: int) -> Column:
    """Hashes of all shingles of so many words; null if there are too few.

    The words are bound as a lambda's variable: the optimizer would otherwise repeat the split for each shingle.
    """
    def hashes(w: Column) -> Column:
        n = F.size(w) - width + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, width))))

    return F.element_at(F.transform(F.array(ws), hashes), 1)


def sketches(benchmark: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, list[int]]:
    """(all shingles, sketches, widths in use): item (its key), item_id, width, q, least (words of the partition's shortest item), h."""
    items = benchmark.select(row_key("item_id").alias("item"), "item_id", words(F.col("text")).alias("ws")).filter("size(ws) > 0")
    items = items.withColumn("width", F.least(F.size("ws"), F.lit(WIDTH)))
    each = [F.when(F.col("width") == w, shingles(F.col("ws"), w)) for w in range(1, WIDTH + 1)]
    rows = items.select("item", "item_id", "width", F.explode(F.array_distinct(F.coalesce(*each))).alias("h")).dropDuplicates(["item", "h"])
    q = rows.groupBy("item").agg(F.count(F.lit(1)).alias("q"))
    every = stored(rows.join(q, "item"), "benchmark-shingles")
    part = F.ceil(F.log2(F.col("q").cast("double"))).cast("int")
    sized = every.withColumn("part", part)
    bounds = sized.groupBy("width", "part").agg(F.min("q").alias("low"), F.max("q").alias("high"))
    # ties of hashes cannot be: shingles of an item are distinct
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.xxhash64("h"), "h"))
    k = F.col("high") - F.ceil(F.col("high") * similarity - 1e-9) + 1
    sketch = sized.withColumn("rank", rank).join(bounds, ["width", "part"]).filter(F.col("rank") <= k)
    sketch = stored(sketch.select("item", "width", F.ceil(F.col("low") * similarity - 1e-9).alias("least"), "h"), "benchmark-sketches")
    return every, sketch, sorted(r["width"] for r in every.select("width").distinct().collect())  # 5 rows at most


def contained(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, doc_id, item, item_id, n_shared, n_item, containment) of all pairs with that containment or more; doc and item are row keys."""
    every, sketch, widths = sketches(benchmark, similarity)
    docs = docs.select("doc_id", "text")
    keyed = docs.select(row_key("doc_id").alias("doc"), "text")
    pairs = None
    for w in widths:
        ws = keyed.select("doc", shingles(words(F.col("text")), w).alias("hs")).filter(F.col("hs").isNotNull())
        rows = ws.select("doc", F.size("hs").alias("n"), F.explode("hs").alias("h"))
        hit = rows.join(checked(sketch.filter(F.col("width") == w)), "h").filter(F.col("n") >= F.col("least")).select("doc", "item")
        pairs = hit if pairs is None else pairs.union(hit)
    if pairs is None:
        zero = F.lit(0).cast("long")
        return docs.select(row_key("doc_id").alias("doc"), "doc_id", F.lit("").alias("item"), zero.alias("item_id"), zero.alias("n_shared"), zero.alias("n_item"), F.lit(0.0).alias("containment")).limit(0)
    pairs = stored(pairs.distinct(), "containment-candidates")
    wanted = checked(stored(pairs.select(F.col("doc").alias("_doc")).distinct(), "candidate-documents"))
    some = docs.withColumn("doc", row_key("doc_id")).join(wanted, F.col("doc") == F.col("_doc"), "left_semi")
    have = None
    for w in widths:
        rows = some.select("doc", "doc_id", F.explode(F.array_distinct(shingles(words(F.col("text")), w))).alias("h"))
        own = rows.join(checked(every.filter(F.col("width") == w).select("item", "item_id", "q", "h")), "h").select("doc", "doc_id", "item", "item_id", "q", "h")
        have = own if have is None else have.union(own)
    # a pair that reaches the similarity is always a candidate; others that share a shingle fall to the test itself
    total = have.groupBy("doc", "item").agg(F.count_distinct("h").alias("n_shared"), F.max("q").alias("n_item"), F.max("doc_id").alias("doc_id"), F.max("item_id").alias("item_id"))
    c = F.col("n_shared") / F.col("n_item")
    return total.filter(c >= similarity - 1e-9).select("doc", "doc_id", "item", "item_id", "n_shared", "n_item", c.alias("containment"))


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of all pairs with that containment or more."""
    return contained(docs, benchmark, similarity).drop("doc", "item")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of docs that contain no item."""
    (name,) = unused(docs, "_doc")
    bad = checked(stored(contained(docs, benchmark, similarity).select(F.col("doc").alias(name)).distinct(), "contaminated"))
    return docs.join(bad, row_key("doc_id") == F.col(name), "left_anti")
