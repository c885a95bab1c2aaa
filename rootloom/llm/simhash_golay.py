"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Two fingerprints that differ in at most two bits
agree wholly in one segment (pigeonhole), and the segment after it differs in at most two bits.  That segment is
padded to 23 bits and fuzzily hashed with the perfect binary Golay code: a word and its 23 one-bit neighbours are
decoded, which gives one or six codeword indices, and two words at distance two or less always share an index (a
word between them is a neighbour of both).  A key is (segment, exact bits, codeword index): some 16 keys a
fingerprint, none missed, 33 bits or more each.  Keys are joined and every pair is verified.

Texts with the same fingerprint are one node, so exact copies cost nothing.  A bucket of over `bucket` different
fingerprints is not joined with itself: its members go through their midpoints instead.  Two fingerprints are within
two bits exactly if a word lies within one bit of both, so linking all fingerprints around each such word (65 at most)
gives the same components with 65 rows a fingerprint, however large the bucket.

deduplicate() keeps one document of each group.  Two bits are less than most near copies differ by, so beside these
links it takes those of near_copies (Jaccard similarity of 5-word shingles, 0.8 or more), and groups are the components
of both.

Cases: null and empty texts have fingerprint zero and link like any other; fewer than three words are one shingle;
repeated rows share a component; null doc_ids take part, and are component_id only where no other id is reachable;
texts of any length are read whole; an empty table gives an empty result; extra columns are ignored by query() and kept
by deduplicate().
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import components, row_map, stored, unused

SEED, WORDS, RADIUS = 42, 3, 2
WIDTHS = (22, 21, 21)
SHIFTS = (42, 21, 0)
#: Different fingerprints up to which a bucket is joined with itself.
BUCKET = 48
#: Generator polynomial of the (23, 12) Golay code.
POLYNOMIAL = 0b101011100011


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the lower-cased word 3-shingles (XXH64, seed 42), repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])], ">u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes)).view(">u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text, fp the fingerprint as a signed long."""

    def make():
        return lambda ids, th, texts: [(i, t, signed(fingerprint(x))) for i, t, x in zip(ids, th, texts, strict=True)]

    return row_map(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), make, "doc_id long, th long, fp long")


@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """Index of the nearest codeword for each 23-bit word."""
    data = np.arange(1 << 12, dtype=np.int64)
    rem = data << 11
    for bit in range(22, 10, -1):
        rem = np.where(rem >> bit & 1, rem ^ (POLYNOMIAL << (bit - 11)), rem)
    code = (data << 11) | rem
    one = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, np.int64), one]
    i, j = np.triu_indices(23, 1)
    errors.append(one[i] | one[j])
    a, b, c = np.meshgrid(*[np.arange(23)] * 3, indexing="ij")
    keep = (a < b) & (b < c)
    errors.append(one[a[keep]] | one[b[keep]] | one[c[keep]])
    out = np.empty(1 << 23, np.int16)
    for e in np.concatenate(errors):
        out[code ^ e] = data
    return out


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, key) for all keys of these fingerprints, each once."""
    at = decoder()
    u = fps.astype(np.int64).view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    rows, keys = [], []
    for i in range(3):
        word = seg[(i + 1) % 3]
        near = np.stack([at[word]] + [at[word ^ (1 << b)] for b in range(23)], axis=1).astype(np.int64)
        near.sort(axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append((np.int64(i) << 34) | (seg[i][r] << 12) | near[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        if len(fps):
            r, k = fuzzy_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(fps[r], pa.int64())], ["key", "fp"])


def _midpoints(batches):
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)]).view(np.int64)
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        if len(fps):
            yield pa.RecordBatch.from_arrays([pa.array((fps[:, None] ^ flips[None, :]).ravel(), pa.int64()), pa.array(np.repeat(fps, 65), pa.int64())], ["key", "fp"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """edges(a, b) between different fingerprints whose components are those of all pairs within two bits."""
    keys = stored(distinct.select("fp").mapInArrow(_keys, "key long, fp long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(keys.join(sizes, "key"), "golay-buckets")
    small = shared.filter(F.col("n") <= bucket).select("key", "fp")
    pairs = small.select("key", F.col("fp").alias("a")).join(
        small.select("key", F.col("fp").alias("b")), "key"
    ).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    crowded = shared.filter(F.col("n") > bucket).select("fp").distinct()
    around = crowded.mapInArrow(_midpoints, "key long, fp long").groupBy("key").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    hubs = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return stored(pairs.union(hubs).distinct(), "simhash-links")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, fp, component_id) for every row of docs(doc_id, text)."""
    prints = stored(fingerprints(docs), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, bucket))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return prints.join(stored(ids, "component-ids"), "fp").select("doc_id", "th", "fp", "component_id")


def near_copies_roots(docs: DataFrame, similarity: float | None = near_copies.SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, root) for every row: rows of one root are linked by fingerprints, or by that similarity if given."""
    if similarity is None:
        found = near_duplicates(docs, bucket)
        # null where no row of the component has an id; the fingerprint tells those apart
        root = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
        return stored(found.select("doc_id", "th", root.alias("root")), "near-roots")
    found = near_copies.prints(docs, similarity, lambda text: signed(fingerprint(text)))
    near = near_copies.links(found, docs, similarity)
    # a fingerprint is spoken for by the first of its sets of shingles, so one search for components serves both links
    nodes = stored(found.select("fp", "node").distinct(), "fingerprint-nodes")
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    close = links(first.select("fp"), bucket).join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    roots = components(near.union(same).union(close))
    return stored(found.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root")), "near-roots")


def deduplicate(docs: DataFrame, similarity: float | None = near_copies.SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Rows of docs, one of each group: that with the least (doc_id, text hash), ids before none; of repeated rows, one.

    similarity: None links by fingerprints alone.
    """
    found = near_copies_roots(docs, similarity, bucket)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    keep = stored(found.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.th").distinct(), "kept")
    cols = docs.columns
    own, i, h = unused(docs, "_th", "_id", "_h")
    d = docs.withColumn(own, F.xxhash64("text"))
    out = d.join(keep.select(F.col("doc_id").alias(i), F.col("th").alias(h)), (F.col(own) == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(i)), "left_semi")
    many = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(keep.filter("doc_id is not null"), ["doc_id", "th"], "left_semi")
    if many.limit(1).count() or keep.filter("doc_id is null").limit(1).count():
        out = out.dropDuplicates(["doc_id", own])
    return out.select(*cols)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
