"""The wider links of near-duplicate removal (see simhash_golay.deduplicate): all pairs of texts whose sets of 5-word
shingles have a Jaccard similarity of at least 0.8.  They lie some 10 of 64 bits of a SimHash apart, where fuzzy hashing
gives no selective keys.

The search is a prefix join, exact for any order of the shingles: of two sets this similar, the least 11 percent of the
smaller and the least 20 percent of the larger share a shingle.  The order is by how often a shingle's slot (the first bits of its
hash) occurs in all texts, the commonest last, so common lines and passages are seldom in a prefix; counts of one level
(less than a tenth apart) go by slot, and within a slot by hash.  Pairs that share one, and whose
sizes, places and whole prefixes allow the similarity, are verified on their whole sets.  A pair need only be found by
the first shingle that it shares, so places count as if nothing before them were shared: a text of many copies' group
with over 11 to 20 percent shingles of its own meets none of them.

Texts with the same set are one node.  In a bucket of over `bucket` nodes each is first compared with the node that has
the least before the bucket's shingle (in a node's first HUBS buckets); then every bucket with nodes of different components is joined with itself, and
the pairs of different components are verified.  Pairs left out are in one component already, so the components are
those of all similar pairs.

Cases: words are those of simhash_golay.fingerprint; fewer than five words are one shingle; null and empty texts have
the empty set and are copies of each other; repeated rows and null doc_ids take part; texts of any
length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, components, slices, stored

WORDS, SIMILARITY = 5, 0.8
#: Bits of a shingle by which its occurrences in all texts are counted.  This, BUCKET and HUBS are for speed: no pair depends on them.
SLOT_BITS = 22
BUCKET, HUBS = 16, 4


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes (XXH64) of the lower-cased word 5-shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[i : i + WORDS])) for i in range(max(1, len(words) - WORDS + 1))], np.uint64).view(np.int64))


def prefix(s: np.ndarray, common: np.ndarray, similarity: float = SIMILARITY, rank: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The least shingles of s, of which a set this similar shares one, and how many of them are not in common.

    Those in common come last.  The order is by hash, or of common ones by their rank, which then stands for them.
    """
    if not len(s):
        return s, 0
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    late = common[at] == s if len(common) else np.zeros(len(s), bool)
    n = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
    last = s[late] if rank is None else np.sort(rank[at[late]])
    return np.concatenate([s[~late], last])[:n], min(n, int((~late).sum()))


def most_shared(s: np.ndarray, rare_s: int, n_s: int, t: np.ndarray, rare_t: int, n_t: int) -> int:
    """Shingles that two sets of n_s and n_t share at most, given their prefixes.

    Both prefixes are whole up to the lesser of their last shingles; beyond it all may be shared.
    """
    late, end = min((rare_s < len(s), s[-1]), (rare_t < len(t), t[-1]))
    upto = lambda p, rare: rare + np.searchsorted(p[rare:], end, "right") if late else np.searchsorted(p[:rare], end, "right")
    return len(np.intersect1d(s, t, assume_unique=True)) + int(min(n_s - upto(s, rare_s), n_t - upto(t, rare_t)))


def count_levels(n: np.ndarray) -> np.ndarray:
    """A byte for each count, in the order of the counts: each below 15 has its own, larger ones eight an octave."""
    return np.minimum(8 * np.log2(n + 1.0), 255).astype(np.uint8)


def slot_counts(docs: DataFrame, levels: bool = False) -> np.ndarray:
    """How many shingles of all docs (a text's repeats once) fall in each slot, the first SLOT_BITS bits of a shingle.

    A task holds one array of counts, whatever its rows; there are as many tasks as cores, so the arrays that are added up
    do not grow with the table.  levels: the counts' levels instead, an eighth of the bytes, so the driver never sees the counts.
    """
    step = 1 << min(16, SLOT_BITS)
    kind = np.uint8 if levels else np.int64

    def count(batches):
        n = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in (part for whole in batches for part in slices(whole)):
            found = [shingles(x) for x in batch.column("text").to_pylist()]
            if found:
                slots, times = np.unique(slots_of(np.concatenate(found)), return_counts=True)
                n[slots] += times.astype(np.uint32)
        for k in range(0, len(n), step):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[k : k + step].tobytes()], pa.binary())], ["k", "n"])

    def add(part: pa.Table) -> pa.Table:
        n = np.asarray(sum(np.frombuffer(v.as_buffer(), np.uint32).astype(np.int64) for v in part.column("n")), np.int64)
        return pa.table({"k": part.column("k")[:1], "n": pa.array([(count_levels(n) if levels else n).tobytes()], pa.binary())})

    schema, tasks = "k int, n binary", docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.select("text").coalesce(tasks).mapInArrow(count, schema).groupBy("k").applyInArrow(add, schema).collect()
    n = np.zeros(1 << SLOT_BITS, kind)
    for r in rows:
        n[r["k"] : r["k"] + step] = np.frombuffer(r["n"], kind)
    return n


def slot_ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each slot by its count or level, the least first, equal ones by slot.

    A block at a time: beside the ranks it takes little memory for levels.
    """
    if counts.dtype != np.uint8:
        counts = np.unique(counts, return_inverse=True)[1]
    parts, width = np.split(counts, range(1 << 16, len(counts), 1 << 16)), int(counts.max()) + 1
    sizes = [np.bincount(p, minlength=width) for p in parts]
    at = np.cumsum([0, *sum(sizes)])[:-1]
    ranks = np.empty(len(counts), np.uint32)
    for p, n, out in zip(parts, sizes, np.split(ranks, range(1 << 16, len(ranks), 1 << 16)), strict=True):
        out[np.argsort(p, kind="stable")] = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(p))
        at += n
    return ranks


def slots_of(s: np.ndarray) -> np.ndarray:
    return (s.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def ordered(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles s as sorted numbers, another for each, by the rank of their slots: it takes the slot's place in the bits."""
    low = np.uint64(64 - SLOT_BITS)
    key = (ranks[slots_of(s)].astype(np.uint64) << low) | (s.view(np.uint64) & np.uint64((1 << int(low)) - 1))
    return np.sort((key ^ np.uint64(1 << 63)).view(np.int64))


def prints(docs: DataFrame, similarity: float = SIMILARITY, fingerprint: Callable[[str | None], int] = lambda text: 0) -> DataFrame:
    """(doc_id, th, fp, node, n, rare, head): hash of the text, its fingerprint (a signed long), hash of its set of shingles, their number, and the prefix."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(slot_counts(docs, levels=True))  # a byte for each slot
    none = np.zeros(0, np.int64)

    def read(batches):
        import xxhash

        ranks = slot_ranks(shared.value)
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            sets = [shingles(x) for x in texts]
            heads, rare = zip(*[prefix(ordered(s, ranks), none, similarity) for s in sets], strict=True)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            head = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(heads), pa.int64()))
            fp = pa.array([fingerprint(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), fp, pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array(rare, pa.int32()), head], ["doc_id", "th", "fp", "node", "n", "rare", "head"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = stored(d.mapInArrow(read, "doc_id long, th long, fp long, node long, n int, rare int, head array<long>"), "shingle-prints")
    shared.destroy()
    return found


def similar(pairs: DataFrame, found: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs(a, b) of nodes whose whole sets are this similar."""

    def read(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [shingles(x).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def likely(batches):
        for batch in batches:
            keep = []
            x, y = (batch.column(c) for c in ("a_head", "b_head"))
            sizes = zip(*(batch.column(c).to_pylist() for c in ("a_rare", "a_n", "b_rare", "b_n")), strict=True)
            for s, t, (rs, ns, rt, nt) in zip(x, y, sizes, strict=True):
                s, t = (v.values.to_numpy() for v in (s, t))
                keep.append(most_shared(s, rs, ns, t, rt, nt) >= similarity / (1 + similarity) * (ns + nt) - 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = lambda df: df.select(F.col("a").alias("node")).union(df.select("b")).distinct()
    pairs = stored(pairs.distinct(), "near-pairs")
    heads = found.select("node", "n", "rare", "head").join(ends(pairs), "node", "left_semi").dropDuplicates(["node"])
    heads = stored(heads, "near-heads")
    a, b = (heads.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "rare", "head")]) for x in "ab")
    pairs = stored(pairs.join(a, "a").join(b, "b").mapInArrow(likely, "a long, b long"), "near-likely")
    texts = found.select("node", "th").join(ends(pairs), "node", "left_semi").groupBy("node").agg(F.min("th").alias("t"))
    text = docs.select("text").join(checked(stored(texts, "near-texts")), F.xxhash64("text") == F.col("t")).select("node", "text")
    sets = stored(text.mapInArrow(read, "node long, shingles binary").dropDuplicates(["node"]), "near-sets")
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return stored(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "near-links")


def links(found: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """edges(a, b) between nodes, whose components are those of all pairs this similar."""
    keys = found.select("node", "n", "head").dropDuplicates(["node"]).select("node", "n", F.posexplode("head").alias("pos", "key"))
    size = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = stored(keys.withColumn("size", size).filter("size > 1"), "near-buckets")
    # a is the smaller set: its prefix may be shorter, for the two share 2s / (1 + s) of it
    share = 2 * similarity / (1 + similarity)
    need = similarity / (1 + similarity)
    side = lambda df, x: df.select("key", *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "key"])
    # in the bucket of the first shingle that they share, all they share is at its places or later
    may = lambda n, m, p, q: (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (F.least(F.col(n) - F.col(p), F.col(m) - F.col(q)) >= need * (F.col(n) + F.col(m)) - 1e-6)
    fits = (F.struct("a_n", "a_node") < F.struct("b_n", "b_node")) & (F.col("a_pos") <= F.col("a_n") - F.ceil(share * F.col("a_n") - 1e-6)) & may("a_n", "b_n", "a_pos", "b_pos")
    roots = found.sparkSession.createDataFrame([], "node long, root long")
    first = None
    large = shared.filter(F.col("size") > bucket)
    if large.limit(1).count():
        hubs = large.groupBy("key").agg(F.min_by(F.struct("node", "n", "pos"), F.struct("pos", F.xxhash64("node", "key"))).alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos"))
        mine = large.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "key", "n"))), 1, HUBS).alias("few")).select("node", F.inline("few"))
        star = mine.join(hubs, "key").filter((F.col("node") != F.col("hub")) & may("n", "hub_n", "pos", "hub_pos")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        first = similar(star, found, docs, similarity)
        roots = components(first)
    named = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named.select("key", "node", "n", "pos", "root"), "near-named")
    open_ = named.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("g")).filter("l < g").select("key")
    rest = stored(named.join(open_, "key", "left_semi"), "near-open")
    pairs = side(rest, "a").join(side(rest, "b"), "key").filter(fits & (F.col("a_root") != F.col("b_root")))
    second = similar(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), found, docs, similarity)
    return second if first is None else first.union(second)
