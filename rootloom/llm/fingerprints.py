"""Document fingerprints: 128-bit SimHash, and permuted block tables for all fingerprints in a Hamming radius.

Terms are lower-cased words and pairs of adjacent words; each occurrence votes, a pair with
three times a word's weight, and the votes are signed: for a bit that the term's hash sets, against one that it does not.  For the search a fingerprint is cut into radius + 2 blocks; if two
differ in at most `radius` bits, two blocks at least agree, so with a table for every pair of blocks (ten for radius 3,
keys of 51 bits or so) no neighbour is missed.  Keys are joined and each pair is verified in the first table in which
it meets.  Searches take query rows against all rows; equal fingerprints are one row with a count.

The next document in descending order of id is found without a global sort in one task: ids are cut into ranges of
about equally many rows (see common.ranges: outliers, clumps and repeated ids make no range heavy), each is sorted by
itself, and the first document of each range is also sent, as a sentinel, to the range before.  The text is shuffled once.

Cases: null and empty texts have the fingerprint zero and likeness 1 to each other; rows of one id follow each other in
order of a hash of the text, then text; null ids come last; a table of one row is its own next; texts of any length are
read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Ranges, ranges, row_map, stored

BITS, RADIUS, PAIR_WEIGHT = 128, 3, 3
#: Least and most ranges of ids (a range is a task; the most bounds what the driver lists), and rows of one, about.
RANGES, RANGE_ROWS = (12, 50_000), 4_000
_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """Word -> XXH64, kept while they are few."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the terms set each of the 128 bits."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        both = np.stack([_mix(part), _mix(part ^ np.uint64(0x9E3779B97F4A7C15))], axis=1).astype("<u8")
        total += np.add.reduce(np.unpackbits(both.view(np.uint8), axis=1), axis=0, dtype=np.uint16)
    return total


class Hasher:
    def __init__(self):
        self.hash = _Hashes()

    def fingerprint(self, text: str | None) -> int:
        words = _WORD.findall((text or "").lower())
        if not words:
            return 0
        one = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        two = one[:-1] * np.uint64(3) + (one[1:] ^ (one[1:] >> np.uint64(17)))
        votes = 2 * (_ones(one) + PAIR_WEIGHT * _ones(two)) - (len(one) + PAIR_WEIGHT * len(two))
        return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _dealt(docs: DataFrame, parts: int | None) -> tuple[DataFrame, int]:
    """docs(doc_id, text) with its range _g, _s (1: a sentinel, the first document of the next range), and how many ranges."""
    key = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit((1 << 63) - 1))  # descending ids, then none
    tie = F.xxhash64("text")
    parts = parts or min(RANGES[1], max(RANGES[0], -(-docs.count() // RANGE_ROWS)))
    cuts = ranges(docs.select(key.alias("k"), F.lit(1).cast("long").alias("w")), parts)
    own = docs.withColumn("_k", key).withColumn("_t", tie).withColumn("_g", cuts.column(F.col("_k"), F.col("_t")))
    # the first document of each range: the least key first, then the first of its texts
    least = own.groupBy("_g").agg(F.min("_k").alias("_k")) if (cuts.parts > 1).any() else _first_keys(docs, key, cuts)
    least = stored(least, "range-heads")  # a row for each range
    order = F.struct((F.col("_t").bitwiseXOR(F.lit(-(1 << 63)))).alias("t"), "text", "doc_id")
    heads = own.join(F.broadcast(least), ["_g", "_k"]).groupBy("_g").agg(F.min(order).alias("h"))
    at = sorted(r["_g"] for r in least.select("_g").collect())
    before = docs.sparkSession.createDataFrame([(g, at[k - 1]) for k, g in enumerate(at)], "_g int, _before int")
    sent = heads.join(F.broadcast(before), "_g").select("h.doc_id", "h.text", F.lit(0).cast("long").alias("_k"), F.lit(0).cast("long").alias("_t"), F.col("_before").alias("_g"), F.lit(1).alias("_s"))
    own = own.select("doc_id", "text", "_k", F.col("_t").bitwiseXOR(F.lit(-(1 << 63))).alias("_t"), "_g", F.lit(0).alias("_s"))
    return own.unionByName(sent), len(cuts)


def _first_keys(docs: DataFrame, key: Column, cuts: Ranges) -> DataFrame:
    """(_g, _k): the least key in each range, where no key is cut by its texts; texts are not read."""
    return docs.select(key.alias("_k")).withColumn("_g", cuts.column(F.col("_k"), F.lit(0).cast("long"))).groupBy("_g").agg(F.min("_k").alias("_k"))


def compare_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) of every row of docs(doc_id, text); fingerprints in hex."""
    rows, n = _dealt(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), parts)
    dealt = rows.repartitionById(n, "_g").sortWithinPartitions("_g", "_s", "_k", "_t", "text").select("doc_id", "text", "_g", "_s")

    def make():
        fingerprint = Hasher().fingerprint
        held: list = []  # the row that waits for its next, and whether its range has met its sentinel

        def work(ids, texts, groups, marks):
            out = []
            for i, text, g, s in zip(ids, texts, groups, marks, strict=True):
                if held and held[3] != g:
                    held.clear()
                fp = fingerprint(text) if held or not s else 0
                if held:
                    mine, own, was, _ = held
                    new = edited(own, text)
                    e = fingerprint(new)
                    out.append((mine, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), f"{was:032x}", f"{e:032x}", likeness(was, e), likeness(was, fp)))
                    held.clear()
                if not s:
                    held[:] = [i, text, fp, g]
            return out

        return work

    return row_map(dealt, make, "doc_id long, n_chars long, edited_sha256 string, fp string, edited_fp string, near_edited double, near_next double")


def tables(radius: int = RADIUS) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of (first bit, width): the two blocks that make a table's key."""
    n = radius + 2
    cuts = [BITS * k // n for k in range(n + 1)]
    return list(combinations([(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], 2))


def _keys(radius: int):
    def make():
        plan = tables(radius)

        def work(fps, marks):
            out = []
            for fp, q in zip(fps, marks, strict=True):
                x = int(fp, 16)
                hi, lo = x >> 64, x & (1 << 64) - 1
                hi, lo = hi - (1 << 64) if hi >> 63 else hi, lo - (1 << 64) if lo >> 63 else lo
                for t, ((a, m), (b, w)) in enumerate(plan):
                    out.append((t, x >> a & (1 << m) - 1, x >> b & (1 << w) - 1, hi, lo, q))
            return out

        return work

    return make


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, other, distance) for each fp of queries(fp) and each different other of prints(fp), both hex, within radius bits."""
    schema = "t int, k1 long, k2 long, hi long, lo long, q int"
    every = stored(row_map(prints.select("fp", F.lit(0).alias("q")).distinct(), _keys(radius), schema), "block-tables")
    asked = row_map(queries.select("fp", F.lit(1).alias("q")).distinct(), _keys(radius), schema)
    a, b = asked.alias("a"), every.alias("b")
    xor_hi, xor_lo = F.col("a.hi").bitwiseXOR(F.col("b.hi")), F.col("a.lo").bitwiseXOR(F.col("b.lo"))
    d = F.bit_count(xor_hi) + F.bit_count(xor_lo)
    met = a.join(b, ["t", "k1", "k2"]).filter((d <= radius) & (d > 0)).select("a.hi", "a.lo", F.col("b.hi").alias("hi2"), F.col("b.lo").alias("lo2"), d.alias("distance")).distinct()
    text = lambda h, low: F.concat(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lpad(F.lower(F.hex(low)), 16, "0"))
    return met.select(text("hi", "lo").alias("fp"), text("hi2", "lo2").alias("other"), "distance")


def query(docs: DataFrame, every: int = 100) -> DataFrame:
    """The contract's columns, and n_near: for ids divisible by `every`, other rows within the radius (equal ones included)."""
    rows = stored(compare_with_next(docs), "prints")
    counts = stored(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") % every == 0).alias("asked")), "print-counts")
    found = near(counts, counts.filter("asked"))
    others = found.join(counts.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("m"))
    total = stored(counts.filter("asked").join(others, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near")), "near-counts")
    asked = F.col("doc_id") % every == 0
    out = rows.join(total, "fp", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", F.when(asked, F.col("n_near")).alias("n_near"))
