"""Best-fit packing with swap-based local search, on a histogram of lengths.

Documents are tokenised where they lie (the text is never shuffled) and cut into pieces of at most `capacity` tokens,
the first the shorter one.  Pieces of equal length are interchangeable, so packing needs only the number of pieces of
each length: at most `capacity` numbers reach the driver, whatever the corpus.  There, best-fit decreasing packs whole
groups of equal bins at once, giving patterns (multisets of lengths) with multiplicities.  The local search then works
on the patterns: it moves a length, or exchanges one for one or two for one, between two underfull patterns wherever
that raises the sum of squared fills, and so empties bins, until no such change is left.  Pieces get their place by their rank among pieces of the
same length: ranks are taken within (length, hash bucket) and shifted by the counts of earlier buckets, so no length,
however common, meets in one task.

Cases: null text counts as empty; an empty text is the end token alone; repeated rows and null doc_ids are packed like
any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_map, stored

CAPACITY, END = 1024, 2
#: Fixed value: how byte-level BPE cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length that one task ranks, and pieces of any length that one task places, about.
RANK_ROWS = 200_000
#: Pairs of patterns that the search looks at, at most; None: until no change is left.
SEARCH = None


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level BPE files write for each byte: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _tokenizer(path: str | None):
    """A function of a text, giving its ids under a byte-level BPE file of the tokenizers library.

    Where the file's merges are in order of their ids, tiktoken runs the same vocabulary, several times as fast; texts
    that hold a special token's string, and other files, go through tokenizers itself.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    at = os.stat(path)
    return _built(str(path), at.st_ino, at.st_mtime_ns, at.st_size)


@lru_cache(maxsize=1)
def _built(path: str, *version: int):
    """The function of _tokenizer(): built once for all tasks of a Python worker, again if the file changes."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    vocab, byte = model["model"]["vocab"], _byte_of()
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
    plain = model.get("normalizer") is None and model["pre_tokenizer"].get("type") == "ByteLevel" and not model["pre_tokenizer"].get("add_prefix_space") and merged == sorted(merged) and not model["model"].get("ignore_merges")
    fast = None
    if plain:
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def ids(text: str) -> np.ndarray:
        if fast is not None and not any(t in text for t in special):
            return np.array(fast.encode_ordinary(text), "<u4")
        if not slow:
            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

    return ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text); tokenizer: path of a byte-level BPE file."""

    def make():
        ids = _tokenizer(tokenizer)

        def work(names, texts):
            out = []
            for name, text in zip(names, texts, strict=True):
                t = np.append(ids(text or ""), np.uint32(END)).astype("<u4")
                n, at, k = len(t), 0, 0
                while at < n:
                    size = n % capacity if not at and n % capacity else min(capacity, n - at)
                    out.append((name, k, at, size, zlib.crc32(t[at : at + size].tobytes())))
                    at, k = at + size, k + 1
            return out

        return work

    return row_map(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Packing:
    """patterns: sorted tuple of lengths -> number of bins."""

    capacity: int
    patterns: Counter = field(default_factory=Counter)

    def bins(self) -> int:
        return sum(self.patterns.values())

    def squares(self) -> int:
        return sum(m * sum(p) ** 2 for p, m in self.patterns.items())


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """Best-fit decreasing; equal bins are treated together."""
    free: dict[int, Counter] = defaultdict(Counter)  # room left -> patterns
    rooms: list[int] = []  # sorted keys of free

    def put(pattern: tuple, room: int, n: int) -> None:
        if room not in free or not free[room]:
            free[room] = Counter()
            insort(rooms, room)
        free[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                if left >= each:
                    put((length,) * each, capacity - each * length, left // each)
                    left %= each
                if left:
                    put((length,) * left, capacity - left * length, 1)
                break
            room = rooms[k]
            pattern, n = next(iter(free[room].items()))
            each = room // length
            use = min(n, left // each) if left >= each else 0
            fit = each if use else left
            use = use or 1
            free[room][pattern] -= use
            if not free[room][pattern]:
                del free[room][pattern]
                if not free[room]:
                    del rooms[k]
            put(pattern + (length,) * fit, room - fit * length, use)
            left -= use * fit
    out = Packing(capacity)
    for by in free.values():
        for p, n in by.items():
            out.patterns[tuple(sorted(p, reverse=True))] += n
    return out


@lru_cache(maxsize=4096)
def _parts(p: tuple) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The different lengths of a pattern, and (sum, one, other) of two of its pieces, sorted."""
    u = sorted(set(p))
    return u, sorted({(x + y, x, y) for i, x in enumerate(u) for y in u[i:] if x != y or p.count(x) > 1})


def _better(a: tuple, b: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """The change between bins a (fuller) and b with the fullest result: a move, one for one, or two for one."""
    room, best, gain = capacity - sum(a), None, 0
    if room <= 0:
        return None
    (ua, pairs), (ub, two) = _parts(a), _parts(b)
    for give in ub:
        tries = []
        if give <= room:
            tries.append((give, ()))
        k = bisect_left(ua, give - room)
        if k < len(ua) and ua[k] < give:
            tries.append((give - ua[k], (ua[k],)))
        k = bisect_left(pairs, (give - room,))
        if k < len(pairs) and pairs[k][0] < give:
            tries.append((give - pairs[k][0], pairs[k][1:]))
        for rise, back in tries:
            if rise > gain:
                gain, best = rise, ((give,), back)
    for back in ua:
        k = bisect_left(two, (room + back + 1,)) - 1
        if k >= 0 and two[k][0] - back > gain:
            gain, best = two[k][0] - back, (two[k][1:], (back,))
    if best is None:
        return None
    na, nb = Counter(a), Counter(b)
    for x in best[0]:
        na[x] += 1
        nb[x] -= 1
    for x in best[1]:
        na[x] -= 1
        nb[x] += 1
    return tuple(sorted(na.elements(), reverse=True)), tuple(sorted(nb.elements(), reverse=True))


def local_search(packing: Packing, effort: int | None = SEARCH) -> Packing:
    """Changes between underfull bins that raise the sum of squared fills, until none does or no bin can be saved.

    Patterns are taken the emptiest first and meet all others, the fullest first.  A pair is looked at again only if one
    of the two has appeared since, so the search ends when every pair has been looked at in vain; effort, if given,
    is the most pairs to look at.
    """
    cap, pats = packing.capacity, Counter(packing.patterns)
    bins = sum(pats.values())
    lower = -(-sum(m * sum(p) for p, m in pats.items()) // cap)
    clock = 0
    born = {p: 0 for p in pats if p and sum(p) < cap}
    met: dict[tuple, int] = {}  # patterns that have met all that were there at this time
    order = sorted((sum(p), p) for p in born)
    queue = list(order)  # sorted, so a heap
    while queue and bins > lower:
        x = heappop(queue)[1]
        if not pats[x] or x in met:
            continue
        clock += 1
        began = clock
        for _, y in reversed(order):
            if not pats[x] or bins == lower:
                break
            if not pats[y] or (x == y and pats[x] < 2) or met.get(y, -1) > born[x]:
                continue
            if effort is not None:
                if effort <= 0:
                    return Packing(cap, Counter({p: m for p, m in pats.items() if m and p}))
                effort -= 1
            a, b = (y, x) if sum(y) >= sum(x) else (x, y)
            new = _better(a, b, cap)
            if new is None and a != b and sum(a) == sum(b):
                a, b = b, a
                new = _better(a, b, cap)
            if new is None:
                continue
            n = pats[a] // 2 if a == b else min(pats[a], pats[b])
            pats[a] -= n
            pats[b] -= n
            clock += 1
            for p in new:
                if not p:
                    bins -= n
                    continue
                if pats[p] < 2 and sum(p) < cap:  # new, or now twice there and so not yet met by itself
                    born[p] = born[p] if pats[p] else clock
                    met.pop(p, None)
                    heappush(queue, (sum(p), p))
                pats[p] += n
        if pats[x]:
            met[x] = began
        order = sorted({(sum(p), p) for p in born if pats[p]})
        born = {p: born[p] for _, p in order}
    return Packing(cap, Counter({p: m for p, m in pats.items() if m and p}))


def slots(packing: Packing) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> (first rank, bins, first bin, offset) of each place such a length has, by rank."""
    out: dict[int, list] = defaultdict(list)
    rank: Counter = Counter()
    first = 0
    for p in sorted(packing.patterns):
        n, offset = packing.patterns[p], 0
        for length in p:
            out[length].append((rank[length], n, first, offset))
            rank[length] += n
            offset += length
        first += n
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, effort: int | None = SEARCH) -> DataFrame:
    """Every piece of docs with its sequence_id and offset."""
    cut = stored(pieces(docs, capacity, tokenizer), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = local_search(best_fit(counts, capacity), effort)
    places = slots(plan)
    table = {n: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for n, v in places.items()}
    buckets = 16 * max(1, -(-max(counts.values(), default=1) // RANK_ROWS))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = cut.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("_r", rank).join(before, ["length", "_b"]).withColumn("_r", F.col("_r") - 1 + F.coalesce("_first", F.lit(0)))
    spark = docs.sparkSession
    # many small partitions are placed and written by few tasks: Hadoop's local files start a process or more for each
    ranked = ranked.coalesce(max(spark.sparkContext.defaultParallelism, -(-sum(counts.values()) // RANK_ROWS)))
    shared = spark.sparkContext.broadcast(table)  # places: a few for each length and pattern, none for a document

    def place(batches):
        import pyarrow as pa

        at = shared.value
        for batch in batches:
            length, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_r"))
            seq, off = np.empty_like(r), np.empty_like(r)
            for n in np.unique(length):
                mine = length == n
                rank0, _, first, offset = at[int(n)]
                k = np.searchsorted(rank0, r[mine], side="right") - 1
                seq[mine], off[mine] = first[k] + r[mine] - rank0[k], offset[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_r").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
