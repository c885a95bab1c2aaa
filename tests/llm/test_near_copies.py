"""The pipeline's near-duplicate stage against brute force."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from rootloom.llm import near_copies, simhash_golay

from test_operators import slow_simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_roots(texts):
    """Index of the first text of each text's component: similar sets of shingles, or fingerprints within two bits."""
    sets, root = [slow_set(t) for t in texts], list(range(len(texts)))
    fps = [slow_simhash(t) for t in texts]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        s, t = sets[i], sets[j]
        if s == t or 5 * len(s & t) >= 4 * len(s | t) or (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    out = list(words)
    for i in rng.integers(0, len(out), n):
        out[int(i)] = f"x{rng.integers(0, 10**9)}"
    return out


@pytest.mark.parametrize("bucket", [2, 16])
def test_stage_equals_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(near_copies.links, "__defaults__", (near_copies.SIMILARITY, bucket))
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 3000)}"
    line = [word() for _ in range(12)]  # a common line
    texts = [None, "", " ", "one two", "One TWO", "one two three four five", "one two three four six"]
    for k in range(60):
        words = line + [word() for _ in range(int(rng.integers(5, 200)))]
        texts.append(" ".join(words))
        for _ in range(40 if k == 0 else int(rng.integers(0, 4))):
            texts.append(" ".join(edited(rng, words, int(rng.integers(1, 8)))))
    want = slow_roots(texts)
    assert 20 < len(set(want)) < len(texts) - 20
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    got = simhash_golay.deduplicate(df, bucket=bucket)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_pipeline_drops_near_copies(spark):
    """Copies with a few words changed: far over 2 bits of the fingerprint apart, Jaccard over 0.8."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(12):
        words = [f"w{rng.integers(0, 10**6)}" for _ in range(200)]
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join([*words[:50], "a", *words[51:150], "b", *words[151:]]), "s")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF)
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 24, 2))


def test_odd_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text, "s"), (3, text, "s"), (3, text, "s"), (None, "another one", "s"), (None, "another one", "s"), (4, None, "s"), (5, "", "s")], DOCS)
    out = sorted(((r.doc_id, r.text) for r in simhash_golay.deduplicate(df).collect()), key=str)
    assert out == sorted([(3, text), (None, "another one"), (4, None)], key=str)
    assert simhash_golay.deduplicate(df.limit(0)).count() == 0


def test_prefixes_meet():
    rng = np.random.default_rng(13)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        both = rng.choice(10**6, n, replace=False)
        s, t = (np.unique(np.append(both, rng.integers(10**6, 10**7, int(rng.integers(0, n // 8 + 1))))) for _ in range(2))
        if 5 * len(np.intersect1d(s, t)) >= 4 * len(np.union1d(s, t)):
            common = np.sort(rng.choice(both, n // 2, replace=False))
            (a, ra), (b, rb) = near_copies.prefix(s, common), near_copies.prefix(t, common)
            assert len(np.intersect1d(a, b))
            assert near_copies.most_shared(a, ra, len(s), b, rb, len(t)) >= len(np.intersect1d(s, t))


def test_ranked_prefixes_meet():
    rng = np.random.default_rng(14)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        both = rng.choice(10**6, n, replace=False) + 10**6
        s, t = (np.unique(np.append(both, rng.integers(10**7, 10**8, int(rng.integers(0, n // 8 + 1))))) for _ in range(2))
        if 5 * len(np.intersect1d(s, t)) >= 4 * len(np.union1d(s, t)):
            common = np.sort(rng.choice(both, n // 2, replace=False))
            rank = rng.permutation(len(common))
            (a, ra), (b, rb) = (near_copies.prefix(x, common, rank=rank) for x in (s, t))
            assert len(np.intersect1d(a, b))
            assert near_copies.most_shared(a, ra, len(s), b, rb, len(t)) >= len(np.intersect1d(s, t))


def test_all_texts_are_counted(spark):
    rng = np.random.default_rng(15)
    texts = [None, "", "one two", *(" ".join(f"w{x}" for x in rng.integers(0, 20, 60)) for _ in range(50))]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    want = np.zeros(1 << near_copies.SLOT_BITS, np.int64)
    for t in texts:
        np.add.at(want, near_copies.slots_of(near_copies.shingles(t)), 1)
    for parts in (1, 40):
        assert (near_copies.slot_counts(df.repartition(parts)) == want).all()
    s, ranks = near_copies.shingles(texts[-1]), near_copies.slot_ranks(want)
    by = want[near_copies.slots_of(np.array(sorted(s, key=lambda x: ranks[near_copies.slots_of(np.array([x]))[0]])))]
    assert (np.diff(by) >= 0).all() and len(np.unique(near_copies.ordered(s, ranks))) == len(s)


def test_shared_passages_are_no_prefix(spark):
    """Texts that share a passage, each with words of its own: their prefixes hold none of it, however few the texts."""
    rng = np.random.default_rng(16)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    passage = [word() for _ in range(20)]
    df = spark.createDataFrame([(i, " ".join([word() for _ in range(20)] + passage), "s") for i in range(3)], DOCS)
    heads = [set(r["head"]) for r in near_copies.prints(df).collect()]
    assert all(heads) and not any(a & b for a, b in combinations(heads, 2))


def test_driver_gets_a_byte_a_slot(spark, monkeypatch):
    """What the driver collects and broadcasts to order the shingles: a byte for each slot, whatever the counts."""
    df = spark.createDataFrame([(i, " ".join(f"w{j % (i + 2)}" for j in range(40)), "s") for i in range(30)], DOCS)
    got, sent = [], []
    collect, broadcast = type(df).collect, type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(df), "collect", lambda self: got.append(rows := collect(self)) or rows)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    found = near_copies.prints(df)
    assert sum(len(x) for rows in got for r in rows for x in r if isinstance(x, (bytes, bytearray))) == 1 << near_copies.SLOT_BITS
    assert [x.nbytes for x in sent] == [1 << near_copies.SLOT_BITS]
    monkeypatch.undo()
    assert found.count() == 30


def test_levels_order_like_counts(spark):
    counts = np.concatenate([np.arange(70_000), np.geomspace(10**5, 10**12, 500).astype(np.int64)])
    levels = near_copies.count_levels(counts)
    assert (np.diff(levels.astype(int)) >= 0).all() and len(np.unique(levels[:15])) == 15
    same = [counts[levels == x] for x in range(200)]
    assert all(x.max() <= 1.1 * x.min() for x in same if len(x))
    mixed = np.random.default_rng(17).permutation(counts)
    for values in (mixed, near_copies.count_levels(mixed)):
        ranks = near_copies.slot_ranks(values)
        assert (values[np.argsort(ranks)] == np.sort(values)).all() and len(np.unique(ranks)) == len(ranks)
        assert (np.argsort(ranks) == np.argsort(values, kind="stable")).all()
    rng = np.random.default_rng(18)
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 3, 60)), "s") for i in range(50)], DOCS)
    assert (near_copies.slot_counts(df, levels=True) == near_copies.count_levels(near_copies.slot_counts(df))).all()
