"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts in one pass and stored (small rows).  The model is fitted on the driver on at most
`sample` labelled rows, those with the least hash of their id (a documented bound), and flattened into arrays (feature,
threshold bin, children, value) that all trees share; scoring walks all rows of a batch down all trees with numpy.
Labels, lang, source and doc_id are never inputs.

Cases: null and empty texts get the statistics of an empty text and a score; repeated rows get equal scores; null
doc_ids are scored and never learned from; with no usable label, or one class only, every score is the prior (0.5
without labels); an empty table gives an empty result; extra columns are ignored by score() and kept by keep_good().
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, row_map, stored, unused

SAMPLE, THRESHOLD, FOLDS = 20_000, 0.3, 5
TREES, LEAVES, RATE, BINS, LEAST, L2 = 60, 12, 0.15, 64, 20, 1.0
_WORD = re.compile(r"\S+")
_LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = (
    "chars", "words", "lines", "word_len", "word_len_sd", "distinct", "top_word", "next_same", "upper", "caps_words", "digits", "punct", "symbols", "space",
    "line_len", "short_lines", "distinct_lines", "end_punct", "pipes", "exclaim", "alpha_words", "trigram_repeat", "longest_word", "sentences", "max_run", "entropy", "one_char",
)
_PUNCT = re.compile(r"[.,;:?'\"()-]")
_SYMBOL = re.compile(r"[#$%&*+/<=>@\\^_`{|}~\[\]]")
_UPPER = re.compile(r"[^\W\d_a-zà-öø-ÿß]")
_DIGITS = re.compile(r"[0-9]")


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text."""
    text = text or ""
    n = max(1, len(text))
    words = text.split()
    k = max(1, len(words))
    lines = text.split("\n")
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    low = [w.lower() for w in words]
    seen = Counter(low)
    top = max(seen.values(), default=0)
    same = sum(a == b for a, b in zip(low, low[1:], strict=False))
    three = Counter(zip(low, low[1:], low[2:], strict=False))
    repeat = sum(c for c in three.values() if c > 1)
    full = [x for x in lines if x.strip()]
    m = max(1, len(full))
    freq = np.fromiter(seen.values(), np.float64, len(seen)) / k if seen else np.ones(1)
    run = best = 1
    for a, b in zip(low, low[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(full)), lens.mean(), lens.std(), len(seen) / k, top / k, same / k, len(_UPPER.findall(text)) / n, sum(w.isupper() and len(w) > 1 for w in words) / k,
        len(_DIGITS.findall(text)) / n, len(_PUNCT.findall(text)) / n, len(_SYMBOL.findall(text)) / n, sum(map(text.count, " \n\t")) / n,
        np.log1p(sum(map(len, full)) / m), sum(len(x) < 30 for x in full) / m, len(set(full)) / m, sum(x.rstrip()[-1] in ".!?" for x in full) / m, text.count("|") / k, text.count("!") / k,
        sum(w.isalpha() for w in words) / k, repeat / max(1, len(words) - 2), np.log1p(lens.max()), sum(w[-1] in ".!?" for w in words) / k, np.log1p(best), float(-(freq * np.log(freq)).sum()) / np.log(k + 1.0), float((lens == 1).sum()) / k,
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, th, x array<float>) of docs(doc_id, text); th is a hash of the text."""

    def make():
        return lambda ids, th, texts: [(i, t, [float(v) for v in statistics(x)]) for i, t, x in zip(ids, th, texts, strict=True)]

    return row_map(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), make, "doc_id long, th long, x array<float>")


@dataclass
class Trees:
    """All nodes of all trees: feature (-1 in a leaf), threshold (go left if x <= it), children, value; roots."""

    prior: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)
        return 1 / (1 + np.exp(-(self.prior + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, leaves: int = LEAVES, rate: float = RATE) -> Trees:
    """Leaf-wise histogram boosting of the logistic loss."""
    x = x.astype(np.float32)
    mean = float(y.mean()) if len(y) else 0.5
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    prior = float(np.log(mean / (1 - mean)))
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b: x <= cuts[b]
        wide = BINS + 1
        flat = bins + np.arange(x.shape[1]) * wide
        margin = np.full(len(y), prior)

        def split(rows, g, h):
            """(gain, feature, bin) of the best split of rows."""
            idx = flat[rows].ravel()
            size = x.shape[1] * wide
            rep = x.shape[1]
            hist = [np.bincount(idx, np.repeat(w, rep), size).reshape(rep, wide).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = hist
            gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
            k = int(gain.argmax())
            return float(gain.flat[k]), k // wide, k % wide

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            root = node()
            roots.append(root)
            every = np.arange(len(y))
            open_ = [(*split(every, g, h), root, every)]
            done = []
            while open_ and len(open_) + len(done) < leaves:
                k = max(range(len(open_)), key=lambda i: open_[i][0])
                gain, f, b, at, rows = open_.pop(k)
                if gain <= 1e-6 or b >= len(cuts[f]):
                    done.append((at, rows))
                    continue
                lt = bins[rows, f] <= b
                feature[at], threshold[at] = f, float(cuts[f][b])
                left[at], right[at] = node(), node()
                for child, part in ((left[at], rows[lt]), (right[at], rows[~lt])):
                    open_.append((*split(part, g, h), child, part))
            for at, rows in [*done, *((o[3], o[4]) for o in open_)]:
                value[at] = rate * float(g[rows].sum() / (h[rows].sum() + L2))
                margin[rows] += value[at]
    if not roots:
        roots.append(node())
    return Trees(prior, np.array(roots), np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """A model from labels(doc_id, quality) outside the held-out fold; stats as from features()."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out(F.col("doc_id")))
    pick = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "label-sample")
    rows = stats.join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("y")).orderBy("doc_id").toPandas()  # sample rows at most
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, th, score) of every row of docs(doc_id, text)."""
    stats = stored(features(docs), "statistics")
    model = train(stats, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees x leaves nodes

    def run(batches):
        for b in batches:
            x = b.column("x").combine_chunks() if isinstance(b.column("x"), pa.ChunkedArray) else b.column("x")
            if b.num_rows:
                s = shared.value.score(x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(s, pa.float64())], ["doc_id", "th", "score"])

    return stats.mapInArrow(run, "doc_id long, th long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, labels)
    return s.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score at least threshold."""
    i, h = unused(docs, "_i", "_h")
    bad = score(docs, labels).filter(F.col("score") < threshold).select(F.col("doc_id").alias(i), F.col("th").alias(h)).distinct()
    bad = checked(stored(bad, "rejected"))
    return docs.join(bad, (F.xxhash64("text") == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(i)), "left_anti")
