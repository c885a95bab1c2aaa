"""Language identification by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior: the text (a byte-trigram naive Bayes model, tempered to an effective
length so that it can be overruled), the language declared in the markup (a table of how often a declaration goes with
a text's language), the address suffix, and the host.  The last two are priors by grouped aggregation: counts of
text languages by host are smoothed towards those of the host's suffix, and those towards the counts of all; a row's
own vote is taken out of its host's and suffix's counts.

The model is fitted on at most about `sample` documents a language, chosen by a hash of their id (a documented bound),
for every labelled language; it takes a quarter of a megabyte a language.  Texts are read once; small rows (likelihoods,
host) are stored and aggregated by host and language.  The host's counts meet the rows by broadcast if they are few,
else by a join in which each host is split into parts by a hash of the row, its counts sent to each part of a large one;
rows without a host do not take part in it.

Cases: null and empty texts have equal likelihoods and follow the priors; without a host the prior is that of all; an
unknown declaration is none; ties go to the first language in order; repeated rows get equal answers; texts of any
length are read whole; without labelled documents every language is null; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, row_map, stored
from .urls import host_of

#: Documents a language to learn from, about; bins of the trigram table.
SAMPLE, TABLE = 2000, 1 << 16
#: Rows of a host that meet its counts in one task, about, where the counts are too many to send to all.
HOST_ROWS = 1_000_000
#: Trigrams that a text counts as at most, and pseudo-counts of the smoothing.
LENGTH, HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 60.0, 8.0, 20.0, 5.0
_SCRIPT = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


def visible(html: str) -> str:
    return _TAG.sub(" ", _SCRIPT.sub(" ", html))


def declared(html: str) -> str | None:
    m = _LANG.search(html)
    return m[1].lower() if m else None


def codes(text: str) -> np.ndarray:
    """Bins of the text's byte trigrams; white space and digits are folded."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    b = np.where(b < 65, 32, b)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return (h ^ (h >> np.uint32(15))) & np.uint32(TABLE - 1)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities (TABLE, languages)) from docs(doc_id, text, lang)."""
    known = docs.filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each labelled language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((TABLE, 0), np.float32)
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, sample / sizes[lang]) * (1 << 20)))])
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < shares[F.col("lang")]

    def make():
        def work(texts, names):
            total: dict[str, np.ndarray] = {}
            for text, lang in zip(texts, names, strict=True):
                total.setdefault(lang, np.zeros(TABLE, np.int64))
                total[lang] += np.bincount(codes(text or ""), minlength=TABLE)
            return [(lang, int(k), int(n[k])) for lang, n in total.items() for k in np.nonzero(n)[0]]

        return work

    rows = row_map(known.filter(keep).select("text", "lang"), make, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # languages x TABLE rows at most
    counts = np.zeros((TABLE, len(langs)))
    counts[rows["bin"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = rows["n"]
    counts += 0.1
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows(kind, id, text, url, host): adds no column of text; gives kind, id, lang, confidence, text_lang, declared.

    Where url is not null, text is html: its visible text and declared language are used.
    """
    langs, table = model
    spark = rows.sparkSession
    if not langs:
        return rows.select("kind", "id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    shared = spark.sparkContext.broadcast(table)  # TABLE floats a language

    def make():
        known = frozenset(langs)

        def work(kinds, ids, texts, markup, hosts, suffixes):
            t, out = shared.value, []
            for kind, i, text, m, host, suffix in zip(kinds, ids, texts, markup, hosts, suffixes, strict=True):
                text, said = text or "", None
                if m:
                    said = declared(text)
                    text = visible(text)
                c = codes(text)
                # counts of bins, not codes, so that a long text does not gather a table as long as itself
                bins, n = np.unique(c, return_counts=True)
                ll = (n[:, None] * t[bins].astype(np.float64)).sum(axis=0) * min(1.0, LENGTH / max(1, len(c)))
                out.append((kind, i, host, suffix, said if said in known else None, int(ll.argmax()) if len(c) else -1, (ll - ll.max()).tolist()))
            return out

        return work

    host = F.nullif(F.col("host"), F.lit(""))
    suffix = F.when(F.col("url").isNotNull(), F.substring_index(host, ".", -1))
    read = rows.select("kind", "id", "text", F.col("url").isNotNull().alias("markup"), host.alias("host"), suffix.alias("suffix"))
    votes = stored(row_map(read, make, "kind string, id long, host string, suffix string, declared string, v int, ll array<double>"), "likelihoods")
    n = len(langs)
    cast = votes.filter("v >= 0")
    by_host = stored(cast.filter("host is not null").groupBy("host", "suffix", "v").agg(F.count(F.lit(1)).alias("n")), "host-votes")
    by_suffix = by_host.groupBy("suffix", "v").agg(F.sum("n").alias("n"))
    dense = lambda of: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(of[i], F.lit(0)).cast("double"))
    counts = lambda df, *key: df.groupBy(*key).agg(dense(F.map_from_entries(F.collect_list(F.struct("v", "n")))).alias("of"), F.sum("n").alias("rows"))  # noqa: E731 - languages entries at most
    suffixes = counts(by_suffix, "suffix").select(F.col("suffix").alias("_s"), F.col("of").alias("s"))
    prior = counts(by_host, "host", "suffix").join(suffixes, F.col("suffix").eqNullSafe(F.col("_s")))
    prior = stored(prior.select(F.col("host").alias("_h"), F.col("suffix").alias("_s"), F.col("of").alias("h"), "s", "rows"), "host-priors")
    whole = {r["v"]: r["n"] for r in cast.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    every = np.array([whole.get(i, 0) for i in range(n)]) + 1.0
    every = every / every.sum()
    # a declaration's likelihood under each language, from a table of languages x languages
    said = {(r["declared"], r["v"]): r["n"] for r in cast.filter("declared is not null").groupBy("declared", "v").agg(F.count(F.lit(1)).alias("n")).collect()}
    like = np.array([[said.get((d, i), 0) + DECLARED_WEIGHT * (0.8 if d == lang else 0.2 / max(1, n - 1)) for i, lang in enumerate(langs)] for d in langs])
    like = np.log(like / like.sum(axis=0))
    joined = _with_priors(votes, prior)
    at = {lang: i for i, lang in enumerate(langs)}
    fusion = spark.sparkContext.broadcast((every, like))

    def fuse(batches):
        every, like = fusion.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").to_numpy(zero_copy_only=False)
            own = np.zeros((len(v), n))
            own[np.arange(len(v))[v >= 0], v[v >= 0]] = 1
            some = lambda c: np.array([x or [0.0] * n for x in batch.column(c).to_pylist()], np.float64).reshape(len(v), n)  # noqa: B023, E731
            p = posterior(some("ll"), np.maximum(some("h") - own, 0), np.maximum(some("s") - own, 0), [at.get(d, -1) for d in batch.column("declared").to_pylist()], every, like)
            best = p.argmax(axis=1)
            name = lambda i: langs[i] if i >= 0 else None
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("id"), pa.array([langs[i] for i in best], pa.string()), pa.array(p[np.arange(len(v)), best]), pa.array([name(i) for i in v], pa.string()), batch.column("declared")],
                ["kind", "id", "lang", "confidence", "text_lang", "declared"],
            )

    return joined.select("kind", "id", "declared", "v", "ll", "h", "s").mapInArrow(fuse, "kind string, id long, lang string, confidence double, text_lang string, declared string")


def posterior(ll: np.ndarray, host: np.ndarray, suffix: np.ndarray, declared: list[int], every: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Probabilities of the languages (columns) for each row, from log-likelihoods and the counts of other rows of the host and suffix."""
    by_suffix = (suffix + SUFFIX_WEIGHT * every) / (suffix.sum(axis=1, keepdims=True) + SUFFIX_WEIGHT)
    by_host = (host + HOST_WEIGHT * by_suffix) / (host.sum(axis=1, keepdims=True) + HOST_WEIGHT)
    said = np.array([like[d] if d >= 0 else np.zeros(like.shape[1]) for d in declared]).reshape(ll.shape)
    p = ll + np.log(by_host) + said
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _with_priors(votes: DataFrame, prior: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """votes with h and s, the counts of their host and suffix; null without a host."""
    here = (F.col("host") == F.col("_h")) & F.col("suffix").eqNullSafe(F.col("_s"))
    if prior.limit(few + 1).count() <= few:
        return votes.join(F.broadcast(prior), here, "left")
    split = prior.withColumn("_n", F.ceil(F.col("rows") / HOST_ROWS).cast("int"))
    large = F.broadcast(split.filter("_n > 1").select(F.col("_h").alias("_lh"), F.col("_s").alias("_ls"), "_n"))  # rows / HOST_ROWS rows at most
    some = votes.filter("host is not null").join(large, (F.col("host") == F.col("_lh")) & F.col("suffix").eqNullSafe(F.col("_ls")), "left")
    some = some.withColumn("_part", F.pmod(F.xxhash64("kind", "id", "ll"), F.coalesce("_n", F.lit(1))).cast("int"))
    parts = split.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = some.join(parts.drop("_n").hint("merge"), here & (F.col("_part") == F.col("_p")), "left").select(*votes.columns, "h", "s")
    none = F.lit(None).cast("array<double>")
    return met.unionByName(votes.filter("host is null").withColumn("h", none).withColumn("s", none))


def query(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Every document and page: doc_id or page_id, the fused language and its confidence.

    Documents have a source in place of a host, and neither markup nor an address suffix.
    """
    model = train(docs)
    a = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("url"), F.col("source").alias("host"))
    b = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("text"), F.coalesce("url", F.lit("")).alias("url"), host_of(F.col("url")).alias("host"))
    out = identify(a.unionByName(b), model)
    return out.select(F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), "kind", "lang", "confidence", "text_lang", "declared")
