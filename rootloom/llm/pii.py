"""Personal data: fixed formats, plus bootstrapped contextual extraction.

The fixed formats (email, ip, card, phone) are the seeds.  The words around each seed are lexical patterns: the two
words before it, and the word before with the word after.  Identifier-like tokens (with a digit or an at sign) that no
format covers are unknown instances, and the same patterns are taken around them.  Patterns and instances form a
bipartite graph that Spark scores in rounds: a pattern's confidence is the mean score of its instances, shrunk
towards zero by a prior; an unknown instance's score is the mean confidence of its patterns.  Instances that reach the
confidence are promoted: they count as seeds from the next round on, and so admit patterns that the formats alone do
not.  Patterns with enough different seeds and a high confidence discover identifiers that no format knows; these
become spans of kind `context`.  The rounds end when PATIENCE of them in a row promote nothing.

The text is read twice and never shuffled; only occurrences (hashes) and patterns are.  The accepted patterns are
broadcast if a count shows that they are few, else occurrences are joined to the documents.

Cases: null text counts as empty; null and repeated doc_ids keep their rows; words and identifiers of any length count
whole, in texts of any length; empty tables give empty results; extra columns are ignored by find() and kept by redact().
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import row_map, stored, unused

KINDS = ("email", "ip", "card", "phone", "context")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]\S*")
_DIGIT = re.compile(r"[0-9]")
_NEXT = re.compile(r"\S+")
#: The least length of an unknown identifier.
TOKEN = 4
MIN_SEEDS, MIN_CONFIDENCE, PRIOR = 8, 0.8, 1.0
#: Rounds in a row, in which scores still move, that must promote nothing before the search ends.
PATIENCE = 2
#: Accepted patterns up to which they are sent to every task.
PATTERN_ROWS = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats in order."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            s = m.start()
            while s > done and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                out.append((s, 0, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _hash(text: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _before(text: str, end: int) -> tuple[str, int]:
    """The whole word that ends last before `end` (what touches `end` is a word of its own), and where it begins."""
    while end > 0 and text[end - 1].isspace():
        end -= 1
    start = end
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    return text[start:end].lower(), start


def patterns(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a span; none at a text's edge or next to another identifier."""
    one, at = _before(text, start)
    if not one or _DIGIT.search(one):
        return []
    two, _ = _before(text, at)
    m = _NEXT.search(text, end)
    after = m[0].lower() if m else ""
    out = []
    if two and not _DIGIT.search(two):
        out.append(_hash(f"L {two} {one}"))
    if after and not _DIGIT.search(after):
        out.append(_hash(f"M {one} {after}"))
    return out


def unknown(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of identifier-like tokens that no span touches."""
    out, done, k = [], 0, 0
    covered = sorted((s, e) for s, _, e in spans)
    for m in _MARK.finditer(text):
        s, e = m.start(), m.end()
        while s > done and not text[s - 1].isspace():
            s -= 1
        done = e
        while e > s and not text[e - 1].isalnum():
            e -= 1
        while s < e and not text[s].isalnum():
            s += 1
        if e - s < TOKEN:
            continue
        while k < len(covered) and covered[k][1] <= s:
            k += 1
        if k < len(covered) and covered[k][0] < e:
            continue
        out.append((s, e))
    return out


def _occurrences():
    def work(ids, th, texts):
        out = []
        for i, t, text in zip(ids, th, texts, strict=True):
            text = text or ""
            if not _MARK.search(text):
                continue
            spans = base_spans(text)
            for s, _, e in spans:
                out += [(i, t, s, e, p, _hash(text[s:e]), 1) for p in patterns(text, s, e)]
            for s, e in unknown(text, spans):
                out += [(i, t, s, e, p, _hash(text[s:e]), 0) for p in patterns(text, s, e)]
        return out

    return work


def learn(docs: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(occurrences, accepted patterns(p)) over all of docs(doc_id, text)."""
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = stored(row_map(d, _occurrences, "doc_id long, th long, s int, e int, p long, v long, seed int"), "pii-occurrences")
    edges = found.groupBy("p", "v").agg(F.max("seed").alias("seed"))
    # a pattern of fewer different instances never has enough seeds; of the others all instances stay
    wide = edges.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_seeds)
    edges = stored(edges.join(wide.select("p"), "p"), "pii-graph")
    # per instance: its score, and whether it counts as a seed; unknown ones begin at zero
    state = stored(edges.groupBy("v").agg(F.max("seed").alias("fixed")).select("v", "fixed", F.col("fixed").alias("seed"), F.col("fixed").cast("double").alias("score")), "pii-instances")
    seeds, idle = 0, -1
    while True:
        scored = edges.select("p", "v").join(state, "v")
        patterns = scored.groupBy("p").agg(F.sum("seed").alias("seeds"), (F.sum("score") / (F.count(F.lit(1)) + PRIOR)).alias("c"))
        patterns = stored(patterns, "pii-patterns")
        now = state.agg(F.sum("seed")).first()[0] or 0
        idle = 0 if now > seeds else idle + 1  # seeds only ever grow, so this ends
        if idle == PATIENCE or not now:
            return found, patterns.filter((F.col("c") >= min_confidence) & (F.col("seeds") >= min_seeds)).select("p")
        seeds = now
        # only patterns that have enough seeds speak for an instance's promotion
        met = edges.select("p", "v").join(patterns, "p").groupBy("v").agg(F.avg("c").alias("m"), F.max(F.when(F.col("seeds") >= min_seeds, F.col("c"))).alias("best"))
        new = state.join(met, "v")
        up = (F.col("seed") == 1) | (F.col("best") >= min_confidence)
        state = stored(new.select("v", "fixed", up.cast("int").alias("seed"), F.when(up, F.lit(1.0)).otherwise(F.col("m")).alias("score")), "pii-instances")


def _extra(text: str, spans: list, accepted: frozenset) -> list[tuple[int, int, int]]:
    if not accepted:
        return []
    return [(s, 4, e) for s, e in unknown(text, spans) if any(p in accepted for p in patterns(text, s, e))]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        s, kind, e = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < e:
            k += 1
            e = max(e, spans[k][2])
        out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at, k = e, k + 1
    return "".join([*out, text[at:]])


def _with_extra(docs: DataFrame, found: DataFrame, accepted: DataFrame, limit: int) -> tuple[DataFrame, frozenset | None]:
    """docs with a last column (discovered spans of the row, or null), or else the accepted patterns as a set."""
    x, i, h = unused(docs, "_x", "_i", "_h")
    accepted = stored(accepted, "pii-accepted")
    few = accepted.limit(limit + 1).collect()
    if len(few) <= limit:
        return docs.withColumn(x, F.lit(None).cast("array<struct<s:int,e:int>>")), frozenset(r.p for r in few)
    extra = found.filter("seed = 0").join(accepted, "p").groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias(x))
    extra = extra.select(F.col("doc_id").alias(i), F.col("th").alias(h), x)
    return docs.join(extra, (F.xxhash64("text") == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(i)), "left").drop(i, h), None


def _all(text: str, extra, accepted) -> tuple[list, list]:
    base = base_spans(text)
    more = [(x["s"], 4, x["e"]) for x in extra or ()] if accepted is None else _extra(text, base, accepted)
    return base, sorted(base + more)


def find(docs: DataFrame, limit: int = PATTERN_ROWS, **settings) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context."""
    rows, accepted = _with_extra(docs.select("doc_id", "text"), *learn(docs, **settings), limit)

    def make():
        def work(ids, texts, extras):
            out = []
            for i, text, x in zip(ids, texts, extras, strict=True):
                base, every = _all(text or "", x, accepted)
                n = [0] * 5
                for _, k, _ in every:
                    n[k] += 1
                out.append((i, *n[:4], hashlib.sha256(written(base).encode()).hexdigest(), written(every), n[4]))
            return out

        return work

    return row_map(rows, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_context long")


def redact(docs: DataFrame, limit: int = PATTERN_ROWS, **settings) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, and n_chars (if there) counted anew."""
    rows, accepted = _with_extra(docs, *learn(docs, **settings), limit)
    names = docs.columns
    at, extra = names.index("text"), len(names)
    count = names.index("n_chars") if "n_chars" in names else None
    schema = StructType([f if f.name != "text" else f.__class__("text", StringType()) for f in docs.schema.fields])

    def make():
        def work(*cols):
            out = []
            for row in zip(*cols, strict=True):
                new = list(row[:extra])
                if new[at]:
                    spans = _all(new[at], row[extra], accepted)[1]
                    if spans:
                        new[at] = masked(new[at], spans)
                        if count is not None:
                            new[count] = len(new[at])
                out.append(tuple(new))
            return out

        return work

    return row_map(rows, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))
