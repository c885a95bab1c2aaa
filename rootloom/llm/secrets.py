"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regex is parsed on the driver and turned into a Boolean query over lower-case trigrams that any match must
contain: an AND of ORs of ANDs, kept in disjunctive form.  index() makes postings (trigram, doc_id) of all documents for
the trigrams that the rules ask for.  candidates() intersects postings: a conjunction holds for a document that has
a posting for each of its trigrams.  Only candidates are verified with the rule's regex; rules without a mandatory
trigram (the hex rule) scan every text in full.

Spans are code points: the text is split at the matches, and lengths of pieces and matches are summed.

The matches of a text are placed chunk by chunk, so a text with a million of them takes no quadratic copying.

Cases: null text counts as empty; texts of any length are read whole; rows that share a doc_id are candidates together and verified each by itself; null
doc_ids match null-safely; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as rc, _parser as rp
except ImportError:  # pragma: no cover - before Python 3.11
    import sre_constants as rc
    import sre_parse as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, stored


@dataclass(frozen=True)
class Rule:
    """pattern: understood alike by Java and Python; group and least: that group's least length, checked after a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which kinds are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 0, 20),
)
#: Most strings followed through a regex before its trigrams so far are taken, and most conjunctions of a rule.
STRINGS, CONJUNCTIONS = 32, 64
#: Matches of a text that are placed together.
CHUNK = 256


def _both(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    """AND of two disjunctive forms; one that grows too large is weakened to the first, which is still mandatory."""
    both = {x | y for x in a for y in b}
    both = {x for x in both if not any(y < x for y in both)}
    return both if len(both) <= CONJUNCTIONS else a


def _strings(strings: set[str]) -> set[frozenset]:
    return {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}


def _walk(items) -> tuple[set[str] | None, set[frozenset]]:
    """(all strings the items match, or None; a mandatory query).  {frozenset()} is true."""
    query, run, exact = {frozenset()}, {""}, True

    def close():
        nonlocal query, run, exact
        query, run, exact = _both(query, _strings(run)), {""}, False

    for op, arg in items:
        sub: tuple[set[str] | None, set[frozenset]]
        if op is rc.LITERAL:
            sub = {chr(arg).lower()}, {frozenset()}
        elif op is rc.IN and all(k is rc.LITERAL for k, _ in arg):
            sub = {chr(v).lower() for _, v in arg}, {frozenset()}
        elif op is rc.SUBPATTERN:
            sub = _walk(arg[-1])
        elif op is rc.BRANCH:
            each = [_walk(x) for x in arg[1]]
            strings = None if any(s is None for s, _ in each) else set().union(*(s for s, _ in each))
            sub = strings, set().union(*(q if s is None else _strings(s) for s, q in each))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, body = arg
            inner = _walk(body)
            if (least, most) == (0, 1) and inner[0] is not None:
                sub = inner[0] | {""}, {frozenset()}
            elif least == most == 1:
                sub = inner
            else:
                sub = None, (inner[1] if inner[0] is None else _strings(inner[0])) if least else {frozenset()}
        elif op is rc.AT:
            continue
        else:
            sub = None, {frozenset()}
        if sub[0] is not None and len(sub[0]) * len(run) <= STRINGS:
            run = {a + b for a in run for b in sub[0]}
            continue
        close()
        query = _both(query, sub[1] if sub[0] is None else _strings(sub[0]))
    if exact:
        return run, query
    close()
    return None, query


def trigram_query(pattern: str) -> list[frozenset] | None:
    """Conjunctions of lower-case trigrams, one of which any match contains; None if no trigram is mandatory."""
    strings, query = _walk(rp.parse(pattern))
    if strings is not None:
        query = _both(query, _strings(strings))
    return None if any(not c for c in query) else sorted(query, key=sorted)


def queries_of(rules=RULES) -> dict[str, list[frozenset] | None]:
    return {r.kind: trigram_query(r.pattern) for r in rules}


def index(docs: DataFrame, rules=RULES) -> DataFrame:
    """Postings (trigram, doc_id) of docs(doc_id, text), for the trigrams in the rules' queries."""
    grams = sorted({g for q in queries_of(rules).values() for c in q or () for g in c})
    low = docs.select("doc_id", F.lower("text").alias("low"))
    have = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    return low.select("doc_id", F.explode(F.array_compact(F.array(*have)) if have else F.array().cast("array<string>")).alias("trigram"))


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds array) of documents whose postings meet some conjunction of a rule."""
    spark = postings.sparkSession
    wants = [(g, f"{kind}/{n}", kind, len(c)) for kind, q in queries_of(rules).items() for n, c in enumerate(q or ()) for g in sorted(c)]
    wanted = F.broadcast(spark.createDataFrame(wants, "trigram string, clause string, kind string, need int"))  # as many rows as the rules have trigrams
    met = postings.join(wanted, "trigram").groupBy("doc_id", "kind", "clause").agg(F.count_distinct("trigram").alias("have"), F.max("need").alias("need"))
    return met.filter("have = need").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<s,k,e,kind>> of the rule's matches in text, shorter ones dropped."""
    java = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, java, F.lit(0)), lambda x: F.length(x))
    part = F.transform(F.regexp_extract_all(text, java, F.lit(rule.group)), lambda x: F.length(x)) if rule.group else whole
    # the last piece has no match after it: its b is null
    steps = F.filter(F.arrays_zip(pieces.alias("a"), whole.alias("b"), part.alias("c")), lambda x: x["b"].isNotNull())
    # an array that grows by one is copied each time, so it grows by chunks, each grown by itself
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(CHUNK)), lambda k: k <= F.size(steps))
    empty = F.array().cast("array<struct<s:int,e:int,n:int>>")

    def one(acc, x):
        s = acc["at"] + x["a"]
        return F.struct((s + x["b"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["b"]).alias("e"), x["c"].alias("n")))).alias("out"))

    def chunk(acc, xs):
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return F.element_at(F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(acc["all"], F.array(i["out"])).alias("all"))), 1)

    chunks = F.transform(starts, lambda k: F.slice(steps, k, CHUNK))
    nested = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,n:int>>>").alias("all")), chunk, lambda acc: acc["all"])
    kept = F.filter(F.flatten(nested), lambda x: x["n"] >= rule.least)
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id and found, array<struct<s,k,e,kind>> in order of start, then rule."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = queries_of(rules)
    nothing = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    hits = stored(candidates(stored(index(docs, rules), "postings"), rules).withColumnRenamed("doc_id", "_id"), "candidates")
    rows = docs.join(checked(hits), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    each = []
    for k, r in enumerate(rules):
        test = F.col("text").rlike(r.pattern)
        if queries[r.kind] is not None:
            test = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) & test
        each.append(F.when(test, spans_of(F.col("text"), r, k)).otherwise(nothing))
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def _line(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def query(docs: DataFrame) -> DataFrame:
    found = F.col("found")
    base = F.filter(found, lambda x: x["k"] < 3)
    of = lambda k: F.filter(found, lambda x: x["k"] == k)  # noqa: E731 - a second argument of the inner lambda would be the index
    count = [F.size(of(k)).cast("long").alias(f"n_{RULES[k].kind}") for k in range(3)]
    more = F.size(F.filter(found, lambda x: x["k"] >= 3)).cast("long").alias("n_more")
    return scan(docs).select("doc_id", *count, F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"), _line(found).alias("spans"), more)


