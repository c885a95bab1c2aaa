"""The queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, language, packing, pii, quality, secrets, simhash_golay, urls, warc
from .common import table


def _of(f, *names):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*(table(spark, sf_dir, n) for n in names))

    return run


def queries() -> dict:
    return {
        "op1_language": _of(language.query, "documents", "pages"),
        "op2_pii": _of(pii.find, "documents"),
        "op3_simhash": _of(simhash_golay.query, "documents"),
        "op4_secrets": _of(secrets.query, "documents"),
        "op5_packing": _of(packing.pack, "documents"),
        "op6_quality": _of(quality.query, "documents", "labels"),
        "op7_warc": _of(warc.query, "pages"),
        "op8_decontamination": _of(decontaminate.find, "documents", "benchmark"),
        "op9_fingerprints": _of(fingerprints.query, "documents"),
        "op10_urls": _of(urls.query, "pages", "labels"),
    }


#: Payloads below 1000 bytes are never revisits.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN top END AS refers_to
FROM t
"""

#: Documents and items are different rows (id and text).
DECONTAMINATION_SQL = """
WITH d AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws, row_number() OVER () AS doc FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
i AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws, row_number() OVER () AS item FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
v AS (SELECT item, ws, least(len(ws), 5) AS k FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT k FROM v),
s AS (SELECT DISTINCT item, k, unnest([array_to_string(ws[j : j + k - 1], ' ') FOR j IN range(1, len(ws) - k + 2)]) AS h FROM v),
q AS (SELECT item, count(*) AS n_item FROM s GROUP BY item),
e AS (SELECT DISTINCT doc, k, unnest([array_to_string(ws[j : j + k - 1], ' ') FOR j IN range(1, len(ws) - k + 2)]) AS h FROM d, w WHERE len(ws) >= k),
m AS (SELECT doc, item, count(*) AS n_shared FROM e JOIN s USING (k, h) GROUP BY doc, item)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN q USING (item) JOIN d USING (doc) JOIN i USING (item) WHERE n_shared >= 0.8 * n_item - 1e-9
"""


def _plain(pattern: str) -> str:
    """The pattern with its ASCII letters in either case spelt out, as RE2 folds some letters beyond ASCII too."""
    either = lambda m: "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in m[1]) + ")"
    return re.sub(r"\(\?i:([^)]*)\)", either, pattern)


def secrets_sql(rules=secrets.RULES) -> str:
    """Plain scans with each rule's regex, no index: spans from the lengths of the pieces between matches."""
    each = []
    for k, r in enumerate(rules):
        p = "'" + _plain(r.pattern).replace("'", "''") + "'"
        total = lambda of: f"coalesce(list_sum(list_transform({of}, lambda x: length(x))), 0)"
        each.append(f"""
SELECT rid, {k} AS k, '{r.kind}' AS kind, unnest([{{'s': {total('p[1:i]')} + {total('w[1:i - 1]')}, 'n': length(w[i]), 'g': length(c[i])}} FOR i IN range(1, len(w) + 1)]) AS m
FROM (SELECT rid, regexp_split_to_array(text, {p}) AS p, regexp_extract_all(text, {p}, 0) AS w, regexp_extract_all(text, {p}, {r.group}) AS c FROM d WHERE regexp_matches(text, {p}))""")
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules))
    line = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{rules[k].kind}" for k in range(3))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(each)}),
spans AS (SELECT rid, k, kind, CAST(m.s AS BIGINT) AS s, CAST(m.s + m.n AS BIGINT) AS e FROM found WHERE m.g >= CASE k {least} END)
SELECT doc_id, {counts}, sha256(coalesce({line} FILTER (k < 3), '')) AS base_sha256, coalesce({line} FILTER (k >= 0), '') AS spans, count(*) FILTER (k >= 3) AS n_more
FROM d LEFT JOIN spans USING (rid) GROUP BY rid, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": secrets_sql(), "op7_warc": WARC_SQL, "op8_decontamination": DECONTAMINATION_SQL}
