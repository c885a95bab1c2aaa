"""Every catalogued query against its SQL in DuckDB."""

import os
import random
from datetime import datetime

import duckdb
import pytest

from rootloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(rows):
    return sorted((tuple(repr(round(x, 5) + 0.0) if isinstance(x, float) else repr(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    con = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    pick = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in pick) for r in con.fetchall()]
    assert len(got) == len(want) and _norm(got) == _norm(want)


def _scattered(spark, tmp_path, events):
    """events(event_id, ts, user_id, event_type, value) in order, written once so, and once as many files out of order: their folders."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for name, rows, parts in (("whole", events, 1), ("parts", events[::-1], 16)):
        spark.createDataFrame(rows, schema).coalesce(1).repartition(parts).write.parquet(f"{tmp_path}/{name}/events.parquet")
    return f"{tmp_path}/whole", f"{tmp_path}/parts"


def _in_order(name, events):
    """The SQL on one thread, over events in order."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE events(event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", events)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def _same_for_any_files(spark, tmp_path, name, events):
    want = _in_order(name, events)
    cols = sorted(want[0])
    for at in _scattered(spark, tmp_path, events):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, at).select(*cols).collect()]
        assert _norm(got) == _norm([tuple(r[c] for c in cols) for r in want])


def test_differences_of_a_half_do_not_hang_on_files(spark, tmp_path):
    """Of 60 groups the weights differ by a number and a half, so the order of a sum decides how it is rounded."""
    rng = random.Random(5)
    events = []
    for k in range(60):
        cents = {run: [100 * k + rng.randrange(100) for _ in range(40)] for run in (5, 25)}
        cents[5].append(100 * k + (50 + sum(cents[25]) - sum(cents[5])) % 100)
        events += [(datetime(2024, 1, day), "view", c / 100) for day, values in cents.items() for c in values]
    rng.shuffle(events)
    _same_for_any_files(spark, tmp_path, "group_match_diff", [(i, ts, 0, code, v) for i, (ts, code, v) in enumerate(events)])


def test_equal_averages_rank_alike_for_any_files(spark, tmp_path):
    """Threads of the same values in other orders: only the order of a sum tells their averages apart."""
    rng = random.Random(6)
    values = [4 * rng.randrange(1, 25) + rng.randrange(100) / 100 for _ in range(12)]
    events = [(datetime(2024, 1, day), tid, v if day == 25 else v / 2 // 4 * 4 + 0.3) for tid in range(80) for day in (5, 25) for v in values[: 12 if day == 25 else 6]]
    rng.shuffle(events)
    _same_for_any_files(spark, tmp_path, "relation_report", [(i, ts, tid, "view", v) for i, (ts, tid, v) in enumerate(events)])
