"""The binary trace source and the streaming edges, against a plain loop."""

import io
import time

import pytest

from rootloom.sources import trace
from rootloom.streaming import stream_edges


def test_raw_trace_round_trip(spark, tmp_path):
    records = [(1, 3, None), (1, 4, 77), (2, 3, None), (2, 4, -5), (1, 5, None)]
    (tmp_path / "a").write_bytes(trace.encode_raw(records))
    trace.register(spark)
    rows = spark.read.format("rootloom_trace").option("registers", "4").option("mode", "raw").load(tmp_path.as_uri() + "/a").orderBy("uid").collect()
    assert [(r.tid, r.code, r.reg) for r in rows if r.code] == [(t, c, r if r is None or r >= 0 else r + (1 << 64)) for t, c, r in records[::-1]]


def test_stream_edges(spark, tmp_path):
    rows = [(1, 0, 10), (1, 1, 11), (2, 2, 12), (1, 3, 12), (1, 4, 10), (1, 5, 12), (2, 6, 10), (2, 7, 12)]
    static = {12: [10, 11]}
    src = tmp_path / "in"
    schema = "tid long, t long, code int"
    spark.createDataFrame(rows[:5], schema).coalesce(1).write.parquet(str(src))
    spark.createDataFrame(rows[5:], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream_edges(stream, static).writeStream.format("memory").queryName("edges").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.table("edges").collect())
    assert got == [(1, 3, 12, 1, 11), (1, 5, 12, 4, 10), (2, 7, 12, 6, 10)]


def test_trace_registers_and_blocks(spark, tmp_path, monkeypatch):
    """Whole unsigned words, and files of many blocks."""
    data = [(k // 7 % 3, 1 + k % 5, (1 << 64) - 1 - k if k % 5 == 0 else None) for k in range(3000)]
    (tmp_path / "big").write_bytes(trace.encode_raw(data))
    read = lambda: sorted(map(tuple, spark.read.format("rootloom_trace").option("registers", "1").load(f"{tmp_path}/big").select("uid", "tid", "code", "reg").collect()), reverse=True)
    trace.register(spark)
    got = read()
    assert [(tid, code, None if reg is None else int(reg)) for _, tid, code, reg in got] == data
    for block in (10, 64, 4096):
        with open(tmp_path / "big", "rb") as f:
            monkeypatch.setattr(trace, "BLOCK", block)
            rows = list(trace.backwards(f, (tmp_path / "big").stat().st_size, frozenset({1})))
        assert [(t, c, r) for _, t, c, r in reversed(rows)] == data
    with pytest.raises(ValueError):
        list(trace.backwards(io.BytesIO(b"\x07\x01\x00"), 3, frozenset({1})))


def test_trace_reading_is_linear():
    """Ten times the records take about ten times as long."""
    def seconds(n):
        raw = trace.encode_raw([(1, 1, k) for k in range(n)])
        start = time.perf_counter()
        assert sum(1 for _ in trace.backwards(io.BytesIO(raw), len(raw), frozenset({1}))) == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(800_000) < 25 * seconds(80_000)
