"""Dependence edges as a stream: state per key is the last definition of each code, so an edge leaves as its use arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_edges(trace: DataFrame, static: dict[int, list[int]], key: str = "tid") -> DataFrame:
    """trace(key long, t long, code int) rising in t per key; static: using code -> its defining codes.

    (key, dst_t, dst, src_t, src): the nearest earlier definition of each use.  Rows of a batch are put in order of t;
    later batches must not go back behind earlier ones.
    """
    import pandas as pd

    def run(keys, batches, state: GroupState):
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, code in rows[["t", "code"]].itertuples(index=False):
            near = max(((last[c], c) for c in static.get(code, ()) if c in last), default=None)
            if near:
                out.append((keys[0], t, code, near[0], near[1]))
            last[code] = t
        state.update(([int(c) for c in last], [int(t) for t in last.values()]))
        yield pd.DataFrame(out, columns=["key", "dst_t", "dst", "src_t", "src"])

    return trace.groupBy(key).applyInPandasWithState(run, "key long, dst_t long, dst int, src_t long, src int", "codes array<int>, times array<long>", "append", GroupStateTimeout.NoTimeout)
