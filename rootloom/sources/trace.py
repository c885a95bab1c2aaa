"""Binary trace source: `spark.read.format("rootloom_trace")`.

Raw files are read from their end, since a record's payload precedes its code: [reg u64][code u16], or a thread mark
[tid u8][0 u16].  uid rises from the end of the file, marks included.  Parsed files run forward: [code u16][uid i64] and
[reg i64] for codes with a register; code 0 alone is a mark, whose thread id (u8) is in the side file (option threads:
its suffix).  A record's width depends on its code, so a file is one task; a directory of files is
as many.  Options: path, registers (comma-separated codes with a payload), mode (raw or parsed).

Registers are unsigned in raw files and signed in parsed ones; both are decimal(20,0).

Fixed values: little-endian fields of 8, 2 and 1 bytes.
"""

from __future__ import annotations

import struct
import uuid
from itertools import groupby, islice

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import stored

#: Bytes read at once, records given at once, and bytes of the widest raw record.
BLOCK, ROWS, WIDEST = 1 << 22, 1 << 16, 10
#: What a parsed file's name and its file of thread ids differ by.
THREADS = "_thread_ids"


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path[5:])


def backwards(f, size: int, registers: frozenset):
    """(uid, tid, code, reg) of a raw trace, last record first; tid is that of the mark met last, or None."""
    held, pos, at, uid, tid = b"", 0, size, 0, None
    while pos or at:
        if pos < WIDEST and at:  # what is left of a block goes behind the one before it
            step = min(BLOCK, at)
            at -= step
            f.seek(at)
            held = f.read(step) + held[:pos]
            pos += step
        pos -= 2
        code = held[pos] | held[pos + 1] << 8 if pos >= 0 else 0
        reg = None
        if pos >= 0 and code == 0:
            pos -= 1
            tid = held[pos] if pos >= 0 else None
        elif code in registers:
            pos -= 8
            reg = int.from_bytes(held[pos : pos + 8], "little") if pos >= 0 else None
        if pos < 0:
            raise ValueError("the trace is cut off at its start")
        if code:
            yield uid, tid, code, reg
        uid += 1


def forwards(f, registers: frozenset, threads: bytes = b""):
    """(uid, tid, code, reg) of a parsed trace; a mark has no uid, and takes the next of the thread ids; tid is null without them."""
    marks, tid = iter(threads), None
    held, pos = b"", 0
    while True:
        if len(held) - pos < 18:
            held, pos = held[pos:] + f.read(BLOCK), 0
            if not held:
                return
        code = int.from_bytes(held[pos : pos + 2], "little")
        wide = 2 if code == 0 else 18 if code in registers else 10
        if len(held) - pos < wide:
            raise ValueError("the trace is cut off at its end")
        if code == 0:
            tid = next(marks, tid)
        else:
            uid = int.from_bytes(held[pos + 2 : pos + 10], "little", signed=True)
            yield uid, tid, code, int.from_bytes(held[pos + 10 : pos + 18], "little", signed=True) if wide == 18 else None
        pos += wide


def batches(name: str, rows):
    """Arrow batches of records of the file `name`."""
    import pyarrow as pa

    types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.decimal128(20, 0))
    while part := list(islice(rows, ROWS)):
        uid, tid, code, reg = zip(*part, strict=True)
        # registers as whole words: unsigned in raw traces, signed in parsed ones
        wide = pa.array(reg, pa.uint64() if all(x is None or x >= 0 for x in reg) else pa.int64()).cast(types[4])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), types[0]), pa.array(uid, types[1]), pa.array(tid, types[2]), pa.array(code, types[3]), wide], ["run", "uid", "tid", "code", "reg"])


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "raw")
        self.threads = options.get("threads", THREADS)
        self.registers = frozenset(int(x) for x in options.get("registers", "").split(",") if x.strip())

    def partitions(self):
        from pyarrow import fs

        store, at = _fs(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.File:
            return [_File(at)]
        return [_File(x.path) for x in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda x: x.path) if x.is_file and not x.path.endswith(self.threads)]

    def read(self, partition):
        store, _ = _fs(self.path)
        name, threads = partition.value.rpartition("/")[2], b""
        if self.mode != "raw" and store.get_file_info(side := partition.value + self.threads).is_file:
            with store.open_input_file(side) as f:
                threads = f.read()
        with store.open_input_file(partition.value) as f:
            rows = backwards(f, f.size(), self.registers) if self.mode == "raw" else forwards(f, self.registers, threads)
            yield from batches(name, rows)


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rootloom_trace"

    def schema(self) -> str:
        return "run string, uid long, tid int, code int, reg decimal(20,0)"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(TraceSource)


class RawEncoder:
    """Bytes of a raw trace from (order, tid, code, reg or None) in execution order, with a mark after each thread's stretch."""

    def __init__(self):
        self.tid = None

    def add(self, records) -> dict[str, bytes]:
        out = bytearray()
        for _, tid, code, reg in records:
            if self.tid is not None and tid != self.tid:
                out += struct.pack("<BH", self.tid, 0)
            self.tid = tid
            out += (struct.pack("<Q", int(reg) & (1 << 64) - 1) if reg is not None else b"") + struct.pack("<H", code)
        return {"": bytes(out)}

    def end(self) -> dict[str, bytes]:
        return {"": struct.pack("<BH", self.tid, 0) if self.tid is not None else b""}


class ParsedEncoder:
    """Bytes of a parsed trace and its thread ids from (uid, tid, code, reg or None) in order, with a mark where the thread changes."""

    def __init__(self):
        self.tid = None

    def add(self, records) -> dict[str, bytes]:
        out, threads = bytearray(), bytearray()
        for uid, tid, code, reg in records:
            if tid != self.tid:
                out += struct.pack("<H", 0)
                threads.append(tid)
                self.tid = tid
            out += struct.pack("<Hq", code, uid) + (struct.pack("<q", int(reg)) if reg is not None else b"")
        return {"": bytes(out), THREADS: bytes(threads)}

    def end(self) -> dict[str, bytes]:
        return {}


def encode_raw(records) -> bytes:
    """A raw trace from (tid, code, reg or None) in execution order."""
    encoder = RawEncoder()
    return encoder.add((None, *r) for r in records)[""] + encoder.end()[""]


def _write(trace, path: str, order: str, encoder):
    """One file for each run, of whatever length: written under a temporary name and renamed once it is whole."""

    def run(batches):
        import pyarrow as pa

        store, root = _fs(path)
        store.create_dir(f"{root}/_temporary", recursive=True)
        at, now, files, done = None, None, {}, []

        def put(parts: dict[str, bytes]) -> None:
            for suffix, data in parts.items():
                if suffix not in files:
                    temp = f"{root}/_temporary/{uuid.uuid4().hex}"
                    files[suffix] = store.open_output_stream(temp, compression=None), temp
                files[suffix][0].write(data)

        def close() -> None:
            if now is None:
                return
            put(now.end())
            for suffix, (f, temp) in files.items():
                f.close()
                name = f"{root}/{at}{suffix}"
                if store.get_file_info(name).is_file:  # of an earlier attempt; some file systems do not move onto a file
                    store.delete_file(name)
                store.move(temp, name)
            files.clear()
            done.append(at)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("run", order, "tid", "code", "reg")), strict=True)
            for name, group in groupby(rows, key=lambda r: r[0]):
                if name != at:
                    close()
                    at, now = name, encoder()
                put(now.add(r[1:] for r in group))
        close()
        if done:
            yield pa.RecordBatch.from_pydict({"run": done})

    dealt = trace.select("run", order, "tid", "code", "reg").repartition("run").sortWithinPartitions("run", order)
    written = stored(dealt.mapInArrow(run, "run string"), "written-runs")
    store, root = _fs(path)
    store.delete_dir(f"{root}/_temporary")
    return written


def write_raw(trace, path: str):
    """trace(run, t, tid, code, reg) to raw files in the folder path, one a run; the runs written."""
    return _write(trace, path, "t", RawEncoder)


def write_parsed(trace, path: str):
    """trace(run, uid, tid, code, reg) to parsed files and their thread ids in the folder path, one a run; the runs written."""
    return _write(trace, path, "uid", ParsedEncoder)
