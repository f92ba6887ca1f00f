"""Segments on disk: writing chained frames, scanning, verifying and repairing them. Files are reached by URI through pyarrow.fs."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.blake3 import blake3, blake3_one
from ..functions.scalars import CONTROL_TYPE
from . import seal as sealing

MAGIC, HEAD, FRAME, CHAIN = bytes.fromhex("464c534876303031"), 24, 20, 40
BLOCK = 1 << 16
#: Bytes of payloads that are held at once, when the frames aren't more before.
WEIGHT = 1 << 24
_HEADER, _FRAME = struct.Struct("<IIQ"), struct.Struct("<IIQI")
SCHEMA = "path string, frame_index long, file_offset long, length long, type long, ts_ns long, crc32 long, payload binary, seq long, prev_hash binary, rc int"
#: What ends a scan: nothing more, a cut frame, a wrong checksum, a broken chain, no segment at all.
END, CUT, BAD_CRC, BAD_CHAIN, NOT_ONE = 1, -4, -6, -7, -2


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """One segment: frames are appended in order, each bound to the one before. It is written under another name and renamed when it is closed, so a task that dies leaves no segment."""

    def __init__(self, uri: str, created_ns: int):
        self.fs, self.path = open_fs(uri)
        self.uri, self.created = uri, created_ns
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temp)
        self.digest, self.size, self.held, self.waiting = hashlib.blake2b(digest_size=32), 0, [], 0
        head = struct.pack("<IQI", 0, created_ns, 0)
        self._put(MAGIC + head)
        self.tip, self.seq = blake3_one(head), 0

    def _put(self, b: bytes) -> None:
        self.held.append(b)
        self.waiting += len(b)
        if self.waiting >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        b = b"".join(self.held)
        self.out.write(b)
        self.digest.update(b)
        self.size += self.waiting
        self.held, self.waiting = [], 0

    def append(self, type_id: int, ts_ns: int, payload: bytes) -> None:
        head = _HEADER.pack(len(payload), type_id, ts_ns)
        frame = head + zlib.crc32(payload, zlib.crc32(head[4:])).to_bytes(4, "little") + payload
        self._put(frame + self.seq.to_bytes(8, "little") + self.tip)
        self.tip, self.seq = blake3_one(frame + self.tip), self.seq + 1

    def close(self, records: int | None = None, mode: int = sealing.CLEAN, reason: int = 0, seal: bool = True, seed: bytes | None = None) -> None:
        self._flush()
        if seal:
            self.out.write(sealing.trailer(self.size, self.seq if records is None else records, self.tip, self.digest.digest(), mode, reason, seed))
        self.out.close()
        self.fs.move(self.temp, self.path)


def control(writer: Writer, which: int, **fields) -> None:
    writer.append(CONTROL_TYPE + which, 0, json.dumps({"schema_version": 1, **fields}, separators=(",", ":")).encode())


def meta(fmt: str, label: str, source: dict, policy: dict, rotate: dict, fallback: str) -> dict:
    return {"format": fmt, "type_label": label, "source": source, "timestamp_policy": policy, "rotate": rotate, "fallback_mode": fallback}


def write(frames: DataFrame, folder: str, by: str = "segment", order: str = "frame_index", created_ns: int = 0, run: bool = False) -> DataFrame:
    """(segment, path, records, bytes): writes a sealed segment for each value of `by`. frames: (by, order, type, ts_ns, payload).

    A chain is serial, so a segment is one task's; segments are written side by side and their frames pass through in batches. Tasks are dealt out by
    the segments' numbers of frames, largest first, so no two share a task while others have none. run:
    with control frames at both ends. Lazy like any DataFrame; a repeated task writes the same segment again.
    """

    def go(batches: Iterator) -> Iterator:
        import pandas as pd

        writer, at, first, last, n = None, None, 0, 0, 0

        def end() -> tuple:
            if run:
                control(writer, 2, run_id=str(created_ns), end_ts=last, status="CLEAN")
            writer.close(records=n)
            return (at, writer.uri, n, writer.size + sealing.SIZE)

        done = []
        for b in batches:
            for s, type_id, ts, payload in zip(b[by], b["type"], b["ts_ns"], b["payload"]):
                if writer is None or s != at:
                    if writer:
                        done.append(end())
                    writer, at, n = Writer(f"{folder}/segment-{s}.seg", created_ns), s, 0
                    if run:
                        control(writer, 0, **meta("ndjson", "ndjson_v1", {"kind": "table", "detail": ""}, {"source": "field", "field": "ts", "parsed": "unix_ns"}, {"size": 0, "time": 0, "records": 0}, "soft"))
                        control(writer, 1, run_id=str(created_ns), start_ts=int(ts))
                writer.append(int(type_id), int(ts), bytes(payload))
                n, last = n + 1, int(ts)
        if writer:
            done.append(end())
        yield pd.DataFrame(done, columns=["segment", "path", "records", "bytes"])

    rows = frames.select(F.col(by).cast("string").alias(by), order, "type", "ts_ns", F.col("payload").cast("binary").alias("payload"))
    spark = frames.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tasks = rows.groupBy(F.col(by).alias("_of")).count().select("_of", ((F.row_number().over(Window.orderBy(F.desc("count"), "_of")) - 1) % n).alias("_task"))  # a row for each segment
    rows = rows.join(F.broadcast(tasks), F.col(by).eqNullSafe(F.col("_of")), "left").repartitionById(n, F.coalesce("_task", F.lit(0))).sortWithinPartitions(by, order)
    return rows.drop("_of", "_task").mapInPandas(go, "segment string, path string, records long, bytes long")


def trailer_at(fs, path: str) -> tuple[int, bytes]:
    """(bytes before the trailer, trailer): it counts only at the very end of the file, so no payload can be taken for it."""
    size = fs.get_file_info(path).size
    if size < HEAD + sealing.SIZE:
        return size, b""
    with fs.open_input_file(path) as f:
        f.seek(size - sealing.SIZE)
        last = f.read(sealing.SIZE)
    return (size - sealing.SIZE, last) if sealing.parse(last) else (size, b"")


def scan_file(uri: str, payloads: bool = True, check: bool = True, start: int = HEAD, batch: int = 1000) -> Iterator[tuple]:
    """Rows as in SCHEMA, and last one with only path, frame_index, file_offset and rc: why the scan ended. check: checksums and chain; from another start, or without payloads, the chain isn't looked at."""
    fs, path = open_fs(uri)
    end, _ = trailer_at(fs, path)
    with fs.open_input_file(path) as raw, io.BufferedReader(raw, BLOCK) as f:
        head = f.read(HEAD)
        if len(head) < HEAD or head[:8] != MAGIC:
            yield (uri, 0, 0, None, None, None, None, None, None, None, NOT_ONE)
            return
        tip = blake3([head[8:]])[0] if check and payloads and start == HEAD else None
        at, n, held, weight, rc = start, 0, [], 0, END
        if start != HEAD:
            f.seek(start)

        def flush(held: list, tip: bytes | None) -> tuple[list, bytes | None, int]:
            if not held or tip is None:
                return held, tip, 0
            hashes = blake3([h for _, h in held])
            for k, (row, _) in enumerate(held):
                if row[9] != tip or row[8] != row[1]:
                    return held[:k], tip, BAD_CHAIN
                tip = hashes[k]
            return held, tip, 0

        while rc == END:
            h = f.read(min(FRAME, end - at))
            if not h:
                break
            size, type_id, ts, crc = _FRAME.unpack(h) if len(h) == FRAME else (0, 0, 0, 0)
            if len(h) < FRAME or at + FRAME + size + CHAIN > end:
                rc = CUT
                break
            payload = f.read(size) if payloads else None
            if not payloads:
                f.seek(size, 1)
            chain = f.read(CHAIN)
            if payloads and check and zlib.crc32(h[4:16] + payload) != crc:
                rc = BAD_CRC
                break
            held.append(((uri, n, at, size, type_id, ts, crc, payload, int.from_bytes(chain[:8], "little"), chain[8:], 0), h + payload + chain[8:] if payloads else b""))
            at, n, weight = at + FRAME + size + CHAIN, n + 1, weight + len(payload or b"")
            if len(held) >= batch or weight >= WEIGHT:
                good, tip, bad = flush(held, tip)
                yield from (row for row, _ in good)
                if bad:
                    _, n, at, *_ = held[len(good)][0]
                held, weight, rc = [], 0, bad or rc
        good, tip, bad = flush(held, tip)
        yield from (row for row, _ in good)
        if bad:
            _, n, at, *_ = held[len(good)][0]
            rc = bad
        yield (uri, n, at, None, None, None, None, None, None, tip, rc)


def frames_from(uri: str, start: int, batch: int = 1000) -> Iterator[pa.RecordBatch]:
    """(path, place, ts_ns, payload) of the frames from an offset on, a batch at a time: no more of the file is held."""
    held, weight = [], 0

    def out() -> pa.RecordBatch:
        cols = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["path", "place", "ts_ns", "payload"])

    for row in scan_file(uri, start=start, batch=batch):
        if row[10] == 0:
            held.append((row[0], row[1], row[5], row[7]))
            weight += row[3]
            if len(held) >= batch or weight >= WEIGHT:
                yield out()
                held, weight = [], 0
    if held:
        yield out()


def list_files(uri: str) -> list[str]:
    from pyarrow import fs as pafs

    fs, path = open_fs(uri)
    info = fs.get_file_info(path)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    if info.type == pafs.FileType.File:
        return [uri]
    return sorted(prefix + x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File and x.path.endswith(".seg"))


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_File]:
        return [_File(u) for u in list_files(self.options["path"])]

    def read(self, part: _File) -> Iterator[tuple]:
        yes = lambda k: str(self.options.get(k, "true")).lower() != "false"
        return scan_file(part.uri, yes("payloads"), yes("verify"))


class SegmentSource(DataSource):
    """spark.read.format("strandlog").load(folder or file); options payloads and verify (true). A task for each file."""

    @classmethod
    def name(cls) -> str:
        return "strandlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def scan(spark: SparkSession, uri: str, payloads: bool = True, verify: bool = True, ends: bool = False) -> DataFrame:
    """The frames of a segment or folder; ends: also each file's last row, with why its scan ended."""
    spark.dataSource.register(SegmentSource)
    rows = spark.read.format("strandlog").option("payloads", payloads).option("verify", verify).load(uri)
    return rows if ends else rows.where("rc = 0")


def blocks(f, size: int) -> Iterator[bytes]:
    """The next bytes of an open file, up to `size`, in blocks."""
    while size > 0 and (block := f.read(min(BLOCK, size))):
        yield block
        size -= len(block)


def _verified(uri: str) -> tuple[dict, tuple]:
    """The report of one file, and the last row of its scan: the frames before the first damage, their end, the chain's tip there, and why it ended."""
    fs, path = open_fs(uri)
    report = {"file": uri, "exit_code": 0, "is_segment": True, "sealed": False, "salvage": False, "records": 0}
    for last in scan_file(uri):
        pass
    n, rc = last[1], last[10]
    if rc == NOT_ONE:
        return report | {"exit_code": 3, "is_segment": False}, last
    end, trailer = trailer_at(fs, path)
    report["records"] = n
    if rc != END:
        return report | {"exit_code": 2}, last
    if not trailer:
        return report | {"exit_code": 1}, last
    seal, digest = sealing.parse(trailer), hashlib.blake2b(digest_size=32)
    with fs.open_input_file(path) as f:
        for block in blocks(f, end):
            digest.update(block)
    good = seal.signed_length == end and sealing.verified(seal, digest.digest())
    return report | {"exit_code": 0 if good else 2, "sealed": good, "salvage": good and seal.mode == sealing.SALVAGE}, last


def verify_file(uri: str) -> dict:
    """The report of one file: exit 0 sealed and whole, 1 whole without a seal, 2 damaged, 3 not a segment."""
    return _verified(uri)[0]


def repair_file(uri: str, target: str | None = None, dry_run: bool = False, seed: bytes | None = None) -> dict:
    """Keep the frames before the first damage in a new segment with a salvage seal, beside the old one unless target is the same. A sealed whole file stays as it is.

    The one scan has checked the kept bytes and their chain, so they are copied as they are and nothing is hashed anew but for the seal.
    """
    before, (_, rows, end, *_, tip, rc) = _verified(uri)
    report = {"file": uri, "exit_code": 0, "sealed_before": before["sealed"], "sealed_after": before["sealed"], "modified": False, "dry_run": dry_run, "salvage_applied": False, "salvage_reason": 0, "salvage_reason_str": "none", "records_kept": before["records"], "error": None}
    if before["exit_code"] in (0, 3):
        return report | {"exit_code": before["exit_code"], "error": None if not before["exit_code"] else "not a segment"}
    reason = 5 if not rows else {END: 4, CUT: 1, BAD_CRC: 3, BAD_CHAIN: 2}[rc]
    report |= {"salvage_reason": reason, "salvage_reason_str": sealing.REASONS[reason], "records_kept": rows}
    if not rows:
        return report | {"exit_code": 2, "error": "no frames to keep"}
    if dry_run:
        return report
    (fs, path), (target_fs, target_path), digest = open_fs(uri), open_fs(target or f"{uri}.repaired"), hashlib.blake2b(digest_size=32)
    target_fs.create_dir(target_path.rpartition("/")[0], recursive=True)
    temp = f"{target_path}.{uuid.uuid4().hex}.part"
    with fs.open_input_file(path) as f, target_fs.open_output_stream(temp) as out:
        for block in blocks(f, end):
            out.write(block)
            digest.update(block)
        out.write(sealing.trailer(end, rows, tip, digest.digest(), sealing.SALVAGE, reason, seed))
    target_fs.move(temp, target_path)
    return report | {"modified": True, "sealed_after": True, "salvage_applied": True}


def cut_half(uri: str, target: str) -> None:
    """A copy that ends within the frame after the first half of the frames; the frames are counted, and the cut found, from their headers."""
    fs, path = open_fs(uri)
    for last in scan_file(uri, payloads=False):
        pass
    half = next(row for row in scan_file(uri, payloads=False) if row[1] == last[1] // 2)
    with fs.open_input_file(path) as f, fs.open_output_stream(open_fs(target)[1]) as out:
        for block in blocks(f, half[2] + FRAME + half[3] // 2):
            out.write(block)


def file_tasks(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file), a row and a task for each file."""
    rows = spark.createDataFrame(list(enumerate(files)), "task int, file string")
    return rows.repartitionById(max(1, len(files)), F.col("task")).select("file")


_REPORTS = {"verify": "file string, exit_code int, is_segment boolean, sealed boolean, salvage boolean, records long", "repair": "file string, exit_code int, sealed_before boolean, sealed_after boolean, modified boolean, dry_run boolean, salvage_applied boolean, salvage_reason int, salvage_reason_str string, records_kept long, error string"}


def reports(spark: SparkSession, files: list[str], what: str = "verify", **options) -> DataFrame:
    """A row for each file, a task for each: verify or repair."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(verify_file if what == "verify" else lambda u: repair_file(u, **options))(u) for u in b["file"]])

    return file_tasks(spark, files).mapInPandas(go, _REPORTS[what])


def index_bytes(entries: list[tuple[int, int, int, int]], every: int, file_size: int) -> bytes:
    """The index file: 128 bytes of head, 32 for each (frame_index, offset, first_ts, type)."""
    times = [e[2] for e in entries if e[2]]
    head = bytes.fromhex("4649447876303031") + struct.pack("<BBIIIIQqqQ", 1, 0, 128, 32, 0, every, len(entries), times[0] if times else 0, times[-1] if times else 0, file_size) + bytes(32 + 32 + 6)
    return head + b"".join(struct.pack("<QQqII", a, b, c, d, 0) for a, b, c, d in entries)


def parse_index(b: bytes) -> tuple[dict, list[tuple]]:
    if b[:8] != bytes.fromhex("4649447876303031"):
        raise ValueError("not an index")
    _, _, _, size, _, every, n, first, last, file_size = struct.unpack_from("<BBIIIIQqqQ", b, 8)
    if size != 32 or n > 1 << 40 or len(b) < 128 + 32 * n:
        raise ValueError("a damaged index")
    return {"every_n": every, "entries": n, "first_ts": first, "last_ts": last, "file_size": file_size}, [struct.unpack_from("<QQqII", b, 128 + 32 * k)[:4] for k in range(n)]
