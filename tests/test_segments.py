"""Segments on disk: golden bytes, hashes, seals, damage and repair, and the command line."""

import json
import socket
import struct
import threading

import pytest
from pyspark.sql import functions as F

from strandlog import __main__ as cli
from strandlog.functions.blake3 import blake3, blake3_one
from strandlog.operators import frames as O
from strandlog.sources import inputs, segments
from strandlog.sources import seal as sealing
from strandlog.streaming import ingest


def test_blake3():
    pattern = bytes(k % 251 for k in range(4000))
    want = {
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030", 3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    }
    assert {n: d.hex() for n, d in zip(want, blake3([pattern[:n] for n in want]))} == want
    assert all(blake3_one(pattern[:n]) == blake3([pattern[:n]])[0] for n in (0, 1, 63, 64, 65, 128, 1000, 1024, 1025))
    assert blake3([b"abc"])[0].hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def make(path, payloads=(b"a", b"", b"c" * 3000, sealing.MAGIC, b"e"), seal=True):
    w = segments.Writer(str(path), 5)
    for k, p in enumerate(payloads):
        w.append(7, 100 + k, p)
    w.close(seal=seal, seed=bytes(32))
    return str(path)


def test_golden_bytes(tmp_path):
    data = open(make(tmp_path / "a.seg", [b"abc"], seal=False), "rb").read()
    assert data[:24] == bytes.fromhex("464c534876303031") + struct.pack("<IQI", 0, 5, 0)
    assert data[24:44] == struct.pack("<IIQI", 3, 7, 100, __import__("zlib").crc32(struct.pack("<IQ", 7, 100) + b"abc"))
    assert data[44:47] == b"abc" and data[47:55] == bytes(8) and data[55:] == blake3([data[8:24]])[0]
    rows = list(segments.scan_file(str(tmp_path / "a.seg")))
    assert rows[0][:6] == (str(tmp_path / "a.seg"), 0, 24, 3, 7, 100) and rows[-1][10] == segments.END


def test_frames_from_an_offset_come_in_batches(tmp_path, monkeypatch):
    path = make(tmp_path / "a.seg", [b"%d" % k for k in range(2500)])
    at = [r[2] for r in segments.scan_file(path, payloads=False)][10]
    got = list(segments.frames_from(path, at))
    assert [b.num_rows for b in got] == [1000, 1000, 490]
    assert [r["payload"] for b in got for r in b.to_pylist()] == [b"%d" % k for k in range(10, 2500)]
    assert [r["place"] for b in got for r in b.to_pylist()] == list(range(2490))
    monkeypatch.setattr(segments, "WEIGHT", 40)
    assert max(sum(len(r["payload"]) for r in b.to_pylist()) for b in segments.frames_from(path, at)) < 44


def test_index_bytes():
    head, entries = segments.parse_index(b := segments.index_bytes([(0, 24, 0, 7), (16, 999, 5, 7)], 16, 4321))
    assert len(b) == 128 + 64 and head == {"every_n": 16, "entries": 2, "first_ts": 5, "last_ts": 5, "file_size": 4321} and entries[1] == (16, 999, 5, 7)


def test_seal():
    public, signature = sealing.sign(b"k" * 32, b"message")
    assert sealing.check(public, signature, b"message") and not sealing.check(public, signature, b"massage")
    assert not sealing.check(public, signature[:32] + bytes(32), b"message")


@pytest.mark.parametrize("damage, exit_code, kept, reason", [
    (lambda b: b, 0, 5, 0), (lambda b: b[:-200], 1, 5, 4), (lambda b: b[:-190], 2, 5, 1),
    (lambda b: b.replace(b"c" * 10, b"c" * 9 + b"d", 1), 2, 2, 3),
    (lambda b: b[: 24 + 61 + 1 + 20] + b"\1" + b[24 + 61 + 1 + 21 :], 2, 1, 2), (lambda b: b[:-230], 2, 4, 1), (lambda b: b[:24], 1, 0, 5), (lambda b: b"X" + b[1:], 3, 0, 0), (lambda b: b[:5], 3, 0, 0),
])
def test_damage(tmp_path, damage, exit_code, kept, reason):
    data = open(make(tmp_path / "a.seg"), "rb").read()
    (tmp_path / "b.seg").write_bytes(damage(data))
    path = str(tmp_path / "b.seg")
    assert segments.verify_file(path)["exit_code"] == exit_code
    report = segments.repair_file(path, seed=bytes(32))
    assert (report["records_kept"], report["salvage_reason"]) == (kept, reason)
    if report["modified"]:
        again = segments.verify_file(path + ".repaired")
        assert (again["exit_code"], again["salvage"], again["records"]) == (0, True, kept)


def test_repair_copies_what_the_scan_has_checked(tmp_path, monkeypatch):
    """A head with other fields, as another writer may leave it, stays; no frame is hashed anew."""
    path, head = make(tmp_path / "a.seg", [b"%d" % k for k in range(50)]), struct.pack("<IQI", 9, 5, 0)
    tip, body = blake3([head])[0], b""
    rows = list(segments.scan_file(path))
    for r in rows[:-1]:
        frame = struct.pack("<IIQI", r[3], r[4], r[5], r[6]) + r[7]
        body, tip = body + frame + struct.pack("<Q", r[8]) + tip, blake3([frame + tip])[0]
    whole = segments.MAGIC + head + body
    (tmp_path / "b.seg").write_bytes(whole[:-3])
    monkeypatch.setattr(segments, "blake3_one", lambda b: pytest.fail("hashed anew"))
    report = segments.repair_file(str(tmp_path / "b.seg"), seed=bytes(32))
    assert (report["records_kept"], report["salvage_reason"], report["sealed_after"]) == (49, 1, True)
    got = (tmp_path / "b.seg.repaired").read_bytes()
    assert got[: -sealing.SIZE] == whole[: rows[49][2]] and sealing.parse(got[-sealing.SIZE :]).records == 49
    assert segments.verify_file(str(tmp_path / "b.seg.repaired"))["exit_code"] == 0


@pytest.mark.parametrize("bad", [0, 1, 2, 3, 4])
def test_end_of_a_scan_with_a_broken_chain(tmp_path, bad):
    """Whichever frame of a batch is the first bad one."""
    path = make(tmp_path / "a.seg")
    at = [r[2] for r in segments.scan_file(path)]
    data = bytearray(open(path, "rb").read())
    data[at[bad + 1] - 1] ^= 1
    open(path, "wb").write(data)
    for batch in (1, 2, 1000):
        rows = list(segments.scan_file(path, batch=batch))
        assert len(rows) == bad + 1 and (rows[-1][1], rows[-1][2], rows[-1][10]) == (bad, at[bad], segments.BAD_CHAIN)


@pytest.mark.parametrize("n", [2, 3, 50])
def test_cut_half(tmp_path, n):
    path = make(tmp_path / "a.seg", [b"abcd" * 9] * n)
    segments.cut_half(path, path + ".cut")
    *rows, last = segments.scan_file(path + ".cut")
    assert (len(rows), last[10]) == (n // 2, segments.CUT)


def test_each_segment_has_its_task(spark, tmp_path):
    f = O.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).withColumnRenamed("stream", "segment")
    got = segments.write(f, f"file://{tmp_path}/out").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len({r.task for r in got}) == 5
    files = segments.list_files(f"file://{tmp_path}/out")
    got = segments.reports(spark, files).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len({r.task for r in got}) == 5 and {r.exit_code for r in got} == {0}


def test_no_frame_is_lost_with_more_segments_than_tasks(spark, tmp_path):
    f = spark.range(3000).selectExpr("CAST(id % 700 AS string) AS segment", "id AS frame_index", "7L AS type", "id AS ts_ns", "CAST(id AS string) AS payload")
    f = f.unionByName(f.limit(5).withColumn("segment", F.lit(None).cast("string")))
    got = {r.segment: r.records for r in segments.write(f, f"file://{tmp_path}/out").collect()}
    assert len(got) == 701 and sum(got.values()) == 3005


def test_scan_and_spark(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    f = O.from_events(events).withColumnRenamed("stream", "segment")
    folder = f"file://{tmp_path}/out"
    assert segments.write(f, folder, created_ns=5).count() == 5
    assert segments.scan(spark, folder).count() == 1000
    files = segments.list_files(folder)
    data = bytearray(open(files[0].removeprefix("file://"), "rb").read())
    data[24 + 20 + 2] ^= 1
    open(files[0].removeprefix("file://"), "wb").write(data)
    codes = {r.file: r.exit_code for r in segments.reports(spark, files).collect()}
    assert codes[files[0]] == 2 and sum(codes.values()) == 2
    assert [r.records_kept for r in segments.reports(spark, files[:1], "repair", dry_run=True).collect()] == [0]
    assert segments.scan(spark, files[1], ends=True).where("rc <> 0").select("rc").first()[0] == segments.END


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text('{"ts":1731812563123}\n{"ts":1731812563124}\n')
    out = str(tmp_path / "o.seg")
    assert cli.main(["ingest", out, "from", "file", str(tmp_path / "in.txt"), "as", "ndjson"]) == 0
    assert cli.main(["verify", out]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["records"] == 5
    assert cli.main(["replay", out, "--data-only", "--with-ts", "--from-ts", "1731812563124000000"]) == 0
    assert capsys.readouterr().out == '1731812563124000000 {"ts":1731812563124}\n'
    assert cli.main(["export", out, "--data", "--limit=1"]) == 0
    assert cli.main(["info", out]) == 0
    assert cli.main(["index", out, "--every=2"]) == 0
    assert cli.main(["merge", str(tmp_path / "m.seg"), out, out]) == 0
    assert segments.verify_file(str(tmp_path / "m.seg"))["records"] == 10
    with pytest.raises(SystemExit) as e:
        cli.main(["replay"])
    assert e.value.code == 64


def test_sources(spark, tmp_path):
    for name, text in (("b", "2"), ("a", "1"), (".c", "3")):
        (tmp_path / name).write_text(text)
    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]

    def serve():
        conn, _ = server.accept()
        with conn:
            conn.sendall(b"x\ny")

    t = threading.Thread(target=serve)
    t.start()
    assert bytes(inputs.open_source(spark, "tcp", f"127.0.0.1:{port}").first()["content"]) == b"x\ny"
    t.join()
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    s.bind(("127.0.0.1", 0))
    c = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for b in (b"1", b"22"):
        c.sendto(b, s.getsockname())
    assert list(inputs.udp("", bound=s)) == [b"1", b"22"]
    for kind, error in (("serial", NotImplementedError), ("ws", NotImplementedError), ("odd", ValueError)):
        with pytest.raises(error):
            inputs.open_source(spark, kind)
    p = inputs.Pushback(lambda n: b"rest"[:n])
    p.unread(b"ab")
    assert (p.read(1), p.read(5), p.read(5)) == (b"a", b"b", b"rest")


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.txt").write_text('{"ts":1}\n{"ts":2}\n')
    f = lambda: ingest.lines_stream(spark, str(inbox), 9)
    ingest.run(f(), str(tmp_path / "out"), str(tmp_path / "ck"))
    (inbox / "2.txt").write_text('{"x":1}\r\n')
    ingest.run(f(), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.ts_ns for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [9, 1000000, 2000000]
    rotated = ingest.rotate(f().withColumn("key", F.lit("k")), "key", records=2)
    rotated.writeStream.outputMode("update").format("memory").queryName("rotated").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    last = spark.table("rotated").orderBy(F.desc("segment")).first()
    assert (last.segment, last.records) == (1, 1)
