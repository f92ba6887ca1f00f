"""Scalars and decoders against tables of inputs and wanted results."""

import pytest
from pyspark.sql import functions as F

from strandlog.__main__ import ingest_words
from strandlog.functions import scalars as S
from strandlog.sources import decoders as D

NOW = 1700000000000000000


def one(spark, expression, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items()) or [F.lit(1).alias("x")])
    return row.select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("text, want", [
    ("2025-11-17T12:23:45Z", 1763382225000000000), ("2025-11-17T12:23:45+02:00", 1763375025000000000), ("2025-11-17T12:23:45.5-01:30", 1763387625500000000),
    ("2025-11-17T12:23:45.1234567899Z", 1763382225123456789), ("2025-11-17", None), ("2025-13-17T12:23:45Z", None), ("", None),
])
def test_rfc3339(spark, text, want):
    assert one(spark, S.rfc3339(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("1731812563123", 1731812563123000000), ("1731812563123456789", 1731812563123456789), (" 12.9", 12000000), ("-5", -5000000), ("x", None), ("99999999999999999999", None)])
def test_numeric(spark, text, want):
    assert one(spark, S.unix_numeric(F.col("t")), t=text) == want


@pytest.mark.parametrize("json, want", [
    ('{"ts":1731812563123456789}', 1731812563123456789), ('{"ts":"2025-11-17T12:23:45Z"}', 1763382225000000000), ('{"ts":"1731812563123"}', None),
    ('{"ts":null,"created_at":1731812563123}', 1731812563123000000), ('{"ts":"2025-11-17T12:23:45', None), ('{"a":{"time" : 7}}', 7000000), ('{}', None),
])
def test_first_time(spark, json, want):
    assert one(spark, S.first_time(F.col("t")), t=json) == want


@pytest.mark.parametrize("payload, want", [("", "CONTROL"), (" \t\n", "CONTROL"), ('{"schema_version":1,"format":"x"}', "CONTROL"), ('{"run_id":1,"status":2}', "CONTROL"), ('{"run_id":1}', "DATA"), ("abc", "DATA"), ('{"schema_version":1}', "DATA")])
def test_kind(spark, payload, want):
    assert one(spark, S.kind(F.col("t")), t=payload) == want


def test_rendering(spark):
    assert one(spark, S.snippet(F.col("t")), t="a\nb\x01\t\x7f") == "a b\\x01\t\\x7f"
    assert one(spark, S.human(F.lit(0).cast("long"))) == "NONE"
    assert one(spark, S.human(F.lit(1763382225123456789))) == "2025-11-17 12:23:45.123"
    assert one(spark, S.json_text(F.col("t")), t='a"\\\n\x01') == '"a\\"\\\\\\n\\u0001"'
    assert one(spark, S.trimmed(F.col("t")), t="\x0b a b\r\n") == "a b"


def test_checksums(spark):
    assert one(spark, F.crc32(F.lit("123456789").cast("binary"))) == 0xCBF43926
    assert one(spark, S.frame_crc(F.lit(7), F.lit(123), F.lit("abc"))) == 1538539930
    for label, want in (("lines_v1", 3191346596), ("ndjson_v1", 670853987), ("json_v1", 949857109), ("csv_v1", 1452202889), ("bytes_v1", 4000381740), ("é", S.fnv1a_of("é"))):
        assert one(spark, S.fnv1a(F.col("t")), t=label) == S.fnv1a_of(label) == want
    assert one(spark, S.from_little(S.little(F.lit(0x80FF01), 4), 4)) == 0x80FF01


def test_literals():
    assert [S.literal(*x) for x in (("64M", "size"), ("1k", "size"), ("off", "size"), ("2h", "time"), ("90s", "time"), ("5m", "time"), ("10k", "records"), ("2m", "records"))] == [67108864, 1024, 0, 7200, 90, 300, 10000, 2000000]
    with pytest.raises(ValueError):
        S.literal("5x", "size")
    assert S.rotate_clause("size=64M,time=1h") == {"size": 67108864, "time": 3600, "records": 0}
    assert S.rotate_clause("500")["records"] == 500
    with pytest.raises(ValueError):
        S.rotate_clause("bogus=1")


@pytest.mark.parametrize("text, want", [("a\r\n\r\nb", ["a", "", "b"]), ("a\rb\n", ["a\rb"]), ("one\ntwo\n", ["one", "two"]), ("", [])])
def test_lines(spark, text, want):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    assert [r.record for r in D.lines(df).orderBy("pos").collect()] == want


def test_ndjson_and_csv(spark):
    df = spark.createDataFrame([(1, '{"ts":1731812563123456789}\n\n{"time":1731812563123}\n  \n[1]\n{"ts":0}\n')], "k int, text string")
    got = [(r.mismatch, r.ts_ns) for r in D.ndjson(df, NOW).orderBy("pos").collect()]
    assert got == [(False, 1731812563123456789), (False, 1731812563123000000), (True, NOW), (True, NOW), (False, NOW)]
    df = spark.createDataFrame([(1, "id,TS\n1,1731812563123\n2,2025-11-17T12:23:45Z\n3\n")], "k int, text string")
    got = [(r.record, r.mismatch, r.ts_ns) for r in D.csv(df, NOW, "k").orderBy("pos").collect()]
    assert got == [("1,1731812563123", False, 1731812563123000000), ("2,2025-11-17T12:23:45Z", False, 1763382225000000000), ("3", True, NOW)]
    assert one(spark, D.split_csv(F.col("t")), t="1,2,") == ["1", "2"]
    assert one(spark, D.split_csv(F.col("t")), t='"x,y",2,"a""b"') == ["x,y", "2", 'a""b']


@pytest.mark.parametrize("data, want", [(b'{"a":1}\n' * 3, "ndjson"), (b"a,b\n1,2\n3,4\n", "csv"), (b"x\ny\n", "lines"), (bytes.fromhex("03000000616263"), "len4"), (b"", "raw"), (b'{"a":1}', "raw"), (b"x\ny\n\x01", "raw")])
def test_sniff(spark, data, want):
    assert one(spark, D.sniff(F.col("t")), t=bytearray(data)) == want


def test_len4_and_raw(spark):
    df = spark.createDataFrame([(1, bytearray.fromhex("0300000061626300000000")), (2, bytearray.fromhex("050000006162")), (3, bytearray.fromhex("0300"))], "k int, content binary")
    assert [(r.k, bytes(r.record) if r.record is not None else None, r.error) for r in D.len4(df, "k").orderBy("k", "pos").collect()] == [(1, b"abc", False), (1, b"", False), (2, None, True)]
    df = spark.createDataFrame([(1, bytearray(65537))], "k int, content binary")
    assert [r.length for r in D.raw(df, "content").orderBy("pos").collect()] == [65536, 1]


def test_grammar():
    got = ingest_words("out.seg from file in.txt as ndjson type mine rotate records=5".split())
    assert got["label"] == "mine" and got["rotate"]["records"] == 5 and got["detail"] == "in.txt"
    for bad in ("out.seg", "out.seg from nowhere as raw", "out.seg from file x as odd", "out.seg from stdin as raw type"):
        with pytest.raises(ValueError):
            ingest_words(bad.split())
