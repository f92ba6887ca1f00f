"""Decoders: from whole inputs (a key and their text or bytes) to records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

RAW, SNIFFED, MOST = 1 << 16, 2048, 1 << 24


def lines(inputs: DataFrame, text: str = "text") -> DataFrame:
    """(..., pos, record): cut at line feeds only, one carriage return before it dropped; empty lines are records, the end of the last line isn't one."""
    parts = F.split(F.col(text), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    kept = [c for c in inputs.columns if c != text]
    out = inputs.select(*kept, F.posexplode(parts).alias("pos", "record"))
    return out.withColumn("record", F.regexp_replace("record", "\r\\z", ""))


def ndjson(inputs: DataFrame, now_ns: int, text: str = "text") -> DataFrame:
    """Lines that aren't empty, with their time; mismatch: the line doesn't begin an object."""
    rows = lines(inputs, text).where(F.length("record") > 0)
    return rows.withColumn("mismatch", ~F.col("record").rlike(r"^[ \t\x0B\f\r]*\{")).withColumn("ts_ns", S.or_now(S.first_time(F.col("record")), now_ns))


def json_whole(inputs: DataFrame, now_ns: int, text: str = "text") -> DataFrame:
    return inputs.withColumnRenamed(text, "record").withColumn("ts_ns", S.or_now(S.first_time(F.col("record")), now_ns))


def split_csv(line: Column) -> Column:
    """Fields by commas outside quotes; quotes around a field go, doubled ones stay; a last empty field isn't one."""
    fields = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    fields = F.when(F.length(line) == 0, F.array().cast("array<string>")).when(line.endswith(","), F.slice(fields, F.lit(1), F.size(fields) - 1)).otherwise(fields)
    return F.transform(fields, lambda f: F.regexp_replace(f, r'^"((?:[^"]|"")*)"$', "$1"))


def csv(inputs: DataFrame, now_ns: int, key: str, text: str = "text") -> DataFrame:
    """Lines after each input's header, which isn't stored; mismatch: another number of fields. The time is in the first field whose name is a candidate, in any case; ISO first, then a number."""
    rows = lines(inputs, text)
    heads = rows.where("pos = 0").select(key, split_csv(F.col("record")).alias("_head"))
    names = F.transform("_head", lambda h: F.lower(S.trimmed(h)))
    at = F.coalesce(*(F.when(F.array_position(names, c) > 0, F.array_position(names, c)) for c in S.CANDIDATES))
    fields = split_csv(F.col("record"))
    value = F.try_element_at(fields, at.cast("int"))
    out = rows.where("pos > 0").join(heads, key)
    return out.withColumn("mismatch", F.size(fields) != F.size("_head")).withColumn("ts_ns", S.or_now(F.coalesce(S.rfc3339(value), S.unix_numeric(value)), now_ns)).drop("_head")


def raw(inputs: DataFrame, content: str, size: int = RAW) -> DataFrame:
    """(..., pos, length, chunk): the bytes in pieces of `size`."""
    b = F.col(content).cast("binary")
    kept = [c for c in inputs.columns if c != content]
    n = F.octet_length(b)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.substr(b, k * size + 1, F.lit(size)))
    out = inputs.where(n > 0).select(*kept, F.posexplode(cut).alias("pos", "chunk"))
    return out.select(*kept, "pos", F.octet_length("chunk").cast("long").alias("length"), "chunk")


def len4(inputs: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, pos, record, error): records after their length in four bytes, least first. A length beyond MOST or more than is left is an error; a cut length ends the input. Each input is one pass."""

    def run(batches):
        import struct

        import pandas as pd

        for b in batches:
            for k, data in zip(b[key], b[content]):
                rows, at, pos = [], 0, 0
                while at + 4 <= len(data or b""):
                    (n,) = struct.unpack_from("<I", data, at)
                    bad = n > MOST or at + 4 + n > len(data)
                    rows.append((k, pos, None if bad else data[at + 4 : at + 4 + n], bad))
                    if bad:
                        break
                    at, pos = at + 4 + n, pos + 1
                yield pd.DataFrame(rows, columns=[key, "pos", "record", "error"])

    return inputs.select(key, content).mapInPandas(run, f"{key} {dict(inputs.dtypes)[key]}, pos long, record binary, error boolean")


def sniff(content: Column) -> Column:
    """The format of an input from its first bytes; json is never found out."""
    b = F.substr(content.cast("binary"), F.lit(1), F.lit(SNIFFED))
    h = F.decode(b, "ISO-8859-1")
    n = lambda c: F.length(h) - F.length(F.replace(h, F.lit(c), F.lit("")))
    feeds, commas = n("\n"), n(",")
    braces = F.regexp_count(h, F.lit(r"(?:^|\n)[ \t\r]*[{\[]"))
    any_brace = F.contains(h, F.lit("{")) | F.contains(h, F.lit("["))
    odd = h.rlike("[\\x01-\\x08\\x0E-\\x1F]")
    first = S.from_little(F.substr(b, F.lit(1), F.lit(4)), 4)
    return (
        F.when(F.octet_length(b) == 0, "raw").when((feeds >= 3) & (braces >= 2), "ndjson").when((feeds >= 2) & (commas >= 3) & ~any_brace, "csv")
        .when((feeds >= 2) & ~odd, "lines").when((F.octet_length(b) >= 4) & (first >= 1) & (first < MOST), "len4").otherwise("raw")
    )


def fall_back(rows: DataFrame, key: str) -> DataFrame:
    """rows with the format each is kept in: raw from an input's first mismatch on."""
    first = rows.where("mismatch").groupBy(key).agg(F.min("pos").alias("_first"))
    return rows.join(first, key, "left").withColumn("kept_as", F.when(F.col("pos") >= F.col("_first"), "raw").otherwise("ndjson")).drop("_first")


def decode(inputs: DataFrame, fmt: str, now_ns: int, key: str, text: str = "text") -> DataFrame:
    """The records of inputs (key, text) in a format."""
    known = {
        "lines": lambda: lines(inputs, text), "ndjson": lambda: ndjson(inputs, now_ns, text), "lines+json": lambda: ndjson(inputs, now_ns, text), "json": lambda: json_whole(inputs, now_ns, text),
        "csv": lambda: csv(inputs, now_ns, key, text), "raw": lambda: raw(inputs, text), "len4": lambda: len4(inputs, key, text),
    }
    if fmt not in known:
        raise ValueError(f"unknown format: {fmt}")
    return known[fmt]()
