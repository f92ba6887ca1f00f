"""Byte sources: files, folders, standard input and sockets."""

from __future__ import annotations

import socket
import sys
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("stdin", "file", "dir", "tcp", "udp", "http", "sse", "ws", "serial")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): a row for each file of the path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_dir(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, content): the files right in a folder, hidden ones too, with their place in the order of the bytes of their names. A record that straddles files is whole when their bytes are joined in that order."""
    from ..operators.frames import Window

    names = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "content")
    order = names.select("path").withColumn("ordinal", F.row_number().over(Window.orderBy(F.encode("path", "UTF-8"))) - 1)  # a row for each file
    return names.join(F.broadcast(order), "path")


class Pushback:
    """A byte stream from which what was read can be put back, so that sniffing loses nothing."""

    def __init__(self, read):
        self.source, self.held = read, b""

    def read(self, n: int) -> bytes:
        if self.held:
            out, self.held = self.held[:n], self.held[n:]
            return out
        return self.source(n)

    def unread(self, b: bytes) -> None:
        self.held = b + self.held


def _address(detail: str) -> tuple[str, int]:
    host, _, port = detail.rpartition(":")
    return host or "0.0.0.0", int(port)


def tcp(detail: str, size: int = 1 << 16) -> Iterator[bytes]:
    """HOST:PORT connects; :PORT waits for one connection."""
    host, port = _address(detail)
    if detail.startswith(":"):
        with socket.create_server((host, port)) as server:
            conn, _ = server.accept()
    else:
        conn = socket.create_connection((host, port))
    with conn:
        while b := conn.recv(size):
            yield b


def udp(detail: str, idle: float = 0.1, bound: socket.socket | None = None) -> Iterator[bytes]:
    """A datagram is a record; it ends when none has come for `idle` seconds after the first."""
    with bound or socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        if not bound:
            s.bind(_address(detail))
        while True:
            try:
                yield s.recv(1 << 16)
                s.settimeout(idle)
            except TimeoutError:
                return


def http(url: str, size: int = 1 << 16) -> Iterator[bytes]:
    with urllib.request.urlopen(url) as r:  # noqa: S310
        while b := r.read(size):
            yield b


def sse(url: str) -> Iterator[bytes]:
    """The data of each event, its lines joined by line feeds."""
    data: list[bytes] = []
    rest = b""
    for b in http(url):
        *lines, rest = (rest + b).split(b"\n")
        for line in lines:
            line = line.rstrip(b"\r")
            if line.startswith(b"data:"):
                data.append(line[5:].removeprefix(b" "))
            elif not line and data:
                yield b"\n".join(data)
                data = []
    if data:
        yield b"\n".join(data)


def open_source(spark: SparkSession, kind: str, detail: str = "") -> DataFrame:
    """(path, content) of any source. Sockets and standard input are read by the driver, as they are one stream."""
    if kind == "file":
        return read_file(spark, detail)
    if kind == "dir":
        return read_dir(spark, detail).drop("ordinal")
    if kind == "serial":
        raise NotImplementedError("serial devices aren't supported")
    if kind == "ws":
        raise NotImplementedError("web sockets need a client library, which isn't there")
    if kind not in KINDS:
        raise ValueError(f"unknown source: {kind}")
    chunks = iter([sys.stdin.buffer.read()]) if kind == "stdin" else {"tcp": tcp, "udp": udp, "http": http, "sse": sse}[kind](detail)
    rows = [(f"{kind}:{detail}", b) for b in chunks] if kind in ("udp", "sse") else [(f"{kind}:{detail}", b"".join(chunks))]
    return spark.createDataFrame(rows, "path string, content binary")
