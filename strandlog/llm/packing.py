"""op8: packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, documents, ranked, ship, staged
from .word_bpe import encoder, vocabulary

LENGTH, END = 2048, 1


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut at every `length` ids."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        import numpy as np

        last = np.array([end], "<u4").tobytes()
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder(path).encode([t or "" for t in b.column(1).to_pylist()])):
                ids += last
                for at in range(0, len(ids), 4 * length):
                    own = ids[at : at + 4 * length]
                    for to, x in zip(rows, (doc_id, at // 4, len(own) // 4, crc32(own), len(ids) // 4)):
                        to.append(x)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each is packed, for a histogram of lengths.

    Lengths go longest first, each into the packs with the most room that take it, and into new ones only if none does. Packs
    of one pattern are one entry with a count: the work follows the number of lengths and patterns, not of pieces.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            room = max((r for r, packs in open_.items() if packs), default=0)
            if room < n:
                open_[length - n].append(((n,), left))
                break
            pattern, count = open_[room].pop()
            taken = min(left, count)
            if count > taken:
                open_[room].append((pattern, count - taken))
            open_[room - n].append((pattern + (n,), taken))
            left -= taken
    return sorted(p for packs in open_.values() for p in packs)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, sequence, offset): the pieces of a length with ranks from low to below high lie at the offset of sequences from `sequence` on."""
    out, next_rank, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        at = 0
        for n in pattern:
            out.append((n, next_rank[n], next_rank[n] + count, sequence, at))
            next_rank[n] += count
            at += n
        sequence += count
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece of the documents (doc_id, text; further columns don't matter), by the contract of op8.

    A document longer than a sequence is cut at every `length` ids; what remains is one piece. Each id lies in exactly one
    piece. The histogram of piece lengths, at most `length` rows, is all that comes to the driver; the patterns packed from
    it go back as ranges of ranks (a few for each length; broadcast) and are joined to the pieces by their rank within their
    length. Sequences shorter than `length` are to be padded up to it. A null text counts as empty: only the end id. An
    empty table gives no rows; repeated rows are packed each.
    """
    spark = docs.sparkSession
    own = staged(pieces(docs, path or vocabulary("word_bpe_49k.json"), length, end), "pieces")
    histogram = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = spark.createDataFrame(slots(shortest_pack_first(histogram, length)), "length long, low long, high long, sequence long, offset long")
    numbered = ranked(own, "length", ["doc_id", "start"], "rank", buckets(spark))
    placed = numbered.join(F.broadcast(at), "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(sequence_id, ids array<int>): the sequences themselves, without padding; docs are encoded once more."""
    path = path or vocabulary("word_bpe_49k.json")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for doc_id, ids in zip(b.column(0), encoder(path).encode([t or "" for t in b.column(1).to_pylist()])):
                all_ids = np.append(np.frombuffer(ids, "<u4"), end)
                starts = list(range(0, len(all_ids), length))
                yield pa.record_batch([pa.array([doc_id.as_py()] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array([all_ids[s : s + length].tolist() for s in starts], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    cut = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, ids array<int>")
    joined = packed.select("doc_id", "start", "sequence_id", "offset").join(cut, ["doc_id", "start"])
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
