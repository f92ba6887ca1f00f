"""op6: token ids in a content-addressed store of chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, running_total, ship, staged
from .word_bpe import encoder, vocabulary

END = 2
#: A chunk ends where the rolling hash over WINDOW ids has BITS zero bits (512 ids on average), but has LEAST ids at least and MOST at most.
WINDOW, BITS, LEAST, MOST = 8, 9, 128, 2048
#: Digests to a node of the manifest's tree above the documents, and ids to its lowest nodes.
FAN, LEAF = 256, 1 << 17


def cuts(ids) -> list[int]:
    """The ends of the chunks of an id array. They follow from the ids nearby, so a change in a document changes few chunks."""
    import numpy as np

    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)  # spread each id over 64 bits
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h, k = x, 1
    while k < WINDOW:  # of k ids, then of 2 k
        h, x, k = h.copy(), h, 2 * k
        h[k // 2 :] += x[: -(k // 2)] << np.uint64(k // 2)
    ends = (np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << BITS) - 1) == 0) + 1).tolist()
    out, at = [], 0
    for e in [*ends, n]:
        while e - at > MOST:
            at += MOST
            out.append(at)
        if e - at >= LEAST or e == n > at:
            out.append(e)
            at = e
    return out


def merkle(digests: list[bytes]) -> bytes:
    """The root of the binary tree over digests; an odd one goes up as it is."""
    while len(digests) > 1:
        digests = [sha256(b"\1" + digests[k] + digests[k + 1]).digest() if k + 1 < len(digests) else digests[k] for k in range(0, len(digests), 2)]
    return digests[0] if digests else sha256(b"").digest()


@cache
def _shift(n_bytes: int) -> tuple[int, ...]:
    """The GF(2) matrix, by columns, that carries a CRC-32 over n_bytes of zeros."""
    if n_bytes == 0:
        return tuple(1 << k for k in range(32))
    if n_bytes == 1:
        one = []
        for k in range(32):
            v = 1 << k
            for _ in range(8):
                v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
            one.append(v)
        return tuple(one)
    half = _shift(n_bytes // 2)
    twice = tuple(_carry(half, v) for v in half)
    return tuple(_carry(_shift(1), v) for v in twice) if n_bytes % 2 else twice


def _carry(matrix: tuple[int, ...], v: int) -> int:
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= matrix[k]
        v >>= 1
        k += 1
    return out


def crc_join(a: int, b: int, n_bytes: int) -> int:
    """The CRC-32 of two parts one after the other, from the CRC-32 of each and the length of the second."""
    return _carry(_shift(n_bytes), a) ^ b


_ROWS = "kind string, key binary, doc_id long, n long, payload binary"


def _chunked(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Rows of two kinds: `chunk` (key: SHA-256 of the ids, n ids, payload: them compressed) and `recipe` (key: of its own, n ids, payload: the digests of its chunks in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard
        from pyspark import TaskContext

        last, squeeze = np.array([end], "<u4").tobytes(), zstandard.ZstdCompressor(level=1)
        part, count = TaskContext.get().partitionId(), 0  # the same again if the task is repeated
        for b in batches:
            seen: set[bytes] = set()
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder(path).encode([t or "" for t in b.column(1).to_pylist()])):
                ids += last
                x, at, recipe = np.frombuffer(ids, "<u4"), 0, []
                for e in cuts(x):
                    own = ids[4 * at : 4 * e]
                    recipe.append(digest := sha256(own).digest())
                    if digest not in seen:
                        seen.add(digest)
                        thin = x[at:e].astype("<u2").tobytes() if x[at:e].max() < 1 << 16 else own
                        for to, v in zip(rows, ("chunk", digest, None, e - at, squeeze.compress(thin))):
                            to.append(v)
                    at = e
                for to, v in zip(rows, ("recipe", b"%d-%d" % (part, count), doc_id, len(x), b"".join(recipe))):
                    to.append(v)
                count += 1
                if len(rows[0]) > 5000:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "key", "doc_id", "n", "payload"])
                    rows = ([], [], [], [], [])
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "key", "doc_id", "n", "payload"])

    return docs.select("doc_id", "text").mapInArrow(run, _ROWS)


def unpack(payload: bytes, n: int) -> bytes:
    """A chunk's ids as little-endian unsigned 32-bit integers."""
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    return raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _tree(leaves: DataFrame) -> bytes:
    """The root over (start, root) of all documents: nodes are the SHA-256 of their children in order, FAN of them or, lowest, the documents of LEAF ids; each id is a document's at most, so no node has more."""
    nodes = leaves.groupBy(F.floor(F.col("start") / LEAF).alias("node")).agg(F.array_sort(F.collect_list(F.struct("start", "root"))).alias("c"))
    while True:
        joined = F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["root"]))
        nodes = staged(nodes.select("node", F.unhex(F.sha2(joined, 256)).alias("root")), "nodes")
        n = nodes.count()
        if n <= 1:
            return bytes(nodes.first()["root"]) if n else sha256(b"").digest()
        nodes = nodes.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("start"), "root"))).alias("c")).withColumnRenamed("up", "node")


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> bytes:
    """Write the ids of docs (doc_id, text), each document ended by the end id, as a store in folder; returns the manifest's root.

    folder/data/kind=chunk has each distinct chunk once, named by its digest: one exchange by digest keeps one copy, after
    tasks have dropped their own copies. folder/manifest has, in ascending order of doc_id, each document's place in the
    stream of all ids, its number of ids, its recipe (the digests of its chunks) and the Merkle root of these. Null texts
    count as empty; a repeated doc_id has a row each; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = _chunked(docs, path or vocabulary("word_bpe_49k.json"), end)
    rows.dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "none").parquet(f"{folder}/data")

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("root", pa.array([merkle(_digests(r)) for r in b.column(3).to_pylist()], pa.binary()))

    recipes = spark.read.schema("kind string, " + _ROWS.split(", ", 1)[1]).parquet(f"{folder}/data").where("kind = 'recipe'").select("doc_id", "key", "n", F.col("payload").alias("recipe"))
    placed = running_total(recipes, ["doc_id", "key"], "n", "start").select("doc_id", "start", "n", "recipe")
    manifest = placed.mapInArrow(root, "doc_id long, start long, n long, recipe binary, root binary")
    manifest.repartitionByRange("start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{folder}/manifest")
    return _tree(spark.read.parquet(f"{folder}/manifest").select("start", "root"))


def _digests(recipe: bytes) -> list[bytes]:
    return [recipe[k : k + 32] for k in range(0, len(recipe), 32)]


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, payload) of the store's chunks."""
    data = spark.read.schema("kind string, " + _ROWS.split(", ", 1)[1]).parquet(f"{folder}/data")
    return data.where("kind = 'chunk'").select(F.col("key").alias("digest"), "n", "payload")


def read(spark: SparkSession, folder: str, root: bytes | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the store's files, each chunk read once and nothing else moved.

    Every chunk's ids are hashed and held against its name, every recipe against its document's Merkle root, and the documents
    against the manifest's root; each failure raises, a missing chunk too. A document's CRC-32 is put together from those of
    its chunks.
    """
    ship(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    if root is not None and _tree(manifest.select("start", "root")) != root:
        raise ValueError("the manifest doesn't match its root")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for b in batches:
            crcs = []
            for digest, n, payload in zip(*(b.column(k).to_pylist() for k in range(3))):
                ids = unpack(payload, n)
                if len(ids) != 4 * n or sha256(ids).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                crcs.append(crc32(ids))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for n, recipe, root, parts in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
                own, crc = _digests(recipe), 0
                if merkle(own) != root:
                    raise ValueError("a recipe doesn't match its root")
                if len(parts or ()) != len(own) or sum(p["n"] for p in parts or ()) != n:
                    raise ValueError("a document lacks chunks")
                for p in parts or ():
                    crc = crc_join(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    known = chunks(spark, folder).mapInArrow(check, "digest binary, n long, crc long")
    listed = manifest.select("start", F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("recipe") / 32 - 1).cast("int")), lambda k: F.col("recipe").substr(k * 32 + 1, F.lit(32)))).alias("pos", "digest"))
    parts = listed.join(known, "digest").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))
    whole = manifest.join(parts, "start", "left").select("doc_id", "start", "n", "recipe", "root", "parts")
    return whole.mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<int>) of the documents whose doc_id is in wanted (doc_id), put together from the chunks."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            out = [np.concatenate([np.frombuffer(unpack(p["payload"], p["n"]), "<u4") for p in ps]).tolist() for ps in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    manifest = spark.read.parquet(f"{folder}/manifest").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    listed = manifest.select("doc_id", "start", F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("recipe") / 32 - 1).cast("int")), lambda k: F.col("recipe").substr(k * 32 + 1, F.lit(32)))).alias("pos", "digest"))
    parts = listed.join(chunks(spark, folder), "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "payload"))).alias("parts"))
    return parts.mapInArrow(run, "doc_id long, start long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "store")
    root = write(documents(spark, sf_dir), folder)
    return read(spark, folder, root)
