"""op3: shards of near equal bytes by histogram sort."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, documents, ranked, staged, text_of

SHARDS = 24
#: A splitter may be so far from its target, as a share of a shard's mean bytes.
TOLERANCE = 0.001
#: Bits of the key that each round of probes adds: 2 ** BITS cells in each interval that is still open.
BITS = 10


def splitters(groups: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """For each target, ascending, a key such that the bytes of the groups (key long, bytes) below it are the target, as near as keys allow.

    Each round counts the exact bytes in the cells of the intervals that hold an unmet target, at most 2 ** BITS cells for
    each, with one aggregation: only those counts come to the driver. A target is met if an edge of its cell is within the
    tolerance or the cell is one key.
    """
    found: dict[int, int] = {}
    open_: dict[int, float] = {0: 0.0}  # interval, by its leading bits, to the bytes below it
    holds = {0: list(range(len(targets)))}
    shift = 64
    while holds:
        was, shift = shift, max(0, shift - BITS)
        keys = groups if was == 64 else groups.where(F.shiftright("key", was).isin([int(x) for x in holds]))
        counts: dict[int, dict[int, int]] = {}
        for r in keys.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("bytes").alias("bytes")).collect():
            counts.setdefault(0 if was == 64 else r["cell"] >> (was - shift), {})[r["cell"]] = r["bytes"]
        after: dict[int, list[int]] = {}
        below: dict[int, float] = {}
        for interval, wanted in holds.items():
            low, cells = open_[interval], sorted(counts.get(interval, {}).items())
            for t in wanted:
                at, edge = low, None
                for cell, n in cells:
                    if at + n >= targets[t]:
                        near, far = targets[t] - at, at + n - targets[t]
                        if min(near, far) <= tolerance or shift == 0:
                            edge = cell if near <= far else cell + 1
                        else:
                            after.setdefault(cell, []).append(t)
                            below[cell] = at
                        break
                    at += n
                else:
                    edge = (cells[-1][0] + 1) if cells else 1 << (63 - shift)
                if edge is not None:
                    found[t] = edge << shift
        holds, open_ = after, below
    return [found[t] for t in range(len(targets))]


def _levels(held: list[int], light: int) -> list[float]:
    """How many light bytes each shard gets, so that the fullest is as empty as can be."""
    level, rest, n = 0.0, float(light), 0
    order = sorted(held)
    for n in range(1, len(order) + 1):
        level = (rest + sum(order[:n])) / n
        if n == len(order) or level <= order[n]:
            break
    return [max(0.0, level - h) for h in held]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row of docs (doc_id, text; further columns don't matter) with its shard, 0 to shards - 1, and its slot there.

    Law `bytes`: each shard's bytes are within about twice the tolerance of equal. Rows are sorted by the hash of the text, so
    equal texts share a key and thereby a shard; a null text counts as empty. Groups of more bytes than the tolerance (at
    most shards / tolerance of them) are dealt out first, largest to the emptiest shard; splitters then cut the rest to fill
    each shard up. A group larger than a shard is cut by the hash of doc_id, or the law couldn't hold. Slots go from 0
    without a gap in the order of (hash of doc_id, doc_id). An empty table gives no rows; repeated rows get a slot each.
    """
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = staged(rows, "rows")
    sizes = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = [r["key"] for r in sizes.where(F.col("bytes") > max(1.0, total / shards)).collect()]  # fewer than shards
    if large:
        apart = F.xxhash64("key", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 14)))
        rows = rows.withColumn("key", F.when(F.col("key").isin(large), apart).otherwise(F.col("key")))
        sizes = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = staged(sizes, "groups")
    most = max(1.0, tolerance * total / shards)
    heavy = sorted(((r["bytes"], r["key"]) for r in groups.where(F.col("bytes") > most).collect()), reverse=True)  # at most shards / tolerance
    held, of, heap = [0] * shards, [], [(0, s) for s in range(shards)]
    for n, key in heavy:
        at, s = heapq.heappop(heap)
        held[s] = at + n
        of.append((key, s))
        heapq.heappush(heap, (held[s], s))
    light = groups.where(F.col("bytes") <= most)
    widths = _levels(held, total - sum(held))
    targets = [sum(widths[: s + 1]) for s in range(shards - 1)]
    place = F.lit(0)
    for edge in splitters(light, targets, most) if total else []:
        if edge < 1 << 63:  # no key reaches a larger one
            place = place + (F.col("key") >= max(edge, -(1 << 63))).cast("int")
    dealt = spark.createDataFrame(of, "key long, heavy_shard int")
    rows = rows.join(F.broadcast(dealt), "key", "left").withColumn("shard", F.coalesce("heavy_shard", place).cast("int"))
    out = ranked(rows.select("doc_id", "size", "text_crc32", "shard"), "shard", ["doc_id"], "slot", buckets(spark))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
