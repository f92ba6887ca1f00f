"""Frames as DataFrames: (frame_index, ts_ns, type, length, payload) and what can be asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Bytes of a frame besides its payload, and of a segment's head.
OVERHEAD, HEAD = 60, 24


def nanoseconds(ts: str) -> Column:
    """Nanoseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) * 1000")


def from_events(events: DataFrame) -> DataFrame:
    """Events as frames of NDJSON records, in the order of event_id; ts is kept so that bounds on it reach the Parquet scan."""
    return events.select(
        F.col("event_id").alias("frame_index"), nanoseconds("ts").alias("ts_ns"), F.lit(S.fnv1a_of("ndjson_v1")).alias("type"),
        F.octet_length("props").cast("long").alias("length"), F.col("props").alias("payload"), "ts", F.col("event_type").alias("stream"),
    )


def _at(ns: int, up: bool) -> Column:
    us = -(-ns // 1000) if up else ns // 1000
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {us // 10**6}.{us % 10**6:06d})")


def replay(frames: DataFrame, from_ts: str | int | None = None, to_ts: str | int | None = None, data_only: bool = False, limit: int = 0, order: tuple[str, ...] = ("frame_index",)) -> DataFrame:
    """Frames in order whose time is within both bounds, these included; data frames only; the first `limit` after all filters (0: all).

    Bounds also go on the column ts, where there is one, in its own type: those reach the scan's statistics.
    """
    if from_ts is not None:
        low = S.parse_time(from_ts)
        frames = frames.where(F.col("ts_ns") >= low)
        frames = frames.where(F.col("ts") >= _at(low, True)) if "ts" in frames.columns else frames
    if to_ts is not None:
        high = S.parse_time(to_ts)
        frames = frames.where(F.col("ts_ns") <= high)
        frames = frames.where(F.col("ts") <= _at(high, False)) if "ts" in frames.columns else frames
    if data_only:
        frames = frames.where(~S.is_control(F.col("payload")))
    return frames.orderBy(*order).limit(limit) if limit else frames


def human_rows(frames: DataFrame, cap: int | None = S.SNIPPET) -> DataFrame:
    return frames.select("frame_index", S.kind(F.col("payload")).alias("kind"), S.human(F.col("ts_ns")).alias("ts"), "length", S.snippet(F.col("payload"), cap).alias("snippet"))


def summary(frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by kind and the span of the times above 0."""
    data, at = ~S.is_control(F.col("payload")), F.when(F.col("ts_ns") > 0, F.col("ts_ns"))
    return frames.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(data).alias("data"), F.count_if(~data).alias("control"),
        F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), ((F.max(at) - F.min(at)) / 1e9).alias("span_seconds"),
    )


def info(frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Records, times of the first and last frame in file order, bytes, and floor of the mean frame size."""
    size = F.sum(F.col("length") + OVERHEAD)
    return frames.groupBy(*by).agg(
        F.count("*").alias("records"), F.min_by("ts_ns", "frame_index").alias("first_ts"), F.max_by("ts_ns", "frame_index").alias("last_ts"),
        (size + HEAD).alias("file_bytes"), F.floor(size / F.count("*")).alias("avg_frame_bytes"),
    )


def counters(frames: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return frames.groupBy(*by).agg(F.count("*").alias("records"), F.sum("length").alias("payload_bytes"), F.max_by("ts_ns", "frame_index").alias("last_ts"))


def ranges(df: DataFrame, key: str, n: int = 64) -> Column:
    """The number of the range, of about n with as many rows each, in which the key lies; from quantiles, so the same whenever it is computed."""
    edges = sorted(set(df.approxQuantile(key, [k / n for k in range(1, n)], 0.25 / n)))
    out = F.lit(0)
    for e in edges:
        out = out + (F.col(key) > F.lit(int(e))).cast("int")
    return out


def numbered(df: DataFrame, key: str, by: tuple[str, ...] = (), out: str = "position", total: str | None = None) -> DataFrame:
    """df with its place, from 0, in the order of key, in each group `by`: within ranges first, then carried on by a row for each range and group. With `total`, also the sum of that column over the rows before."""
    df = df.withColumn("_range", ranges(df, key))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by, "_range").agg(F.count("*").alias("_n"), *([F.sum(total).alias("_s")] if total else []))
    counts = counts.select(*by, "_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ["_n"] + ["_s"] * bool(total)))
    within = Window.partitionBy(*by, "_range").orderBy(key)
    df = df.withColumn("_k", F.row_number().over(within) - 1)
    if total:
        df = df.withColumn("_t", F.coalesce(F.sum(total).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.join(counts, [*by, "_range"]).withColumn(out, (F.col("_n0") + F.col("_k")).cast("long"))
    if total:
        df = df.withColumn(f"{total}_before", (F.col("_s0") + F.col("_t")).cast("long"))
    return df.drop("_range", "_k", "_t", "_n0", "_s0")


def layout(frames: DataFrame) -> DataFrame:
    """Each frame's offset in its file."""
    placed = numbered(frames.withColumn("_size", F.col("length") + OVERHEAD), "frame_index", total="_size")
    return placed.withColumn("file_offset", F.col("_size_before") + HEAD).drop("_size", "_size_before", "position")


def index(frames: DataFrame, every: int = 16) -> DataFrame:
    """The sparse index: each every-th frame; and, of the frames up to the next, the least and largest time and the number, by which a block can be passed over safely whatever the order of times."""
    placed = layout(frames).withColumn("block", F.floor(F.col("frame_index") / max(1, every)))
    return placed.groupBy("block").agg(
        F.min("frame_index").alias("frame_index"), F.min("file_offset").alias("offset"), F.min_by("ts_ns", "frame_index").alias("first_ts"),
        F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"), F.count("*").alias("n_frames"),
    ).drop("block")


def lookup_time(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (ts) the entry with the largest first_ts at most it, the last such one; the first entry for an earlier probe.

    A union in the order of time, by ranges; each range's last entry is carried on to the next.
    """
    e = entries.select(F.col("first_ts").alias("ts"), F.lit(0).alias("probe"), F.struct("first_ts", "frame_index", "offset").alias("e"))
    both = e.unionByName(probes.select("ts", F.lit(1).alias("probe"), F.lit(None).cast(e.schema["e"].dataType).alias("e")))
    both = both.withColumn("_range", ranges(entries.select(F.col("first_ts").alias("ts")), "ts"))
    ends = both.groupBy("_range").agg(F.max("e").alias("_end"))
    ends = ends.select("_range", F.max("_end").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))  # a row for each range
    within = Window.partitionBy("_range").orderBy("ts", "probe").rowsBetween(Window.unboundedPreceding, 0)
    first = entries.agg(F.min(F.struct("first_ts", "frame_index", "offset")).alias("_first"))
    found = both.withColumn("_own", F.max("e").over(within)).where("probe = 1").join(F.broadcast(ends), "_range").crossJoin(F.broadcast(first))  # one row
    hit = F.coalesce("_own", "_carried", "_first")
    return found.select("ts", hit["first_ts"].alias("first_ts"), hit["frame_index"].alias("frame_index"), hit["offset"].alias("offset"))


def replay_indexed(frames: DataFrame, entries: DataFrame, every: int, from_ts: str | int) -> DataFrame:
    """Replay from a time through the index: only blocks whose largest time reaches it are read. Equal to the full scan."""
    low = S.parse_time(from_ts)
    blocks = entries.where(F.col("max_ts") >= low).select((F.col("frame_index") / every).cast("long").alias("_block"))
    return replay(frames.withColumn("_block", F.floor(F.col("frame_index") / every)).join(blocks, "_block", "left_semi").drop("_block"), from_ts)


def rotate_records(frames: DataFrame, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    return numbered(frames, "frame_index", by).withColumn("segment", F.floor(F.col("position") / most)).drop("position")


def rotate_time(frames: DataFrame, seconds: int, by: tuple[str, ...]) -> DataFrame:
    """A new segment at each full period since the stream's first frame."""
    first = frames.groupBy(*by).agg(F.min("ts_ns").alias("_first"))
    return frames.join(first, list(by)).withColumn("segment", S.whole(F.col("ts_ns") - F.col("_first"), seconds * 10**9)).drop("_first")


def rotate_size(frames: DataFrame, most: int, by: str) -> DataFrame:
    """(by, frame_index, segment): a segment ends before the frame that would take its payload bytes over `most`. Each stream is one fold in order, which its definition makes serial; streams run side by side, and a stream's rows go through in batches."""

    def run(batches):
        import pandas as pd

        stream, segment, held = None, 0, 0
        for b in batches:
            out = []
            for s, n in zip(b[by], b["length"]):
                if s != stream:
                    stream, segment, held = s, 0, 0
                if held and held + n > most:
                    segment, held = segment + 1, 0
                held += n
                out.append(segment)
            yield pd.DataFrame({by: b[by], "frame_index": b["frame_index"], "segment": out})

    slim = frames.select(by, "frame_index", "length").repartition(by).sortWithinPartitions(by, "frame_index")
    return slim.mapInPandas(run, f"{by} {dict(frames.dtypes)[by]}, frame_index long, segment long")


def probe(files: DataFrame) -> DataFrame:
    """For each input (path): the time of its first data frame and its frames."""
    data = F.when(~S.is_control(F.col("payload")), F.struct("frame_index", "ts_ns"))
    return files.groupBy("path").agg(F.min(data)["ts_ns"].alias("first_ts"), F.count("*").alias("frames"))


def file_order(probes: DataFrame) -> DataFrame:
    """probes (path, first_ts, created_ns, arg) with their rank: by first time; those without one after, by creation; ties as given. A row for each file."""
    w = Window.orderBy(F.asc_nulls_last("first_ts"), F.when(F.col("first_ts").isNull(), F.col("created_ns")), "arg")
    return probes.withColumn("file_rank", F.row_number().over(w) - 1)


def merge(files: DataFrame, probes: DataFrame) -> DataFrame:
    """All frames of the files, numbered anew: files in their order, frames in theirs. Offsets come from a row for each file, so no task holds the stream."""
    order = file_order(probes).join(files.groupBy("path").agg(F.count("*").alias("_n")), "path")
    order = order.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("path", "file_rank", "_base")
    placed = numbered(files, "frame_index", ("path",)).join(F.broadcast(order), "path")
    return placed.withColumn("seq", (F.col("_base") + F.col("position")).cast("long")).drop("_base", "position")


def export(frames: DataFrame) -> DataFrame:
    """One line of JSON for each frame that holds an object, in order of frames; other payloads as a JSON string."""
    p = F.col("payload")
    return frames.select("frame_index", F.when(p.rlike(r"^[ \t\n\r]*\{"), F.translate(p, "\n\r", "  ")).otherwise(S.json_text(p)).alias("line"))
