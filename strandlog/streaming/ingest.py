"""Ingest as a structured stream: files of NDJSON lines to frames, and rotation with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def lines_stream(spark: SparkSession, folder: str, now_ns: int) -> DataFrame:
    """Frames of the lines of files that come into a folder; each file is read once."""
    rows = spark.readStream.option("lineSep", "\n").text(folder).where(F.length("value") > 0)
    record = F.regexp_replace("value", "\r\\z", "")
    return rows.select(F.lit(S.fnv1a_of("ndjson_v1")).alias("type"), S.or_now(S.first_time(record), now_ns).alias("ts_ns"), record.alias("payload"), F.octet_length(record).cast("long").alias("length"))


def run(frames: DataFrame, out: str, checkpoint: str) -> None:
    """Append what has come to Parquet at `out`, exactly once, and end; started again it goes on from the checkpoint."""
    frames.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rotate(frames: DataFrame, key: str, records: int = 0, size: int = 0) -> DataFrame:
    """(key, segment, records, bytes): each stream's open segment after each batch; its number, frames and bytes are keyed state, so rotation goes on across batches and restarts."""

    def step(k: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        segment, n, held = state.get if state.exists else (0, 0, 0)
        for b in batches:
            for length in b["length"]:
                if (records and n + 1 > records) or (size and n and held + length > size):
                    segment, n, held = segment + 1, 0, 0
                n, held = n + 1, held + int(length)
        state.update((segment, n, held))
        yield pd.DataFrame({key: [k[0]], "segment": [segment], "records": [n], "bytes": [held]})

    kind = dict(frames.dtypes)[key]
    return frames.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, segment long, records long, bytes long", "segment long, records long, bytes long", "update", "NoTimeout")
