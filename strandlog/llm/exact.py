"""op5: exact copies by a stream with disk-backed keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, text_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


class Deduplicator:
    """State by digest that outlives its runs: for each digest seen, the number of rows, and of the row that stays the doc_id and the locator.

    Rows are added in batches and each batch is read once by the stream. The state lies in RocksDB on the executors' disks
    with its checkpoint in `folder`, a URI that all executors can reach; it has no watermark, so nothing expires. The stream
    sees digests and sizes, not texts, so its log holds some 60 bytes a row whatever the texts' length.
    """

    def __init__(self, spark: SparkSession, folder: str, digest=None):
        """digest: a text's digest as a binary column; SHA-256 unless given (tests give a short one, for collisions)."""
        self.spark, self.folder = spark, folder
        self.digest = digest or (lambda t: F.unhex(F.sha2(t, 256)))

    def add(self, docs: DataFrame, batch: str = "documents") -> None:
        """Add rows (doc_id, text). The locator is the batch's name with the doc_id."""
        text = text_of()
        slim = docs.select("doc_id", self.digest(text).alias("digest"), F.sha2(text, 256).alias("sha"), F.lit(batch).alias("batch"))
        slim.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/log")

    def run(self) -> None:
        """Take what has been added since the last run into the state; after a stop it goes on from the checkpoint."""
        name, was = "spark.sql.streaming.stateStore.providerClass", self.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        self.spark.conf.set(name, ROCKS)
        try:
            rows = self.spark.readStream.schema("doc_id long, digest binary, sha string, batch string").parquet(f"{self.folder}/log")
            state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "batch")).alias("keeper"))
            state.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        finally:
            self.spark.conf.set(name, was) if was else self.spark.conf.unset(name)

    def state(self) -> DataFrame:
        """(digest, n, keep_id, batch), a row for each digest."""
        s = self.spark.read.format("statestore").load(f"{self.folder}/checkpoint")
        fields = {f.name: [x.name for x in f.dataType.fields] for f in s.schema.fields if f.name in ("key", "value")}
        digest, (n, keeper) = fields["key"][0], fields["value"]
        return s.select(F.col(f"key.{digest}").alias("digest"), F.col(f"value.{n}").alias("n"), F.col(f"value.{keeper}.doc_id").alias("keep_id"), F.col(f"value.{keeper}.batch").alias("batch"))

    def log(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, digest binary, sha string, batch string").parquet(f"{self.folder}/log")


def exact_copies(docs: DataFrame, digest=None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text; further columns don't matter).

    Texts are equal if all their bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays. The
    stream finds the hits, digests with two rows or more; their texts, and no others, are then grouped byte by byte, partial
    groups first, so of a much repeated text a row for each partition is moved. Where a digest has several texts, each is a
    group of its own. The keeper of a group is known only when the last row is in: so all rows are given after the stream's
    run. Of a repeated doc_id each row is returned. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = Deduplicator(spark, new_path(spark, "dedup"), digest)
    own.add(docs)
    own.run()
    state = own.state()
    hits = state.where("n > 1").select("digest")
    text = docs.select("doc_id", text_of().alias("_text")).withColumn("digest", own.digest(F.col("_text")))
    groups = text.join(hits, "digest", "left_semi").groupBy("digest", "_text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    split = groups.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    rows = own.log().join(state.select("digest", "keep_id", "n"), "digest")
    if not split.isEmpty():  # a digest of several texts
        more = text.join(groups.join(split, "digest", "left_semi"), ["digest", "_text"]).select("doc_id", F.sha2("_text", 256).alias("sha"), "keep_id", "n")
        rows = rows.join(split, "digest", "left_anti").select("doc_id", "sha", "keep_id", "n").unionByName(more)
    return rows.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage: of equal texts the document with the largest doc_id, with its columns. Rows without a doc_id stay."""
    return docs.join(exact_copies(docs).where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(documents(spark, sf_dir))
