"""op10: near copies by SimHash, candidates by pigeonring filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship, staged
from .graph import components

#: Words to a shingle, the seed of XXH64, and the most bits by which linked fingerprints differ.
WORDS, SEED, DISTANCE = 3, 42, 2
#: Segments on the ring, one more than DISTANCE: the budget of a chain of l segments is l * DISTANCE // len(SEGMENTS).
SEGMENTS = ((0, 21), (21, 42), (42, 64))
#: Fingerprints that share a key are compared with each other up to so many; beyond, they meet at their one-bit neighbours.
COMPARED = 64
#: A longer text is hashed in pieces of about so many bytes, so a task holds the words of one piece.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: bytes, words: int = WORDS, piece: int = PIECE) -> Iterator:
    """The hashes of all shingles as NumPy arrays; of the whole sequence, if it has fewer words; nothing without a word."""
    import numpy as np
    from xxhash import xxh64_intdigest

    text, at, kept, seen = text.lower(), 0, [], False  # of bytes: A to Z only
    while at < len(text):
        cut = _SPACE.search(text, at + piece)
        end = cut.start() if cut else len(text)
        w = kept + text[at:end].split()  # of bytes: at 20 and 09 to 0D only
        at = end
        if len(w) >= words:
            shingles = map(b" ".join, zip(*(w[k:] for k in range(words))))
            n = len(w) - words + 1
            yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
            seen = True
        kept = w[-(words - 1) :] if words > 1 else []
    if not seen and kept:
        yield np.array([xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint as a signed long: a bit is set if it is in over half the hashes."""
    import numpy as np

    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        for k in range(0, len(h), 1 << 16):
            part = h[k : k + (1 << 16)]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row. A missing text counts as empty and has the fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _mask(low: int, high: int) -> int:
    m = (1 << high) - (1 << low)
    return m - (1 << 64) if m >> 63 else m


def _keys() -> list[tuple[int, int]]:
    """(segment, mask) of the keys: a whole segment and one half of the next on the ring."""
    keys = []
    for i, (low, high) in enumerate(SEGMENTS):
        a, b = SEGMENTS[(i + 1) % len(SEGMENTS)]
        mid = (a + b) // 2
        keys += [(i, _mask(low, high) | _mask(a, mid)), (i, _mask(low, high) | _mask(mid, b))]
    return keys


def _chain(x: Column, start: int) -> Column:
    """Whether the chain that starts at this segment stays within its budget at each length. x: the differing bits."""
    m, ok, total = len(SEGMENTS), F.lit(True), F.lit(0)
    for length in range(1, m + 1):
        total = total + F.bit_count(x.bitwiseAND(F.lit(_mask(*SEGMENTS[(start + length - 1) % m]))))
        ok = ok & (total <= length * DISTANCE // m)
    return ok


def links(classes: DataFrame) -> DataFrame:
    """(x, y): pairs of different fingerprints at most DISTANCE bits apart, each named by its rep; enough of them that whatever such pairs link is linked.

    classes: (fp, rep), each fp once. By the pigeonring principle, of two fingerprints at most DISTANCE bits apart, some
    segment starts a chain around the ring whose cumulative differences stay within l * DISTANCE / m at every length l. So its
    first segment is equal and the next differs in one bit at most, hence is equal in one of its halves: those 32 bits are
    the join key, six to a fingerprint, and no pair is lost. Candidates that share a key then have to pass the chain's
    budgets, and last the full Hamming check. Where more than COMPARED fingerprints share a key they aren't compared with
    each other: each goes to itself and to its 64 neighbours at one bit, and those that meet there are linked to the least
    of them (they are at most two bits apart; any two at most two bits apart meet). At most 65 can meet.
    """
    keys = _keys()
    key = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, (_, m) in enumerate(keys)))
    keyed = classes.select("fp", "rep", F.explode(key).alias("key")).select("fp", "rep", "key.k", "key.v")
    shared = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    keyed = staged(keyed.join(shared, ["k", "v"]), "keyed")
    few = keyed.where(F.col("n") <= COMPARED).select("k", "v", "fp", "rep")
    other = few.select("k", "v", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    chain = F.lit(False)
    for k, (start, _) in enumerate(keys):
        chain = chain | ((F.col("k") == k) & _chain(x, start))
    near = few.join(other, ["k", "v"]).where("rep < rep2").where(chain).where(F.bit_count(x) <= DISTANCE).select(F.col("rep").alias("x"), F.col("rep2").alias("y"))
    many = keyed.where(F.col("n") > COMPARED).select("fp", "rep").distinct()
    bits = F.array(F.lit(0).cast("long"), *(F.lit(_mask(b, b + 1)) for b in range(64)))
    at = many.select("rep", F.explode(F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b))).alias("at"))
    meet = at.groupBy("at").agg(F.min("rep").alias("x"), F.collect_list("rep").alias("all")).where(F.size("all") > 1)
    stars = meet.select("x", F.explode("all").alias("y")).where("x <> y")
    return near.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text; further columns don't matter).

    fingerprint: 16 hexadecimal digits. component_id: the smallest doc_id that links reach. Rows without a word, null texts
    too, have the fingerprint zero and are linked like any other. Equal fingerprints are one class with its smallest doc_id,
    so a hot one is a row. An empty table gives no rows; of a repeated doc_id each row is returned.
    """
    fps = staged(fingerprints(docs), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(classes).select(F.col("x").alias("a"), F.col("y").alias("b")))
    joined = classes.join(found, classes["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(joined, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage: of each component the document with the smallest doc_id, with its columns. Rows without a doc_id stay."""
    return docs.join(near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
