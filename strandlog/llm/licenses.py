"""op9: licence scans by diagonal voting, with DataFrame operations only."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, staged, text_of
from .license_texts import TEMPLATES

#: What lies between words; lower-casing comes before, so A to Z needn't be spared.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase to label of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words to a k-gram, words by which diagonals of one copy may differ, share of a template's words that must be there.
K, DRIFT, SHARE = 5, 12, 0.8
#: So many doc_ids with a vote are broadcast to fetch their texts (8 bytes each); with more, the texts are joined by shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BETWEEN, -1), "")


def words_of(text: str) -> list[str]:
    """The same in Python, for templates."""
    return [w for w in re.split(BETWEEN, text.translate({a: a + 32 for a in range(65, 91)})) if w]


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places): the words at which phrases start, with their labels. All places count, overlapping ones too."""
    spelled = {p: p.split() for p in PHRASES}
    w = docs.select("doc_id", words(text_of()).alias("w"))
    at = lambda i, parts: [F.get("w", i + j) == x for j, x in enumerate(parts)]

    def label(i: Column) -> Column:
        out = F
        for p, parts in spelled.items():
            ok = at(i, parts)[0]
            for x in at(i, parts)[1:]:
                ok = ok & x
            out = out.when(ok, F.lit(PHRASES[p]))
        return out

    may = F.arrays_overlap("w", F.array(*(F.lit(parts[-1]) for parts in spelled.values())))  # the last words are the rare ones
    none = F.array().cast("array<struct<i:int,label:string>>")
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("i"), label(i).alias("label"))), lambda p: p["label"].isNotNull())
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when((F.size("w") > 0) & may, starts).otherwise(none).alias("places"))


def template_words(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, label, tw): a row for each template; constants of this package, about 20 rows."""
    rows = [(n, label, words_of(text)) for n, (label, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, label string, tw array<string>")


def _kgrams(w: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(K))))


def votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, template, diagonal, votes): how many k-grams of a document stand at a template's place plus the diagonal."""
    rolling = docs.select("doc_id", words(text_of()).alias("w")).select("doc_id", F.when(F.size("w") >= K, _kgrams("w")).alias("g"))
    # outer: else the optimiser adds a filter on the array below, which computes every k-gram once more
    rolling = rolling.select("doc_id", F.posexplode_outer("g").alias("pos", "h"))
    places = templates.where(F.size("tw") >= K).select("template", F.posexplode(_kgrams("tw")).alias("tpos", "h"))
    # a few thousand rows, as many as the templates have words
    hits = rolling.join(F.broadcast(places), "h")
    return hits.groupBy("doc_id", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"))


def spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, label, share): verified spans. Neighbouring diagonals of a template, at most DRIFT words apart one from the next, are one copy with words put in or left out; its share is that of the template's words that stand at one of its diagonals."""
    ordered = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    v = staged(votes(docs, templates), "votes")
    apart = (F.col("diagonal") - F.lag("diagonal").over(ordered) > DRIFT).cast("int")
    copies = v.withColumn("copy", F.sum(F.coalesce(apart, F.lit(0))).over(ordered))
    copies = copies.groupBy("doc_id", "template", "copy").agg(F.array_sort(F.collect_set("diagonal")).alias("diagonals"), F.sum("votes").alias("votes"))
    ids = v.select("doc_id").distinct()
    if v.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", words(text_of()).alias("w"))
    both = copies.join(texts, "doc_id").join(F.broadcast(templates), "template")
    there = F.filter(F.sequence(F.lit(0), F.size("tw") - 1), lambda t: F.exists("diagonals", lambda d: (t + d >= 0) & (F.get("w", t + d) == F.get("tw", t))))
    return both.select("doc_id", "label", (F.size(there) / F.size("tw")).alias("share")).where(F.col("share") >= SHARE)


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """A row for every row of docs (doc_id, text; further columns don't matter), by the contract of op9.

    All rolling K-gram hashes are joined to the templates' places, counted by diagonal, neighbouring diagonals merged, and
    each such span verified word by word against the template. labels: the base ones and those of the verified templates.
    score: 1 where a phrase stands, else the largest verified share of a template, else 0. A null text counts as empty: no
    words, no labels (empty strings), score 0. Of a repeated doc_id each row is returned, with the labels of all its texts.
    """
    templates = template_words(docs.sparkSession) if templates is None else templates
    found = spans(docs, templates).groupBy("doc_id").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    sorted_labels = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    b = base(docs).join(found, "doc_id", "left")
    starts, named = F.transform("places", lambda p: p["i"]), F.transform("places", lambda p: p["label"])
    return b.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        sorted_labels(named).alias("base_labels"),
        sorted_labels(F.concat(named, F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
