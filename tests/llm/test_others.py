"""Quality, embeddings, dialogues and the pipeline."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from strandlog.llm import chat, embeddings, exact, quality, simhash

DIR = "/root/testdata/sf0.01"


def auc(y, s):
    r = s.argsort().argsort() + 1
    return (r[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality(spark):
    import zlib

    got = entry.queries()["op1_quality_classifier"](spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out]
    y, s = held.quality.to_numpy(), held.score.to_numpy()
    balanced = ((held.predicted[y == 1] == 1).mean() + (held.predicted[y == 0] == 0).mean()) / 2
    print("held out: AUC", auc(y, s), "balanced accuracy", balanced)
    assert auc(y, s) > 0.98 and balanced > 0.9


def test_quality_learns_from_nothing_else(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    a, b = ({r.doc_id: r.score for r in quality.score(*x).collect()} for x in ((docs, labels), (changed, other)))
    assert all(math.isclose(a[i], b[i], rel_tol=1e-6, abs_tol=1e-9) for i in a)


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "x", 3), (5, "word " * 2000000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    none, one_class = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([(2, 1), (1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, one_class).collect()} <= {1.0, 0.5}
    assert quality.score(docs.where("false"), none).count() == 0
    model = quality.discriminant({k: (10.0, np.arange(13.0) * k, np.eye(13) * 20 + 100) for k in (0, 1)}, 0.1, 0.1)
    assert np.isfinite(model.score(np.array([quality.statistics(b"")]))).all()


def brute(x, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, 0)
    return s >= cosine


def test_embeddings(spark):
    r = np.random.default_rng(0)
    c = r.standard_normal((150, 48))
    x = np.concatenate([c[k] + r.standard_normal((r.integers(1, 40), 48)) * r.choice([0.05, 0.2, 0.3, 0.34]) for k in range(150)] + [r.standard_normal((2500, 48)), c[0] + r.standard_normal((1500, 48)) * 0.02]).astype("float32")
    x = np.concatenate([x, x[:50], x[:50] * 2])[r.permutation(len(x) + 100)]
    bad = [(10**6 + k, v) for k, v in enumerate([None, [0.0] * 48, [float("nan")] * 48, [None] + [1.0] * 47, [float("inf")] * 48, [], [1.0, 2.0]])]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + bad, "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df.selectExpr("*", "1 AS ball", "2 AS id", "3 AS n"), window=256).toPandas().set_index("vec_id").sort_index()
    want = brute(x.astype(float))
    found = got.n_links.to_numpy()[: len(x)]
    print("recall", found.sum() / want.sum())
    assert (found <= want.sum(1) + (np.abs(found - want.sum(1)) < 0)).all() and found.sum() >= 0.95 * want.sum()
    assert (got.loc[10**6 :].n_links == 0).all() and (got.loc[10**6 :].component_id == got.loc[10**6 :].index).all()
    assert (got.kept == (got.component_id == got.index)).all() and len(got) == len(x) + 7
    comp = got.component_id.to_numpy()[: len(x)]
    assert all((comp[np.flatnonzero(comp == k)] == k).all() and np.flatnonzero(comp == k).min() == k for k in set(comp))
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_every_window_pair_is_found_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ROWS", 64)
    r = np.random.default_rng(1)
    c = r.standard_normal((300, 16))
    x = np.repeat(c, 3, 0) + r.standard_normal((900, 16)) * 0.05
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df, window=60, number=8).toPandas().sort_values("vec_id").n_links.to_numpy()
    assert got.sum() >= 0.97 * brute(x).sum()


def test_few_pairs_at_the_threshold(spark):
    r = np.random.default_rng(2)
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.standard_normal((4000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    x = np.concatenate([a, 0.905 * a + math.sqrt(1 - 0.905**2) * b])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df).toPandas().n_links.sum()
    print("recall at 0.905", got / 8000)
    assert got >= 0.9 * 8000


TURNS = [
    (1, 0, "ann", "hi <|end|>"), (1, 1, "bob", "yo"), (1, 2, "eve", None), (1, 1, "bob", "yo"), (1, None, "system", "rules"), (1, 3, None, "who"), (1, 3, "ann", ""),
    (2, 0, "solo", "alone"), (3, 0, "system", "only"), (None, 0, "x", "no id"), (4, 5000, "a", "late"), (4, 1, "b", "early"),
]


def plain_renderings(turns):
    esc = lambda s: s.replace("<|", "<\\|")
    out = set()
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "unknown", esc(t[3] or ""))
    for conv in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == conv]
        for p in {t[2] for t in own} - {None, "system"}:
            for part in {(t[1] or 0) // chat.PART for t in own}:
                text, spans = "", []
                for t in sorted((t for t in own if (t[1] or 0) // chat.PART == part), key=key):
                    text += "<|assistant|>\n" if t[2] == p else "<|system|>\n" if t[2] == "system" else f"<|user name={esc(t[2] or 'unknown')}|>\n"
                    start = len(text)
                    text += esc(t[3] or "") + "<|end|>\n"
                    spans += [(start, len(text))] if t[2] == p else []
                out.add((conv, p, part, text, tuple(spans)))
    return out


def test_chat(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, part string")
    got = [(r.conv_id, r.perspective, r.part, r.rendered, tuple((s.start, s.stop) for s in r.spans)) for r in chat.perspectives(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_renderings(TURNS)
    assert chat.perspectives(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_against_sql(spark, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    with duckdb.connect() as db:
        for p in glob.glob(f"{DIR}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        r = db.execute(entry.oracle_sql()[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == cols
        want = sorted(str([row[names.index(c)] for c in cols]) for row in r.fetchall())
    assert sorted(str([row[c] for c in cols]) for row in df.collect()) == want


def test_pipeline(spark, tmp_path):
    assert [n.split("_")[0] for n, _ in corpus_pipeline.STAGES] == ["op1", "op5", "op10", "op8"]
    df = docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = df
        stage(spark, df, DIR).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == docs.columns
            kept.append({r.doc_id for r in df.select("doc_id").collect()})
    bad = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 0").collect()}
    assert kept[0] == {r.doc_id for r in docs.collect()} - bad and 0 < len(bad) < 300
    good = docs.where(docs.doc_id.isin(list(kept[0])))
    assert kept[1] == {r.doc_id for r in exact.exact_copies(good).where("kept").collect()}
    alone = good.where(good.doc_id.isin(list(kept[1])))
    assert kept[2] == {r.doc_id for r in simhash.near_duplicates(alone).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in df.collect()} == kept[2] == {r.doc_id for r in before.collect()}
    got = entry.queries()["pipeline"](spark, DIR)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
