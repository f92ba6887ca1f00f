"""op2: near copies among embeddings by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, staged
from .graph import components

COSINE = 0.9
#: Rows of the sorted order that each row is compared with, before and after it; bits of its key, one random hyperplane each.
WINDOW, BITS = 1024, 64
#: There are as many passes as find a pair at exactly COSINE with this probability, if the rows are spread evenly.
RECALL = 0.98
#: Passes in which close vectors are folded into balls, and rows to a partition of a pass.
FOLDS, ROWS = 3, 16 * WINDOW

_LINKS = "a long, b long, part int, side int, pass int, seq int, id long, ball long, v binary"
_LINK_TYPES = [(n, pa.binary() if t == "binary" else pa.int64() if t == "long" else pa.int32()) for n, t in (x.split() for x in _LINKS.split(", "))]


def passes(n: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """A pair is in one window at least if it agrees on the leading bits that leave a window's rows."""
    bits = max(0.0, math.log2(max(1, n) / window))
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys(x: np.ndarray, number: int) -> np.ndarray:
    """The sort keys of unit vectors in pass `number`: concatenated signs against the pass's hyperplanes, as signed longs in lexicographic order."""
    planes = np.random.default_rng([number, x.shape[1]]).standard_normal((x.shape[1], BITS))
    bits = np.packbits(x @ planes >= 0, axis=1)
    return (bits.view(">u8")[:, 0] ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)


def _sorted(rows: DataFrame, numbers: list[int], n: int) -> DataFrame:
    """(pass, dim, key, id, ball, v) of every row (id, ball, v) for each pass, range-partitioned and sorted by pass, dimension and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2).to_pylist()
            dims = np.array([len(x) // 8 for x in v], np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(v[k] for k in at), "<f8").reshape(-1, dim)
                part = b.take(pa.array(at))
                for number in numbers:
                    own = [pa.array(np.full(len(at), number, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(keys(x, number))]
                    yield pa.record_batch([*own, *part.columns], ["pass", "dim", "key", "id", "ball", "v"])

    made = rows.select("id", "ball", "v").mapInArrow(run, "pass int, dim int, key long, id long, ball long, v binary")
    order = ("pass", "dim", "key", "id")
    return made.repartitionByRange(max(1, math.ceil(n * len(numbers) / ROWS)), *order).sortWithinPartitions(*order)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(pass, ids, balls, unit vectors) of at most `size` rows in order; a block has one pass and dimension."""
    for b in batches:
        number, dims = b.column(0).to_numpy(), b.column(1).to_numpy()
        ids, balls, v = b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_pylist()
        cut = np.flatnonzero((np.diff(number) != 0) | (np.diff(dims) != 0)) + 1
        for low, high in zip([0, *cut], [*cut, b.num_rows]):
            for k in range(low, high, size):
                e = min(high, k + size)
                if e > k:
                    yield int(number[k]), ids[k:e], balls[k:e], np.frombuffer(b"".join(v[k:e]), "<f8").reshape(e - k, int(dims[k]))


def _near(x: np.ndarray, at: np.ndarray, y: np.ndarray, at_y: np.ndarray, cosine: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where rows of x meet earlier rows of y, at most a window before them, at this cosine."""
    far = at[:, None] - at_y[None, :]
    return np.nonzero((x @ y.T >= cosine) & (far > 0) & (far <= window))


def _links(rows: DataFrame, numbers: list[int], n: int, cosine: float, window: int) -> DataFrame:
    """Verified pairs (a < b) in different balls that share a window of some pass."""

    def record(**given) -> pa.RecordBatch:
        size = len(next(iter(given.values())))
        return pa.record_batch([pa.array(given[k], t) if k in given else pa.nulls(size, t) for k, t in _LINK_TYPES], [k for k, _ in _LINK_TYPES])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, first, before = TaskContext.get().partitionId(), 0, 0, None
        edge = lambda side, number, seq, ids, balls, x: record(part=[part] * len(ids), side=[side] * len(ids), **{"pass": [number] * len(ids)}, seq=seq, id=ids, ball=balls, v=[r.tobytes() for r in x])
        for number, ids, balls, x in _blocks(batches, window):
            seq = np.arange(at, at + len(ids))
            if before is None or before[0] != number or before[4].shape[1] != x.shape[1]:
                before = (number, seq[:0], ids[:0], balls[:0], x[:0])
            if first is not None:  # what the last partition's rows have yet to meet
                here = seq < window
                yield edge(0, number, seq[here], ids[here], balls[here], x[here])
                first = None if at + len(ids) >= window else first
            all_seq, all_ids, all_balls, all_x = (np.concatenate(p) for p in ((before[1], seq), (before[2], ids), (before[3], balls), (before[4], x)))
            i, j = _near(x, seq, all_x, all_seq, cosine, window)
            other = balls[i] != all_balls[j]
            i, j = ids[i[other]], all_ids[j[other]]
            if len(i):
                yield record(a=np.minimum(i, j), b=np.maximum(i, j))
            before = (number, all_seq[-window:], all_ids[-window:], all_balls[-window:], all_x[-window:])
            at += len(ids)
        if before is not None:
            yield edge(1, before[0], before[1] - at, *before[2:])

    def meet(t: pa.Table) -> pa.Table:
        """The last rows of a partition (seq below 0) and the first of the next."""
        side, seq = t.column("side").to_numpy(), t.column("seq").to_numpy()
        number, ids, balls, v = t.column("pass").to_numpy(), t.column("id").to_numpy(), t.column("ball").to_numpy(), t.column("v").to_pylist()
        out: tuple[list, list] = ([], [])
        size = np.array([len(x) for x in v])
        for key in set(zip(number[side == 0].tolist(), size[side == 0].tolist())) & set(zip(number[side == 1].tolist(), size[side == 1].tolist())):
            new, old = (np.flatnonzero((side == s) & (number == key[0]) & (size == key[1])) for s in (0, 1))
            x, y = (np.frombuffer(b"".join(v[k] for k in w), "<f8").reshape(len(w), -1) for w in (new, old))
            i, j = _near(x, seq[new], y, seq[old], cosine, window)
            i, j = new[i], old[j]
            other = balls[i] != balls[j]
            i, j = ids[i[other]], ids[j[other]]
            out[0].extend(np.minimum(i, j).tolist())
            out[1].extend(np.maximum(i, j).tolist())
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    found = staged(_sorted(rows, numbers, n).mapInArrow(scan, _LINKS), "windows")
    # two windows' rows to a border
    borders = found.where("a IS NULL").withColumn("border", F.when(F.col("side") == 1, F.col("part")).otherwise(F.col("part") - 1))
    across = borders.groupBy("border").applyInArrow(meet, "a long, b long")
    return found.where("a IS NOT NULL").select("a", "b").unionByName(across).distinct()


def _assign(rows: DataFrame, number: int, n: int, half: float, window: int) -> DataFrame:
    """(id, leader) of the rows that an earlier leader takes in this pass: the rows go in sorted order, and each joins the nearest of the last `window` leaders, if that is near enough, or is a leader."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead, lead_x = None, None, None
        for number, ids, _, x in _blocks(batches, 256):
            if last != (number, x.shape[1]):
                last, lead, lead_x = (number, x.shape[1]), np.zeros(0, np.int64), np.zeros((0, x.shape[1]))
            to = np.full(len(ids), -1, np.int64)
            if len(lead):
                s = x @ lead_x.T
                best = s.argmax(1)
                near = s[np.arange(len(ids)), best] >= half
                to[near] = lead[best[near]]
                taken = near
            else:
                taken = np.zeros(len(ids), bool)
            free = np.flatnonzero(~taken)
            own = x[free] @ x[free].T >= half
            leaders, open_ = [], np.ones(len(free), bool)
            for k in range(len(free)):
                if open_[k]:
                    leaders.append(free[k])
                    mine = open_ & own[k]
                    mine[: k + 1] = False
                    to[free[mine]] = ids[free[k]]
                    open_ &= ~mine
            lead, lead_x = np.concatenate([lead, ids[leaders]])[-window:], np.concatenate([lead_x, x[leaders]])[-window:]
            moved = np.flatnonzero(to != -1) if len(to) else []
            moved = [k for k in moved if to[k] != ids[k]]
            if len(moved):
                yield pa.record_batch([pa.array(ids[moved]), pa.array(to[moved])], ["id", "leader"])

    return _sorted(rows, [number], n).mapInArrow(scan, "id long, leader long")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def balls(classes: DataFrame, n: int, cosine: float, window: int, folds: int = FOLDS) -> DataFrame:
    """(id, ball, v) of every class (id, u array<double>, v): ball is a class within half the angle of the cosine, or the class itself.

    Any two members of a ball are then within the whole angle, so they are linked without being compared: a crowd of close
    vectors costs its size and not its square. In each fold the leaders left are sorted by another pass and joined to leaders
    near them; who followed a leader that joined another goes along if it is near enough to that one too, else by itself again.
    """
    half = math.sqrt((1 + cosine) / 2) + 1e-9
    of = staged(classes.select("id", F.col("id").alias("ball")), "balls")
    for k in range(folds):
        leaders = classes.join(of.where("id = ball").select("id"), "id", "left_semi").select("id", F.col("id").alias("ball"), "v")
        moved = staged(_assign(leaders, 1_000_000 + k, n, half, window), "moved")
        if moved.isEmpty():
            break
        to = of.join(moved.select(F.col("id").alias("ball"), "leader"), "ball").select("id", "leader")
        u = classes.select("id", "u")
        to = to.join(u, "id").join(u.select(F.col("id").alias("leader"), F.col("u").alias("w")), "leader")
        to = to.select("id", F.when(_dot("u", "w") >= half, F.col("leader")).otherwise(F.col("id")).alias("new"))
        of = staged(of.join(to, "id", "left").select("id", F.coalesce("new", "ball").alias("ball")), "balls")
    return classes.select("id", "v").join(of, "id")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, window: int = WINDOW, number: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of rows (vec_id, embedding array; further columns don't matter).

    Vectors with equal components are one class; classes close enough to be linked in any case are one ball (see balls); over
    all classes run sorted projection passes: a pass orders them by the concatenated signs of random projections, and compares
    each, in double precision, with the rows of a window before it, across partitions too. The pairs found in any pass that
    aren't in one ball are united. The windows bound the work, so a link may be missed; `number` of passes follows from the
    number of classes, for a recall of RECALL where links are hardest to find. n_links counts members of the class, of the ball
    and of the classes linked. Vectors that are null, zero, or hold null or non-finite components, and rows without vec_id,
    link with nothing; vectors of different dimensions don't either. An empty table gives no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    fine = F.coalesce(fine, F.lit(False))
    own = rows.where(fine).select("vec_id", x.alias("e"))

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [unit(np.array([e]))[0] for e in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(u, pa.list_(pa.float64())), pa.array([r.astype("<f8").tobytes() for r in u], pa.binary())], ["id", "n", "u", "v"])

    grouped = own.groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = staged(grouped.select("id", "n", "e").mapInArrow(norm, "id long, n long, u array<double>, v binary"), "classes")
    n = classes.count()
    in_balls = staged(balls(classes, n, cosine, window), "in_balls")
    pairs = staged(_links(in_balls, list(range(number or passes(n, cosine, window))), n, cosine, window), "pairs")
    found = components(pairs.unionByName(in_balls.where("id <> ball").select(F.col("id").alias("a"), F.col("ball").alias("b"))))
    sizes = classes.select("id", "n")
    ball_sizes = in_balls.join(sizes, "id").groupBy("ball").agg(F.sum("n").alias("ball_n"))
    partners = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(sizes.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    told = in_balls.select("id", "ball").join(ball_sizes, "ball").join(partners, "id", "left").join(found, "id", "left")
    told = told.select("id", (F.col("ball_n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    told = own.join(grouped.select("e", "id"), "e").join(told, "id").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
