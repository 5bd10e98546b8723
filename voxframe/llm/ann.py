"""Nearest neighbours by shifted space-filling curves.

Vectors are projected at random to a few dimensions, shifted, and put in order along a Hilbert curve; several such
orders are range-partitioned in Spark. A query is compared with the window of vectors around its own place in each
order; the windows' nearest are merged and ranked by their distance on the original vectors.

How wide the windows must be depends on the data, so it is measured: the neighbours of a bounded sample of queries
are found by brute force, and the window is as wide as it must be for the orders to hold the wanted share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored
from .common import parts

#: Dimensions and bits of each on a curve; their product is under 64.
CURVE_DIMS, CURVE_BITS = 8, 7
#: Vectors of one block of an order, the unit that a task compares.
BLOCK = 1024
#: Queries that meet a block in one task.
QUERIES = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows) on the Hilbert curve, by exclusive-or transforms of their bits."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for axis in x:
            up = (axis & q) != 0
            swap = np.where(up, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(up, low, swap)
            axis ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & q, q - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | axis >> b & 1
    return place


def _vectors(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def _distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances, but for rounding."""
    return (queries * queries).sum(1)[:, None] + (vectors * vectors).sum(1) - 2 * queries @ vectors.T


def curve_places(dims: int, curves: int, low: float, high: float, seed: int):
    """Places of each vector on all curves; ``low`` and ``high`` bound the projections."""
    rng = np.random.default_rng(seed)
    width = min(CURVE_DIMS, dims)
    bases = [(np.linalg.qr(rng.normal(size=(dims, width)))[0], rng.uniform(0, 1, width)) for _ in range(curves)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column("vec"), dims)
            for curve, (base, shift) in enumerate(bases):
                cells = np.clip(((v @ base - low) / max(high - low, 1e-300) + shift) / 2, 0, 1) * ((1 << CURVE_BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), curve, np.int32)), pa.array(hilbert(cells.astype(np.int64), CURVE_BITS)), batch.column("entry")], names=["curve", "place", "entry"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the rows of each curve in this task, in order."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        curve = batch.column("curve").to_numpy()
        at = np.zeros(len(curve), np.int64)
        for c in np.unique(curve):
            own = np.flatnonzero(curve == c)
            at[own] = seen.get(c, 0) + np.arange(len(own))
            seen[c] = seen.get(c, 0) + len(own)
        yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("entry"), pa.array(np.full(len(curve), part, np.int32)), pa.array(at)], names=["curve", "entry", "part", "at"])


def ranks(places: DataFrame) -> DataFrame:
    """(curve, entry, rank): ranks from 0 in the order of each curve, from counts per task of the range-partitioned rows."""
    n = parts(places.sparkSession, 1)
    numbered = places.repartitionByRange(n, "curve", "place", "entry").sortWithinPartitions("curve", "place", "entry").mapInArrow(_number, "curve int, entry long, part int, at long")
    numbered = stored(numbered, "ann-order")
    counts = numbered.groupBy("curve", "part").count()
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("curve", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return stored(numbered.join(base, ["curve", "part"]).select("curve", "entry", (F.col("base") + F.col("at")).alias("rank")), "ann-ranks")


def nearest(sample: np.ndarray, own: np.ndarray, dims: int, k: int):
    """The k entries nearest to each sampled query among this task's, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, entry = _vectors(batch.column("vec"), dims), batch.column("entry").to_numpy()
            if not len(entry):
                continue
            d = _distances(sample, v)
            d[own[:, None] == entry] = np.inf
            best = np.argsort(d, 1)[:, :k]
            q = np.repeat(np.arange(len(sample)), best.shape[1])
            found = pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(entry[best.ravel()]), pa.array(d[q, best.ravel()])], names=["query", "entry", "d"])
            yield found.filter(pa.array(np.isfinite(d[q, best.ravel()])))

    return run


def compare_blocks(dims: int, k: int):
    """The k nearest of a block for each query that reaches it."""

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if block.num_rows and queries.num_rows:
            v, q = _vectors(block.column("vec"), dims), _vectors(queries.column("vec"), dims)
            ids, own = block.column("ids").to_pylist(), queries.column("query_id").to_pylist()
            take = min(k + 1, len(v))  # the query's own vector may be among them
            for s in range(0, len(q), 256):
                d = _distances(q[s : s + 256], v)
                bound = np.partition(d, take - 1, 1)[:, take - 1] + 1e-9 * (1 + np.abs(d).max(1))
                for i, row in enumerate(d):
                    some, limit = take, bound[i]
                    while True:
                        near = np.flatnonzero(row <= limit)
                        exact = np.sqrt(((v[near] - q[s + i]) ** 2).sum(1))
                        found: dict[int, float] = {}  # each other id at its smallest distance
                        for x, vec in sorted((x, vec) for x, j in zip(exact.tolist(), near.tolist()) for vec in ids[j] if vec != own[s + i]):
                            found.setdefault(vec, x)
                        if len(found) >= k or len(near) == len(v):
                            break
                        some = min(2 * some, len(v))  # vectors of the same ids are in the way
                        limit = np.partition(row, some - 1)[some - 1] + 1e-9 * (1 + np.abs(row).max())
                    out += [(own[s + i], vec, x) for vec, x in list(found.items())[:k]]
        query, vec, score = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def search(vectors: DataFrame, every: int = 100, k: int = 10, curves: int = 6, recall: float = 0.97, sample: int = 96, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows, by Euclidean distance, of each row whose id is divisible by ``every``, itself apart.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the distance in double precision; nearest first, ties to the
    smaller id; fewer than k only where there are no more rows.

    Vectors that are null, zero, of another length than most, or that hold a null or a number that is not finite take no part; nor do null ids. Equal
    vectors are one entry of the index with their k + 1 smallest different ids, more than which no result can need, so a vector that
    a third of all rows share is no larger than others. A repeated id is returned once per query, at its smallest distance. Other columns
    are not looked at. A table without vectors that take part gives an empty result.

    Every row is indexed. The windows are fitted on ``sample`` queries at most: their width is that at which the orders
    hold the share ``recall`` of those queries' true neighbours, and as many of the ``curves``, two at least, are used as need the least work for that. Vectors without structure so get windows over much of the
    table, in blocks; the result stays right and only the work grows.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & vec.isNotNull() & fine)
    usual = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not usual:
        return spark.createDataFrame([], schema)
    dims = usual[0].dims
    rows = rows.where(F.size("vec") == dims)
    first = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))  # ids, not rows: one may be there many times
    entries = rows.withColumn("_n", first).where(F.col("_n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = stored(entries.select(F.col("ids")[0].alias("entry"), "vec", "ids"), "ann-entries")
    top = entries.select(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))), F.count(F.lit(1))).first()
    spread, count = float(top[0]) * min(dims, 64) ** 0.5, top[1]
    spread = min(spread, entries.select(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()[0])
    order = ranks(entries.select("entry", "vec").mapInArrow(curve_places(dims, curves, -spread, spread, seed), "curve int, place long, entry long"))

    asked = rows.where(F.col("id") % every == 0).join(entries.select("vec", "entry"), "vec").select(F.col("id").alias("query_id"), "vec", "entry")
    asked = stored(asked, "ann-queries")
    some = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("entry", "vec").dropDuplicates(["entry"]).collect()
    if not some:
        return spark.createDataFrame([], schema)
    own, points = np.array([r.entry for r in some], np.int64), np.array([r.vec for r in some], float)
    true = entries.select("entry", "vec").mapInArrow(nearest(points, own, dims, k), "query long, entry long, d double")
    true = true.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("d", "entry"))).where(F.col("_n") <= k).select("query", "entry")
    apart = true.join(order, "entry").join(order.select(F.col("entry").alias("query"), "curve", F.col("rank").alias("own_rank")), ["query", "curve"])
    # how many of the curves are worth their work: the first ones, with the windows that these need
    need = apart.withColumn("need", F.min(F.abs(F.col("rank") - F.col("own_rank"))).over(Window.partitionBy("query", "entry").orderBy("curve")))
    needed = {r.curve: int(r.need or 0) + 1 for r in need.groupBy("curve").agg(F.percentile("need", F.lit(recall)).alias("need")).collect()}
    used = min((c for c in needed if c), key=lambda c: ((c + 1) * min(2 * needed[c], count), c), default=curves - 1)
    window = max(k, needed.get(used, count))
    order = order.where(F.col("curve") <= used)

    block = F.expr(f"rank div {BLOCK}")
    reach = F.sequence(F.expr(f"greatest(rank - {window}, 0) div {BLOCK}"), F.expr(f"least(rank + {window}, {count - 1}) div {BLOCK}"))
    # queries that lie together on a curve share a tile, so a block goes to the few tiles that want it
    tiles = max(1, asked.count() // QUERIES)
    tile = F.least(F.floor(F.col("rank") * tiles / count), F.lit(tiles - 1)).cast("int")
    queries = asked.join(order, "entry").select("query_id", "vec", F.col("curve").alias("q_curve"), F.explode(reach).alias("q_block"), tile.alias("q_tile"))
    wanted = asked.join(order, "entry").select("curve", F.explode(reach).alias("block"), tile.alias("tile")).distinct()
    blocks = entries.join(order, "entry").select("curve", block.alias("block"), "vec", "ids").join(wanted, ["curve", "block"])
    found = blocks.groupBy("curve", "block", "tile").cogroup(queries.groupBy("q_curve", "q_block", "q_tile")).applyInArrow(compare_blocks(dims, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
