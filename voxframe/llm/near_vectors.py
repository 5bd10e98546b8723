"""Near-duplicate vectors by range search in a robust-pruned flat graph.

Vectors that may link (equal labels, equal lengths) are dealt over shards around sampled centres until every shard is small; a vector near
the border of two shards is in both. In each shard a graph is built: a vector's neighbours are pruned so that none is much nearer
to a kept one than to the vector itself. A vector's lists from all its shards are one list of the whole graph.

Each vector then searches its shards: a greedy search from the shard's medoid comes near, and from there on the search goes over all vectors in range.
Where a list leads out of a shard to what may be in range, the search goes on in that shard in the next round. A vector counts what belongs to the shard
(each vector belongs to one), so that counts of shards add up and no pairs are kept; shards send on a spanning forest of their links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Tables
from ..operators.components import graph_components

#: Vectors of a shard at most, and shards that a larger one is cut into at most.
SHARD, FAN = 512, 32
#: A vector goes to the second nearest centre too if that is farther by this angle at most.
OVERLAP = 0.3
#: Neighbours of a list: near ones after pruning, far ones by chance; candidates before pruning; how much nearer pruning asks for.
NEAR, FAR, CANDIDATES, ALPHA = 16, 4, 64, 1.2
#: Vectors that search a shard in one task, and in one step of it.
TASK_QUERIES, STEP_QUERIES = 4096, 256
#: Vectors of the audit, half of them from those with links.
AUDIT = 128
KEYS = ["label", "dims", "shard"]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, from the vectors as they are."""
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))  # so that squares stay in range
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _apart(df: DataFrame) -> DataFrame:
    """The same columns as ones of their own, so that a cogroup with a relative can tell them."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


# --- shards ----------------------------------------------------------------------------------


def _deal(fan: int):
    """New shards of the vectors of one shard, or part of one: the nearest centre's, and the second's for those near its border."""

    def run(some: pa.Table, centres: pa.Table) -> pa.Table:
        schema = pa.schema([*[some.schema.field(c) for c in ("label", "dims")], pa.field("shard", pa.int64()), *[some.schema.field(c) for c in ("entry", "weight", "vec", "home")]])
        if not some.num_rows:
            return schema.empty_table()
        old, ids = some.column("shard").to_numpy(), some.column("entry").to_numpy()
        c = units(np.array(centres.column("centres")[0].as_py(), float))
        angle = _angles(units(_matrix(some.column("vec"))) @ c.T)
        # of centres that are equally near, each vector takes one by its number, so that vectors of one direction part too
        order = (ids[:, None] * 2654435761 + np.arange(len(c)) * 40503) % 65521
        best = np.lexsort((order, np.round(angle, 9)), axis=1)
        row = np.arange(len(ids))
        second = some.column("home").to_numpy(zero_copy_only=False) & (angle[row, best[:, 1]] <= angle[row, best[:, 0]] + OVERLAP)
        take = np.concatenate([row, row[second]])
        shard = old[take] * fan + np.concatenate([best[:, 0], best[second, 1]])
        home = some.column("home").to_numpy(zero_copy_only=False)[take] & (np.arange(len(take)) < len(row))
        out = some.take(pa.array(take))
        return pa.table([*[out.column(c) for c in ("label", "dims")], pa.array(shard), *[out.column(c) for c in ("entry", "weight", "vec")], pa.array(home)], schema=schema)

    return run


def deal_shards(entries: DataFrame, work: Tables, most: int = SHARD) -> DataFrame:
    """(label, dims, shard, entry, weight, vec, home): every entry in the shard it belongs to, and again where it is near a border; no shard has more than ``most``."""
    done, level = None, 0
    rows = entries.select("label", "dims", F.lit(1).cast("long").alias("shard"), "entry", "weight", "vec", F.lit(True).alias("home"))
    while True:
        sizes = work.keep(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size")), f"sizes-{level}")
        sized = rows.join(sizes, KEYS)
        small = sized.where(F.col("size") <= most).drop("size")
        done = small if done is None else done.union(small)
        large = sizes.where(F.col("size") > most)
        if level == 11 or not large.limit(1).count():  # shards' numbers have 60 bits
            return work.keep(done if level < 11 else done.union(sized.where(F.col("size") > most).drop("size")), "placed")
        # centres: of some hundred vectors by hash, so many as shards of half the size need
        wanted = F.greatest(F.lit(2), F.least(F.lit(FAN), F.ceil(F.col("size") * 2 / most).cast("int")))
        draw = F.pmod(F.xxhash64("entry", F.lit(level)), F.col("size"))
        centres = sized.where((F.col("size") > most) & (draw < 4 * FAN)).groupBy(*KEYS, "size").agg(F.array_sort(F.collect_list(F.struct(draw.alias("draw"), "entry", "vec"))).alias("all"))
        centres = centres.select(*KEYS, "size", F.slice(F.transform("all", lambda x: x["vec"]), F.lit(1), wanted).alias("centres"))
        pieces = F.ceil(F.col("size") / (2 * TASK_QUERIES)).cast("int")
        centres = centres.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("size")
        parts = sized.where(F.col("size") > most).withColumn("piece", F.pmod(F.xxhash64("entry", F.lit("piece")), pieces).cast("int")).drop("size")
        schema = rows.schema
        parts, centres = _apart(parts), _apart(centres)
        rows = parts.groupBy(*KEYS, "piece").cogroup(centres.groupBy(*KEYS, "piece")).applyInArrow(_deal(FAN), schema)
        rows, level = work.keep(rows, f"dealt-{level}"), level + 1


# --- the graph -------------------------------------------------------------------------------


def pruned_lists(u: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Neighbours of each vector of a shard (-1 where there are fewer), and the medoid, from which all are reached."""
    m, rng = len(u), np.random.default_rng(seed)
    medoid = int(np.argmax(u @ u.sum(0)))
    if m == 1:
        return np.full((1, 1), -1), medoid
    cosine = u @ u.T
    far = np.sqrt(np.maximum(2 - 2 * cosine, 0))
    np.fill_diagonal(cosine, -2)
    near = min(CANDIDATES, m - 1)
    some = np.argpartition(-cosine, near - 1, 1)[:, :near]
    row = np.arange(m)[:, None]
    some = np.take_along_axis(some, np.argsort(far[row, some], 1, kind="stable"), 1)
    lists, alive, i = np.full((m, 2 * NEAR + FAR), -1), np.ones_like(some, bool), np.arange(m)
    for k in range(min(NEAR, near)):
        at = np.argmax(alive, 1)
        p, any_ = some[i, at], alive.any(1)
        lists[:, k] = np.where(any_, p, -1)
        alive &= ALPHA * far[p[:, None], some] > far[row, some]
        alive[i, at] = False
    chance = rng.integers(0, m, (m, FAR))
    lists[:, NEAR : NEAR + FAR] = np.where(chance == row, -1, chance)
    # the other way too, the nearest first
    ends, starts = lists[:, :NEAR].ravel(), np.repeat(i, NEAR)
    ends, starts = ends[ends >= 0], starts[ends >= 0]
    order = np.lexsort((far[ends, starts], ends))
    ends, starts = ends[order], starts[order]
    place = np.arange(len(ends)) - np.searchsorted(ends, ends)
    lists[ends[place < NEAR], NEAR + FAR + place[place < NEAR]] = starts[place < NEAR]
    # lists are full where many are near: who is in few of them is tied to its two nearest, so that a search among those finds it
    close = np.concatenate([lists[:, :NEAR], lists[:, NEAR + FAR :]], 1)
    seldom = np.flatnonzero(np.bincount(close[close >= 0], minlength=m) < 3)
    extra = [(int(p), int(x)) for x in seldom for p in some[x, :2]]
    if extra:
        lists = np.concatenate([lists, _tied(extra, m)], 1)
    # what the medoid does not reach is tied to the nearest that it does reach
    extra = []
    seen = np.zeros(m, bool)
    fresh = np.array([medoid])
    while True:
        while len(fresh):
            seen[fresh] = True
            fresh = np.unique(lists[fresh])
            fresh = fresh[(fresh >= 0) & ~seen[fresh]]
        if seen.all():
            break
        rest, have = np.flatnonzero(~seen), np.flatnonzero(seen)
        x, y = divmod(int(np.argmax(cosine[np.ix_(rest, have)])), len(have))
        extra.append((have[y], rest[x]))
        fresh = np.array([rest[x]])
    return np.concatenate([lists, _tied(extra, m)], 1) if extra else lists, medoid


def _tied(pairs: list[tuple[int, int]], m: int) -> np.ndarray:
    """Lists of the second numbers for each first one."""
    a, b = np.array(sorted(pairs)).T
    return _padded(a, b, m)


def _build(shard: pa.Table) -> pa.Table:
    ids, home = shard.column("entry").to_numpy(), shard.column("home").to_numpy(zero_copy_only=False)
    u = units(_matrix(shard.column("vec")))
    lists, medoid = pruned_lists(u)
    row, _ = np.nonzero(lists >= 0)
    to = lists[lists >= 0]
    number = shard.column("shard")[0].as_py()
    return pa.table({"a": ids[row], "b": ids[to], "cosine": (u[row] * u[to]).sum(1).astype(np.float32), "medoid": row == medoid, "shard": np.full(len(row), number), "b_home": home[to]})


# --- the search ------------------------------------------------------------------------------


class Shard:
    """The vectors of a shard with their lists, ready to be searched."""

    def __init__(self, nodes: pa.Table, threshold: float, beam: int, slack: float):
        self.ids, self.weight = nodes.column("entry").to_numpy(), nodes.column("weight").to_numpy()
        self.home, self.v = nodes.column("home").to_numpy(zero_copy_only=False), _matrix(nodes.column("vec"))
        self.u, self.threshold, self.beam = units(self.v), threshold, beam
        self.wide = math.cos(min(math.pi, math.acos(threshold) + slack))
        order = np.argsort(self.ids)
        lists = nodes.column("lists").combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        to, homes, cosine = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        at = np.minimum(np.searchsorted(self.ids, to, sorter=order), len(order) - 1)
        inside = self.ids[order[at]] == to
        self.lists = _padded(row[inside], order[at[inside]], len(self.ids))
        out = np.lexsort((-cosine[~inside], homes[~inside], row[~inside]))
        self.out = [x[~inside][out] for x in (row, to, homes, cosine)]
        self.home_shard = nodes.column("home_shard").to_numpy()
        medoids = np.flatnonzero(nodes.column("medoid").to_numpy(zero_copy_only=False))
        self.medoid = int(medoids[0]) if len(medoids) else 0

    def search(self, q: np.ndarray, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query and each vector: whether it is in range, whether the search went on from it, and the cosine (-2 if not looked at); ``starts`` are rows of places, -1 for none."""
        n, m, i = len(q), len(self.ids), np.arange(len(q))[:, None]
        cosine = np.full((n, m), -2.0)
        found = np.full((n, self.beam), -1)
        score = np.full((n, self.beam), -2.0)
        went = np.zeros((n, m), bool)
        fresh = starts
        while True:
            # look at what is new, and keep the nearest; each is there once
            fresh = np.where((fresh >= 0) & (cosine[i, fresh] == -2), fresh, -1)
            got = np.where(fresh >= 0, np.einsum("qd,qkd->qk", q, self.u[fresh]), -2.0)
            a, b = np.nonzero(fresh >= 0)
            cosine[a, fresh[a, b]] = got[a, b]
            again = np.sort(np.where(fresh >= 0, fresh, m + np.arange(fresh.shape[1])), 1)
            if (again[:, 1:] == again[:, :-1]).any():
                for r in np.flatnonzero((again[:, 1:] == again[:, :-1]).any(1)):
                    _, first = np.unique(fresh[r], return_index=True)
                    dup = np.ones(fresh.shape[1], bool)
                    dup[first] = False
                    got[r, dup] = -2.0
            found, score = np.concatenate([found, fresh], 1), np.concatenate([score, got], 1)
            best = np.argsort(-score, 1, kind="stable")[:, : self.beam]
            found, score = found[i, best], score[i, best]
            open_ = (score > -2) & ~went[i, found]
            if not open_.any():
                break
            at = np.argmax(open_, 1)
            here = np.where(open_.any(1), found[i[:, 0], at], -1)
            went[i[:, 0][here >= 0], here[here >= 0]] = True
            fresh = np.where(here[:, None] >= 0, self.lists[here], -1)
        while True:  # from all that is in range, or near it
            a, b = np.nonzero((cosine >= self.wide) & ~went)
            if not len(a):
                break
            went[a, b] = True
            new = np.zeros((n, m), bool)
            to = self.lists[b]
            k, j = np.nonzero(to >= 0)
            new[a[k], to[k, j]] = True
            new &= cosine == -2
            if new.sum() * 8 > new.size:
                cosine = np.where(new, q @ self.u.T, cosine)
            else:
                a, b = np.nonzero(new)
                for s in range(0, len(a), 1 << 15):
                    cosine[a[s : s + (1 << 15)], b[s : s + (1 << 15)]] = (q[a[s : s + (1 << 15)]] * self.u[b[s : s + (1 << 15)]]).sum(1)
        hit = cosine >= self.threshold
        a, b = np.nonzero(np.abs(cosine - self.threshold) < 1e-9)  # these are told by the vectors themselves
        if len(a):
            hit[a, b] = exact_cosine(raw[a], self.v[b]) >= self.threshold
        return hit, (cosine >= self.wide) & went, cosine

    def exits(self, hit: np.ndarray, went: np.ndarray, cosine: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(query, shard, vector there): for what is in range and belongs to another shard, and for what is not here and may be in range, by the triangle inequality of angles."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for x, y in zip(*np.nonzero(hit & ~self.home)):
            best[int(x), int(self.home_shard[y])] = (-1.0, int(self.ids[y]))
        row, to, homes, near = self.out
        limit = math.acos(self.threshold)
        starts = np.searchsorted(row, np.arange(len(self.ids) + 1))
        reach = _angles(near.astype(float)) - 1e-3
        for x, y in zip(*np.nonzero(went & (starts[1:] > starts[:-1]))):
            own = math.acos(max(-1.0, min(1.0, cosine[x, y])))
            span = slice(starts[y], starts[y + 1])
            least = np.abs(reach[span] - own)
            for j in np.flatnonzero(least <= limit):
                key = (int(x), int(homes[span][j]))
                if key not in best or least[j] < best[key][0]:
                    best[key] = (float(least[j]), int(to[span][j]))
        for (x, home), (_, start) in best.items():
            yield x, home, start


def _padded(row: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full((n, int(place.max(initial=-1)) + 1 or 1), -1)
    out[row, place] = to
    return out


class _Forest:
    """Groups of numbers, joined link by link."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, own: int, others: np.ndarray) -> np.ndarray:
        """Put all in one group; returns one of the others for each group that was apart."""
        groups, first = np.unique(self.label[others], return_index=True)
        apart = groups != self.label[own]
        for g in groups[apart]:
            self.label[self.label == g] = self.label[own]
        return others[first[apart]]


FOUND = "kind int, a long, b long, n long"
#: Kinds of rows that a search returns: a vector's links in a shard; a link of the forest; a shard (n) to go on to, from b.
COUNT, LINK, EXIT = 0, 1, 2


def _search(threshold: float, beam: int, slack: float):
    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if nodes.num_rows and queries.num_rows:
            shard = Shard(nodes, threshold, beam, slack)
            ids, raw = queries.column("query").to_numpy(), _matrix(queries.column("q_vec"))
            q, start = units(raw), queries.column("start").to_numpy(zero_copy_only=False)
            place = {x: k for k, x in enumerate(shard.ids.tolist())}
            starts = np.array([[shard.medoid, place.get(int(s), -1) if s >= 0 else -1] for s in start])
            starts[starts[:, 1] == starts[:, 0], 1] = -1
            number = np.array([place.get(x, -1) for x in ids.tolist()])
            forest = _Forest(len(shard.ids) + len(ids))
            for s in range(0, len(q), STEP_QUERIES):
                some = slice(s, s + STEP_QUERIES)
                hit, went, cosine = shard.search(q[some], raw[some], starts[some])
                known = number[some] >= 0
                hit[np.flatnonzero(known), number[some][known]] = False
                count = (hit & shard.home) @ shard.weight
                for k in np.flatnonzero(hit.any(1)):
                    own = number[s + k] if number[s + k] >= 0 else len(shard.ids) + s + k
                    out += [(LINK, int(ids[s + k]), int(shard.ids[j]), 0) for j in forest.join(own, np.flatnonzero(hit[k]))]
                out += [(COUNT, int(ids[s + k]), 0, int(count[k])) for k in np.flatnonzero(count)]
                out += [(EXIT, int(ids[s + k]), to, home) for k, home, to in shard.exits(hit, went, cosine)]
        kind, a, b, n = zip(*out) if out else ((), (), (), ())
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _true_links(points: np.ndarray, labels: list, threshold: float):
    """Of each sampled vector, how many of this task's rows link with it, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, u = np.zeros(len(points), np.int64), units(points)
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            batch = batch.filter(pa.array(dims == points.shape[1]))
            if batch.num_rows:
                weight, label = batch.column("weight").to_numpy(), batch.column("label").to_pylist()
                same = np.array([[x == y for y in label] for x in labels])
                total += ((u @ units(_matrix(batch.column("vec"))).T >= threshold) & same) @ weight
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points))), pa.array(total)], names=["k", "n"])

    return run


def audit(entries: DataFrame, counts: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """The share of true links that the counts (entry, n) hold, over a bounded sample: half of all vectors, half of those with links."""
    all_ = entries.join(counts, "entry", "left").select("entry", "label", "dims", "weight", "vec", F.coalesce("n", F.lit(0)).alias("n"))
    draw = F.xxhash64("entry", F.lit("audit"))
    some = {r.entry: r for part in (all_, all_.where("n > 0")) for r in part.orderBy(draw, "entry").limit(sample // 2).collect()}
    true = found = 0
    for dims in {r.dims for r in some.values()}:
        own = [r for r in some.values() if r.dims == dims]
        links = entries.mapInArrow(_true_links(np.array([r.vec for r in own], float), [r.label for r in own], threshold), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        for r in links:
            real = r.n - own[r.k].weight  # equal vectors are known to link
            true, found = true + real, found + min(real, own[r.k].n)
    return found / true if true else 1.0


def near_components(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.98, beam: int = 24, slack: float = 0.1, most: int = SHARD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Group the rows of ``vectors`` by links: equal labels and a cosine of ``threshold`` or more, in double precision.

    Returns one row per row: id, ``n_links`` (other rows linked directly), ``component_id`` (the smallest id reachable by links, itself included) and ``kept``
    (the id is its component's).

    Rows link with nothing if their vector is null, empty, zero, or holds nulls or numbers that are not finite, or if their label or id is null; a null id's component is null, and it is
    kept. Vectors of unlike lengths do not link. Equal vectors of a label are one entry of the graph, whatever their number, and count each. Rows that
    repeat an id are vectors each and one node of the components. Columns besides the three are not looked at. An empty table gives an empty result.

    Every row is indexed and every row searches. Links found are verified on the vectors; whether they are all is measured: a sample is held against brute force, and while its share of
    true links is under ``recall``, the search is done again with wider beams and ranges (four times at most, the last over whole shards).
    """
    work, vec = Tables(vectors.sparkSession, "near-vectors"), F.col(vec_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    able = F.coalesce(vec.isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & fine, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.size(vec).alias("dims"), vec.alias("vec"), able.alias("able"))
    entries = rows.where("able").groupBy("label", "dims", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    entries = work.keep(entries.select("label", "dims", "vec", "first", "weight", F.monotonically_increasing_id().alias("entry")), "entries")

    placed = deal_shards(entries, work, most)
    built = work.keep(placed.groupBy(*KEYS).applyInArrow(_build, "a long, b long, cosine float, medoid boolean, shard long, b_home boolean"), "lists")
    # the lists of all shards are one graph: where each neighbour belongs, what it is like, and who is a medoid where
    homes = placed.where("home").select("entry", F.col("shard").alias("home_shard"))
    lists = built.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).join(homes, F.col("b") == F.col("entry")).groupBy("a").agg(F.collect_list(F.struct("b", "home_shard", "cosine")).alias("lists"))
    medoids = built.where("medoid").select("a", "shard").distinct()
    nodes = placed.join(lists.withColumnRenamed("a", "entry"), "entry", "left").join(medoids.select(F.col("a").alias("entry"), "shard", F.lit(True).alias("medoid")), ["entry", "shard"], "left").join(homes, "entry")
    nodes = work.keep(nodes.select(*KEYS, "entry", "weight", "vec", "home", "home_shard", F.coalesce("lists", F.expr("array()").cast("array<struct<b:bigint,home_shard:bigint,cosine:float>>")).alias("lists"), F.coalesce("medoid", F.lit(False)).alias("medoid")), "nodes")

    for turn in range(4):
        last = turn == 3
        counts, links = _rounds(work, nodes, threshold, (most if last else beam << turn), slack * (turn + 1), turn)
        if last or audit(entries, counts, threshold) >= recall:
            break

    same = entries.select("entry", "first")
    shared = rows.where("able").groupBy("id").agg(F.count_distinct("label", "dims", "vec").alias("several")).where("several > 1").select("id")
    known = rows.where("able").join(shared, "id").join(entries, ["label", "dims", "vec"]).select("id", "entry")
    tied = known.join(known.groupBy("id").agg(F.min("entry").alias("least")), "id").where("entry <> least").select(F.col("entry").alias("a"), F.col("least").alias("b"))
    groups = graph_components(links.union(tied))
    label = same.join(groups.withColumnRenamed("id", "entry"), "entry", "left").select("entry", "first", F.coalesce("component", "entry").alias("group"))
    least = label.groupBy("group").agg(F.min("first").alias("component_id"))
    facts = entries.join(label.join(least, "group").select("entry", "component_id"), "entry").join(counts, "entry", "left")
    facts = work.keep(facts.select("label", "dims", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "facts")
    work.drop("placed", "lists", "nodes")
    out = rows.where("able").join(facts, ["label", "dims", "vec"]).select("id", "n_links", "component_id").union(rows.where("NOT able").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _rounds(work: Tables, nodes: DataFrame, threshold: float, beam: int, slack: float, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links of each entry (entry, n) without its equals, and the links of the shards' forests (a, b)."""
    at = nodes.where("home").select(F.col("entry").alias("query"), F.col("vec").alias("q_vec"), "label", "dims")
    ask = nodes.select(*KEYS, F.col("entry").alias("query"), F.col("vec").alias("q_vec"), F.lit(-1).cast("long").alias("start"))
    been, found, number = nodes.select("shard", F.col("entry").alias("query")), None, 0
    while True:
        # a shard that many vectors search is there once for each few thousand of them
        load = ask.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("pieces"))
        ask = ask.join(load, KEYS).withColumn("piece", F.pmod(F.xxhash64("query"), F.col("pieces")).cast("int")).drop("pieces")
        here = nodes.join(load, KEYS).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        here, ask = _apart(here), _apart(ask)
        got = here.groupBy(*KEYS, "piece").cogroup(ask.groupBy(*KEYS, "piece")).applyInArrow(_search(threshold, beam, slack), FOUND)
        got = work.keep(got, f"found-{turn}-{number}")
        found, number = got if found is None else found.union(got), number + 1
        exits = got.where(f"kind = {EXIT}").groupBy(F.col("a").alias("query"), F.col("n").alias("shard")).agg(F.min("b").alias("start"))
        exits = work.keep(exits.join(been, ["query", "shard"], "left_anti"), f"exits-{turn}-{number}")
        if not exits.limit(1).count():
            break
        been = been.union(exits.select("shard", "query"))
        ask = exits.join(at, "query").select(*KEYS, "query", "q_vec", "start")
    counts = found.where(f"kind = {COUNT}").groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("n"))
    return counts, found.where(f"kind = {LINK}").select("a", "b")
