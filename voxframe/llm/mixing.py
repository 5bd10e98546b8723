"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

The text of each source, in a pseudo-random order of its documents, is cut into blocks of equal size.
With weight w, block k of a source may run from slot floor(k / w) and is due by slot ceil((k + 1) / w).
One block runs per slot; of the blocks that may run, the one that is due first does. The weights are
exact fractions and the schedule runs through all blocks, so nothing is rounded and no remainder is
lost. The driver plans it one block at a time and holds a bounded number of them; documents take no
part in that, and the plan has three numbers per block.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import new_path
from .common import parts

COLUMNS = ("block", "release", "deadline", "slot", "block_offset")
#: Blocks of a source in one row of the plan, and of all sources that the driver holds before it writes them.
RUN = 256
HELD = 1 << 16
#: Sources that one plan may have; their sizes reach the driver.
MOST_SOURCES = 1 << 17
STRUCT = "_mix_source: string, _mix_run: bigint, _mix_releases: array<bigint>, _mix_deadlines: array<bigint>, _mix_slots: array<bigint>"
PLAN = "_mix_source string, _mix_run long, _mix_releases array<long>, _mix_deadlines array<long>, _mix_slots array<long>"


def exact_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights as decimals; equal ones if all weights are 0. Weights must be finite numbers, or ValueError names those that are not."""
    if odd := [s for s, w in weights.items() if not math.isfinite(w)]:
        raise ValueError(f"weights that are no finite numbers: {odd[:5]}")
    given = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    if not any(given.values()):
        given = dict.fromkeys(weights, Fraction(1))
    scale = math.lcm(*(x.denominator for x in given.values()))
    whole = {s: int(x * scale) for s, x in given.items()}
    common = math.gcd(*whole.values())
    return {s: x // common for s, x in whole.items()}


def pfair(shares: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[int, str, int, int, int]]:
    """(slot, source, block, release, deadline) of all blocks by slot, earliest deadline first among released blocks.

    A source that is used up leaves its slots to blocks that are released by then, or else to sources without a share,
    which run at no other time, in the order of their names. Slots that nobody can use stay empty.
    """
    total = sum(shares.values())
    waiting = [(0, s, 0) for s in shares if shares[s] and blocks[s]]
    heapq.heapify(waiting)
    rest = ((s, k) for s in sorted(shares) if not shares[s] for k in range(blocks[s]))
    ready: list[tuple[int, str, int, int]] = []
    for t in count():
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // shares[s]), s, k, release))
        if ready:
            due, s, k, release = heapq.heappop(ready)
            yield t, s, k, release, due
            if k + 1 < blocks[s]:
                heapq.heappush(waiting, ((k + 1) * total // shares[s], s, k + 1))
        elif (idle := next(rest, None)) is not None:
            yield t, *idle, 0, t + 1
        elif not waiting:
            return


def pfair_period(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of the blocks of each source in one period of sum(shares) slots."""
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for t, s, *_ in pfair(shares, shares):
        slots[s].append(t)
    return slots


def written_plan(spark: SparkSession, shares: Mapping[str, int], blocks: Mapping[str, int]) -> DataFrame:
    """The schedule of all blocks in the shared folder, in rows of ``RUN`` blocks of a source."""
    total = sum(shares.values())
    far = [s for s in shares if shares[s] and -(-blocks[s] * total // shares[s]) >= 1 << 63]
    if far:
        raise ValueError(f"weights so small that slots pass 64 bits: {far[:5]}")
    path = new_path(spark, "mixing-plan")
    open_: dict[str, tuple[list, list, list]] = {s: ([], [], []) for s in shares}
    done: list[dict] = []
    names = ("_mix_source", "_mix_run", "_mix_releases", "_mix_deadlines", "_mix_slots")

    def write() -> None:  # as JSON in the query itself
        rows = F.from_json(F.lit(json.dumps(done)), f"array<struct<{STRUCT}>>")
        spark.range(1).select(F.inline(rows)).coalesce(1).write.mode("append").parquet(path)
        done.clear()

    for t, s, k, release, due in pfair(shares, blocks):
        for own, x in zip(open_[s], (release, due, t)):
            own.append(x)
        if (k + 1) % RUN == 0 or k + 1 == blocks[s]:
            done.append(dict(zip(names, (s, k // RUN, *open_[s]))))
            open_[s] = ([], [], [])
            if len(done) * RUN >= HELD:
                write()
    if done:
        write()
    return spark.read.schema(PLAN).parquet(path)


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, block_bytes: int = 1 << 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Give each document its place in a mixture of the sources; every document gets one.

    ``weights``: target weight by source; a source that it leaves out or gives 0 runs only in slots that no other can use.
    Without it, a source's weight is its size in bytes to the ``power``. Of more than ``MOST_SOURCES`` sources, none is planned: ValueError
    asks for them to be grouped. The number of documents is not bounded. The driver plans a few hundred
    thousand blocks a second, and raises ValueError for weights so small that slots pass 64 bits, or that are no finite numbers.

    Returns the columns of ``docs`` (those named like a result column are replaced) and ``block`` (of its
    source, from 0), ``release``, ``deadline`` (slot numbers; the block runs in [release, deadline)),
    ``slot`` and ``block_offset`` (bytes of the block before the document). (slot, block_offset) is the
    order of the mixture. As long as a source is not used up, it has had its weight's share of the slots
    to within less than one block, however many those are; later slots may stay empty. A document is in the block where it starts, so one longer than a block leaves
    its source's next blocks empty.

    Null sources are a source of their own. Null or empty texts count one byte. An empty table gives
    an empty result. Rows that repeat an id follow each other in either order.
    A source's documents are spread over many buckets by a hash of the id, and offsets are summed in two
    steps, so a source with a third of all rows is no larger for any task than the others.
    """
    placed = _placed(docs, weights, power, block_bytes, seed, id_col, text_col, source_col)
    return placed.select(*(F.col("_mix_row").getField(c).alias(c) for c in docs.columns if c not in COLUMNS), *COLUMNS)


def _placed(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, block_bytes: int = 1 << 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as one column ``_mix_row``, in which no name can clash, beside ``COLUMNS``."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    bits = max(4, (parts(spark, 4) - 1).bit_length())
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_mix_row"),
        F.col(id_col).alias("_mix_id"),
        key.alias("_mix_source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("_mix_size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_mix_hash"),
    ).withColumn("_mix_bucket", F.shiftrightunsigned("_mix_hash", 64 - bits))
    totals = rows.groupBy("_mix_source", "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_total"))
    found = totals.groupBy("_mix_source").agg(F.sum("_mix_total")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    sizes = {r[0]: r[1] for r in found}
    if weights is None:
        wanted = {s: float(n) ** power for s, n in sizes.items()}
    else:
        given = {s: float(weights.get(s[1:] if s else None, 0)) for s in sizes}
        wanted = {s: w if math.isnan(w) else max(0.0, w) for s, w in given.items()}
    shares = exact_parts(wanted) if wanted else {}
    plan = written_plan(spark, shares, {s: (n - 1) // block_bytes + 1 for s, n in sizes.items()}) if wanted else spark.createDataFrame([], PLAN)

    earlier = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_mix_source", "_mix_bucket", "_mix_total", F.coalesce(F.sum("_mix_total").over(earlier), F.lit(0)).alias("_mix_base"))
    base = base.withColumns({"_mix_first": F.expr(f"_mix_base div {block_bytes}"), "_mix_last": F.expr(f"(_mix_base + _mix_total - 1) div {block_bytes}")})
    # each bucket gets the plan of its own blocks, so that rows meet it where they are
    own = base.withColumn("_mix_run", F.explode(F.expr(f"sequence(_mix_first div {RUN}, _mix_last div {RUN})"))).join(plan, ["_mix_source", "_mix_run"])
    own = own.groupBy("_mix_source", "_mix_bucket", "_mix_base", "_mix_first", "_mix_last").agg(F.array_sort(F.collect_list(F.struct("_mix_run", "_mix_releases", "_mix_deadlines", "_mix_slots"))).alias("_mix_runs"))
    cut = lambda c: F.expr(f"slice(flatten(_mix_runs.{c}), cast(_mix_first % {RUN} + 1 as int), cast(_mix_last - _mix_first + 1 as int))").alias(c)
    own = own.select("_mix_source", "_mix_bucket", "_mix_base", "_mix_first", *(cut(c) for c in ("_mix_releases", "_mix_deadlines", "_mix_slots")))
    inside = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_hash", "_mix_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_mix_before", F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))).join(own, ["_mix_source", "_mix_bucket"])
    placed = placed.withColumn("_mix_start", F.col("_mix_base") + F.col("_mix_before")).withColumn("block", F.expr(f"_mix_start div {block_bytes}"))
    at = "cast(block - _mix_first + 1 as int)"
    placed = placed.withColumns({
        "release": F.expr(f"element_at(_mix_releases, {at})"),
        "deadline": F.expr(f"element_at(_mix_deadlines, {at})"),
        "slot": F.expr(f"element_at(_mix_slots, {at})"),
        "block_offset": F.expr(f"_mix_start - block * {block_bytes}"),
    })
    return placed.select("_mix_row", *COLUMNS)


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The same documents and columns, sorted into the order of the mixture; written out, their files are in that order.

    Columns named like those of a mixture keep their values. Rows with a null id, text or source are in it as others are.
    """
    mixed = _placed(docs, **options).orderBy("slot", "block_offset")
    return mixed.select(*(F.col("_mix_row").getField(c).alias(c) for c in docs.columns))
