"""Undo with a bounded memory, in batch and from keyed state, and tables that batches are merged into."""

import random

import pytest

from voxframe.operators import edits
from voxframe.streaming import streams


def plain(entries, depth):
    """Edits in force, one entry after the other."""
    stacks, active = {}, set()
    for layer, seq, operation in sorted(entries, key=lambda e: e[1]):
        stack = stacks.setdefault(layer, [])
        if operation == "undo":
            if stack:
                active.discard((layer, stack.pop()))
        else:
            active.add((layer, seq))
            stack.append(seq)
            del stack[:-depth]
    return active


def log_of(n, share, seed, layers="ab"):
    rng = random.Random(seed)
    return [(rng.choice(layers), k, "undo" if rng.random() < share else "add") for k in range(n)]


@pytest.mark.parametrize("depth", [1, 3, 20])
@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_undo_is_bounded(spark, depth, share):
    entries = log_of(400, share, depth)
    d = spark.createDataFrame(entries, "layer_name string, seq long, operation string")
    assert {(r.layer_name, r.seq) for r in edits.active_edits(d, depth=depth).collect()} == plain(entries, depth)


def test_state_over_many_batches_equals_the_batch(spark, tmp_path):
    entries = log_of(300, 0.45, 9)
    source = str(tmp_path / "in")
    for k in range(5):  # files come in the order of their entries
        spark.createDataFrame(entries[60 * k : 60 * k + 60], "layer_name string, seq long, operation string").coalesce(1).write.mode("append").parquet(source)
    before = {k: spark.conf.get(k, None) for k in streams.ROCKSDB}
    for k, v in streams.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = streams.undo_stream(spark.readStream.schema("layer_name string, seq long, operation string").option("maxFilesPerTrigger", 1).parquet(source), depth=4)
        sink, batches = streams.KeyedSink(spark, str(tmp_path / "out"), stream.schema, ["layer_name", "seq"], 4), []
        run = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("update")
        run.foreachBatch(lambda df, n: (batches.append(n), sink.merge(df, n))).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(batches) == 5
    assert {(r.layer_name, r.seq) for r in sink.read().where("active").collect()} == plain(entries, 4)


def test_sink_follows_its_keys(spark, tmp_path):
    sink = streams.KeyedSink(spark, str(tmp_path / "sink"), spark.createDataFrame([], "k long, v long").schema, ["k"], 4)
    batch = lambda n: spark.createDataFrame([(k, 1000 * n + k) for k in range(n, n + 30)], "k long, v long")
    want = {}
    for n in range(6):
        sink.merge(batch(n), n)
        want |= {k: 1000 * n + k for k in range(n, n + 30)}
    assert {r.k: r.v for r in sink.read().collect()} == want
    sink.merge(batch(5), 5)  # a batch that runs again
    assert {r.k: r.v for r in sink.read().collect()} == want
    held = sum(spark.read.parquet(str(tmp_path / f"sink/slot-{s}")).count() for s in (0, 1))
    assert held <= 2 * len(want)
    sink.merge(spark.createDataFrame([], "k long, v long"), 6)
    assert {r.k: r.v for r in sink.read().collect()} == want
