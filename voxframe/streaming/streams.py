"""Structured Streaming jobs. Each function takes a streaming (or batch) DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scratch import new_path
from ..operators.edits import UNDO_DEPTH


def _timed(log: DataFrame, late: str) -> DataFrame:
    """Event times as instants, with a watermark."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def edit_rate(log: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Edits of each operation in tumbling or sliding windows."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = _timed(log, late).groupBy(w.alias("w"), "operation").agg(F.count(F.lit(1)).alias("edits"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "operation", "edits")


def edit_sessions(log: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of edits on each layer, ended by a gap."""
    out = _timed(log, late).groupBy(F.session_window("ts", gap).alias("w"), "layer_name").agg(F.count(F.lit(1)).alias("edits"))
    return out.select("layer_name", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "edits")


def dedup_log(log: DataFrame, keys: tuple[str, ...] = ("operation", "label_id", "z_index", "layer_name", "ts"), late: str = "1 hour") -> DataFrame:
    """The log without repeated entries."""
    marked = _timed(log, late)
    return marked.dropDuplicatesWithinWatermark(list(keys)) if log.isStreaming else marked.dropDuplicates(list(keys))


def online_confidence(patches: DataFrame) -> DataFrame:
    """T4: mean confidence and number of writes of each voxel, as patches arrive."""
    return patches.groupBy("vol_id", "z", "y", "x").agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("written"))


def online_label_sizes(deltas: DataFrame) -> DataFrame:
    """T5: voxels of each label so far, from rows (label, delta)."""
    return deltas.groupBy("label").agg(F.sum("delta").alias("voxel_count"))


def closing(log: DataFrame, after: str = "30 days", time: str = "ts") -> DataFrame:
    """One more row, so long after the log's last that the watermark passes all of the log; its own window stays open and is never returned."""
    end = log.agg((F.max(time) + F.expr(f"INTERVAL {after}")).cast(log.schema[time].dataType).alias(time)).where(F.col(time).isNotNull())
    return log.unionByName(end, allowMissingColumns=True)


class _Undo(StatefulProcessor):
    """A layer's last edits, newest last, and the last entry seen."""

    def __init__(self, undo: str, depth: int):
        self.undo, self.depth = undo, depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stack = handle.getListState("stack", "seq long")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stack = [r[0] for r in self.stack.get()] if self.stack.exists() else []
        last, active = self.last.get()[0] if self.last.exists() else None, {}
        entries = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, operation in zip(entries.seq.tolist(), entries.operation.tolist()):
            late = last is not None and seq <= last
            if operation != self.undo:
                active[seq] = True
                if not late:  # a late edit counts, but nothing can take it back
                    stack = [*stack, seq][-self.depth :]
            elif stack and not late:
                active[stack.pop()] = False
            last = seq if last is None else max(last, seq)
        self.stack.put([(s,) for s in stack]) if stack else self.stack.clear()
        self.last.update((last,))
        yield pd.DataFrame({"layer_name": [key[0]] * len(active), "seq": list(active), "active": list(active.values())})

    def close(self) -> None:
        pass


def undo_stream(log: DataFrame, undo: str = "undo", depth: int = UNDO_DEPTH) -> DataFrame:
    """(layer_name, seq, active) as edits come in and are taken back, from a stream of (layer_name, seq, operation); the newest row of an edit counts.

    The state of a layer is a list of at most ``depth`` numbers. Entries of a batch are taken in their order; an undo that comes after later
    entries were seen is ignored, and an edit that does so counts but cannot be taken back.
    """
    entries = log.select("layer_name", F.col("seq").cast("long").alias("seq"), "operation")
    return entries.groupBy("layer_name").transformWithStateInPandas(_Undo(undo, depth), "layer_name string, seq long, active boolean", "Update", "None")


#: The state store that keyed state with lists needs.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class KeyedSink:
    """A table that holds the newest row of each key: batches of changed rows are merged into it.

    Keys are dealt over buckets, and each bucket has two slots. A batch reads the buckets that it touches, puts its rows in the place of those with the same keys, and
    writes them to the other slots; then it notes which slot counts. So the table follows the keys and not the batches, readers see whole batches, and a batch that
    runs again does the same again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.schema = StructType([*schema.fields, StructField("bucket", IntegerType())])

    def slots(self, before: int | None = None) -> dict[int, int]:
        """The slot of each bucket as of the last batch, or the last one before a given batch."""
        noted = []
        for half in (0, 1):
            try:
                noted += self.spark.read.schema("batch long, bucket int, slot int").parquet(f"{self.path}/noted-{half}").collect()
            except AnalysisException:  # not written yet
                continue
        batch = max((r.batch for r in noted if before is None or r.batch < before), default=None)
        return {r.bucket: r.slot for r in noted if r.batch == batch and r.bucket >= 0}

    def _read(self, slots: dict[int, int]) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for slot in (0, 1):
            own = [b for b, s in slots.items() if s == slot]
            if own:
                out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/slot-{slot}").where(F.col("bucket").isin(own)))
        return out

    def merge(self, changed: DataFrame, batch: int) -> None:
        """Put the rows of a batch, one for each key, in the place of those with the same keys."""
        changed = changed.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
        try:
            slots = self.slots(batch)
            touched = [r.bucket for r in changed.select("bucket").distinct().collect()]
            for target in (0, 1):
                own = [b for b in touched if 1 - slots.get(b, 1) == target]
                if own:
                    rows = changed.where(F.col("bucket").isin(own))
                    old = self._read({b: slots[b] for b in own if b in slots}).join(rows.select(*self.keys), self.keys, "left_anti")
                    rows.unionByName(old.select(*rows.columns)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/slot-{target}")
            noted = slots | {b: 1 - slots.get(b, 1) for b in touched}
            self.spark.createDataFrame([(batch, -1, -1), *((batch, b, s) for b, s in noted.items())], "batch long, bucket int, slot int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/noted-{batch % 2}")
        finally:
            changed.unpersist()

    def read(self) -> DataFrame:
        return self._read(self.slots()).drop("bucket")


def replayed(spark: SparkSession, rows: DataFrame, job, mode: str = "append", keys: Sequence[str] = (), conf: dict[str, str] | None = None, files_per_batch: int | None = None) -> DataFrame:
    """The result of a streaming job over rows that are written as files and read as a stream until no more are there.

    In append mode a batch adds its rows. In update mode it has the keys that changed, and a ``KeyedSink`` holds the newest row of each. ``conf`` is set while the
    stream runs.
    """
    source, sink = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    rows.write.parquet(source)
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        reader = spark.readStream.schema(rows.schema)
        stream = job((reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source))
        writer = stream.writeStream.option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).outputMode(mode)
        if mode == "append":
            writer.format("parquet").option("path", sink).start().awaitTermination()
            return spark.read.schema(stream.schema).parquet(sink)
        table = KeyedSink(spark, sink, stream.schema, keys)
        writer.foreachBatch(table.merge).start().awaitTermination()
        return table.read()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
