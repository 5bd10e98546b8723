"""Exact deduplication with disk-backed keyed state, in DataFrame and SQL functions only.

A Structured Streaming aggregation in RocksDB reads the digests of all texts and keeps, for each
digest and without expiry, the identifier of the row that stays, the number of rows and the locator of
the kept content. A row whose digest is known there is a hit; hits are compared by their full bytes,
and texts that only share a digest are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import new_path, stored, write_table
from .common import ascii_lower

#: Bits of the filter that holds the digests that came more than once (8 MB, whatever their number), and of each of its rows.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15
#: Settings of the keyed state while the stream runs.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def keyed_state(spark, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Stream the written table of (digest, id, locator) at ``path`` through keyed state.

    Returns what the state holds: (digest, keep_id, group_size, locator), one row per digest. The state
    is on the executors' disks, with its snapshots in the shared folder, and has no time to live.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    at = new_path(spark, "exact-state")
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        state = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
            .groupBy("digest").agg(F.max("id"), F.count(F.lit(1)), F.max_by("locator", "id"))
        )
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = spark.read.format("statestore").load(at)
    keep_id, group_size, locator, *_ = (F.col("value").getField(x) for x in held.schema["value"].dataType.names)
    return held.select(F.col("key.digest").alias("digest"), keep_id.alias("keep_id"), group_size.alias("group_size"), locator.alias("locator"))


def maybe_in(rows: DataFrame, keys: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``name`` is in ``keys``, and by chance some others: a bitmap of hashed keys is sent to all tasks, of the same size for any number of keys."""
    bit = F.pmod(F.xxhash64(name), F.lit(bits))
    place = lambda c: c.select("*", F.expr(f"_bit div {ROW_BITS}").alias("_row"), F.expr(f"cast(_bit % {ROW_BITS} as int)").alias("_at"))
    marks = place(keys.select(bit.alias("_bit"))).groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_map"))
    found = place(rows.withColumn("_bit", bit)).join(F.broadcast(marks), "_row")
    byte = F.conv(F.hex(F.expr("substring(_map, _at div 8 + 1, 1)")), 16, 10).cast("int")
    return found.where(F.getbit(byte, F.col("_at") % 8) == 1).select(*rows.columns)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=lambda text: F.sha2(text, 256), filter_bits: int = FILTER_BITS) -> DataFrame:
    """Which rows of ``docs`` have the same text, and which of them stays.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts
    the row with the largest id stays. Returns one row per row of ``docs``: id, ``digest`` of the
    normalised text, ``keep_id``, ``group_size`` (rows with this text), ``kept`` and ``locator``.

    Null ids are smaller than any other; where all are null, ``keep_id`` is null and the rows stay.
    Rows that repeat both id and text each count, and each has ``kept`` true if its id stays.
    Other columns of ``docs`` are not looked at. An empty table gives an empty result.

    ``locator`` is the file and block that the kept text was read from (empty if it was in no file; null where texts share a digest).

    Digests meet in one group of the state each; the map side aggregates first, so that a text which
    a third of all rows share sends one row per task, and so do the full bytes of hits. Only texts of digests that came
    more than once need be compared: a bitmap of fixed size (``filter_bits``) tells most others before the shuffle and none of them, and a text that it lets through by chance costs work, not
    rightness. The plan is the same at every size.
    ``digest`` may be any function of the text: equal digests of different texts are found by their bytes and parted.
    """
    spark = docs.sparkSession
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    locator = F.concat_ws("#", F.input_file_name(), F.when(F.input_file_name() != "", F.input_file_block_start()).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("body"), locator.alias("locator"))
    rows = rows.withColumn("digest", digest(F.col("body")).cast("string"))
    path = new_path(spark, "exact-digests")
    slim = write_table(rows.select("digest", "id", "locator"), path)
    index = stored(keyed_state(spark, path, slim.schema), "exact-index")

    # Hits: every row of a digest that came more than once, by its full bytes.
    texts = rows.select("id", "digest", "body")
    bodies = maybe_in(texts, index.where("group_size > 1").select("digest"), "digest", filter_bits)
    bodies = stored(bodies.groupBy("digest", "body").agg(F.max("id").alias("own_keep"), F.count(F.lit(1)).alias("own_size")), "exact-bodies")
    clashes = bodies.groupBy("digest").count().where("count > 1").select("digest")

    found = slim.select("id", "digest").join(index, "digest")
    if clashes.limit(1).count():
        apart = texts.join(clashes, "digest", "left_semi").join(bodies, ["digest", "body"]).select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "own_keep", "own_size").distinct()
        found = found.join(apart, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")
        found = found.withColumn("keep_id", F.when(F.col("own_digest").isNull(), F.col("keep_id")).otherwise(F.col("own_keep"))).withColumn("group_size", F.coalesce("own_size", "group_size"))
        found = found.withColumn("locator", F.when(F.col("own_digest").isNull(), F.col("locator")))
    return found.select(F.col("id").alias(id_col), "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "locator")


def keep_last_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns.

    Each row is judged by its id and its text. Of rows that repeat both, the one whose text is first as it is written stays;
    where those are equal too, any one.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), "digest").distinct()
    whole = lambda id: [id.isNull().alias("no_id"), F.coalesce(id, F.lit(0).cast("long")).alias("id")]  # noqa: E731, A002
    kept = kept.select(*whole(F.col("id")), "digest")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the row is one column, so that no name of it can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *whole(F.col(id_col).cast("long")), F.sha2(ascii_lower(text), 256).alias("digest"))
    # the keys of the join are those of the window, so the rows are shuffled once
    own = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    first = F.row_number().over(Window.partitionBy("no_id", "id", "digest").orderBy(own))
    return rows.join(kept, ["no_id", "id", "digest"], "left_semi").withColumn("place", first).where("place = 1").select("row.*")
