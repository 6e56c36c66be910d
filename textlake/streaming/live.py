"""The live index: settled intents of a stream change catalog and search index, as one version a batch.

Catalog rows and all index tables of a batch are published by one manifest, which names the number of
the batch; a batch that is run again after a failure finds its number there and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.operators.catalog import MAX_ERROR, numbered
from textlake.operators.search import BUCKET_IDS, TABLES, Index, bucket_of, replace_documents, upsert_index
from textlake.sources.snapshots import Store
from textlake.sources.tables import stored
from textlake.streaming.changes import GAP, REST_MS, change_stream, clock_intents, final_intents, latest_intent, ticks

FILES = "id long, path string, status string, error string"


def live_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES | {"files": FILES})


def apply_batch(store: Store, settled: DataFrame, load: Callable[[DataFrame], DataFrame], batch: int, ids: int = BUCKET_IDS) -> Index:
    """The version after a batch of settled intents (path, intent, fires_at).

    Deleted paths leave catalog and index.  Changed ones are read by ``load``: of a table of paths, rows
    (path, name, text, error, and columns of the docs table) for those that are there.  Known paths keep
    their ids, new ones get ids above all others in the order of their paths.  A text that couldn't be
    read stays in the catalog as an error and out of the index; a path that is gone by now is deleted.
    """
    base = store.open()
    if base.batch >= batch:
        return Index(base, ids)
    last = stored(final_intents(settled).select("path", "intent"), "intents")
    known = base.read("files").select("id", "path")
    hit = last.join(known, "path", "left")
    found = load(last.where("intent = 'change'").select("path"))
    work = stored(hit.join(found, "path", "left"), "work")
    top = base.read("files").agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))  # one row
    is_there = F.col("text").isNotNull() | F.col("error").isNotNull()
    new = numbered(work.where((F.col("intent") == "change") & F.col("id").isNull() & is_there), "path", "_k").join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_k")).drop("_top", "_k")
    rows = stored(work.where("id is not null").unionByName(new), "rows").withColumnRenamed("id", "doc_id")
    change = rows.where(F.col("intent") == "change")
    good = change.where(F.col("error").isNull() & F.col("text").isNotNull())
    state = change.where(is_there).select(F.col("doc_id").alias("id"), "path", F.when(F.col("error").isNull(), "indexed").otherwise("error").alias("status"), F.substring("error", 1, MAX_ERROR).alias("error"), bucket_of("doc_id", ids))
    touched = sorted(r.bucket for r in rows.select(bucket_of("doc_id", ids)).distinct().collect())
    write = store.begin(batch)
    replace_documents(write, good.drop("intent", "error"), rows.select("doc_id"), touched, ids)
    kept = base.read("files", touched).join(rows.select(F.col("doc_id").alias("id")), "id", "left_anti")
    write.put("files", kept.unionByName(state).repartition("bucket"), ("id",))
    return Index(write.publish(touched), ids)


def run_live_index(changes: DataFrame, store: Store, load: Callable[[DataFrame], DataFrame], checkpoint: str, ids: int = BUCKET_IDS, gap: str = GAP, late: str = "10 seconds", every: str | None = GAP):
    """Starts the live query over a stream of changes: a version for each micro-batch that settles a path.
    ``every`` None takes what is there and stops.  Events that are ignored still move the time on."""
    # a condition on ts keeps the filter of folders above the watermark
    timed = changes.withWatermark("ts", late).withColumn("is_directory", F.when(F.col("ts").isNull(), True).otherwise(F.coalesce("is_directory", F.lit(False))))
    settled = latest_intent(change_stream(timed), gap)

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            apply_batch(store, df, load, number, ids)

    out = settled.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def run_live_clock(changes: DataFrame, store: Store, load: Callable[[DataFrame], DataFrame], checkpoint: str, ids: int = BUCKET_IDS, rest_ms: int = REST_MS, every: str = "1 second"):
    """As ``run_live_index``, by the clock: a changed path settles when it was left alone for ``rest_ms``,
    a deleted one with the trigger that brings it, whether or not other events follow.  It runs until it
    is stopped; paths that had not settled by then settle after the next start."""
    settled = clock_intents(change_stream(ticks(changes)), rest_ms)

    def batch(df: DataFrame, number: int) -> None:
        rows = df.persist()  # the state is read and written once
        if not rows.isEmpty():
            apply_batch(store, rows, load, number, ids)
        rows.unpersist()

    return settled.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(processingTime=every).start()


def run_ingest(texts: DataFrame, store: Store, checkpoint: str, ids: int = BUCKET_IDS, every: str | None = GAP):
    """Starts the first load as a stream of texts (doc_id, name, text, …): what a micro-batch brought is
    published with it.  The source bounds a micro-batch (``maxFilesPerTrigger``: 100 files of one document
    are a version for each 100), the trigger the time between two versions."""
    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty() and store.open().batch < number:
            upsert_index(store, df, df.select("doc_id").limit(0), ids, number)

    out = texts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
