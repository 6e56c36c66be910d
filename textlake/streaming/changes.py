"""Live refresh: a stream of file events becomes settled intents and then a new catalog state.

The same functions take batch and streaming DataFrames of changes (seq, path, dest_path, kind,
is_directory, ts).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.operators.library import SUPPORTED, extension

GAP = "2 seconds"
#: Documents after which a rebuild publishes what it has.
PUBLISH_DOCS = 100
#: Milliseconds that a path must rest until its changes settle by the clock.
REST_MS = 2000
#: Stands for a time or number that isn't known: before all others.
FIRST = -(2**63)


def change_stream(changes: DataFrame) -> DataFrame:
    """(seq, ts, path, intent): a move deletes the old path and changes the new one; directories and
    changes of unsupported files are ignored."""
    one = lambda p, intent: F.struct(F.col(p).alias("path"), F.lit(intent).alias("intent"))
    acts = F.when(F.col("kind") == "moved", F.array(one("path", "delete"), one("dest_path", "change"))).when(F.col("kind") == "deleted", F.array(one("path", "delete"))).otherwise(F.array(one("path", "change")))
    rows = changes.where(~F.coalesce("is_directory", F.lit(False))).select("seq", "ts", F.inline(acts))
    return rows.where((F.col("intent") == "delete") | extension("path").isin(*SUPPORTED))


def latest_intent(intents: DataFrame, gap: str = GAP) -> DataFrame:
    """(path, session_start, fires_at, intent, touches): touches of a path that follow each other within
    the gap settle together, and the last one tells what to do.  Streams need a watermark on ts."""
    rows = intents.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("intent", F.struct("ts", "seq")).alias("intent"), F.count("*").alias("touches"))
    return rows.select("path", F.col("w.start").alias("session_start"), F.col("w.end").alias("fires_at"), "intent", "touches")


def clock_intents(intents: DataFrame, rest_ms: int = REST_MS) -> DataFrame:
    """As ``latest_intent``, for streams alone and by the clock in place of event time, so the last event
    needs no later one to settle: (path, session_start, fires_at, intent, touches).

    A path whose last touch is a change fires in the first trigger after it was left alone for rest_ms; one
    whose last touch is a delete fires in the trigger that brought it.  Last is by ts, then seq (null before
    all others), then delete before change at ties; a touch that comes in later but is older counts, and
    restarts the rest, without changing the intent.  Paths that are null are left out.  The state is one
    small row a path that hasn't settled.
    """

    def settle(key, parts, state):
        now = state.getCurrentProcessingTimeMs()
        fire = lambda first, intent, touches: pd.DataFrame({"path": [key[0]], "first": [first], "fires": [now], "intent": [intent], "touches": [touches]})
        if state.hasTimedOut:
            first, intent, _, _, touches = state.get
            state.remove()
            yield fire(first, intent, touches)
            return
        first, intent, at, seq, touches = state.get if state.exists else (now, "", FIRST, FIRST, 0)
        last = (at, seq, intent)
        for part in parts:
            top = part.sort_values(["at", "seq", "intent"]).iloc[-1]
            last, touches = max(last, (int(top["at"]), int(top["seq"]), top["intent"])), touches + len(part)
        if last[2] == "delete":
            if state.exists:
                state.remove()
            yield fire(first, last[2], touches)
        else:
            state.update((first, last[2], last[0], last[1], touches))
            state.setTimeoutDuration(rest_ms)

    rows = intents.where("path is not null").select("path", "intent", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(FIRST)).alias("at"), F.coalesce("seq", F.lit(FIRST)).alias("seq"))
    out = rows.groupBy("path").applyInPandasWithState(
        settle, "path string, first long, fires long, intent string, touches long", "first long, intent string, at long, seq long, touches long", "append", "ProcessingTimeTimeout"
    )
    return out.select("path", F.timestamp_millis("first").alias("session_start"), F.timestamp_millis("fires").alias("fires_at"), "intent", "touches")


def ticks(changes: DataFrame) -> DataFrame:
    """The stream of changes with a source beside it that ticks each second and adds no row: triggers find
    something new, so timers fire after a restart too while nothing happens."""
    clock = changes.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
    return changes.unionByName(clock.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in changes.schema)))


def debounce_changes(intents: DataFrame, gap: str = GAP) -> DataFrame:
    """Changes alone: (path, session_start, fires_at, touches)."""
    rows = intents.where("intent = 'change'").groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("touches"))
    return rows.select("path", F.col("w.start").alias("session_start"), F.col("w.end").alias("fires_at"), "touches")


def final_intents(settled: DataFrame) -> DataFrame:
    """The last settled intent of each path in a batch."""
    return settled.groupBy("path").agg(F.max_by("intent", "fires_at").alias("intent"), F.max("fires_at").alias("fires_at"))


def apply_changes(files: DataFrame, settled: DataFrame) -> DataFrame:
    """files (path, status, …) after a batch: deleted paths go first, changed ones are pending, new ones
    are added as pending."""
    last = final_intents(settled)
    left = files.join(last.where("intent = 'delete'").select("path"), "path", "left_anti")
    changed = last.where("intent = 'change'").select("path", F.lit(True).alias("_hit"))
    both = left.join(changed, "path", "full_outer")
    rest = [c for c in files.columns if c not in ("path", "status")]
    return both.select("path", F.when(F.col("_hit"), "pending").otherwise(F.col("status")).alias("status"), *rest)


def timed_publish(done: DataFrame, every: str = GAP, docs: int = PUBLISH_DOCS) -> DataFrame:
    """done (seq, ts) of documents that were loaded -> (window_start, part, docs, upto_seq): a snapshot for
    each window of ``every``, and inside a window one for each ``docs`` documents."""
    rows = done.select("seq", F.window("ts", every).start.alias("window_start"))
    place = F.row_number().over(Window.partitionBy("window_start").orderBy("seq")) - 1
    rows = rows.withColumn("part", F.floor(place / docs).cast("int"))
    return rows.groupBy("window_start", "part").agg(F.count("*").alias("docs"), F.max("seq").alias("upto_seq"))


def run_live(changes: DataFrame, load: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str, gap: str = GAP, late: str = "10 seconds", every: str | None = GAP):
    """Starts the live query: each micro-batch of settled intents is applied to what ``load`` returns and
    given to ``publish``, which writes one snapshot.  ``every`` None takes what is there and stops."""
    settled = latest_intent(change_stream(changes).withWatermark("ts", late), gap)

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            publish(apply_changes(load(), df), number)

    out = settled.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def pending_drain(queue: DataFrame, recognized: DataFrame, partial: DataFrame, files: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """One turn over queue (id, sha1, page_count, attempts): (states, pages).

    A file whose content another indexed file has takes that file's text.  Else pages recognized now (id,
    page, text) are added to those of earlier turns, partial (id, page, text); with all of page_count the
    file is indexed, with some it waits as partial, and without text it waits until its attempts are used
    up, then it is an error.  states: (id, attempts, status, source, twin_id, done, error); pages: (id,
    page, text), those to keep for the next turn or to save.
    """
    twins = files.where("status = 'indexed' and full_text is not null").groupBy("sha1").agg(F.min("id").alias("twin_id"))
    rows = queue.join(twins, "sha1", "left").withColumn("attempts", F.col("attempts") + 1)
    new = recognized.where(F.trim("text") != "").select("id", "page", "text", F.lit(0).alias("age"))
    both = new.union(partial.select("id", "page", "text", F.lit(1).alias("age")))
    pages = both.groupBy("id", "page").agg(F.min_by("text", "age").alias("text"))
    pages = pages.join(rows.where("twin_id is null").select("id"), "id", "left_semi")
    have = pages.groupBy("id").agg(F.count("*").alias("done"))
    rows = rows.join(have, "id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    twin, whole = F.col("twin_id").isNotNull(), F.col("done") >= F.col("page_count")
    status = F.when(twin | whole, "indexed").when((F.col("done") == 0) & (F.col("attempts") >= most), "error").otherwise("pending_ocr")
    source = F.when(twin, "twin").when(whole, "ocr").when(F.col("done") > 0, "ocr_partial")
    error = F.when(status == "error", "no text after all attempts")
    return rows.select("id", "attempts", status.alias("status"), source.alias("source"), "twin_id", "done", error.alias("error")), pages
