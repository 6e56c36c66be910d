"""Queries of live refresh: the batch twins of the streaming functions, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import search as X
from textlake.plans.fixtures import read
from textlake.registry import query
from textlake.sources.tables import new_path
from textlake.streaming import changes as G
from textlake.streaming.live import apply_batch, live_store

CHANGES = """changes AS (SELECT event_id AS seq, ts, '/lib/u' || user_id || '.txt' AS path, '/lib/m' || user_id || '.txt' AS dest_path,
  CASE WHEN event_type = 'error' THEN 'deleted' WHEN event_type = 'purchase' THEN 'moved' ELSE 'modified' END AS kind, event_id % 17 = 0 AS is_directory FROM events),
intents AS (SELECT seq, ts, path, 'delete' AS intent FROM changes WHERE kind IN ('deleted', 'moved') AND NOT is_directory UNION ALL SELECT seq, ts, dest_path, 'change' FROM changes WHERE kind = 'moved' AND NOT is_directory
  UNION ALL SELECT seq, ts, path, 'change' FROM changes WHERE kind = 'modified' AND NOT is_directory)"""


def _islands(src: str) -> str:
    return f"""steps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM {src} WINDOW w AS (PARTITION BY path ORDER BY ts)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts RANGE UNBOUNDED PRECEDING) AS island FROM steps),
settled AS (SELECT path, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS fires_at, arg_max(intent, (ts, seq)) AS intent, count(*) AS touches FROM islands GROUP BY path, island)"""


def changes(spark, sf):
    return _changes(read(spark, sf, "events"))


def _changes(events):
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "moved").otherwise("modified")
    name = lambda p: F.concat(F.lit(f"/lib/{p}"), F.col("user_id").cast("string"), F.lit(".txt"))
    return events.select(F.col("event_id").alias("seq"), "ts", name("u").alias("path"), name("m").alias("dest_path"), kind.alias("kind"), (F.col("event_id") % 17 == 0).alias("is_directory"))


def _times(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in df.columns if c in ("ts", "session_start", "fires_at")})


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


@query("change_stream", f"WITH {CHANGES} SELECT seq, path, intent, {_stamp('ts')} FROM intents")
def change_stream(spark, sf):
    return _times(G.change_stream(changes(spark, sf)))


@query("debounce_changes", f"WITH {CHANGES}, touched AS (SELECT * FROM intents WHERE intent = 'change'), {_islands('touched')} SELECT path, {_stamp('session_start')}, {_stamp('fires_at')}, touches FROM settled")
def debounce_changes(spark, sf):
    return _times(G.debounce_changes(G.change_stream(changes(spark, sf)), "30 minutes"))


@query("latest_intent", f"WITH {CHANGES}, {_islands('intents')} SELECT path, {_stamp('session_start')}, {_stamp('fires_at')}, intent, touches FROM settled")
def latest_intent(spark, sf):
    return _times(G.latest_intent(G.change_stream(changes(spark, sf)), "30 minutes"))


@query("clock_intents", f"WITH {CHANGES} SELECT path, arg_max(intent, (ts, seq)) AS intent, count(*) AS touches FROM intents GROUP BY path")
def clock_intents(spark, sf):
    """The stream of all events at once, settled by the clock: deletes at once, changes after a rest."""
    source = read(spark, sf, "events")
    out = new_path(spark, "clock")
    spark.createDataFrame([], "path string, intent string, touches long").write.parquet(out)
    if source.isEmpty():
        return spark.read.parquet(out)
    # a pattern, since a stream takes a single file for a folder
    events = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parque[t]")
    settled = G.clock_intents(G.change_stream(_changes(events)), 1000).select("path", "intent", "touches")
    append = lambda df, number: df.write.mode("append").parquet(out)
    run = settled.writeStream.option("checkpointLocation", new_path(spark, "clock-state")).foreachBatch(append).trigger(processingTime="1 second").start()
    while run.isActive and not ((seen := run.lastProgress) and seen.stateOperators and seen.stateOperators[0].numRowsTotal == 0):
        run.awaitTermination(1)
    run.stop()
    return spark.read.parquet(out)


APPLIED = f"""{CHANGES}, {_islands('intents')}, last_ AS (SELECT path, arg_max(intent, fires_at) AS intent FROM settled GROUP BY path),
known AS (SELECT DISTINCT '/lib/u' || user_id || '.txt' AS path, 'indexed' AS status FROM events WHERE user_id % 3 <> 0)"""


@query("apply_changes", f"WITH {APPLIED} SELECT coalesce(k.path, l.path) AS path, CASE WHEN l.intent = 'change' THEN 'pending' ELSE k.status END AS status FROM known k FULL JOIN last_ l ON k.path = l.path WHERE l.intent IS NULL OR l.intent = 'change'")
def apply_changes(spark, sf):
    settled = G.latest_intent(G.change_stream(changes(spark, sf)), "30 minutes")
    known = read(spark, sf, "events").where("user_id % 3 <> 0").select(F.concat(F.lit("/lib/u"), F.col("user_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("indexed").alias("status")).distinct()
    return G.apply_changes(known, settled)


#: Ids of a bucket of the small catalog.
FEW_IDS = 256


@query("apply_changes_index", f"""WITH {APPLIED}, old AS (SELECT DISTINCT user_id AS id, '/lib/u' || user_id || '.txt' AS path FROM events),
changed AS (SELECT path FROM last_ WHERE intent = 'change'),
new AS (SELECT path, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY path) AS id FROM changed ANTI JOIN old USING (path)),
now AS (SELECT id, path, CASE WHEN l.intent = 'change' THEN 'changed ' ELSE '' END AS lead FROM old LEFT JOIN last_ l USING (path) WHERE l.intent IS DISTINCT FROM 'delete' UNION ALL SELECT id, path, 'changed ' FROM new),
texts AS (SELECT id, path, lead || 'text of ' || (CAST(regexp_extract(path, '[0-9]+') AS BIGINT) % CASE WHEN lead = '' THEN 50 ELSE 30 END) AS text FROM now)
SELECT term, id AS doc_id, path, count(*) AS tf FROM (SELECT unnest(string_split(text, ' ')) AS term, id, path FROM texts) GROUP BY term, id, path""")
def apply_changes_index(spark, sf):
    """Postings and paths of the live index after a batch of events: new files and targets of moves have
    ids and postings, deleted ones are gone."""
    settled = G.latest_intent(G.change_stream(changes(spark, sf)), "30 minutes")
    n = F.regexp_extract("path", "[0-9]+", 0).cast("long")
    text = lambda lead, k: F.concat(F.lit(lead), (n % k).cast("string"))
    base = F.element_at(F.split("path", "/"), -1)
    users = read(spark, sf, "events").select(F.col("user_id").alias("id"), F.concat(F.lit("/lib/u"), F.col("user_id").cast("string"), F.lit(".txt")).alias("path")).distinct()
    store = live_store(spark, new_path(spark, "live"))
    write = store.begin(0)
    docs = users.select(F.col("id").alias("doc_id"), "path", base.alias("name"), text("text of ", 50).alias("text"))
    buckets = sorted(r[0] for r in users.select(X.bucket_of("id", FEW_IDS)).distinct().collect())
    X.replace_documents(write, docs, docs.select("doc_id").limit(0), buckets, FEW_IDS)
    write.put("files", users.select("id", "path", F.lit("indexed").alias("status"), F.lit(None).alias("error"), X.bucket_of("id", FEW_IDS)).repartition("bucket"), ("id",))
    write.publish(buckets)
    load = lambda paths: paths.select("path", base.alias("name"), text("changed text of ", 30).alias("text"), F.lit(None).cast("string").alias("error"))
    index = apply_batch(store, settled, load, 1, FEW_IDS)
    return index.posts.where("field = 'content'").join(index.docs.select("doc_id", "path"), "doc_id").select("term", "doc_id", "path", "tf")


@query("timed_publish", f"""WITH d AS (SELECT event_id AS seq, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events), p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY w ORDER BY seq) - 1) / 5.0) AS INTEGER) AS part FROM d)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, part, count(*) AS docs, max(seq) AS upto_seq FROM p GROUP BY w, part""")
def timed_publish(spark, sf):
    """The events are an hour and more apart from each other; so are the snapshots, of five at most."""
    done = read(spark, sf, "events").select(F.col("event_id").alias("seq"), "ts")
    out = G.timed_publish(done, "1 hour", 5)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("pending_drain", """WITH docs AS (SELECT doc_id, sha1(text) AS sha1, CAST(doc_id % 3 + 1 AS INTEGER) AS page_count, CAST(doc_id % 4 AS INTEGER) AS attempts, text FROM documents),
twins AS (SELECT sha1, min(doc_id) AS twin_id FROM docs WHERE doc_id % 2 = 0 GROUP BY sha1),
q AS (SELECT * FROM docs LEFT JOIN twins USING (sha1) WHERE doc_id % 2 = 1),
pages AS (SELECT doc_id AS id, unnest(range(1, page_count + 1)) AS page FROM docs),
got AS (SELECT DISTINCT id, page FROM (SELECT id, page FROM pages WHERE (id + page) % 5 < 2 UNION ALL SELECT id, page FROM pages WHERE (id + page) % 7 = 3)),
have AS (SELECT id, count(*) AS done FROM got GROUP BY id),
s AS (SELECT doc_id AS id, attempts + 1 AS attempts, twin_id, CASE WHEN twin_id IS NULL THEN coalesce(done, 0) ELSE 0 END AS done, page_count FROM q LEFT JOIN have ON have.id = doc_id)
SELECT id, attempts, twin_id, done, CASE WHEN twin_id IS NOT NULL OR done >= page_count THEN 'indexed' WHEN done = 0 AND attempts >= 3 THEN 'error' ELSE 'pending_ocr' END AS status,
  CASE WHEN twin_id IS NOT NULL THEN 'twin' WHEN done >= page_count THEN 'ocr' WHEN done > 0 THEN 'ocr_partial' END AS source,
  CASE WHEN twin_id IS NULL AND done = 0 AND attempts >= 3 THEN 'no text after all attempts' END AS error FROM s""")
def pending_drain(spark, sf):
    """Odd documents wait; even ones are indexed and may be their twins.  Pages come from an earlier turn
    and from this one."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha1(F.encode("text", "UTF-8")).alias("sha1"), (F.col("doc_id") % 3 + 1).cast("int").alias("page_count"), (F.col("doc_id") % 4).cast("int").alias("attempts"), "text")
    pages = docs.select("id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"), F.concat("text", F.lit(" ")).alias("text"))
    now = pages.where("(id + page) % 5 < 3").withColumn("text", F.when((F.col("id") + F.col("page")) % 5 == 2, " ").otherwise(F.concat(F.lit("x"), "text")))
    early = pages.where("(id + page) % 7 = 3")
    files = docs.where("id % 2 = 0").select("id", "sha1", F.lit("indexed").alias("status"), F.col("text").alias("full_text"))
    states, _ = G.pending_drain(docs.where("id % 2 = 1").drop("text"), now, early, files)
    return states
