"""Versions, upserts and the live index, on small folders."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from textlake.operators import match as M
from textlake.operators import search as X
from textlake.sources.snapshots import Store
from textlake.streaming import live as L

EVENT = "seq long, path string, dest_path string, kind string, is_directory boolean, ts timestamp"
DOC = "doc_id long, path string, name string, ext string, text string"


def rows(df, *but):
    return sorted(tuple(str(v) for v in r) for r in df.drop(*but).collect())


def tables_of(index):
    return {t: rows(getattr(index, t)) for t in X.TABLES}


def documents(spark, texts):
    return spark.createDataFrame([(i, f"/lib/f{i}.txt", f"f{i}.txt", ".txt", t) for i, t in texts.items()], DOC)


def hits(spark, index, word):
    return sorted(r.path for r in X.search(spark, [M.Query(1, word)], index).collect())


def test_store_versions_are_whole_and_old_ones_stay_readable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": "a long, b string"})
    frame = lambda data: spark.createDataFrame(data, "a long, b string, bucket int")
    assert store.versions() == [] and store.open().read("t").count() == 0
    w = store.begin(4)
    w.put("t", frame([(1, "x", 0), (2, "y", 1)]), ("a",))
    assert store.open().version == 0, "nothing is readable before the manifest"
    one = w.publish([0, 1])
    half = store.begin(5)
    half.put("t", frame([(9, "lost", 1)]), ("a",))  # a write that fails before it is published
    assert rows(store.open().read("t")) == [("1", "x", "0"), ("2", "y", "1")]
    w = store.begin(6)
    w.put("t", frame([(3, "z", 0)]), ("a",))
    two = w.publish([0])
    assert rows(two.read("t")) == rows(store.open().read("t")) == [("2", "y", "1"), ("3", "z", "0")]
    assert rows(one.read("t")) == rows(store.open(1).read("t")) == [("1", "x", "0"), ("2", "y", "1")]
    assert rows(two.read("t", [1])) == [("2", "y", "1")] and store.open().batch == 6
    w = store.begin()
    w.put("t", frame([]), ("a",))
    assert rows(w.publish([0]).read("t")) == [("2", "y", "1")]
    assert store.expire(1) == [1, 2] and store.versions() == [3] and rows(store.open().read("t")) == [("2", "y", "1")]
    assert not (tmp_path / "s" / "t" / "data=2").exists() and (tmp_path / "s" / "t" / "data=1").exists()


def test_upsert_equals_a_fresh_index_and_writes_touched_buckets_only(spark, tmp_path):
    old = {i: f"word{i} common שלום{i % 3} same same" for i in range(40)} | {41: "", 42: " - "}
    new = {i: t for i, t in old.items() if i not in (3, 4)} | {5: "changed text only", 17: "", 100: "a new one"}
    store = X.index_store(spark, str(tmp_path / "i"))
    first = X.rebuild_index(documents(spark, old), store, 10)
    changed = {i: t for i, t in new.items() if old.get(i) != t}
    after = X.upsert_index(store, documents(spark, changed), spark.createDataFrame([(3,), (4,), (77,)], "doc_id long"), 10)
    assert tables_of(after) == tables_of(X.build_index(documents(spark, new), 10))
    assert rows(after.stats) == rows(X.build_index(documents(spark, new), 10).stats)
    assert tables_of(first) == tables_of(X.build_index(documents(spark, old), 10)), "a reader of the first version still has it"
    for t in X.TABLES:
        written = {int(p.name.removeprefix("bucket=")) for p in (tmp_path / "i" / t / "data=2").glob("bucket=*")}
        assert written <= {0, 1, 7, 10} and written, "untouched buckets keep their files"
    assert hits(spark, after, "common") == sorted(f"/lib/f{i}.txt" for i in range(40) if i not in (3, 4, 5, 17))


def test_reader_during_a_rebuild_sees_the_old_version(spark, tmp_path):
    store = X.index_store(spark, str(tmp_path / "i"))
    X.rebuild_index(documents(spark, {1: "old words", 2: "old too"}), store, 10)
    seen = []

    def watched(paths):
        seen.append(hits(spark, X.Index(store.open(), 10), "old"))
        return paths

    write = store.begin()
    meta = X._meta(documents(spark, {1: "fresh words"}), 10)
    watched(meta)
    X._write_tables(write, meta.repartition("bucket"), X._forward(documents(spark, {1: "fresh words"}), 10))
    watched(meta)
    index = X.Index(write.publish([0]), 10)
    assert seen == [["/lib/f1.txt", "/lib/f2.txt"]] * 2
    assert hits(spark, index, "fresh") == ["/lib/f1.txt"] and hits(spark, index, "old") == []


def test_loading_in_turns_publishes_each_turn(spark, tmp_path):
    store = X.index_store(spark, str(tmp_path / "i"))
    docs = documents(spark, {i: "all of them" for i in range(0, 50)})
    sizes = [len(hits(spark, i, "them")) for i in X.publish_in_turns(docs.withColumn("text", F.concat("text", F.lit(" x"), "doc_id")), store, 10, turn=2)]
    assert sizes == [20, 40, 50] and store.versions() == [1, 2, 3]
    assert [len(hits(spark, X.Index(store.open(v), 10), "them")) for v in (1, 2, 3)] == sizes


def test_turns_of_small_buckets_are_written_together(spark, tmp_path):
    store = X.index_store(spark, str(tmp_path / "i"))
    docs = documents(spark, {i: f"all of them x{i}" for i in range(0, 70)})
    for _ in X.publish_in_turns(docs, store, 10, turn=2):
        pass
    assert len(list((tmp_path / "i" / "posts").glob("data=*"))) == 1 and store.versions() == [1, 2, 3, 4]
    own = {(r.version, r.bucket): r.data for r in store.manifests().collect()}
    assert own == {(v, b): 1 for v in range(1, 5) for b in range(min(7, 2 * v))}
    assert store.parts("docs").count() == 70
    # a version that is written afterwards keeps what it doesn't touch
    index = X.upsert_index(store, documents(spark, {3: "fresh"}), spark.createDataFrame([(65,)], "doc_id long"), 10)
    assert hits(spark, index, "fresh") == ["/lib/f3.txt"] and len(hits(spark, index, "them")) == 68


def test_ingest_stream_publishes_what_a_batch_brought(spark, tmp_path):
    src, store = tmp_path / "in", X.index_store(spark, str(tmp_path / "i"))
    for k in range(3):
        documents(spark, {i: f"batch{k} text{i}" for i in range(k * 100, k * 100 + 100)}).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(str(src))
    L.run_ingest(stream, store, str(tmp_path / "ck"), 64, every=None).awaitTermination(300)
    assert store.versions() == [1, 2, 3], "a version for each hundred documents"
    assert [X.Index(store.open(v), 64).docs.count() for v in (1, 2, 3)] == [100, 200, 300]


def test_live_index_follows_creates_changes_moves_deletes_and_restarts(spark, tmp_path):
    files = {"/a.txt": "alpha one", "/b.txt": "beta two", "/c.txt": "gamma three"}
    src, store, n = tmp_path / "events", L.live_store(spark, str(tmp_path / "i")), [0]
    spark.createDataFrame([], EVENT).write.parquet(str(src))

    def load(paths):
        known = [(p, p[1:], t if t != "?" else None, "unreadable" if t == "?" else None) for p, t in files.items()]
        return paths.join(spark.createDataFrame(known, "path string, name string, text string, error string"), "path")

    def happen(*events):
        """One run of the query over new events, each an hour after the ones before; a later event of a
        folder moves the time on."""
        data = []
        for kind, path, dest in events:
            n[0] += 1
            data.append((n[0], path, dest, kind, False))
        n[0] += 1
        hour = n[0]
        df = spark.createDataFrame([(*d, hour * 3600) for d in data] + [(n[0], "/dir", None, "modified", True, hour * 3600 + 1800)], "seq long, path string, dest_path string, kind string, is_directory boolean, t long")
        df.select("seq", "path", "dest_path", "kind", "is_directory", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(EVENT).parquet(str(src))
        L.run_live_index(stream, store, load, str(tmp_path / "ck"), 2, every=None).awaitTermination(300)
        return X.Index(store.open(), 2)

    index = happen(("created", "/a.txt", None), ("created", "/b.txt", None), ("created", "/c.txt", None), ("created", "/odd.bin", None))
    ids = {r.path: r.id for r in store.open().read("files").collect()}
    assert ids == {"/a.txt": 0, "/b.txt": 1, "/c.txt": 2} and hits(spark, index, "beta") == ["/b.txt"]
    files["/a.txt"] = "alpha changed"
    files["/m.txt"] = files.pop("/b.txt")
    index = happen(("modified", "/a.txt", None), ("moved", "/b.txt", "/m.txt"))
    assert hits(spark, index, "beta") == ["/m.txt"] and hits(spark, index, "changed") == ["/a.txt"] and hits(spark, index, "one") == []
    files["/bad.txt"] = "?"
    del files["/c.txt"]
    index = happen(("deleted", "/c.txt", None), ("created", "/bad.txt", None), ("modified", "/gone.txt", None))
    state = {r.path: (r.id, r.status, r.error) for r in store.open().read("files").collect()}
    assert state == {"/a.txt": (0, "indexed", None), "/m.txt": (3, "indexed", None), "/bad.txt": (4, "error", "unreadable")}
    assert hits(spark, index, "gamma") == []
    fresh = spark.createDataFrame([(0, "/a.txt", "a.txt", None, "alpha changed"), (3, "/m.txt", "m.txt", None, "beta two")], DOC)
    assert tables_of(index) == tables_of(X.build_index(fresh, 2))
    # a batch that is run again finds its number and does nothing
    before = store.versions()
    again = spark.createDataFrame([("/a.txt", "delete", None)], "path string, intent string, fires_at timestamp")
    assert hits(spark, L.apply_batch(store, again, load, store.open().batch, 2), "alpha") == ["/a.txt"] and store.versions() == before


def test_search_looks_rows_up_by_id_and_reads_no_text(spark, tmp_path):
    docs = documents(spark, {i: f"rare{i} common" for i in range(60)})
    index = X.build_index(docs, 10)
    found = X.search(spark, [M.Query(1, "rare7")], index)
    assert [r.doc_id for r in found.collect()] == [7]
    forward = index.of("forward", spark.createDataFrame([(7,), (23,)], "doc_id long"))
    plan = forward._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*In\(doc_id, \[(7,23|23,7)\]\)", plan) and "PartitionFilters" in plan
    assert {f.split("bucket=")[1].split("/")[0] for f in forward.inputFiles()} <= {str(b) for b in range(6)} and forward.count() == 2
    assert not any("text" in f.name for t in X.TABLES for f in getattr(index, t).schema)


def test_clock_settles_the_last_event_without_a_later_one_and_after_a_restart(spark, tmp_path):
    files = {"/a.txt": "alpha one", "/b.txt": "beta two"}
    src, store, ck = tmp_path / "events", L.live_store(spark, str(tmp_path / "i")), str(tmp_path / "ck")

    def load(paths):
        return paths.join(spark.createDataFrame([(p, p[1:], t, None) for p, t in files.items()], "path string, name string, text string, error string"), "path")

    def write(*events):
        data = [(n, p, d, k, False, t) for n, (k, p, d, t) in enumerate(events)]
        df = spark.createDataFrame(data, "seq long, path string, dest_path string, kind string, is_directory boolean, t long")
        df.select("seq", "path", "dest_path", "kind", "is_directory", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(src))

    def start(rest=500):
        return L.run_live_clock(spark.readStream.schema(EVENT).parquet(str(src)), store, load, ck, 2, rest, "500 milliseconds")

    def wait(run, done):
        for _ in range(120):
            if done():
                return True
            assert run.isActive or run.exception() is None, run.exception()
            run.awaitTermination(0.5)
        return False

    state = lambda: {r.path: r.id for r in store.open().read("files").collect()}
    # touches of one path are one; a delete that a change follows is none; null paths and times are no obstacle
    write(("created", "/a.txt", None, 10), ("modified", "/a.txt", None, 11), ("deleted", "/b.txt", None, 10), ("created", "/b.txt", None, 11), ("created", None, None, 10), ("created", "/none.txt", None, None))
    run = start()
    try:
        assert wait(run, lambda: state() == {"/a.txt": 0, "/b.txt": 1})
        files["/m.txt"] = files.pop("/b.txt")
        write(("moved", "/b.txt", "/m.txt", 20))
        assert wait(run, lambda: state() == {"/a.txt": 0, "/m.txt": 1}), "the last event of all settles; ids are above those that are left"
    finally:
        run.stop()
    # a path that rests when the query stops settles after the next start, though nothing happens any more
    files["/a.txt"] = "alpha changed"
    write(("modified", "/a.txt", None, 30))
    run = start(20_000)
    try:
        assert wait(run, lambda: any(p.stateOperators and p.stateOperators[0].numRowsTotal == 1 for p in run.recentProgress))
    finally:
        run.stop()
    assert hits(spark, X.Index(store.open(), 2), "one") == ["/a.txt"], "it still rests"
    run = start()
    try:
        assert wait(run, lambda: hits(spark, X.Index(store.open(), 2), "changed") == ["/a.txt"])
    finally:
        run.stop()
    assert hits(spark, X.Index(store.open(), 2), "beta") == ["/m.txt"]
