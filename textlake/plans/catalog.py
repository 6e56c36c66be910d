"""Queries of the catalog's state, its refresh and its listings, over states made of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import catalog as C
from textlake.plans.fixtures import DOC_PAGES, HEB, VISUAL, doc_pages, heb, read, visual
from textlake.plans.text import sql_flip_words, sql_lines, sql_score
from textlake.registry import query

STATUS = "CASE doc_id % 6 WHEN 4 THEN 'pending_ocr' WHEN 5 THEN 'error' ELSE 'indexed' END"
SOURCE = "CASE doc_id % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'mixed' WHEN 2 THEN 'ocr_partial' ELSE 'extracted' END"


def _as_files(docs):
    return docs.select(
        F.col("doc_id").alias("id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "ext", F.octet_length("text").cast("long").alias("size"), F.col("doc_id").cast("double").alias("mtime"),
        C.content_hash(F.encode("text", "UTF-8"), F.octet_length("text")).alias("sha1"), F.expr(STATUS).alias("status"), F.expr("CASE WHEN doc_id % 6 = 5 THEN 'bad ' || doc_id END").alias("error"), F.expr(SOURCE).alias("source"),
        F.expr("CAST(doc_id % 4 + 1 AS INT)").alias("page_count"), F.length("text").cast("long").alias("char_count"), F.col("text").alias("full_text"), (F.col("doc_id") * F.lit(1.5)).alias("indexed_at"), F.expr("doc_id % 13 = 0").alias("force_ocr"),
    )


def before(spark, sf):
    return _as_files(heb(spark, sf).where("doc_id % 10 <> 0"))


def after(spark, sf):
    docs = heb(spark, sf).where("doc_id % 10 <> 1").withColumn("text", F.expr("CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END"))
    return _as_files(docs).select("path", "name", "ext", "size", "mtime", "sha1", F.col("full_text").alias("text"))


AS_FILES = f"""SELECT doc_id AS id, path, string_split(path, '/')[-1] AS name, ext, CAST(strlen(text) AS BIGINT) AS size, CAST(doc_id AS DOUBLE) AS mtime, sha1(CAST(strlen(text) AS VARCHAR) || text) AS sha1,
  {STATUS} AS status, CASE WHEN doc_id % 6 = 5 THEN 'bad ' || doc_id END AS error, {SOURCE} AS source, CAST(doc_id % 4 + 1 AS INTEGER) AS page_count, CAST(length(text) AS BIGINT) AS char_count, text AS full_text,
  doc_id * CAST(1.5 AS DOUBLE) AS indexed_at, doc_id % 13 = 0 AS force_ocr FROM"""
FB = f"{HEB}, fb AS ({AS_FILES} heb WHERE doc_id % 10 <> 0)"
FA = f"{FB}, fa AS ({AS_FILES} (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text) FROM heb WHERE doc_id % 10 <> 1)), changed AS (SELECT fa.* FROM fa LEFT JOIN fb USING (path) WHERE fb.status IS NULL OR fb.status NOT IN ('indexed', 'pending_ocr') OR fb.sha1 <> fa.sha1)"
STATE = "id, path, status, error, source, page_count, char_count, force_ocr"


def _state(df):
    return df.select("id", "path", "status", "error", "source", "page_count", "char_count", "force_ocr")


def _changed(spark, sf):
    return C.needs_reindex(after(spark, sf), before(spark, sf))


@query("content_hash", f"WITH {HEB} SELECT doc_id, sha1(CAST(strlen(text) AS VARCHAR) || text) AS sha1 FROM heb")
def content_hash(spark, sf):
    return heb(spark, sf).select("doc_id", C.content_hash(F.encode("text", "UTF-8")).alias("sha1"))


@query("filter_max_size", "SELECT doc_id, n_chars * 50000 AS size FROM documents WHERE n_chars * 50000 <= 209715200")
def filter_max_size(spark, sf):
    return C.filter_max_size(read(spark, sf, "documents").select("doc_id", (F.col("n_chars") * 50000).alias("size")))


@query("needs_reindex", f"WITH {FA} SELECT path, sha1 FROM changed")
def needs_reindex(spark, sf):
    return _changed(spark, sf).select("path", "sha1")


@query("upsert_files", f"""WITH {FA}, kept AS (SELECT fb.id, path, CASE WHEN c.path IS NULL THEN fb.status ELSE 'pending' END AS status, CASE WHEN c.path IS NULL THEN fb.error END AS error, coalesce(c.sha1, fb.sha1) AS sha1, coalesce(c.size, fb.size) AS size FROM fb LEFT JOIN changed c USING (path)),
new AS (SELECT (SELECT max(id) FROM fb) + row_number() OVER (ORDER BY path) AS id, path, 'pending' AS status, NULL AS error, sha1, size FROM changed WHERE path NOT IN (SELECT path FROM fb)) SELECT * FROM kept UNION ALL SELECT * FROM new""")
def upsert_files(spark, sf):
    new = _changed(spark, sf).select("path", "name", "ext", "size", "mtime", "sha1")
    return C.upsert_files(before(spark, sf), new).select("id", "path", "status", "error", "sha1", "size")


SEGMENTS = f"""{DOC_PAGES}, seg AS (SELECT file_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seq, page, CAST(sum(length(text) + 2) OVER w - 2 - length(text) AS INTEGER) AS char_start, CAST(sum(length(text) + 2) OVER w - 2 AS INTEGER) AS char_end
  FROM doc_pages WINDOW w AS (PARTITION BY file_id ORDER BY page)),
full_ AS (SELECT file_id, string_agg(text || chr(10) || chr(10), '' ORDER BY page) AS full_text, CAST(count(*) AS INTEGER) AS page_count FROM doc_pages GROUP BY file_id)"""


def segments(spark, sf):
    return C.assemble_full_text(doc_pages(spark, sf))


@query("assemble_full_text", f"WITH {SEGMENTS} SELECT file_id, seq, page, char_start, char_end, page_count, md5(full_text) AS full_text FROM seg JOIN full_ USING (file_id)")
def assemble_full_text(spark, sf):
    full, seg = segments(spark, sf)
    return seg.join(full, "file_id").select("file_id", "seq", "page", "char_start", "char_end", "page_count", F.md5("full_text").alias("full_text"))


@query("replace_segments", f"WITH {SEGMENTS} SELECT file_id, seq, page, char_start, char_end FROM seg WHERE file_id % 3 <> 0 UNION ALL SELECT file_id, 0, page, 0, char_end FROM seg WHERE file_id % 3 = 0 AND seq = 0")
def replace_segments(spark, sf):
    _, seg = segments(spark, sf)
    new = seg.where("file_id % 3 = 0 and seq = 0").withColumn("char_start", F.lit(0))
    return C.replace_segments(seg, new)


@query("save_content", f"""WITH {SEGMENTS}, {FB.removeprefix(HEB + ', ')} SELECT id, path, CASE WHEN h THEN 'indexed' ELSE status END AS status, CASE WHEN h THEN NULL ELSE error END AS error, CASE WHEN h THEN 'extracted' ELSE source END AS source,
  CASE WHEN h THEN full_.page_count ELSE fb.page_count END AS page_count, CASE WHEN h THEN CAST(length(full_.full_text) AS BIGINT) ELSE char_count END AS char_count, CASE WHEN h THEN false ELSE force_ocr END AS force_ocr
FROM (SELECT *, id % 3 = 1 AS h FROM fb) fb LEFT JOIN full_ ON file_id = id""")
def save_content(spark, sf):
    full, _ = segments(spark, sf)
    content = full.where("file_id % 3 = 1").select(F.col("file_id").alias("id"), "full_text", F.lit("extracted").alias("source"), "page_count")
    return _state(C.save_content(before(spark, sf), content))


@query("twin_reuse", f"WITH {FA}, dear AS (SELECT sha1, min(id) AS twin_id FROM fb WHERE source IN ('ocr', 'mixed') AND status IN ('indexed', 'cache') GROUP BY sha1) SELECT path, twin_id FROM changed JOIN dear USING (sha1) WHERE NOT force_ocr")
def twin_reuse(spark, sf):
    work = _changed(spark, sf).withColumn("force_ocr", F.col("mtime").cast("long") % 13 == 0)
    return C.twins(work.select("path", "sha1", "force_ocr"), before(spark, sf)).select("path", "twin_id")


@query("classify_outcome", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'pending_ocr' WHEN doc_id % 3 = 0 THEN 'indexed' ELSE 'error' END AS outcome FROM documents")
def classify_outcome(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", *((F.col("doc_id") % n == 0).alias(a) for n, a in ((4, "s"), (3, "t"), (5, "o"))))
    return d.select("doc_id", C.classify_outcome("s", "t", "o").alias("outcome"))


PAGES = f"""{DOC_PAGES}, layers AS (SELECT file_id, page, CASE WHEN (file_id + page) % 3 = 0 THEN left(text, 8) ELSE text END AS layer, CASE WHEN page % 4 = 1 THEN 'part ' || page WHEN page % 4 = 2 THEN ' ' END AS partial, 'seen ' || file_id || ' ' || page AS recognized, file_id % 13 = 0 AS force FROM doc_pages),
needed AS (SELECT *, force OR length(trim(layer, ' ' || chr(10))) < 15 AS need FROM layers),
merged AS (SELECT *, CASE WHEN NOT need THEN layer WHEN trim(partial) <> '' THEN partial ELSE recognized END AS text FROM needed)"""


def layers(spark, sf):
    p = F.col("page")
    return doc_pages(spark, sf).select("file_id", "page", F.expr("CASE WHEN (file_id + page) % 3 = 0 THEN left(text, 8) ELSE text END").alias("layer"), F.when(p % 4 == 1, F.concat(F.lit("part "), p)).when(p % 4 == 2, " ").alias("partial"), F.concat(F.lit("seen "), "file_id", F.lit(" "), p).alias("recognized"), (F.col("file_id") % 13 == 0).alias("force"))


@query("page_needs_recognition", f"WITH {PAGES} SELECT file_id, page, need FROM needed")
def page_needs_recognition(spark, sf):
    return layers(spark, sf).select("file_id", "page", C.page_needs_recognition("layer", "force").alias("need"))


@query("merge_page_texts", f"WITH {PAGES} SELECT file_id, page, md5(text) AS text FROM merged")
def merge_page_texts(spark, sf):
    return C.merge_page_texts(layers(spark, sf)).select("file_id", "page", F.md5("text").alias("text"))


@query("source_label", f"WITH {PAGES} SELECT file_id, CASE WHEN count(*) FILTER (need) = 0 THEN 'extracted' WHEN bool_or(force) OR count(*) FILTER (need) = count(*) THEN 'ocr' ELSE 'mixed' END AS source FROM merged GROUP BY file_id")
def source_label(spark, sf):
    return C.source_label(C.merge_page_texts(layers(spark, sf)))


def _full_files(spark, sf):
    full, seg = segments(spark, sf)
    files = before(spark, sf).drop("full_text", "page_count").join(full.withColumnRenamed("file_id", "id"), "id")
    return files, seg


@query("partial_pages_map", f"""WITH {SEGMENTS}, {FB.removeprefix(HEB + ', ')} SELECT file_id, page, md5(substr(full_.full_text, char_start + 1, char_end - char_start)) AS text FROM seg JOIN full_ USING (file_id) JOIN fb ON id = file_id
WHERE source = 'ocr_partial' AND trim(substr(full_.full_text, char_start + 1, char_end - char_start), ' ' || chr(10)) <> ''""")
def partial_pages_map(spark, sf):
    rows = C.partial_pages_map(*_full_files(spark, sf))
    return rows.select("file_id", F.explode("pages").alias("page", "text")).select("file_id", "page", F.md5("text").alias("text"))


@query("pending_queue", f"WITH {FB} SELECT id, path, (SELECT count(*) FROM fb WHERE status = 'pending_ocr') AS waiting FROM fb WHERE status = 'pending_ocr' ORDER BY id LIMIT 25")
def pending_queue(spark, sf):
    files = before(spark, sf)
    return C.pending_queue(files, 25).select("id", "path").crossJoin(files.where("status = 'pending_ocr'").agg(F.count("*").alias("waiting")))


@query("mark_pending", f"WITH {FB} SELECT id, CASE WHEN id % 4 = 1 THEN 'pending_ocr' ELSE status END AS status, CASE WHEN id % 4 = 1 THEN NULL ELSE error END AS error FROM fb")
def mark_pending(spark, sf):
    return C.mark_pending(before(spark, sf), F.col("id") % 4 == 1).select("id", "status", "error")


@query("mark_force", f"WITH {FB} SELECT id, CASE WHEN id % 4 = 1 THEN 'pending_ocr' ELSE status END AS status, force_ocr OR id % 4 = 1 AS force_ocr FROM fb")
def mark_force(spark, sf):
    return C.mark_force(before(spark, sf), F.col("id") % 4 == 1).select("id", "status", "force_ocr")


@query("mark_error", f"WITH {FB} SELECT id, CASE WHEN id % 4 = 1 THEN 'error' ELSE status END AS status, md5(CASE WHEN id % 4 = 1 THEN substr(full_text, 1, 2000) ELSE error END) AS error FROM fb")
def mark_error(spark, sf):
    return C.mark_error(before(spark, sf), F.col("id") % 4 == 1, F.col("full_text")).select("id", "status", F.md5("error").alias("error"))


IMAGE_SQL = ", ".join(f"'{x}'" for x in (*C.IMAGES, ".pdf"))


@query("mark_rerun", f"""WITH {FB}, m AS (SELECT *, (status = 'indexed' AND source IN ('ocr', 'mixed')) OR (status = 'error' AND ext IN ({IMAGE_SQL})) AS hit FROM fb)
SELECT id, CASE WHEN hit THEN 'pending_ocr' ELSE status END AS status, CASE WHEN hit THEN NULL ELSE error END AS error, nullif(source, 'ocr_partial') AS source, (SELECT count(*) FROM m WHERE hit) AS affected FROM m""")
def mark_rerun(spark, sf):
    files = before(spark, sf)
    return C.mark_rerun(files).select("id", "status", "error", "source").crossJoin(files.where(C.rerun_rows()).agg(F.count("*").alias("affected")))


@query("mark_reextract", f"WITH {FB} SELECT id, CASE WHEN ext = '.pdf' AND status = 'indexed' AND source = 'extracted' THEN 'pending' ELSE status END AS status FROM fb")
def mark_reextract(spark, sf):
    return C.mark_reextract(before(spark, sf)).select("id", "status")


@query("cleanup_deleted", f"WITH {FA} SELECT id, path FROM fb WHERE NOT (status = 'indexed' AND path NOT IN (SELECT path FROM fa))")
def cleanup_deleted(spark, sf):
    left, _ = C.cleanup_deleted(before(spark, sf), after(spark, sf))
    return left.select("id", "path")


@query("update_text_inplace", f"WITH {FB} SELECT id, md5(CASE WHEN id % 3 = 0 THEN reverse(path) ELSE full_text END) AS full_text, CASE WHEN id % 3 = 0 THEN CAST(length(path) AS BIGINT) ELSE char_count END AS char_count FROM fb")
def update_text_inplace(spark, sf):
    files = before(spark, sf)
    out = C.update_text(files, files.where("id % 3 = 0").select("id", F.reverse("path").alias("text")))
    return out.select("id", F.md5("full_text").alias("full_text"), "char_count")


VISUAL_PAGES = f"""{VISUAL}, vl AS (SELECT doc_id AS file_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM visual)),
vp AS (SELECT file_id, CAST(floor(n / 3.0) AS INTEGER) + 1 AS page, string_agg(line, chr(10) ORDER BY n) AS text FROM vl GROUP BY file_id, CAST(floor(n / 3.0) AS INTEGER) + 1),
vw AS (SELECT *, {sql_flip_words('text')} AS words FROM vp WHERE file_id % 4 = 1 AND file_id % 6 IN (0, 1, 2, 3)),
vs AS (SELECT *, {sql_score('text')} AS s0, {sql_score('words')} AS s1, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2) AS ls FROM vw),
vf AS (SELECT *, s1 >= 6 AND s1 >= s0 + 6 AS bad, len(list_filter(ls, lambda x: contains('.,:;!?', left(x, 1)))) > len(list_filter(ls, lambda x: contains('.,:;!?', right(x, 1)))) AS by_line FROM vs)"""


def visual_files(spark, sf):
    docs = visual(spark, sf)
    lines = docs.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    rows = lines.groupBy("file_id", (F.floor(F.col("n") / 3.0).cast("int") + 1).alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    full, seg = C.assemble_full_text(rows.select("file_id", "page", F.array_join("l.line", "\n").alias("text")))
    files = docs.select(F.col("doc_id").alias("id"), "ext", F.expr(STATUS).alias("status")).join(full.withColumnRenamed("file_id", "id"), "id")
    return files, seg


@query("repair_catalog_text", f"WITH {VISUAL_PAGES} SELECT file_id AS id, md5(string_agg(CASE WHEN bad AND by_line THEN {sql_lines('text')} WHEN bad THEN words ELSE text END || chr(10) || chr(10), '' ORDER BY page)) AS text FROM vf GROUP BY file_id HAVING bool_or(bad)")
def repair_catalog_text(spark, sf):
    return C.repair_catalog_text(*visual_files(spark, sf)).select("id", F.md5("text").alias("text"))


@query("refresh_batch", f"""WITH {FA}, twin0 AS (SELECT c.path, min(b.id) AS twin_id FROM changed c JOIN fb b ON b.sha1 = c.sha1 LEFT JOIN fb own ON own.path = c.path WHERE b.source IN ('ocr', 'mixed') AND b.status IN ('indexed', 'cache') AND NOT coalesce(own.force_ocr, false) GROUP BY c.path)
SELECT path, status, source, sha1, char_count FROM fb WHERE (path IN (SELECT path FROM fa) OR status <> 'indexed') AND path NOT IN (SELECT path FROM changed)
UNION ALL SELECT c.path, CASE WHEN trim(coalesce(t.full_text, c.full_text), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) = '' THEN 'error' ELSE 'indexed' END,
  CASE WHEN t.id IS NOT NULL THEN t.source ELSE 'extracted' END, c.sha1, CAST(CASE WHEN t.id IS NOT NULL THEN length(t.full_text) ELSE length(c.full_text) + 2 END AS BIGINT)
FROM changed c LEFT JOIN twin0 USING (path) LEFT JOIN fb t ON t.id = twin_id""")
def refresh_batch(spark, sf):
    old = before(spark, sf)
    seg = old.select(F.col("id").alias("file_id"), F.lit(0).alias("seq"), F.lit(1).alias("page"), F.lit(0).alias("char_start"), F.col("char_count").cast("int").alias("char_end"))
    files, _, _ = C.refresh_batch(old, seg, after(spark, sf).drop("sha1"))
    return files.select("path", "status", "source", "sha1", "char_count")


# -- listings ----------------------------------------------------------------------------------

@query("catalog_stats", f"WITH {FB} SELECT count(*) AS total_files, count(*) FILTER (status = 'indexed') AS indexed_files, count(*) FILTER (status = 'error') AS error_files, CAST(coalesce(sum(char_count) FILTER (status = 'indexed'), 0) AS BIGINT) AS total_chars FROM fb")
def catalog_stats(spark, sf):
    return C.catalog_stats(before(spark, sf))


@query("component_counts", f"WITH {FB} SELECT count(*) FILTER (status = 'indexed' AND full_text IS NOT NULL) AS files, count(*) FILTER (status = 'indexed' AND full_text IS NOT NULL) > 0 AS available FROM fb")
def component_counts(spark, sf):
    return C.component_counts(before(spark, sf))


@query("progress_counters", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'pending_ocr' WHEN doc_id % 3 = 0 THEN 'indexed' ELSE 'error' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def progress_counters(spark, sf):
    return classify_outcome(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


@query("list_errors", f"WITH {FB} SELECT path, error FROM fb WHERE status = 'error' ORDER BY indexed_at DESC, id LIMIT 200")
def list_errors(spark, sf):
    return C.list_errors(before(spark, sf))


@query("word_recall", "WITH w AS (SELECT text, unnest(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) AS w FROM documents) SELECT round_even(100.0 * count(*) FILTER (contains(replace(text, 'e', 'a'), w)) / count(*), 1) AS recall FROM w")
def word_recall(spark, sf):
    return C.word_recall(read(spark, sf, "documents").select(F.col("text").alias("truth"), F.replace("text", F.lit("e"), F.lit("a")).alias("found")))


@query("file_info", f"WITH {FA} SELECT fa.path, coalesce(fb.id, -1) AS id, fb.status, fb.source, coalesce(fb.page_count, 0) AS page_count, coalesce(fb.char_count, 0) AS char_count, coalesce(fb.status = 'indexed', false) AS indexed FROM fa LEFT JOIN fb USING (path)")
def file_info(spark, sf):
    return C.file_info(after(spark, sf).select("path"), before(spark, sf)).fillna({"id": -1, "page_count": 0, "char_count": 0})


MARKS = "marks AS (SELECT conv_id * 1000 + turn AS id, 'book ' || role AS book_name, left(text, 20) AS label, CAST((conv_id * 7919 + turn * 13) % 1000 AS DOUBLE) AS created_at FROM conversations)"


def bookmarks(spark, sf):
    return read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("book "), "role").alias("book_name"), F.left("text", F.lit(20)).alias("label"), ((F.col("conv_id") * 7919 + F.col("turn") * 13) % 1000).cast("double").alias("created_at"))


@query("bookmarks_list", f"WITH {MARKS} SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM marks QUALIFY place <= 50")
def bookmarks_list(spark, sf):
    from pyspark.sql.window import Window

    first = C.bookmarks_list(bookmarks(spark, sf)).limit(50)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).cast("long"))


@query("bookmarks_filter", f"WITH {MARKS} SELECT * FROM marks WHERE contains(book_name, 'user') OR contains(label, 'the')")
def bookmarks_filter(spark, sf):
    m = bookmarks(spark, sf)
    return C.bookmarks_filter(m, "user").union(C.bookmarks_filter(m, "the")).distinct()


@query("bookmarks_delete", f"WITH {MARKS} SELECT * FROM marks WHERE id % 3 <> 0")
def bookmarks_delete(spark, sf):
    m = bookmarks(spark, sf)
    return C.bookmarks_delete(m, m.where("id % 3 = 0").select("id"))


@query("log_tail", "WITH l AS (SELECT event_id AS id, event_type AS level, value FROM events ORDER BY event_id DESC LIMIT 2000) SELECT * FROM l WHERE id > (SELECT max(id) - 1500 FROM l) AND level = 'error'")
def log_tail(spark, sf):
    logs = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("level"), "value")
    return C.log_tail(logs, logs.agg(F.max("id")).first()[0] - 1500, "error")
