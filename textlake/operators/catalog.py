"""The catalog as tables: state transitions are functions from old tables and inputs to new tables.

files (id, path, name, ext, size, mtime, sha1, status, error, source, page_count, char_count, full_text,
indexed_at, force_ocr) and segments (file_id, seq, page, char_start, char_end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.functions import bidi
from textlake.functions.text import BLANK, col
from textlake.sources.tables import stored

FILES = "id long, path string, name string, ext string, size long, mtime double, sha1 string, status string, error string, source string, page_count int, char_count long, full_text string, indexed_at double, force_ocr boolean"
SEPARATOR = "\n\n"
WHOLE_HASH, SAMPLE = 4 << 20, 1 << 20
MAX_BYTES = 200 << 20
LEAST_PAGE_CHARS = 15
MAX_ERROR = 2000
#: Extensions by kind (fixed values).
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp")
TEXTS = (".txt", ".md", ".csv", ".log", ".json", ".xml", ".htm", ".html")


def trimmed(text) -> Column:
    return F.regexp_replace(col(text), f"^[{BLANK}]+|[{BLANK}]+$", "")


def content_hash(content, size=None) -> Column:
    """SHA-1 over the decimal size and the bytes; of large files over the size, the first MiB and twice
    the MiB from the middle on."""
    c = col(content)
    n = F.octet_length(c) if size is None else col(size)
    head = F.encode(n.cast("string"), "UTF-8")
    half = (n / 2).cast("int")
    mid = F.substring(c, half + 1, F.lit(SAMPLE))
    return F.sha1(F.when(n <= WHOLE_HASH, F.concat(head, c)).otherwise(F.concat(head, F.substring(c, F.lit(1), F.lit(SAMPLE)), mid, mid)))


def filter_max_size(listing: DataFrame, size_col: str = "size") -> DataFrame:
    return listing.where(F.col(size_col) <= MAX_BYTES)


def needs_reindex(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of listing (path, sha1, …) that are new, were not done, or changed."""
    old = files.select("path", F.col("status").alias("_status"), F.col("sha1").alias("_sha1"))
    found = listing.join(old, "path", "left")
    again = F.col("_status").isNull() | ~F.col("_status").isin("indexed", "pending_ocr") | ~F.col("sha1").eqNullSafe(F.col("_sha1"))
    return found.where(again).drop("_status", "_sha1")


def upsert_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """files with the metadata of changed (path, name, ext, size, mtime, sha1): known paths keep id and
    content and become pending, new ones get ids above all others in the order of their paths."""
    meta = changed.select("path", *(F.col(c).alias(f"n_{c}") for c in ("name", "ext", "size", "mtime", "sha1")), F.lit(True).alias("hit"))
    both = files.join(meta, "path", "left")
    kept = both.select(*(F.when(F.col("hit"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in ("name", "ext", "size", "mtime", "sha1") else F.when(F.col("hit"), "pending").otherwise(F.col(c)).alias(c) if c == "status" else F.when(F.col("hit").isNull(), F.col(c)).alias(c) if c == "error" else F.col(c) for c in files.columns))
    new = changed.join(files.select("path"), "path", "left_anti")
    # row numbers over new paths only; a range repartition numbers them in parallel
    base = F.broadcast(files.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_base")))
    added = numbered(new, "path", "_k").join(base).withColumn("id", F.col("_base") + F.col("_k"))
    defaults = {"status": F.lit("pending"), "force_ocr": F.lit(False)}
    return kept.unionByName(added.select(*(F.col(c) if c in ("id", *changed.columns) else defaults.get(c, F.lit(None)).cast(files.schema[c].dataType).alias(c) for c in files.columns)))


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Adds 1..n in the order of ``by``: ranges are counted apart and shifted by the sum of those in
    front, so no task sees all rows.  The ranges are written, since both uses must see the same ones."""
    parts = df.repartitionByRange(by).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_l", F.row_number().over(Window.partitionBy("_p").orderBy(by)))
    local = stored(local, "numbered")
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_l")).drop("_p", "_l", "_before")


def assemble_full_text(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (file_id, page, text) -> (file_id, full_text, page_count), segments.  Each page is followed
    by a blank line that belongs to no page."""
    own = Window.partitionBy("file_id").orderBy("page")
    text = F.coalesce("text", F.lit(""))
    upto = F.sum(F.length(text) + len(SEPARATOR)).over(own) - len(SEPARATOR)
    seg = pages.select("file_id", (F.row_number().over(own) - 1).alias("seq"), "page", upto.cast("int").alias("char_end"), F.length(text).alias("n"))
    seg = seg.select("file_id", "seq", "page", (F.col("char_end") - F.col("n")).alias("char_start"), "char_end")
    rows = pages.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", text.alias("text")))).alias("p"))
    full = rows.select("file_id", F.concat(F.array_join(F.col("p.text"), SEPARATOR), F.lit(SEPARATOR)).alias("full_text"), F.size("p").alias("page_count"))
    return full, seg


def replace_segments(segments: DataFrame, new: DataFrame) -> DataFrame:
    return segments.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def save_content(files: DataFrame, content: DataFrame) -> DataFrame:
    """files with content (id, full_text, source, page_count): indexed, counted, error and force cleared."""
    new = content.select("id", *(F.col(c).alias(f"n_{c}") for c in ("full_text", "source", "page_count")), F.lit(True).alias("hit"))
    both = files.join(new, "id", "left")
    put = {"full_text": F.col("n_full_text"), "source": F.col("n_source"), "page_count": F.col("n_page_count"), "char_count": F.length("n_full_text").cast("long"), "status": F.lit("indexed"), "error": F.lit(None).cast("string"), "force_ocr": F.lit(False)}
    return both.select(*(F.when(F.col("hit"), put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in files.columns))


def twins(changed: DataFrame, files: DataFrame) -> DataFrame:
    """changed (path, sha1, force_ocr) with twin_id: the least id of equal content whose text was dear to
    get; none where recognition is forced."""
    dear = files.where(F.col("source").isin("ocr", "mixed") & F.col("status").isin("indexed", "cache") & F.col("full_text").isNotNull())
    first = dear.groupBy("sha1").agg(F.min("id").alias("twin_id"))
    return changed.join(first, "sha1", "left").withColumn("twin_id", F.when(~F.coalesce("force_ocr", F.lit(False)), F.col("twin_id"))).where("twin_id is not null")


def classify_outcome(skipped, has_text, needs_ocr) -> Column:
    s, t, o = col(skipped), col(has_text), col(needs_ocr)
    return F.when(s, "skipped").when(o, "pending_ocr").when(t, "indexed").otherwise("error")


def page_needs_recognition(text, force) -> Column:
    return col(force) | (F.length(trimmed(F.coalesce(col(text), F.lit("")))) < LEAST_PAGE_CHARS)


def merge_page_texts(pages: DataFrame) -> DataFrame:
    """pages (file_id, page, layer, partial, recognized, force) with text: the layer's where it is enough
    and not forced, else an earlier partial result, else what was recognized now."""
    keep = ~page_needs_recognition("layer", "force")
    text = F.when(keep, F.col("layer")).otherwise(F.coalesce(F.when(trimmed("partial") != "", F.col("partial")), F.col("recognized"), F.lit("")))
    return pages.select("file_id", "page", text.alias("text"), (~keep).alias("recognized_page"), "force")


def source_label(merged: DataFrame) -> DataFrame:
    """(file_id, source): extracted if nothing was recognized, ocr if all of it or forced, else mixed."""
    own = merged.groupBy("file_id").agg(F.count_if("recognized_page").alias("r"), F.count("*").alias("n"), F.bool_or("force").alias("force"))
    label = F.when(F.col("r") == 0, "extracted").when(F.col("force") | (F.col("r") == F.col("n")), "ocr").otherwise("mixed")
    return own.select("file_id", label.alias("source"))


def partial_pages(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(file_id, page, text) of unfinished recognition, blank pages left out."""
    part = files.where("source = 'ocr_partial' and full_text is not null").select(F.col("id").alias("file_id"), "full_text")
    rows = segments.where("page is not null").join(part, "file_id")
    rows = rows.select("file_id", "page", F.substring("full_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"))
    return rows.where(trimmed("text") != "")


def partial_pages_map(files: DataFrame, segments: DataFrame) -> DataFrame:
    rows = partial_pages(files, segments).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return rows


def pending_queue(files: DataFrame, n: int) -> DataFrame:
    return files.where("status = 'pending_ocr'").orderBy("id").limit(n)


def _update(files: DataFrame, on: Column, put: dict[str, Column]) -> DataFrame:
    return files.select(*(F.when(on, put[c]).otherwise(F.col(c)).cast(files.schema[c].dataType).alias(c) if c in put else F.col(c) for c in files.columns))


def mark_pending(files: DataFrame, on: Column) -> DataFrame:
    return _update(files, on, {"status": F.lit("pending_ocr"), "error": F.lit(None)})


def mark_force(files: DataFrame, on: Column) -> DataFrame:
    return _update(files, on, {"status": F.lit("pending_ocr"), "error": F.lit(None), "force_ocr": F.lit(True)})


def mark_error(files: DataFrame, on: Column, message: Column) -> DataFrame:
    return _update(files, on, {"status": F.lit("error"), "error": F.substring(message, 1, MAX_ERROR)})


def rerun_rows() -> Column:
    return ((F.col("status") == "indexed") & F.col("source").isin("ocr", "mixed")) | ((F.col("status") == "error") & F.col("ext").isin(*IMAGES, ".pdf"))


def mark_rerun(files: DataFrame) -> DataFrame:
    """Recognized and failed scans go back to the queue; partial results are forgotten."""
    on = F.coalesce(rerun_rows(), F.lit(False))
    files = mark_pending(files, on)
    return _update(files, F.col("source") == "ocr_partial", {"source": F.lit(None)})


def mark_reextract(files: DataFrame) -> DataFrame:
    return _update(files, (F.col("ext") == ".pdf") & (F.col("status") == "indexed") & (F.col("source") == "extracted"), {"status": F.lit("pending")})


def cleanup_deleted(files: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files without indexed paths that the listing lacks, the ids removed)."""
    gone = files.where("status = 'indexed'").join(listing.select("path"), "path", "left_anti").select("id")
    return files.join(gone, "id", "left_anti"), gone


def update_text(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files with texts (id, text) put in place; lengths follow, segments stay."""
    both = files.join(texts.select("id", F.col("text").alias("_t")), "id", "left")
    put = {"full_text": F.col("_t"), "char_count": F.length("_t").cast("long")}
    return both.select(*(F.when(F.col("_t").isNotNull(), put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in files.columns))


def repair_catalog_text(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, text) of pdf texts with any page in visual order, that page put right.  Lengths don't
    change, so a text is put together from its pages and what lies between them."""
    texts = files.where("ext = '.pdf' and full_text is not null and status in ('indexed', 'cache')").select(F.col("id").alias("file_id"), "full_text")
    own = Window.partitionBy("file_id").orderBy("seq")
    seg = segments.withColumn("last", F.coalesce(F.lag("char_end").over(own), F.lit(0))).withColumn("final", F.lead("seq").over(own).isNull())
    rows = seg.join(texts, "file_id").withColumn("page_text", F.substring("full_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    rows = rows.withColumn("bad", bidi.looks_reversed("page_text")).withColumn("by_line", bidi.line_order_reversed("page_text"))
    fixed = F.when(F.col("bad") & F.col("by_line"), bidi.reverse_lines("page_text")).when(F.col("bad"), bidi.reverse_words("page_text"))
    rows = rows.withColumn("fixed", fixed)
    good = F.col("fixed").isNotNull() & (F.length("fixed") == F.length("page_text"))
    piece = F.concat(F.substring("full_text", F.col("last") + 1, F.col("char_start") - F.col("last")), F.when(good, F.col("fixed")).otherwise(F.col("page_text")), F.when(F.col("final"), F.substring("full_text", F.col("char_end") + 1, F.length("full_text"))).otherwise(F.lit("")))
    out = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", piece.alias("piece")))).alias("p"), F.bool_or(good).alias("any"))
    return out.where("any").select(F.col("file_id").alias("id"), F.array_join(F.col("p.piece"), "").alias("text"))


def catalog_stats(files: DataFrame) -> DataFrame:
    done = F.col("status") == "indexed"
    return files.agg(F.count("*").alias("total_files"), F.count_if(done).alias("indexed_files"), F.count_if(F.col("status") == "error").alias("error_files"), F.coalesce(F.sum(F.when(done, F.col("char_count"))), F.lit(0)).alias("total_chars"))


def component_counts(files: DataFrame) -> DataFrame:
    n = F.count_if((F.col("status") == "indexed") & F.col("full_text").isNotNull())
    return files.agg(n.alias("files"), (n > 0).alias("available"))


def list_errors(files: DataFrame, most: int = 200) -> DataFrame:
    return files.where("status = 'error'").orderBy(F.desc("indexed_at"), "id").limit(most).select("path", "error")


def word_recall(pairs: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """One row, recall: percent of the truths' words that their found texts contain; 0 without words."""
    words = F.filter(F.split(col(truth), f"[{BLANK}]+"), lambda w: w != "")
    hit = F.size(F.filter(words, lambda w: F.contains(col(found), w)))
    total = pairs.agg(F.sum(F.size(words)).alias("n"), F.sum(hit).alias("hit"))
    return total.select(F.when(F.col("n") > 0, F.bround(F.lit(100.0) * F.col("hit") / F.col("n"), 1)).otherwise(0.0).alias("recall"))


def file_info(paths: DataFrame, files: DataFrame) -> DataFrame:
    found = paths.join(files.select("path", "id", "status", "source", "page_count", "char_count"), "path", "left")
    return found.withColumn("indexed", F.coalesce(F.col("status") == "indexed", F.lit(False)))


def bookmarks_list(bookmarks: DataFrame) -> DataFrame:
    return bookmarks.orderBy(F.desc("created_at"), F.desc("id"))


def bookmarks_filter(bookmarks: DataFrame, term: str) -> DataFrame:
    return bookmarks.where(F.contains("book_name", F.lit(term)) | F.contains("label", F.lit(term)))


def bookmarks_delete(bookmarks: DataFrame, ids: DataFrame) -> DataFrame:
    return bookmarks.join(ids, "id", "left_anti")


def log_tail(logs: DataFrame, after: int, level: str = "ALL", kept: int = 2000) -> DataFrame:
    """Of the last ``kept`` records those with a later id and the level."""
    last = logs.orderBy(F.desc("id")).limit(kept).where(F.col("id") > after)
    return last if level == "ALL" else last.where(F.col("level") == level)


def refresh_batch(files: DataFrame, segments: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One refresh: listing (path, name, ext, size, mtime, text) against the catalog -> (files, segments,
    outcomes).  Changed files are hashed, reuse a twin's text or take their own, deleted ones go."""
    hashed = filter_max_size(listing).withColumn("sha1", content_hash(F.encode("text", "UTF-8"), F.octet_length("text")))
    changed = needs_reindex(hashed, files)
    state = upsert_files(files, changed.select("path", "name", "ext", "size", "mtime", "sha1"))
    ids = state.select("id", "path", "force_ocr")
    work = changed.join(ids, "path")
    twin = twins(work.select("path", "sha1", "force_ocr"), files).select("path", "twin_id")
    old = files.select(F.col("id").alias("twin_id"), F.col("full_text").alias("twin_text"), F.col("source").alias("twin_source"), F.col("page_count").alias("twin_pages"))
    work = work.join(twin, "path", "left").join(old, "twin_id", "left")
    full = F.coalesce("twin_text", F.concat("text", F.lit(SEPARATOR)))
    content = work.select("id", full.alias("full_text"), F.coalesce("twin_source", F.lit("extracted")).alias("source"), F.coalesce("twin_pages", F.lit(1)).alias("page_count"), "twin_id")
    has = trimmed("full_text") != ""
    state = save_content(state, content.where(has).drop("twin_id"))
    state = state.join(content.where(~has).select("id", F.lit(True).alias("empty")), "id", "left")
    state = mark_error(state.withColumn("empty", F.coalesce("empty", F.lit(False))), F.col("empty"), F.lit("no text found")).select(*files.columns)
    own = content.where(has).where("twin_id is null").select(F.col("id").alias("file_id"), F.lit(0).alias("seq"), F.lit(1).alias("page"), F.lit(0).alias("char_start"), (F.length("full_text") - len(SEPARATOR)).alias("char_end"))
    copied = content.where(has).where("twin_id is not null").select("id", "twin_id").join(segments.withColumnRenamed("file_id", "twin_id"), "twin_id").select(F.col("id").alias("file_id"), "seq", "page", "char_start", "char_end")
    seg = replace_segments(segments, own.unionByName(copied))
    left, gone = cleanup_deleted(state, listing)
    outcome = listing.select("path").join(content.join(ids.select("id", "path"), "id").select("path", classify_outcome(F.lit(False), has, F.lit(False)).alias("outcome")), "path", "left").select("path", F.coalesce("outcome", F.lit("skipped")).alias("outcome"))
    return left, seg.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti"), outcome
