"""Result shaping: context windows, snippets, page look-ups, highlighting.

Work on one text and its spans stays in its row; look-ups of offsets in segments are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.functions.text import BLANK, col

ELLIPSIS = "…"


def _words(text: Column, words: int) -> Column:
    """Characters of the first words of a text, each with the blanks before it; a blank run at its end counts as
    a word.  Only these characters are gone through."""
    word = f"(?:[{BLANK}]*+[^{BLANK}]++)"
    few = f"{word}{{0,{words - 1}}}[{BLANK}]*+" if words > 0 else ""
    return F.length(F.regexp_extract(text, f"^(?:{word}{{{words}}}|{few})", 0))


def expand_by_words(text, start, end, words: int) -> tuple[Column, Column]:
    """The span widened by so many words each way."""
    t, s, e = col(text), col(start), col(end)
    before = _words(F.reverse(F.substring(t, F.lit(1), s)), words)
    after = _words(F.substring(t, e + 1, F.length(t)), words)
    return (s - before).cast("int"), (e + after).cast("int")


def snippets(hits: DataFrame, words: int = 50, most: int = 6) -> DataFrame:
    """Of hits (…, text, spans) a row for each snippet: snippet_no, snippet, rel_spans, abs_offset, total.

    Spans are taken in order; one that starts inside the last snippet is covered by it.  The fold over
    spans keeps the last snippet's end, so a snippet is cut out only for spans that open one, and of the text
    only the words around it are matched.
    """
    keys = [c for c in hits.columns if c not in ("text", "spans")]
    opened = F.aggregate(
        F.col("spans"),
        F.array().cast("array<struct<start:int,lo:int,hi:int>>"),
        lambda a, s: F.when((F.size(a) >= most) | (s["start"] < F.coalesce(F.try_element_at(a, F.lit(-1))["hi"], F.lit(-1))), a).otherwise(_open(a, s, words)),
    )
    rows = hits.select(*keys, "text", "spans", F.posexplode(opened).alias("snippet_no", "o"))
    lo, hi = F.col("o.lo"), F.col("o.hi")
    front = F.when(lo > 0, ELLIPSIS).otherwise("")
    back = F.when(hi < F.length("text"), ELLIPSIS).otherwise("")
    inside = F.filter("spans", lambda s: (s["start"] >= lo) & (s["end"] <= hi))
    rel = F.array_distinct(F.transform(inside, lambda s: F.struct((s["start"] - lo + F.length(front)).alias("start"), (s["end"] - lo + F.length(front)).alias("end"))))
    return rows.select(*keys, "snippet_no", F.concat(front, F.substring("text", lo + 1, hi - lo), back).alias("snippet"), rel.alias("rel_spans"), F.col("o.start").alias("abs_offset"), F.size("spans").alias("total"))


def _open(a: Column, s: Column, words: int) -> Column:
    lo, hi = expand_by_words(F.col("text"), s["start"], s["end"], words)
    return F.concat(a, F.array(F.struct(s["start"].alias("start"), lo.alias("lo"), hi.alias("hi"))))


def snippet_chars(text, start, end, chars: int = 90) -> tuple[Column, Column, Column]:
    """(snippet, highlight start, end): so many characters each way, cut at blanks, breaks as blanks."""
    t, s, e = col(text), col(start), col(end)
    n = F.length(t)
    lo, hi = F.greatest(F.lit(0), s - chars), F.least(n, e + chars)
    blank = F.locate(" ", F.substring(t, lo + 1, s - lo))
    lo2 = F.when((lo > 0) & (blank > 0), lo + blank).otherwise(lo)
    tail = F.substring(t, e + 1, hi - e)
    back = F.instr(F.reverse(tail), " ")
    hi2 = F.when((hi < n) & (back > 0), hi - back).otherwise(hi)
    return F.translate(F.substring(t, lo2 + 1, hi2 - lo2), "\n", " "), (s - lo2).cast("int"), (e - lo2).cast("int")


def page_of_offset(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (file_id, offset) with page: the segment that holds the offset, else the last one.

    Segments of a file are disjoint, so the holder is the one before the offset: a look-back over both
    tables in order, without a range join."""
    last = segments.groupBy("file_id").agg(F.max_by("page", "seq").alias("last_page"))
    found = _before(points, segments).join(last, "file_id", "left")
    return found.select("file_id", "offset", F.when((F.col("offset") < F.col("before.char_end")), F.col("before.page")).otherwise(F.col("last_page")).alias("page"))


def page_for_offset_incl(points: DataFrame, segments: DataFrame) -> DataFrame:
    """The first segment that holds the offset with its end included, else null: the one that starts
    before the offset, if it reaches it, else the one that starts there."""
    here = segments.groupBy("file_id", F.col("char_start").alias("offset")).agg(F.min_by("page", "seq").alias("here"))
    rows = _before(points.distinct(), segments, strictly=True).join(here, ["file_id", "offset"], "left")
    found = rows.select("file_id", "offset", F.when(F.col("offset") <= F.col("before.char_end"), F.col("before.page")).otherwise(F.col("here")).alias("page"))
    return points.join(found, ["file_id", "offset"], "left").select("file_id", "offset", "page")


def page_asof_start(points: DataFrame, segments: DataFrame) -> DataFrame:
    """The last segment that starts at or before the offset, else null."""
    return _before(points, segments).select("file_id", "offset", F.col("before.page").alias("page"))


def _before(points: DataFrame, segments: DataFrame, strictly: bool = False) -> DataFrame:
    marks = segments.select("file_id", F.col("char_start").alias("offset"), "seq", F.struct("page", "char_start", "char_end", "seq").alias("before"))
    return look_back(points.select("file_id", "offset"), marks, "file_id", "offset", "seq", strictly)


def look_back(points: DataFrame, marks: DataFrame, key: str, at: str, order: str, strictly: bool = False) -> DataFrame:
    """points (key, at) with ``before`` of marks (key, at, order, before): the last mark at or before (or
    strictly before) the point, the one with the greatest ``order`` of several.  One window over both
    tables in order; no range join."""
    asked = points.select(key, at, F.lit(-1 if strictly else 1).alias("kind"), F.lit(None).cast(marks.schema[order].dataType).alias("_o"), F.lit(None).cast(marks.schema["before"].dataType).alias("before"))
    rows = marks.select(key, at, F.lit(0).alias("kind"), F.col(order).alias("_o"), "before").union(asked)
    own = Window.partitionBy(key).orderBy(at, "kind", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("before", F.last("before", ignorenulls=True).over(own)).where("kind <> 0").select(key, at, "before")


def matches_of(found: DataFrame, docs: DataFrame, segments: DataFrame, words: int = 50, most: int = 6) -> DataFrame:
    """(query_id, rank, doc_id, snippet_no, snippet, page, …) of found results (query_id, rank, doc_id, spans):
    their snippets, each with the page that holds its first hit.  Only the texts of results are read."""
    hits = found.select("query_id", "rank", "doc_id", "spans").join(docs.select("doc_id", "text"), "doc_id")
    rows = snippets(hits, words, most)
    points = rows.select(F.col("doc_id").alias("file_id"), F.col("abs_offset").alias("offset")).distinct()
    own = segments.join(points.select("file_id").distinct(), "file_id", "left_semi")
    pages = page_of_offset(points, own).withColumnsRenamed({"file_id": "doc_id", "offset": "abs_offset"})
    return rows.join(pages, ["doc_id", "abs_offset"], "left")


def highlight_markup(text, spans, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """The text with spans wrapped; of spans that overlap the first wins."""
    t = col(text)
    state = F.struct(F.lit(0).alias("upto"), F.lit("").alias("out"))
    step = lambda a, s: F.when(
        s["start"] < a["upto"], a
    ).otherwise(F.struct(s["end"].alias("upto"), F.concat(a["out"], F.substring(t, a["upto"] + 1, s["start"] - a["upto"]), F.lit(opening), F.substring(t, s["start"] + 1, s["end"] - s["start"]), F.lit(closing)).alias("out")))
    done = F.aggregate(F.array_sort(col(spans)), state, step)
    return F.concat(done["out"], F.substring(t, done["upto"] + 1, F.length(t)))
