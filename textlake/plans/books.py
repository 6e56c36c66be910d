"""Queries of book structure and of page look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.functions import text as T
from textlake.operators import books as K
from textlake.operators import catalog as C
from textlake.operators import match as M
from textlake.operators import results as R
from textlake.plans import sqltext as S
from textlake.plans.catalog import SEGMENTS, segments
from textlake.plans.fixtures import BOOK, BOOKS, HEB, book_name, books, doc_pages, heb
from textlake.plans.search import ANALYZED, ASKED, OCC, PHRASE, asked_sql
from textlake.registry import query
from textlake.sources.tables import stored

LEADS = S.quoted(K.LEGEND_LEADS)
LINES = f"""{BOOKS}, raw AS (SELECT path, string_split(raw_text, chr(10)) AS a FROM books),
l0 AS (SELECT path, unnest(range(0, len(a) - 1)) AS n, unnest(a[:-2]) AS line FROM raw),
l1 AS (SELECT *, trim(line) AS bare, length(regexp_replace(line, '[^{T.LETTERS}]', '', 'g')) AS letters FROM l0),
l2 AS (SELECT *, left(bare, 1) AS lead_, CASE WHEN bare = '' THEN false WHEN contains('$@~', left(bare, 1)) THEN false WHEN contains({LEADS}, left(bare, 1)) THEN true
  ELSE NOT regexp_matches(bare, '^[\\p{{L}}\\p{{N}}]') AND letters < greatest(2, length(bare) // 4) END AS legend FROM l1),
l3 AS (SELECT *, min(CASE WHEN NOT legend AND bare <> '' THEN n END) OVER (PARTITION BY path) AS first_ FROM l2),
l4 AS (SELECT path, n, line, bare, CASE lead_ WHEN '$' THEN 1 WHEN '@' THEN 2 WHEN '~' THEN 3 ELSE TRY_CAST(regexp_extract(line, '(?i)^\\s*<h([123])>(.*?)</h[123]>\\s*$', 1) AS INTEGER) END AS level, lead_ FROM l3 WHERE NOT legend OR n >= first_),
l5 AS (SELECT path, n, level, CASE WHEN level IS NULL THEN line WHEN contains('$@~', lead_) THEN trim(substr(bare, 2)) ELSE trim(regexp_extract(line, '(?i)^\\s*<h([123])>(.*?)</h[123]>\\s*$', 2)) END AS part FROM l4),
lines AS (SELECT *, CAST(sum(length(part) + 1) OVER (PARTITION BY path ORDER BY n) - length(part) - 1 AS INTEGER) AS start FROM l5),
heads AS (SELECT path, level, part AS title, start, CAST(start + length(part) AS INTEGER) AS end_ FROM lines WHERE level IS NOT NULL AND part <> ''),
display AS (SELECT path, string_agg(part || chr(10), '' ORDER BY n) AS text FROM lines GROUP BY path)"""
#: The tail of the second half of a window, reversed, tells the last break.
BOUNDS = f"""{LINES}, cuts AS (SELECT path, text, 0 AS pos, 0 AS k FROM display
  UNION ALL SELECT path, text, CAST(CASE WHEN nxt >= length(text) THEN nxt WHEN strpos(tail, chr(10) || chr(10)) > 0 THEN nxt - strpos(tail, chr(10) || chr(10)) WHEN strpos(tail, chr(10)) > 0 THEN nxt - strpos(tail, chr(10)) + 1 ELSE nxt END AS INTEGER), k + 1
  FROM (SELECT *, least(length(text), pos + 12000) AS nxt, reverse(regexp_replace(substr(text, pos + 6001, least(length(text), pos + 12000) - pos - 6000), '[{T.POINTS}]', '_', 'g')) AS tail FROM cuts WHERE pos < length(text))),
bounds AS (SELECT path, list(pos ORDER BY k) AS b FROM cuts GROUP BY path)"""
CHUNK_OF = "CAST(least(greatest(len(list_filter(b, lambda x: x <= {0})) - 1, 0), greatest(1, len(b) - 1) - 1) AS INTEGER)"


def _lines(spark, sf):
    return K.book_lines(books(spark, sf))


@query("legend_lines", f"WITH {LINES} SELECT path, CAST(n AS INTEGER) AS n, legend FROM l2")
def legend_lines(spark, sf):
    lines = books(spark, sf).select("path", F.posexplode(T.split_lines("raw_text")).alias("n", "line"))
    return lines.select("path", "n", K.is_legend("line").alias("legend"))


@query("parse_headings", f"WITH {LINES} SELECT path, level, title, start, end_ AS \"end\" FROM heads")
def parse_headings(spark, sf):
    return K.headings(_lines(spark, sf))


@query("display_text", f"WITH {LINES} SELECT path, CAST(length(text) AS INTEGER) AS n, md5(text) AS text FROM display")
def display_text(spark, sf):
    return K.display_text(_lines(spark, sf)).select("path", F.length("text").alias("n"), F.md5("text").alias("text"))


@query("chunk_boundaries", f"WITH RECURSIVE {BOUNDS} SELECT path, CAST(k AS INTEGER) AS k, CAST(pos AS INTEGER) AS pos FROM cuts")
def chunk_boundaries(spark, sf):
    return K.display_text(_lines(spark, sf)).select("path", F.posexplode(K.chunk_boundaries("text")).alias("k", "pos"))


@query("chunk_of_offset", f"WITH RECURSIVE {BOUNDS}, o AS (SELECT path, unnest(range(0, length(text) + 1, 7001)) AS off FROM display) SELECT path, CAST(off AS INTEGER) AS off, {CHUNK_OF.format('off')} AS chunk FROM bounds JOIN o USING (path)")
def chunk_of_offset(spark, sf):
    cut = K.display_text(_lines(spark, sf)).select("path", K.chunk_boundaries("text").alias("b"), F.length("text").alias("n"))
    rows = cut.select("path", "b", F.explode(F.sequence(F.lit(0), "n", F.lit(7001))).alias("off"))  # a text is cut once, not for each offset
    return rows.select("path", "off", K.chunk_of("b", "off").alias("chunk"))


@query("book_chunk", f"""WITH RECURSIVE {BOUNDS}, c AS (SELECT path, unnest(range(0, greatest(1, len(b) - 1))) AS chunk, greatest(1, len(b) - 1) AS total, b FROM bounds),
d AS (SELECT path, chunk, total, b[chunk + 1] AS s, substr(text, b[chunk + 1] + 1, b[chunk + 2] - b[chunk + 1]) AS t FROM c JOIN display USING (path))
SELECT path, CAST(chunk AS INTEGER) AS chunk, CAST(total AS INTEGER) AS total_chunks, CAST(s AS INTEGER) AS chunk_start, md5(t) AS text, regexp_matches(t, '[{chr(0x5B0)}-{chr(0x5C7)}]') AS has_niqqud, regexp_matches(t, '[{chr(0x591)}-{chr(0x5AF)}]') AS has_teamim,
  round_even(chunk / total * 100, 1) AS percent FROM d""")
def book_chunk(spark, sf):
    return K.chunks(K.display_text(_lines(spark, sf))).withColumn("text", F.md5("text"))


@query("book_toc", f"WITH RECURSIVE {BOUNDS}, h AS (SELECT heads.*, b, {CHUNK_OF.format('start')} AS chunk FROM heads JOIN bounds USING (path)) SELECT path, level, title, start AS abs_offset, chunk, CAST(start - b[chunk + 1] AS INTEGER) AS \"offset\" FROM h")
def book_toc(spark, sf):
    lines = _lines(spark, sf)
    return K.toc(K.display_text(lines), K.headings(lines))


FEW = [ASKED[1], ASKED[6], ASKED[13]]
_FEW0 = [M.Query(q.query_id, q.q, q.exact, q.whole_word, q.fold_vy, q.fold_aa, q.min_words, 0) for q in FEW]


def _hits_sql(src: str, id_: str) -> str:
    """All spans of the few queries over src(id, text), with their numbers; proximity off."""
    return f"""{S.tokens('(SELECT ' + id_ + ' AS doc_id, text FROM ' + src + ')')}, {asked_sql(_FEW0)}, {OCC}, {PHRASE},
enough AS (SELECT query_id, doc_id FROM occ JOIN (SELECT DISTINCT query_id, required FROM qw) USING (query_id) GROUP BY query_id, doc_id, required HAVING count(DISTINCT w) >= required),
all_spans AS (SELECT DISTINCT query_id, doc_id, start, end_ FROM (SELECT query_id, doc_id, start, end_ FROM occ SEMI JOIN enough USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, start, end_ FROM phrases)),
nums AS (SELECT *, row_number() OVER w - 1 AS hit, count(*) OVER (PARTITION BY query_id, doc_id) AS total FROM all_spans WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY start, end_))"""


@query("search_in_book", f"WITH RECURSIVE {BOUNDS}, {_hits_sql('display', 'path')}, h AS (SELECT nums.*, b, {CHUNK_OF.format('start')} AS chunk FROM nums JOIN bounds ON path = doc_id WHERE hit < 500) SELECT query_id, doc_id AS path, CAST(total AS INTEGER) AS total, CAST(hit AS INTEGER) AS hit, chunk, CAST(start - b[chunk + 1] AS INTEGER) AS start, CAST(end_ - b[chunk + 1] AS INTEGER) AS \"end\", start AS abs_start FROM h")
def search_in_book(spark, sf):
    return K.search_in_book(K.display_text(_lines(spark, sf)), FEW).drop("snippet", "hl_start", "hl_end")


@query("search_in_pages", f"WITH {SEGMENTS}, {_hits_sql('(SELECT file_id, full_text AS text FROM full_)', 'file_id')} SELECT query_id, doc_id AS file_id, CAST(total AS INTEGER) AS total, CAST(hit AS INTEGER) AS hit, page FROM nums ASOF JOIN seg ON seg.file_id = nums.doc_id AND nums.start >= seg.char_start WHERE hit < 500")
def search_in_pages(spark, sf):
    full, seg = C.assemble_full_text(stored(doc_pages(spark, sf), "pages"))  # for texts and for segments
    return K.search_in_pages(full.select("file_id", F.col("full_text").alias("text")), seg, FEW).select("query_id", "file_id", "total", "hit", "page")


PHRASES_SQL = f"""ph0 AS (SELECT doc_id, {S.norms('substr(text, 40, 20)')} AS terms FROM heb), ph AS (SELECT doc_id, unnest(terms) AS norm, unnest(range(0, len(terms))) AS k, len(terms) AS n FROM ph0),
at_ AS (SELECT tok.doc_id, pos - k AS pos, n, count(*) AS m, min(start) AS start FROM tok JOIN ph ON ph.doc_id = tok.doc_id AND ph.norm = tok.norm GROUP BY tok.doc_id, pos - k, n)"""


@query("first_phrase_pos", f"WITH {HEB}, {S.tokens('heb')}, {PHRASES_SQL} SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, arg_min(start, pos) AS start FROM at_ WHERE m = n GROUP BY doc_id")
def first_phrase_pos(spark, sf):
    docs = heb(spark, sf)
    phrases = docs.select(F.col("doc_id").alias("phrase_id"), "doc_id", T.query_terms(F.substring("text", 40, 20)).alias("terms"))
    return K.first_phrase_pos(M.Texts(docs), phrases).select("doc_id", "pos", "start")


#: The paged twin of a book holds the pages of all its documents.
TWIN = f"""{LINES}, dl AS (SELECT doc_id, source, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, {BOOK} AS source, string_split(text, chr(10)) AS ls FROM heb)),
dp AS (SELECT source, doc_id, CAST(floor(n / 3.0) AS INTEGER) + 1 AS p, string_agg(line, chr(10) ORDER BY n) AS text FROM dl GROUP BY source, doc_id, CAST(floor(n / 3.0) AS INTEGER) + 1),
tp AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, p) AS INTEGER) AS page, text FROM dp),
tseg AS (SELECT source, page - 1 AS seq, page, CAST(sum(length(text) + 2) OVER w - 2 - length(text) AS INTEGER) AS char_start, CAST(sum(length(text) + 2) OVER w - 2 AS INTEGER) AS char_end FROM tp WINDOW w AS (PARTITION BY source ORDER BY page)),
ttext AS (SELECT source AS doc_id, string_agg(text || chr(10) || chr(10), '' ORDER BY page) AS text FROM tp GROUP BY source),
{S.tokens('ttext', 'doc_id', 'tt')},
hp0 AS (SELECT path, start AS hs, {S.norms('title')} AS terms FROM heads), hp AS (SELECT path, hs, split_part(split_part(path, '/', 3), '.', 1) AS source, unnest(terms) AS norm, unnest(range(0, len(terms))) AS k, len(terms) AS n FROM hp0),
ha AS (SELECT path, hs, hp.source, pos - k AS pos, n, count(*) AS m, min(start) AS start FROM hp JOIN tt ON tt.doc_id = hp.source AND tt.norm = hp.norm GROUP BY path, hs, hp.source, pos - k, n),
placed AS (SELECT path, hs, source, arg_min(start, pos) AS o FROM ha WHERE m = n GROUP BY path, hs, source),
npages AS (SELECT source, count(*) AS n_pages FROM tseg GROUP BY source)"""


def _twin(spark, sf):
    pages = doc_pages(spark, sf).join(heb(spark, sf).select(F.col("doc_id").alias("file_id"), book_name().alias("source")), "file_id")
    own = Window.partitionBy("source").orderBy("file_id", "page")
    pages = pages.select(F.col("source").alias("file_id"), F.row_number().over(own).alias("page"), "text")
    full, seg = C.assemble_full_text(pages)
    lines = _lines(spark, sf)
    twin = books(spark, sf).select("path", F.col("source").alias("file_id"))
    texts = M.Texts(full.select(F.col("file_id").alias("doc_id"), F.col("full_text").alias("text")))
    return K.display_text(lines), K.headings(lines), twin, texts, seg


@query("sync_text_to_page", f"""WITH {TWIN}, pts AS (SELECT path, unnest(range(0, length(text) + 1, 9001)) AS point FROM display),
pg AS (SELECT path, hs, arg_min(page, seq) AS page FROM placed JOIN tseg ON tseg.source = placed.source AND char_start <= o AND o <= char_end GROUP BY path, hs),
best AS (SELECT path, point, arg_max(page, hs) AS page FROM pts JOIN pg USING (path) WHERE hs <= point GROUP BY path, point)
SELECT path, CAST(point AS INTEGER) AS point, coalesce(best.page, greatest(1, CAST(round_even(point / greatest(1, length(text)) * n_pages, 0) AS INTEGER))) AS page, best.page IS NOT NULL AS matched
FROM pts JOIN display USING (path) JOIN npages ON npages.source = split_part(split_part(path, '/', 3), '.', 1) LEFT JOIN best USING (path, point)""")
def sync_text_to_page(spark, sf):
    display, heads, twin, tokens, seg = _twin(spark, sf)
    points = display.select("path", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(9001))).alias("point"))
    return K.sync_text_to_page(points, display, heads, twin, tokens, seg)


@query("sync_page_to_text", f"""WITH RECURSIVE {BOUNDS}, {TWIN.removeprefix(LINES + ', ')}, pts AS (SELECT source, '/lib/' || source || '.txt' AS path, page, char_end FROM tseg),
best AS (SELECT pts.path, page, arg_max(hs, (o, -hs)) AS best FROM pts JOIN placed ON placed.source = pts.source WHERE o <= char_end GROUP BY pts.path, page),
j AS (SELECT pts.path, page, b, best, {CHUNK_OF.format('best')} AS c1, CAST(least(greatest(1, len(b) - 1) - 1, round_even((page - 1) / n_pages * greatest(1, len(b) - 1), 0)) AS INTEGER) AS c2 FROM pts JOIN bounds USING (path) JOIN npages USING (source) LEFT JOIN best USING (path, page))
SELECT path, page, CASE WHEN best IS NOT NULL THEN c1 ELSE c2 END AS chunk, CAST(CASE WHEN best IS NOT NULL THEN best ELSE b[c2 + 1] END AS INTEGER) AS abs_offset, best IS NOT NULL AS matched FROM j""")
def sync_page_to_text(spark, sf):
    display, heads, twin, tokens, seg = _twin(spark, sf)
    pages = seg.join(twin, "file_id").select("path", "page")
    return K.sync_page_to_text(pages, display, heads, twin, tokens, seg)


# -- page look-ups -----------------------------------------------------------------------------

OFFSETS = f"{SEGMENTS}, pts AS (SELECT file_id, unnest(range(0, length(full_text) + 1, 211)) AS off FROM full_)"


def _points(spark, sf):
    full, seg = segments(spark, sf)
    return full.select("file_id", F.explode(F.sequence(F.lit(0), F.length("full_text"), F.lit(211))).alias("offset")), seg


def _page_sql(expr: str) -> str:
    return f"WITH {OFFSETS} SELECT pts.file_id, CAST(off AS INTEGER) AS \"offset\", {expr} AS page FROM pts"


@query("page_of_offset", _page_sql("coalesce((SELECT min(page) FROM seg WHERE seg.file_id = pts.file_id AND char_start <= off AND off < char_end), (SELECT max(page) FROM seg WHERE seg.file_id = pts.file_id))"))
def page_of_offset(spark, sf):
    return R.page_of_offset(*_points(spark, sf))


@query("page_for_offset_incl", _page_sql("coalesce((SELECT min(page) FROM seg WHERE seg.file_id = pts.file_id AND char_start <= off AND off <= char_end), 0)"))
def page_for_offset_incl(spark, sf):
    return R.page_for_offset_incl(*_points(spark, sf)).fillna({"page": 0})


@query("page_asof_start", f"WITH {OFFSETS} SELECT pts.file_id, CAST(off AS INTEGER) AS \"offset\", page FROM pts ASOF JOIN seg ON seg.file_id = pts.file_id AND off >= char_start")
def page_asof_start(spark, sf):
    return R.page_asof_start(*_points(spark, sf))


@query("document_view", f"WITH {ANALYZED}, {SEGMENTS.removeprefix(HEB + ', ')} SELECT a.query_id, a.doc_id, md5(text) AS text, spans, (SELECT count(*) FROM seg WHERE file_id = a.doc_id) AS pages FROM analyzed a JOIN heb USING (doc_id) WHERE a.query_id IN (6, 7)")
def document_view(spark, sf):
    """Text, spans and page table; the queries' proximity is off."""
    docs = heb(spark, sf)
    _, seg = segments(spark, sf)
    hits = M.analyze(M.Texts(docs), [q for q in ASKED if q.query_id in (6, 7)])
    flat = F.array_join(F.transform("spans", lambda s: F.concat(F.lpad(s["start"].cast("string"), 8, "0"), F.lit("-"), s["end"].cast("string"))), ",")
    pages = seg.groupBy(F.col("file_id").alias("doc_id")).agg(F.count("*").alias("pages"))
    return hits.join(docs, "doc_id").join(pages, "doc_id").select("query_id", "doc_id", F.md5("text").alias("text"), flat.alias("spans"), "pages")
