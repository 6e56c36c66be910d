"""Queries of the text algebra and of direction repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import bidi as B
from textlake.functions import text as T
from textlake.plans import sqltext as S
from textlake.plans.fixtures import HEB, VISUAL, heb, read, visual
from textlake.registry import query

#: Distinct surfaces of the corpus, for the word functions.
SURFACES = f"{HEB}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, {S.TOKEN})) AS surface FROM heb), n AS (SELECT surface, {S.norm('surface')} AS norm FROM w)"


def _words(spark, sf):
    return heb(spark, sf).select(F.explode(T.surfaces("text")).alias("surface")).distinct().withColumn("norm", T.normalize_token("surface"))


@query("tokenize_offsets", f"WITH {HEB}, {S.tokens('heb')} SELECT doc_id, pos, surface, start, end_ AS \"end\", norm, stem FROM tok")
def tokenize_offsets(spark, sf):
    return T.tokens(heb(spark, sf))


@query("strip_niqqud", f"WITH {HEB} SELECT doc_id, md5(regexp_replace(text, '[{T.POINTS}]', '', 'g')) AS bare FROM heb")
def strip_niqqud(spark, sf):
    return heb(spark, sf).select("doc_id", F.md5(T.strip_niqqud("text")).alias("bare"))


@query("normalize_token", f"WITH {SURFACES} SELECT surface, norm FROM n")
def normalize_token(spark, sf):
    return _words(spark, sf)


@query("strip_prefixes", f"WITH {SURFACES} SELECT DISTINCT norm, {S.prefixes('norm')} AS base FROM n")
def strip_prefixes(spark, sf):
    return _words(spark, sf).select("norm", T.strip_prefixes("norm").alias("base")).distinct()


@query("strip_suffixes", f"WITH {SURFACES} SELECT DISTINCT norm, {S.suffixes('norm')} AS base FROM n")
def strip_suffixes(spark, sf):
    return _words(spark, sf).select("norm", T.strip_suffixes("norm").alias("base")).distinct()


@query("light_stem", f"WITH {SURFACES} SELECT DISTINCT norm, {S.stem('norm')} AS stem FROM n")
def light_stem(spark, sf):
    return _words(spark, sf).select("norm", T.light_stem("norm").alias("stem")).distinct()


@query("normalized_stream", f"WITH {HEB} SELECT doc_id, md5(array_to_string({S.norms('text')}, ' ')) AS stream FROM heb")
def normalized_stream(spark, sf):
    return heb(spark, sf).select("doc_id", F.md5(T.normalized_stream("text")).alias("stream"))


@query("stemmed_stream", f"WITH {HEB} SELECT doc_id, md5(array_to_string(list_transform({S.norms('text')}, lambda x: {S.stem('x')}), ' ')) AS stream FROM heb")
def stemmed_stream(spark, sf):
    return heb(spark, sf).select("doc_id", F.md5(T.stemmed_stream("text")).alias("stream"))


@query("fold_form", f"WITH {SURFACES} SELECT DISTINCT norm, {S.fold('norm', True, False)} AS vy, {S.fold('norm', False, True)} AS aa, {S.fold('norm')} AS both_ FROM n")
def fold_form(spark, sf):
    return _words(spark, sf).select("norm", T.fold_form("norm", True, False).alias("vy"), T.fold_form("norm", False, True).alias("aa"), T.fold_form("norm").alias("both_")).distinct()


@query("fold_stream", f"WITH {HEB}, m AS (SELECT doc_id, {S.norms('text')} AS n FROM heb) SELECT doc_id, md5(array_to_string(list_concat(list_transform(n, lambda x: {S.fold('x')}), list_transform(list_transform(n, lambda x: {S.stem('x')}), lambda x: {S.fold('x')})), ' ')) AS stream FROM m")
def fold_stream(spark, sf):
    return heb(spark, sf).select("doc_id", F.md5(T.fold_stream("text")).alias("stream"))


#: Queries made of the corpus itself: the first and the last part of each text's head, one in quotes.
ASKED = """asked AS (SELECT doc_id, '"' || replace(substr(text, 1, 12), '"', ' ') || '" ' || substr(text, 30, 25) || ' "' || replace(substr(text, 60, 9), '"', ' ') || '"' AS q FROM heb)"""


def _asked(spark, sf):
    part = lambda a, n: F.replace(F.substring("text", a, n), F.lit('"'), F.lit(" "))
    return heb(spark, sf).select("doc_id", F.concat(F.lit('"'), part(1, 12), F.lit('" '), F.substring("text", 30, 25), F.lit(' "'), part(60, 9), F.lit('"')).alias("q"))


@query("query_terms", f"WITH {HEB}, {ASKED} SELECT doc_id, array_to_string({S.norms('q')}, '|') AS terms FROM asked")
def query_terms(spark, sf):
    return _asked(spark, sf).select("doc_id", F.array_join(T.query_terms("q"), "|").alias("terms"))


@query("query_match_set", f"WITH {HEB}, {ASKED}, m AS (SELECT doc_id, {S.norms('q')} AS n FROM asked) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(n, list_transform(n, lambda x: {S.stem('x')})), lambda x: x <> ''))), '|') AS forms FROM m")
def query_match_set(spark, sf):
    return _asked(spark, sf).select("doc_id", F.array_join(F.sort_array(T.query_match_set("q")), "|").alias("forms"))


@query("quoted_phrases", f"""WITH {HEB}, {ASKED} SELECT doc_id, array_to_string(list_concat(regexp_extract_all(q, '"([^"]+)"', 1), [regexp_replace(q, '"[^"]+"', ' ', 'g')]), '|') AS phrases FROM asked""")
def quoted_phrases(spark, sf):
    return _asked(spark, sf).select("doc_id", F.array_join(T.quoted_phrases("q"), "|").alias("phrases"))


@query("strip_points_display", f"WITH {HEB} SELECT doc_id, md5(regexp_replace(text, '[{chr(0x5B0)}-{chr(0x5C7)}]', '', 'g')) AS no_vowels, md5(regexp_replace(text, '[{chr(0x591)}-{chr(0x5AF)}]', '', 'g')) AS no_cantillation FROM heb")
def strip_points_display(spark, sf):
    return heb(spark, sf).select("doc_id", F.md5(T.strip_points_display("text", True, False)).alias("no_vowels"), F.md5(T.strip_points_display("text", False, True)).alias("no_cantillation"))


@query("text_marks_flags", f"WITH {HEB} SELECT doc_id, regexp_matches(text, '[{chr(0x5B0)}-{chr(0x5C7)}]') AS has_niqqud, regexp_matches(text, '[{chr(0x591)}-{chr(0x5AF)}]') AS has_teamim FROM heb")
def text_marks_flags(spark, sf):
    return heb(spark, sf).select("doc_id", T.has_niqqud("text").alias("has_niqqud"), T.has_teamim("text").alias("has_teamim"))


NAMES = """names AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CAST(doc_id AS VARCHAR) || '_ ' || lang WHEN 1 THEN ' ' || CAST(doc_id % 7 AS VARCHAR) || ' - ' || source
  WHEN 2 THEN lang || '_' || CAST(doc_id AS VARCHAR) WHEN 3 THEN CAST(doc_id AS VARCHAR) || '.' ELSE '00' || CAST(doc_id AS VARCHAR) || '. ' || source || ' ' END AS name FROM documents)"""
ORDER_RE = "'^\\s*(\\d+)\\s*[-_.\\s]\\s*'"


@query("order_prefix", f"""WITH {NAMES}, p AS (SELECT *, regexp_extract(name, {ORDER_RE}, 1) AS d, trim(regexp_replace(name, {ORDER_RE}, '')) AS r FROM names)
SELECT doc_id, CASE WHEN d = '' OR r = '' THEN {T.NO_ORDER} ELSE TRY_CAST(d AS BIGINT) END AS order_number, CASE WHEN r = '' THEN trim(name) ELSE r END AS display FROM p""")
def order_prefix(spark, sf):
    i, s = F.col("doc_id").cast("string"), F.col("source")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(i, F.lit("_ "), "lang")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit(" "), (F.col("doc_id") % 7).cast("string"), F.lit(" - "), s)).when(F.col("doc_id") % 5 == 2, F.concat("lang", F.lit("_"), i)).when(F.col("doc_id") % 5 == 3, F.concat(i, F.lit("."))).otherwise(F.concat(F.lit("00"), i, F.lit(". "), s, F.lit(" ")))
    return read(spark, sf, "documents").select("doc_id", name.alias("name")).select("doc_id", T.order_number("name").alias("order_number"), T.order_display("name").alias("display"))


@query("normalize_exts", "SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'TXT' WHEN 1 THEN '..Pdf' ELSE '.docx' END AS ext, '.' || ltrim(lower(CASE doc_id % 3 WHEN 0 THEN 'TXT' WHEN 1 THEN '..Pdf' ELSE '.docx' END), '.') AS normal FROM documents")
def normalize_exts(spark, sf):
    ext = F.when(F.col("doc_id") % 3 == 0, "TXT").when(F.col("doc_id") % 3 == 1, "..Pdf").otherwise(".docx")
    return read(spark, sf, "documents").select(ext.alias("ext")).distinct().withColumn("normal", T.normalize_ext("ext"))


@query("split_lines", f"WITH {HEB}, l AS (SELECT doc_id, string_split(replace(text, ' ' || chr(10), chr(13) || chr(10)), chr(10)) AS a FROM heb), m AS (SELECT doc_id, list_transform(a, lambda x: rtrim(x, chr(13))) AS b FROM l), k AS (SELECT doc_id, CASE WHEN b[-1] = '' THEN b[:-2] ELSE b END AS c FROM m) SELECT doc_id, CAST(len(c) AS INTEGER) AS n_lines, md5(array_to_string(c, '|')) AS lines FROM k")
def split_lines(spark, sf):
    lines = T.split_lines(F.replace(F.col("text"), F.lit(" \n"), F.lit("\r\n")))
    return heb(spark, sf).select("doc_id", F.size(lines).alias("n_lines"), F.md5(F.array_join(lines, "|")).alias("lines"))


# -- direction ---------------------------------------------------------------------------------

COMMON_SQL = ", ".join(f"'{w}'" for w in B.COMMON)
FINALS_SQL = ", ".join(f"'{c}'" for c in T.FINALS)


def sql_words(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{B.WORD}'), lambda w: regexp_replace(w, '[{T.POINTS}]', '', 'g')), lambda w: length(w) >= 2)"


def sql_score(x: str) -> str:
    one = f"CASE WHEN right(w, 1) IN ({FINALS_SQL}) THEN 2 ELSE 0 END - CASE WHEN left(w, 1) IN ({FINALS_SQL}) THEN 2 ELSE 0 END + CASE WHEN w IN ({COMMON_SQL}) THEN 1 ELSE 0 END"
    return f"CAST(coalesce(list_sum(list_transform({sql_words(x)}, lambda w: {one})), 0) AS INTEGER)"


def sql_flip(x: str) -> str:
    """reverse_visual of a text without points."""
    return f"array_to_string(list_transform(regexp_extract_all(reverse({x}), '(?s){B.LTR_RUN}|[^0-9A-Za-z]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9A-Za-z]') THEN reverse(p) ELSE p END), '')"


def sql_lines(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {sql_flip('l')}), chr(10))"


def sql_flip_words(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\s+|\\S+'), lambda v: CASE WHEN regexp_matches(v, '^\\s') THEN v ELSE {sql_flip('v')} END), '')"


SCORED = f"{VISUAL}, flipped AS (SELECT *, {sql_flip_words('text')} AS words FROM visual), scored AS (SELECT *, {sql_score('text')} AS s0, {sql_score('words')} AS s1 FROM flipped), fixed AS (SELECT *, s1 >= 6 AND s1 >= s0 + 6 AS bad FROM scored)"


@query("hebrew_words", f"WITH {HEB} SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '{B.WORD}'), lambda w: regexp_replace(w, '[{T.POINTS}]', '', 'g')), ' ')) AS words FROM heb")
def hebrew_words(spark, sf):
    return heb(spark, sf).select("doc_id", F.md5(F.array_join(B.hebrew_words("text"), " ")).alias("words"))


@query("direction_score", f"WITH {HEB} SELECT doc_id, {sql_score('text')} AS score FROM heb")
def direction_score(spark, sf):
    return heb(spark, sf).select("doc_id", B.direction_score("text").alias("score"))


@query("reverse_visual", f"WITH {VISUAL} SELECT doc_id, md5({sql_flip('text')}) AS flipped FROM visual")
def reverse_visual(spark, sf):
    return visual(spark, sf).select("doc_id", F.md5(B.reverse_visual("text")).alias("flipped"))


@query("reverse_lines", f"WITH {VISUAL} SELECT doc_id, md5({sql_lines('text')}) AS flipped FROM visual")
def reverse_lines(spark, sf):
    return visual(spark, sf).select("doc_id", F.md5(B.reverse_lines("text")).alias("flipped"))


@query("reverse_words", f"WITH {VISUAL} SELECT doc_id, md5({sql_flip_words('text')}) AS flipped FROM visual")
def reverse_words(spark, sf):
    return visual(spark, sf).select("doc_id", F.md5(B.reverse_words("text")).alias("flipped"))


@query("looks_reversed", f"WITH {SCORED} SELECT doc_id, bad AS reversed FROM fixed")
def looks_reversed(spark, sf):
    return visual(spark, sf).select("doc_id", B.looks_reversed("text").alias("reversed"))


@query("fix_visual_order", f"WITH {SCORED} SELECT doc_id, bad AS changed, md5(CASE WHEN bad THEN {sql_lines('text')} ELSE text END) AS by_lines, md5(CASE WHEN bad THEN words ELSE text END) AS by_words FROM fixed")
def fix_visual_order(spark, sf):
    docs = visual(spark, sf).withColumn("bad", B.looks_reversed("text"))
    return docs.select("doc_id", F.col("bad").alias("changed"), F.md5(F.when(F.col("bad"), B.reverse_lines("text")).otherwise(F.col("text"))).alias("by_lines"), F.md5(F.when(F.col("bad"), B.reverse_words("text")).otherwise(F.col("text"))).alias("by_words"))


LINE_ENDS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2)"


@query("line_order_reversed", f"WITH {VISUAL}, l AS (SELECT doc_id, {LINE_ENDS} AS ls FROM visual) SELECT doc_id, len(list_filter(ls, lambda x: contains('.,:;!?', left(x, 1)))) > len(list_filter(ls, lambda x: contains('.,:;!?', right(x, 1)))) AS reversed FROM l")
def line_order_reversed(spark, sf):
    return visual(spark, sf).select("doc_id", B.line_order_reversed("text").alias("reversed"))


@query("words_look_reversed", f"""WITH {VISUAL}, j AS (SELECT doc_id, array_to_string(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> ''), ' ') AS text FROM visual),
k AS (SELECT doc_id, text, {sql_flip_words('text')} AS words FROM j), s AS (SELECT doc_id, {sql_score('text')} AS s0, {sql_score('words')} AS s1 FROM k)
SELECT doc_id, s1 >= 6 AND s1 >= s0 + 6 AS reversed FROM s""")
def words_look_reversed(spark, sf):
    words = F.filter(F.split("text", "[ \n]", -1), lambda x: x != "")
    return visual(spark, sf).select("doc_id", B.words_look_reversed(words).alias("reversed"))
