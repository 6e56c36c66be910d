"""Views over the driver's tables that give the engine Hebrew text, pages, books and states.

Each has a DataFrame form and the same view as a common table expression for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FROM = "abcdefghijklmnopqrstuvwxyzéèêçäöüßñíó"
TO = "אבכדהפגחיץקלמןערשתםטוךזקיע" + "".join(map(chr, (1460, 1462, 1464, 1468, 1425, 1443, 1470, 1524, 1523, 1456, 1465)))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def heb(spark: SparkSession, sf: str) -> DataFrame:
    """heb_documents: (doc_id, source, lang, path, ext, text)."""
    ext = F.expr("CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' ELSE '.html' END")
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), ext)
    return read(spark, sf, "documents").select("doc_id", "source", "lang", path.alias("path"), ext.alias("ext"), F.translate(F.lower("text"), FROM, TO).alias("text"))


HEB = f"""heb AS (
  SELECT doc_id, source, lang,
         '/lib/' || source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || e AS path, e AS ext,
         translate(lower(text), '{FROM}', '{TO}') AS text
  FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' ELSE '.html' END AS e FROM documents))"""


def visual(spark: SparkSession, sf: str) -> DataFrame:
    """visual_documents: unpointed English texts; a third has every line reversed."""
    pointed = f"[{chr(0x591)}-{chr(0x5C7)}]"
    flipped = F.array_join(F.transform(F.split("text", "\n", -1), F.reverse), "\n")
    docs = heb(spark, sf).where(~F.col("text").rlike(pointed))
    return docs.withColumn("text", F.when((F.col("lang") == "en") & (F.col("doc_id") % 3 == 0), flipped).otherwise(F.col("text")))


VISUAL = f"""{HEB}, visual AS (
  SELECT doc_id, source, lang, path, ext,
         CASE WHEN lang = 'en' AND doc_id % 3 = 0 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x: reverse(x)), chr(10)) ELSE text END AS text
  FROM heb WHERE NOT regexp_matches(text, '[{chr(0x591)}-{chr(0x5C7)}]'))"""


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """doc_pages: (file_id, page int, text), three lines a page."""
    lines = heb(spark, sf).select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    page = (F.floor(F.col("n") / 3.0).cast("int") + 1).alias("page")
    rows = lines.groupBy("file_id", page).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return rows.select("file_id", "page", F.array_join(F.col("lines.line"), "\n").alias("text"))


DOC_PAGES = f"""{HEB}, doc_lines AS (
  SELECT doc_id AS file_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM heb)),
doc_pages AS (
  SELECT file_id, CAST(floor(n / 3.0) AS INTEGER) + 1 AS page, string_agg(line, chr(10) ORDER BY n) AS text
  FROM doc_lines GROUP BY file_id, CAST(floor(n / 3.0) AS INTEGER) + 1)"""


#: A book holds the documents of a source whose ids share a block of this length, so that books are
#: bounded and their number grows with the input.
BOOK_IDS = 500
BOOK = f"source || '-' || (doc_id // {BOOK_IDS})"


def book_name():
    return F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / BOOK_IDS).cast("string"))


def books(spark: SparkSession, sf: str) -> DataFrame:
    """books: (path, source, raw_text); source is the book's name."""
    return heb(spark, sf).transform(books_of)


def books_of(docs: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    docs = docs.withColumn("source", book_name())
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    head = F.translate(F.substring("text", 1, 20), "\n", " ")
    docs = docs.withColumn("rn", rn).withColumn("head", head)
    line = F.when(F.col("rn") % 10 == 1, F.concat(F.lit("$ "), "head")).when(F.col("rn") % 4 == 0, F.concat(F.lit("<h3>"), "head", F.lit("</h3>"))).when(F.col("rn") % 3 == 0, F.concat(F.lit("@ "), "head")).otherwise(F.concat(F.lit("~ "), "head"))
    part = F.concat(line, F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = docs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rn", part.alias("part")))).alias("parts"))
    return rows.select(F.concat(F.lit("/lib/"), "source", F.lit(".txt")).alias("path"), "source", F.concat(F.lit("!legend\n"), F.array_join(F.col("parts.part"), "")).alias("raw_text"))


BOOKS = f"""{HEB}, books AS (
  SELECT '/lib/' || source || '.txt' AS path, source, '!legend' || chr(10) || string_agg(part, '' ORDER BY rn) AS raw_text
  FROM (SELECT source, rn,
          CASE WHEN rn % 10 = 1 THEN '$ ' || head WHEN rn % 4 = 0 THEN '<h3>' || head || '</h3>' WHEN rn % 3 = 0 THEN '@ ' || head ELSE '~ ' || head END || chr(10) || text || chr(10) AS part
        FROM (SELECT {BOOK} AS source, text, row_number() OVER (PARTITION BY {BOOK} ORDER BY doc_id) AS rn, replace(substr(text, 1, 20), chr(10), ' ') AS head FROM heb))
  GROUP BY source)"""
