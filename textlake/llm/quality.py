"""Operator 4, quality rules: base counts and distribution divergence, in DataFrame functions only.

Each text becomes two histograms: character classes, and the common words of its language (one bin
a word, one for all other words).  A language's reference is the mean histogram over all its
documents, so a few long documents don't set it.  The Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1) of a document to its language's reference decides, once the text is long
enough for the comparison: ``min_letters`` characters in words for classes, ``min_words`` words for
common words.  A document of no listed language is compared to the mean of all documents in
character classes only.

Everything about one text is computed inside its row, so no word is shuffled; what meets in one
place is a row of sums for each listed language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import SPACE, free_name, materialize, small, table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of each language (fixed values).
COMMON_WORDS = {
    "en": ("the", "of", "and", "in", "to", "a", "is", "was", "that", "for", "it", "with"),
    "fr": ("le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "est"),
    "de": ("der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "ein", "auf"),
    "es": ("el", "la", "los", "las", "de", "del", "y", "en", "que", "se", "no", "con"),
}
BINS = 1 + max(map(len, COMMON_WORDS.values()))
#: Character classes next to symbols, blanks, and the rest (other signs: control characters, emoji, …).
CLASSES = {"lower": r"[a-z]", "upper": r"\p{Lu}", "digit": r"[0-9]", "accented": r"[\p{L}&&[^\x00-\x7F]&&[^\p{Lu}]]", "stop": r"[.,;:!?'\"()-]"}
N_CLASSES = len(CLASSES) + 3

MIN_WORDS, MIN_LETTERS = 100, 200
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.27, 0.245


def _again(h: Column, order: Column) -> Column:
    """Windows whose hash may occur twice, as (whole hash, number) in order.

    ``order`` holds the high half of each window's hash over the window's number, sorted as plain
    longs, which is fast; only neighbours with the same high half are sorted by the whole hash.
    """
    high, low = F.lit(-(1 << 32)), F.lit((1 << 32) - 1)
    top = lambda x: x.bitwiseAND(high)
    near = lambda a, x, j, f: F.coalesce(f(F.get(a, j - 1)) == f(x), F.lit(False)) | F.coalesce(f(F.get(a, j + 1)) == f(x), F.lit(False))
    maybe = F.filter(order, lambda x, j: near(order, x, j, top))
    at = lambda x: x.bitwiseAND(low).cast("int")
    return F.sort_array(F.transform(maybe, lambda x: F.struct(F.get(h, at(x)).alias("h"), at(x).alias("i"))))


def features(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``docs`` with _n, _chars, _symbols, _dup_lines, _repeat, _lang, _classes and _bins."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.when(F.col(lang_col).isin(*COMMON_WORDS), F.col(lang_col))
    bare = F.btrim(text, F.lit(BLANKS))
    df = docs.withColumn("_lang", lang)
    df = df.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    df = df.withColumn("_n", F.size("_words").cast("long")).withColumn("_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # classes share no character: each one's runs are cut out of what the ones before left
    df = df.withColumn("_left", text)
    for k, v in {**CLASSES, "symbols": SYMBOLS}.items():
        df = df.withColumn("_cut", F.regexp_replace("_left", f"{v}+", ""))
        df = df.withColumn(f"_{k}", (F.length("_left") - F.length("_cut")).cast("long")).withColumn("_left", F.col("_cut"))
    blank, all_chars = F.length(text) - F.col("_chars"), F.length(text)
    known = [F.col(f"_{k}") for k in CLASSES] + [F.col("_symbols"), blank]
    rest = all_chars
    for c in known:
        rest = rest - c
    df = df.withColumn("_classes", F.array(*(c.cast("double") for c in [*known, rest])))
    padded = F.concat(F.lit(" "), F.lower(F.array_join("_words", "  ")), F.lit(" "))
    df = df.withColumn("_padded", F.when(F.col("_lang").isNotNull(), padded))
    bins = F.lit(None).cast("array<double>")
    for key, listed in COMMON_WORDS.items():
        found = [((F.length("_padded") - F.length(F.replace(F.col("_padded"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)) for w in listed]
        bins = F.when(F.col("_lang") == key, F.array(*found)).otherwise(bins)
    df = df.withColumn("_bins", bins)
    df = df.withColumn("_bins", F.concat("_bins", F.array(F.col("_n") - F.aggregate("_bins", F.lit(0.0), lambda a, x: a + x))))
    w = F.col("_words")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("_h", F.when(F.size(w) >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_order", F.sort_array(F.transform("_h", lambda x, i: x.bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(i.cast("long")))))
    df = df.withColumn("_again", _again(F.col("_h"), F.col("_order")))
    same = lambda x, j: F.coalesce(F.get(F.col("_again"), j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("_again"), j + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter("_again", same), lambda x: x["i"])))
    reach = F.transform("_starts", lambda x, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_starts"), j + 1) - x, F.lit(3))))
    df = df.withColumn("_repeat", F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x))
    return df.drop("_words", "_lines", "_left", "_cut", "_padded", "_h", "_order", "_again", "_starts", *(f"_{k}" for k in CLASSES))


def _distance(counts: str, reference: str, n: int) -> Column:
    """Jensen-Shannon distance of a histogram of counts to a reference distribution."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    sum_ = F.lit(0.0)
    for i in range(n):
        p, q = F.get(F.col(counts), F.lit(i)) / total, F.get(F.col(reference), F.lit(i))
        m = (p + q) / 2
        sum_ = sum_ + F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    return F.when(total > 0, F.sqrt(F.greatest(sum_ / 2, F.lit(0.0))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, min_letters: int = MIN_LETTERS, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance.

    A null text counts as an empty one and fails the base rules (under 50 words).  A null or
    unlisted language leaves word_distance null, which rejects nothing.  Rows that repeat are judged
    each by itself; a null id is kept as null.  An empty table gives an empty one.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_language"))
    seen = materialize(features(src, "_text", "_language").drop("_text", "_language"), "features")
    share = lambda c, i: F.avg(F.when(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) > 0, F.get(F.col(c), F.lit(i)) / F.aggregate(c, F.lit(0.0), lambda a, x: a + x)))
    means = [F.array(*(share("_classes", i) for i in range(N_CLASSES))).alias("_ref_classes"), F.array(*(share("_bins", i) for i in range(BINS))).alias("_ref_bins")]
    listed = seen.groupBy("_lang").agg(*means).where("_lang is not null")
    pooled = seen.agg(*means).select(F.lit(None).cast("string").alias("_lang"), "_ref_classes", "_ref_bins")
    # one row for each listed language and one for the rest
    refs = F.broadcast(materialize(listed.union(pooled).withColumnRenamed("_lang", "_of"), "references"))
    out = seen.join(refs, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    out = out.withColumns({"class_distance": _distance("_classes", "_ref_classes", N_CLASSES), "word_distance": _distance("_bins", "_ref_bins", BINS)})
    base = (F.col("_n") < 50) | (100 * F.col("_repeat") > 50 * F.col("_n"))
    far = F.when(F.col("_chars") >= min_letters, F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False))).otherwise(False)
    odd = F.when(F.col("_n") >= min_words, F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False))).otherwise(False)
    return out.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_dup_lines").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"), base.alias("base_failed"), (~base & ~far & ~odd).alias("kept"), "class_distance", "word_distance",
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their columns; rejected rows go.

    Rows are joined back by a number that is the row's own content hash, so rows without an id and
    repeated ids are judged by their own texts.
    """
    key = free_name(docs, "_row_key")
    hashed = F.xxhash64(F.col(id_col), F.col(text_col), F.col(lang_col))
    verdict = quality(docs.select(hashed.alias(key), text_col, lang_col), key, text_col, lang_col)
    lost = materialize(verdict.where("not kept").select(F.col(key).alias("_lost")).distinct(), "rejected", docs.count())
    return docs.withColumn(key, hashed).join(small(lost), F.col(key) == F.col("_lost"), "left_anti").drop(key)


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _sql_distance(counts: str, reference: str, n: int) -> str:
    terms = []
    for i in range(1, n + 1):
        p, q = f"({counts}[{i}] / list_sum({counts}))", f"{reference}[{i}]"
        m = f"(({p} + {q}) / 2)"
        terms.append(f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END")
    return f"CASE WHEN list_sum({counts}) > 0 THEN sqrt(greatest(({' + '.join(terms)}) / 2, 0)) END"


def _sql() -> str:
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    listed = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    bins = " ".join(f"WHEN '{k}' THEN [{', '.join(f"CAST(len(list_filter(lw, lambda x: x = '{w}')) AS DOUBLE)" for w in v)}]" for k, v in COMMON_WORDS.items())
    mean = lambda c, n: "[" + ", ".join(f"avg({c}[{i}] / list_sum({c})) FILTER (list_sum({c}) > 0)" for i in range(1, n + 1)) + "]"
    return f"""
WITH a AS (
  SELECT doc_id, CASE WHEN lang IN ({listed}) THEN lang END AS l, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
b AS (
  SELECT *, CAST(len(ws) AS BIGINT) AS n, CAST(length(array_to_string(ws, '')) AS BIGINT) AS chars,
         list_transform(ws, lambda x: lower(x)) AS lw,
         CAST({count("[#*$%&|<>]")} AS BIGINT) AS sy, {count("[A-Z]")} AS asciiup, {count("[A-Za-z]")} AS ascii,
         {count("\\p{Lu}")} AS up, {count("\\p{L}")} AS letters, {count("[0-9]")} AS dig,
         {count("[.,;:!?''\"()-]")} AS stop,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM a),
c AS (
  SELECT *, [CAST(ascii - asciiup AS DOUBLE), up, dig, letters - ascii - (up - asciiup), stop, sy, length(t) - chars,
             length(t) - (ascii - asciiup) - up - dig - (letters - ascii - (up - asciiup)) - stop - sy - (length(t) - chars)] AS k,
         CASE l {bins} END AS b0 FROM b),
d AS (SELECT * EXCLUDE (b0), list_append(b0, n - list_sum(b0)) AS bn FROM c),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM a WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY doc_id),
refs AS (SELECT l, {mean("k", N_CLASSES)} AS rk, {mean("bn", BINS)} AS rb FROM d WHERE l IS NOT NULL GROUP BY l
         UNION ALL SELECT NULL, {mean("k", N_CLASSES)}, {mean("bn", BINS)} FROM d),
e AS (
  SELECT d.doc_id, n, chars, sy, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS dl, coalesce(r, 0) AS r,
         {_sql_distance("k", "rk", N_CLASSES)} AS dk, {_sql_distance("bn", "rb", BINS)} AS db
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN refs ON d.l IS NOT DISTINCT FROM refs.l),
f AS (SELECT *, n < 50 OR 100 * r > 50 * n AS bad FROM e)
SELECT doc_id, n AS n_words, chars AS word_chars, sy AS n_symbols, dl AS n_dup_lines, CAST(r AS BIGINT) AS n_repeat_words,
       bad AS base_failed,
       NOT bad AND NOT (chars >= {MIN_LETTERS} AND coalesce(dk > {MAX_CLASS_DISTANCE}, false))
               AND NOT (n >= {MIN_WORDS} AND coalesce(db > {MAX_WORD_DISTANCE}, false)) AS kept
FROM f"""


OP4_SQL = _sql()
