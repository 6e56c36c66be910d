"""Match predicates over a token table: occurrences, phrases, minimum match, proximity.

A search is many queries at once: a short list in the program, a DataFrame of words in the plan.  Word
matches are equi-joins on normal form and stem, never an OR; which side is broadcast is left to the
planner, which knows the sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.functions import text as T
from textlake.sources.tables import stored


@dataclass(frozen=True)
class Query:
    query_id: int
    q: str
    exact: bool = False
    whole_word: bool = False
    fold_vy: bool = False
    fold_aa: bool = False
    min_words: int = 0
    proximity: int = 30


SCHEMA = "query_id int, q string, exact boolean, whole_word boolean, fold_vy boolean, fold_aa boolean, min_words int, proximity int"


def query_table(spark: SparkSession, queries: list[Query]) -> DataFrame:
    rows = [(q.query_id, q.q, q.exact, q.whole_word, q.fold_vy, q.fold_aa, q.min_words, q.proximity) for q in queries]
    return spark.createDataFrame(rows, SCHEMA)


def query_words(queries: DataFrame) -> DataFrame:
    """A row for each word of a query: w (its number), term, stem, n_words, required, and the options."""
    n = queries.withColumn("terms", T.query_terms("q")).withColumn("n_words", F.size("terms"))
    n = n.withColumn("required", F.when((F.col("min_words") > 0) & (F.col("min_words") < F.col("n_words")), F.col("min_words")).otherwise(F.col("n_words")))
    rows = n.select("query_id", F.posexplode("terms").alias("w", "term"), "n_words", "required", "exact", "whole_word", "fold_vy", "fold_aa", "proximity")
    return rows.withColumn("stem", T.light_stem("term"))


def _modes(queries: list[Query]) -> list[tuple[bool, bool]]:
    return sorted({(q.fold_vy, q.fold_aa) for q in queries})


def _mode(vy, aa) -> Column:
    vy, aa = (F.lit(x) if isinstance(x, bool) else F.col(x) for x in (vy, aa))
    return vy.cast("int") * 2 + aa.cast("int")


def token_keys(tokens: DataFrame, modes: list[tuple[bool, bool]], *more: str) -> DataFrame:
    """The keys that a token can be found by: folded normal form and folded stem, for each mode."""
    keys = []
    for vy, aa in modes:
        for kind, name in ((0, "norm"), (1, "stem")):
            keys.append(F.struct(_mode(vy, aa).alias("mode"), F.lit(kind).alias("kind"), T.fold_form(name, vy, aa).alias("key")))
    return tokens.select("doc_id", "pos", "start", "end", *more, F.inline(F.array(*keys)))


class Texts:
    """Texts (doc_id, text) that are searched without a table of all their tokens: a first pass tells their
    forms, a second one brings the tokens of the forms that are asked for.  It can stand for a token table
    in every search here."""

    def __init__(self, docs: DataFrame):
        self.docs, self.sparkSession, self.surfaces = docs.select("doc_id", "text"), docs.sparkSession, None

    def keep(self) -> Texts:
        """The texts, written and dealt out by id, so what made them runs once."""
        if self.surfaces is not None:
            return self
        self.docs = stored(self.docs.repartition(F.col("doc_id")), "texts")
        self.surfaces = stored(T.surface_forms(self.docs).distinct().withColumn("norm", T.normalize_token("surface")), "surfaces")
        return self

    def unique(self) -> bool:
        """Whether no id has two kept texts."""
        return self.docs.groupBy("doc_id").count().where("count > 1").isEmpty()

    def of(self, forms: DataFrame) -> DataFrame:
        """(doc_id, pos, start, end, norm) of tokens with one of ``forms`` (norm, …)."""
        some = self.surfaces.join(forms.select("norm").distinct(), "norm", "left_semi").select("surface", "norm").limit(TOLD_SURFACES + 1).collect()
        if len(some) > TOLD_SURFACES:  # too many for each task to hold
            return T.tokens(self.docs).select("doc_id", "pos", "start", "end", "norm").join(forms.select("norm").distinct(), "norm", "left_semi")
        return stored(T.places_of(self.docs, {r.surface: r.norm for r in some}), "places")  # read more than once


#: So many surfaces of asked forms, at most, go to every task.
TOLD_SURFACES = 1 << 17


def kept_tokens(tokens: DataFrame | Texts) -> DataFrame | Texts:
    """The token table, written: its vocabulary is matched first and its rows are read again after that.
    Stems are those of the vocabulary, made once for each form."""
    return tokens.keep() if isinstance(tokens, Texts) else stored(tokens.select("doc_id", "pos", "start", "end", "norm"), "tokens")


def vocabulary(tokens: DataFrame | Texts) -> DataFrame:
    """(norm, stem) of kept tokens; written, so that stems and folds are not made of every token."""
    forms = (tokens.surfaces if isinstance(tokens, Texts) else tokens).select("norm").distinct()
    return stored(forms.withColumn("stem", T.light_stem("norm")), "norms")


def _with_forms(tokens: DataFrame | Texts, found: DataFrame) -> DataFrame:
    """Kept tokens with the rows of found (norm, …) that have their form."""
    return (tokens.of(found) if isinstance(tokens, Texts) else tokens).join(found, "norm")


def word_occurrences(tokens: DataFrame | Texts, queries: list[Query]) -> DataFrame:
    """(query_id, w, doc_id, pos, start, end): a token is an occurrence of a word if their normal forms
    are equal or, unless whole words are asked for, any of normal form and stem equals any.  Each form
    of the vocabulary is compared once, whatever the number of its tokens."""
    tokens = kept_tokens(tokens)
    return _occurrences(tokens, vocabulary(tokens), queries)


def _occurrences(tokens: DataFrame | Texts, forms: DataFrame, queries: list[Query]) -> DataFrame:
    return _placed(tokens, stored(form_matches(forms, queries), "forms"))  # of known size, so tokens are not shuffled for a few


def _placed(tokens: DataFrame | Texts, found: DataFrame) -> DataFrame:
    return _with_forms(tokens, found).select("query_id", "w", "doc_id", "pos", "start", "end")


def phrase_occurrences(tokens: DataFrame | Texts, queries: list[Query]) -> DataFrame:
    """(query_id, doc_id, pos, start, end) for every place where a query's words follow each other."""
    tokens = kept_tokens(tokens)
    return _phrases(tokens, vocabulary(tokens), queries)


def _phrases(tokens: DataFrame | Texts, forms: DataFrame, queries: list[Query]) -> DataFrame:
    return in_a_row(_with_forms(tokens, stored(phrase_forms(forms, queries), "forms")))


def windowed(occurrences: DataFrame, queries: list[Query], n_words: int, *more: Column) -> DataFrame:
    """(query_id, doc_id, found, near, …): how many different words a document has, the most of them within
    the query's proximity, and ``more`` aggregates.  ``n_words``: of the longest query.  A word is near a
    place if its last occurrence up to there is, so running maxima are enough; all of a document's
    occurrences are shuffled once."""
    upto = Window.partitionBy("query_id", "doc_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    reach = F.lit(None).cast("int")
    for n in sorted({q.proximity for q in queries if q.proximity > 0}):
        reach = F.when(F.col("query_id").isin([q.query_id for q in queries if q.proximity == n]), F.lit(n)).otherwise(reach)
    last = {f"_l{k}": F.max(F.when(F.col("w") == k, F.col("pos"))).over(upto) for k in range(n_words)}
    total = lambda parts: sum(parts, F.lit(0))
    near = F.when(reach.isNotNull(), total(F.coalesce((F.col(c) >= F.col("pos") - reach).cast("int"), F.lit(0)) for c in last))
    found = total(F.max((F.col("w") == k).cast("int")) for k in range(n_words)).cast("long")
    return occurrences.withColumns(last).withColumn("near", near).groupBy("query_id", "doc_id").agg(found.alias("found"), F.max("near").alias("near"), *more)


def matched(occurrences: DataFrame, queries: list[Query], *more: Column) -> DataFrame:
    """(query_id, doc_id, …) of documents with enough words, near enough to each other, with ``more``
    aggregates of their occurrences."""
    words = query_words(query_table(occurrences.sparkSession, queries))
    need = words.select("query_id", "required", "proximity").distinct()
    n_words = words.agg(F.coalesce(F.max("n_words"), F.lit(0))).first()[0]
    seen = windowed(occurrences, queries, n_words, *more)
    out = [c for c in seen.columns if c not in ("found", "near")]
    return seen.join(need, "query_id").where("found >= required and (required <= 1 or proximity <= 0 or near >= required)").select(*out)


#: So many keys of query words are told to a scan of the vocabulary as a filter; more are only joined.
TOLD = 1000


def _near(forms: DataFrame, words: DataFrame, modes: list[tuple[bool, bool]], stems: bool) -> DataFrame:
    """The forms that can have a key of words (mode, key), so that only these are spread over their keys."""
    keys = words.select("mode", "key").distinct().limit(TOLD + 1).collect()
    if len(keys) > TOLD:
        return forms
    hit = F.lit(False)
    for vy, aa in modes:
        own = [r.key for r in keys if r.mode == int(vy) * 2 + int(aa)]
        for name in ("norm", "stem") if stems else ("norm",):
            hit |= T.fold_form(name, vy, aa).isin(own)
    return forms.where(hit)


def form_matches(forms: DataFrame, queries: list[Query]) -> DataFrame:
    """(query_id, w, norm): which forms (norm, stem) of a vocabulary are occurrences of which word."""
    words = query_words(query_table(forms.sparkSession, queries))
    asked = F.array(*(F.struct(F.lit(kind).alias("q_kind"), T.fold_form(name, F.col("fold_vy"), F.col("fold_aa")).alias("key")) for kind, name in ((0, "term"), (1, "stem"))))
    words = words.select("query_id", "w", "whole_word", _mode("fold_vy", "fold_aa").alias("mode"), F.inline(asked))
    found = _keyed(_near(forms, words, _modes(queries), True), queries).join(words, ["mode", "key"]).where("not whole_word or (kind = 0 and q_kind = 0)")
    return found.select("query_id", "w", "norm").distinct()


def phrase_forms(forms: DataFrame, queries: list[Query]) -> DataFrame:
    """(query_id, w, n_words, norm): which forms can stand for which word of an exact phrase."""
    words = query_words(query_table(forms.sparkSession, queries))
    words = words.select("query_id", "w", "n_words", _mode("fold_vy", "fold_aa").alias("mode"), T.fold_form("term", F.col("fold_vy"), F.col("fold_aa")).alias("key"))
    return _keyed(_near(forms, words, _modes(queries), False), queries).where("kind = 0").join(words, ["mode", "key"]).select("query_id", "w", "n_words", "norm").distinct()


def _keyed(forms: DataFrame, queries: list[Query]) -> DataFrame:
    nowhere = [F.lit(0).alias(c) for c in ("doc_id", "pos", "start", "end")]
    return token_keys(forms.select(*nowhere, "norm", "stem"), _modes(queries), "norm")


def in_a_row(hits: DataFrame) -> DataFrame:
    """Of hits (query_id, doc_id, pos, w, n_words, start, end) of phrase words, the whole phrases."""
    at = hits.groupBy("query_id", "doc_id", (F.col("pos") - F.col("w")).alias("pos"), "n_words").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return at.where("n = n_words").select("query_id", "doc_id", "pos", "start", "end")


def analyze(tokens: DataFrame | Texts, queries: list[Query]) -> DataFrame:
    """(query_id, doc_id, spans array<struct<start,end>>, first_pos) of the documents that match; spans
    are all occurrences, each once, in order."""
    exact, plain = [q for q in queries if q.exact], [q for q in queries if not q.exact]
    tokens = kept_tokens(tokens)
    forms = vocabulary(tokens)
    found = stored(form_matches(forms, plain), "forms") if plain else None
    phrases = stored(phrase_forms(forms, exact), "forms") if exact else None
    if isinstance(tokens, Texts) and plain and exact:  # texts are cut once for both
        tokens = tokens.of(found.select("norm").union(phrases.select("norm")))
    return spans(_placed(tokens, found) if plain else None, in_a_row(_with_forms(tokens, phrases)) if exact else None, plain)


def spans(found: DataFrame | None, phrases: DataFrame | None, plain: list[Query]) -> DataFrame:
    """As ``analyze``, from the occurrences of plain queries' words and of exact phrases."""
    whole = (F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.min("pos").alias("first_pos"))
    parts = []  # a query is plain or exact, so its documents are in one part
    if found is not None:
        parts.append(matched(found, plain, *whole))
    if phrases is not None:
        parts.append(phrases.groupBy("query_id", "doc_id").agg(*whole))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def contains_phrase(tokens: DataFrame | Texts, docs: DataFrame, queries: list[Query]) -> DataFrame:
    """(query_id, doc_id, contained) for each query and document; a phrase without words is contained."""
    asked = query_table(tokens.sparkSession, queries).select("query_id", F.size(T.query_terms("q")).alias("n"))
    hits = phrase_occurrences(tokens, queries).select("query_id", "doc_id", F.lit(True).alias("hit")).distinct()
    ids = F.explode(F.array(*(F.lit(q.query_id) for q in queries))).alias("query_id")
    rows = docs.select("doc_id", ids).join(asked, "query_id").join(hits, ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", (F.coalesce("hit", F.lit(False)) | (F.col("n") == 0)).alias("contained"))


def word_spans(tokens: DataFrame | Texts, forms: DataFrame) -> DataFrame:
    """(query_id, doc_id, start, end) of tokens whose normal form or stem is one of (query_id, form)."""
    tokens = kept_tokens(tokens)
    keys = vocabulary(tokens).select("norm", F.explode(F.array_distinct(F.array("norm", "stem"))).alias("form"))
    found = stored(keys.join(forms, "form").select("query_id", "norm").distinct(), "forms")
    rows = _with_forms(tokens, found).select("query_id", "doc_id", "start", "end")
    if isinstance(tokens, Texts) and tokens.unique():
        return rows  # a token is one place of one text, and a query has its form once
    return rows.distinct()
