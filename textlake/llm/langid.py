"""Operator 2, language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: a cell is a bitmask with a bit for each language, and
the AND of an n-gram's cells is the set of languages that contain it.  For a text, the n-grams of each
language are counted; the counts are corrected for the share of n-grams that a language's slice
reports falsely, and the language with the largest corrected share wins.

An n-gram belongs to a language if enough of its training texts have it, compared to the language
where most do, so stray passages of another language don't enter.  Training reads at most TRAIN_DOCS
texts of each language, chosen by hash; prediction reads every whole text and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.llm.common import crc32_of, materialize, table
from textlake.llm.shingles import U, seeds

GRAM, HASHES, CELL_BITS = 4, 2, 20
TRAIN_DOCS = 400
#: Training texts in all, and bytes of the longest one.
TRAIN_TEXTS, TRAIN_BYTES = 8000, 64 << 10
#: Share of a language's texts that must have an n-gram, and that share against the largest one.
LEAST_SHARE, LEAST_RATIO = 0.01, 0.1
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_TO_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_SEEDS = seeds(HASHES, 401) | U(1)


def grams(text: str) -> np.ndarray:
    """Keys of all n-grams of bytes of the lower-cased text; ASCII that is no letter is blank."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_TO_BLANK), np.uint8)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    key = raw[:n].astype(np.uint32)
    for k in range(1, GRAM):
        key |= raw[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    return key


def cells(keys: np.ndarray) -> list[np.ndarray]:
    x = keys.astype(U)
    with np.errstate(over="ignore"):
        return [((x * s) >> U(64 - CELL_BITS)).astype(np.int32) for s in _SEEDS]


class Filters:
    """languages: list of str; table: [cell, bitmask byte]; false: false-positive rate by language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        bits = np.unpackbits(table, axis=1, bitorder="little")[:, : len(languages)]
        self.false = bits.mean(axis=0) ** HASHES if languages else np.zeros(0)
        self.by_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> Filters:
        languages = sorted(set(langs))
        number = {x: i for i, x in enumerate(languages)}
        n_docs = np.bincount([number[x] for x in langs], minlength=len(languages))
        parts: list[list[np.ndarray]] = [[] for _ in languages]
        for text, lang in zip(texts, langs, strict=True):
            parts[number[lang]].append(np.unique(grams(text)))
        found = [np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, np.uint32), np.zeros(0)) for p in parts]
        keys = np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.uint32)
        most = np.zeros(len(keys))
        shares = []
        for (k, c), n in zip(found, n_docs, strict=True):
            share = np.zeros(len(keys))
            share[np.searchsorted(keys, k)] = c / n
            shares.append(share)
            most = np.maximum(most, share)
        table = np.zeros((1 << CELL_BITS, max(1, -(-len(languages) // 8))), np.uint8)
        for i, share in enumerate(shares):
            least = min(LEAST_SHARE, 2 / n_docs[i]) if n_docs[i] > 2 else 0
            for at in cells(keys[(share > 0) & (share >= least) & (share >= LEAST_RATIO * most)]):
                table[at, i // 8] |= np.uint8(1 << (i % 8))
        return cls(languages, table)

    def shares(self, text: str) -> np.ndarray:
        """Corrected share of the text's n-grams by language."""
        first, *rest = cells(grams(text))
        mask = self.table[first]
        for at in rest:
            mask &= self.table[at]
        hits = np.concatenate([np.bincount(mask[:, b], minlength=256) @ self.by_byte for b in range(mask.shape[1])])[: len(self.languages)]
        return np.maximum(0.0, (hits / max(1, len(first)) - self.false) / (1 - self.false))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the winner's part of all corrected shares; ties go to the first in
        order; without a letter (und, 0)."""
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        share = self.shares(text)
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum()) if share.sum() else 1 / len(share)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS) -> Filters:
    """Fits on at most ``per_language`` texts of each language of ``docs``, the first by a hash of the
    id, and on TRAIN_TEXTS texts in all; texts are of at most TRAIN_BYTES, one for each id.  A hash
    threshold leaves few ids to rank, and only the chosen texts reach the driver."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.octet_length(text_col) <= TRAIN_BYTES))
    ids = materialize(known.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang")), "labelled")
    counts = ids.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(TRAIN_TEXTS).withColumnRenamed("count", "_n")
    counts = materialize(counts, "languages", TRAIN_TEXTS)
    most = min(per_language, TRAIN_TEXTS // max(1, counts.count()))
    h = F.xxhash64("_id", F.lit(7))
    near = ids.join(F.broadcast(counts), "_lang").where(F.pmod(h, F.lit(1 << 30)) * F.col("_n") <= F.lit((1 << 30) * (2 * most + 100)))  # a row a language
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(h, "_id"))
    chosen = materialize(near.withColumn("_k", place).where(F.col("_k") <= most).select("_id").distinct(), "training", TRAIN_TEXTS)
    rows = known.join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))  # at most TRAIN_TEXTS ids
    rows = rows.groupBy("_id").agg(F.min(F.struct(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))).alias("r")).select("_id", "r.lang", "r.text").collect()
    rows.sort(key=lambda r: (r.lang, r["_id"], r.text))
    return Filters.fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score.

    A null text, one without a letter, and any text if nothing was learned, is ("und", 0).  Repeated
    rows and null ids get a row each.  An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table))  # fixed size a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(*held.value)
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = train(docs.where(crc32_of(F.col("doc_id"), 4) != 2))
    out = identify(docs, filters)
    return out.select("doc_id", F.coalesce(crc32_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
