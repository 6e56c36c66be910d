"""Operator 10, MinHash near-dedup by fast similarity sketching.

A sketch has T coordinates.  In round i < T every shingle is thrown into one hashed bin with the
value i + u, u in [0, 1); in the rounds T..2T-1 all shingles go to bin i - T.  A bin keeps its least
value, so each coordinate is full after 2T rounds at the latest, mostly after one or two, and equal
coordinates estimate the Jaccard similarity with concentration like that of independent draws
(Dahlgaard, Knudsen, Thorup, "Fast Similarity Sketching", 2017).  Bands of ROWS coordinates find
candidates; whole sets confirm them.

A pair at similarity 0.85 shares no band with probability (1 - 0.85**6)**28 < 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import TEXT_ROWS, free_name, materialize, slices, small, table
from textlake.llm.neardup import near_classes
from textlake.llm.shingles import U, band_hashes, fingerprint, mix, seeds, shingle_set

ROWS, BANDS = 6, 28
COORDINATES = ROWS * BANDS
PERCENT = 85
_SEEDS = seeds(2 * COORDINATES, 101)
_LOW = U(0xFFFFFFFF)


def sketch(members: np.ndarray) -> np.ndarray:
    """The COORDINATES values of a set that is not empty, each as round << 32 | fraction."""
    out = np.zeros(COORDINATES, U)
    full = np.zeros(COORDINATES, bool)
    for i in range(2 * COORDINATES):
        x = mix(members ^ _SEEDS[i])
        if i < COORDINATES:
            x = np.sort((((x >> U(32)) * U(COORDINATES)) >> U(32)) << U(32) | x & _LOW)
            where = (x >> U(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            first = first[~full[where[first]]]
            at = where[first]
            out[at] = (U(i) << U(32)) | x[first] & _LOW
            full[at] = True
        elif not full[i - COORDINATES]:
            out[i - COORDINATES] = (U(i) << U(32)) | (x & _LOW).min()
            full[i - COORDINATES] = True
        if full.all():
            break
    return out


def bands_of(members: np.ndarray) -> np.ndarray:
    return band_hashes(sketch(members), BANDS, 211)


_OUT = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, fp, bands = [], [], []
        for text in batch.column(2):
            members = shingle_set(text.as_py())
            n.append(len(members))
            fp.append(fingerprint(members) if len(members) else None)
            bands.append(bands_of(members) if len(members) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=_OUT)


def _classes(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """A row per row of ``docs``: id, key (a hash of the text; both name a row), n_shingles, component_id and
    first, whether the row is its class's first by id and key; rows without an id are always."""
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("body"))
    sig = materialize(read.mapInArrow(_sketches, "id long, key long, n long, fp long, bands array<long>"), "sketches")
    row = F.struct(F.col("id").isNull().alias("lacks"), "id", "key")
    # equal sets collapse on the map side, so a group of copies is one node from here on
    nodes = sig.where("n > 0").groupBy("fp").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    n = sig.count()
    nodes = materialize(nodes.select("fp", "row.id", "row.key", "n", "bands"), "nodes", n, 4 * TEXT_ROWS)

    def texts_of(fps: DataFrame) -> DataFrame:
        """The text of one row of each set."""
        one = materialize(nodes.select("fp", F.col("id").alias("_id"), F.col("key").alias("_key")).join(fps.hint("merge"), "fp"), "one", n)
        own = read.join(one.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
        return own.select("fp", "body").dropDuplicates(["fp"])

    same = near_classes(nodes.select(F.explode("bands").alias("bucket"), "fp", "n"), texts_of, percent, bands_of)
    keyed = sig.select("id", "key", "n", "fp").join(same.toDF("fp", "c").hint("merge"), "fp", "left").select("id", "key", "n", F.coalesce("c", "fp").alias("c"))
    least = keyed.where("c is not null").groupBy("c").agg(F.min(row).alias("least"), F.count("*").alias("rows")).where("rows > 1").select("c", "least")
    out = keyed.join(materialize(least, "least", n).hint("merge"), "c", "left")
    return out.select("id", "key", F.col("n").alias("n_shingles"), F.coalesce("least.id", "id").alias("component_id"), (F.col("id").isNull() | F.coalesce(F.col("least") == row, F.lit(True))).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles long, component_id, kept boolean.

    Two rows are linked if 100 * intersection >= percent * union of their shingle sets; component_id
    is the smallest id that links reach.  Null and blank texts have no shingles and stay alone and
    kept.  Rows with a null id take part but name no component; they are kept, with component_id null
    only when no row of their class has an id.  Rows that repeat an id take part with their own texts, a
    row each.  percent of 80 and more is what the bands are made for.  Other columns are not read.
    """
    out = _classes(docs, id_col, text_col, percent)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each class: that of the smallest id.  Of rows that repeat id and
    text one stays, and rows that repeat only the id are documents of their own; rows without an id
    stay."""
    n = docs.count()
    found = materialize(_classes(docs.select(id_col, text_col), id_col, text_col, percent).select("id", "key", "first"), "classes", n)
    key = free_name(docs, "_row_key")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(key) == F.col("_key"))
    named = lambda df: df.select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    lost = small(materialize(named(found.where("not first")).distinct(), "lost", n))
    out = docs.withColumn(key, F.xxhash64(text_col)).join(lost, same, "left_anti")
    twice = materialize(named(found.where("first and id is not null").groupBy("id", "key").count().where("count > 1")), "twice", n)
    if not twice.isEmpty():
        out = out.join(twice, same, "left_anti").union(out.join(twice, same, "left_semi").dropDuplicates([id_col, key]))
    return out.drop(key)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
