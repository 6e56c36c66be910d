"""Operator 3, conflict-constrained best-fit packing of documents into fixed-size bins.

Documents are cut into pieces of at most ``capacity`` words; a piece that fills a bin is one.  The
others are dealt by hash into groups of bounded size.  In a group, pieces go largest first into the
compatible bin with the least room: bins stand in order of residual, each with two bitmaps, one of
its documents' sources and one of their duplicate clusters, and the search goes on from the first
bin with enough room to its successors until one shares no bit with the piece.  Without such a bin
a new one is opened.

No bin holds two pieces of one source or of one cluster, whatever share of the pieces a source has: a
dominant source opens as many bins as it has pieces.  Groups pack apart, so no task grows with the
input.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.llm.common import SPACE, materialize, table, word_count

CAPACITY = 2048
GROUP_PIECES = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each piece, given largest first."""
    repeated = {c: i for i, c in enumerate(k for k, n in Counter(clusters).items() if n > 1)}
    numbered: dict = {}
    order: list[tuple[int, int]] = []  # (residual, bin)
    seen: list[list[int]] = []  # bitmaps of sources and clusters
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 1 << numbered.setdefault(source, len(numbered))
        c = 1 << repeated[cluster] if cluster in repeated else 0
        at = bisect_left(order, (size, -1))
        while at < len(order) and (seen[order[at][1]][0] & s or seen[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            room, bin_ = order.pop(at)
        else:
            room, bin_ = capacity, len(seen)
            seen.append([0, 0])
        out.append((bin_, capacity - room))
        seen[bin_][0] |= s
        seen[bin_][1] |= c
        if room > size:
            insort(order, (room - size, bin_))
    return out


def _pack(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc", "ascending"), ("piece", "ascending"), ("copy", "ascending"), ("cluster", "ascending")])
        placed = best_fit(*(rows[c].to_pylist() for c in ("n_tokens", "source", "cluster")), capacity)
        rows = rows.append_column("bin", pa.array([b for b, _ in placed], pa.int32()))
        return rows.append_column("bin_offset", pa.array([o for _, o in placed], pa.int64()))

    return run


_PIECE = "doc long, copy int, source string, cluster long, piece int, first_token long, n_tokens long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, copy int, piece int, first_token long (in its document), n_tokens long,
    source, cluster long, bin_id string, bin_offset long.

    Tokens are words.  Documents whose words are equal but for the case of A-Z are one duplicate
    cluster; near copies are not (drop them first).  Rows that repeat an id are numbered by ``copy`` in
    any order, rows without an id only if they are equal.  Texts that are null or blank have no piece.
    A null source is one source.  An empty table gives an empty one.
    """
    bare = F.btrim(F.translate(F.regexp_replace(F.col(text_col), SPACE, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    sized = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(source_col).cast("string").alias("source"), F.xxhash64(bare).alias("cluster"), word_count(F.col(text_col)).alias("n"))
    sized = kept = materialize(sized.where("n > 0"), "sized")
    # copies of one id meet in one task; rows without an id by their cluster and source
    same = [F.col("doc"), F.when(F.col("doc").isNull(), F.xxhash64("cluster", "source"))]
    sized = sized.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("source", "n", "cluster")) - 1)
    steps = F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))
    pieces = sized.select("*", F.explode(steps).alias("piece"))
    first = F.col("piece").cast("long") * capacity
    pieces = pieces.select("doc", "copy", "source", "cluster", "piece", first.alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n") - first).alias("n_tokens"))
    pieces = materialize(pieces, "pieces", 2 * kept.count())
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    name = F.concat_ws("-", F.lit("f"), F.coalesce(F.col("doc").cast("string"), F.lit("")), F.when(F.col("doc").isNull(), F.xxhash64("cluster", "source")), "copy", "piece")
    whole = pieces.where(F.col("n_tokens") == capacity).select("*", name.alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    part = pieces.where(F.col("n_tokens") < capacity).withColumn("grp", F.pmod(F.xxhash64("doc", "copy", "piece", "cluster", F.lit(5)), F.lit(groups)).cast("int"))
    packed = part.groupBy("grp").applyInArrow(_pack(capacity), f"{_PIECE}, grp int, bin int, bin_offset long")
    packed = packed.withColumn("bin_id", F.concat_ws("-", F.lit("g"), "grp", "bin")).select(*whole.columns)
    out = whole.union(packed).withColumnRenamed("doc", id_col)
    return out.select(id_col, "copy", "piece", "first_token", "n_tokens", "source", "cluster", "bin_id", "bin_offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
