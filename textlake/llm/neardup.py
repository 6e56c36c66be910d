"""Classes of near-equal texts from banded sketches, each link confirmed on whole shingle sets.

Texts with equal shingle sets are one node (a 64-bit fingerprint of the set).  Nodes that agree in
a band share a bucket.  No step emits all pairs of a bucket:

1. ``ROUNDS`` times, members of buckets that are not yet in their bucket's class are checked against
   the bucket's least node: in the first round a node is checked once, against the least of all its
   buckets' leaders, later against each leader that it has not joined.  Leaders are found with a
   map-side combine, and confirmed links are turned into components after each round.
2. Buckets whose members are still in different classes are cut into blocks of bounded size, and
   each pair of blocks is one task that holds the two blocks' texts, compares only nodes of different
   classes in the first band that they share, and emits a spanning forest.
3. Components of all confirmed links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import TEXT_ROWS, discard, materialize, slices
from textlake.llm.components import components
from textlake.llm.shingles import shingle_set, similar

ROUNDS = 2
#: Nodes and bytes of text that one block may hold.
BLOCK_NODES, BLOCK_BYTES = 1024, 8 << 20


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in slices(batches):
            keep = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if last != b:  # rows of one node often follow each other
                    last, known = b, shingle_set(tb.as_py())
                keep.append(similar(shingle_set(ta.as_py()), known, percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_bands(bands_of: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x.as_py()) for x in batch.column(1)]
            n, bands = pa.array([len(x) for x in sets], pa.int64()), pa.array([bands_of(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, n, bands], names=["fp", "body", "n", "bands"])

    return run


def _forest(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between classes in one pair of blocks: rows of (bucket, i, j, fp,
    c, n, block, bands, body).  A text's set is built only when it meets a candidate."""
    if len({r[4] for r in rows}) < 2:
        return []
    bucket, first, second = rows[0][:3]
    node, size, block = (np.array([r[k] for r in rows], np.int64) for k in (3, 5, 6))
    classes = np.unique(np.array([r[4] for r in rows], np.int64), return_inverse=True)[1]
    bands = np.stack([r[7] for r in rows])
    k = int((bands == bucket).any(axis=0).argmax())
    sets: dict[int, np.ndarray] = {}
    group = list(range(int(classes.max()) + 1))

    def members(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingle_set(rows[x][8])
        return sets[x]

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    places = np.arange(len(rows))
    for x in places:
        if first != second and block[x] != first:
            continue
        ok = (block == second) if first != second else places > x
        ok &= (classes != classes[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
        if k and ok.any():  # pairs that share an earlier band are looked at there
            ok &= ~(bands[:, :k] == bands[x, :k]).any(axis=1)
        for y in np.flatnonzero(ok):
            p, q = root(int(classes[x])), root(int(classes[y]))
            if p != q and similar(members(int(x)), members(int(y)), percent):
                group[q] = p
                out.append((int(node[x]), int(node[y])))
    return out


def _blocks(percent: int):
    """Over rows in the order of (bucket, i, j): one pair of blocks at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches):
            found = []
            bands = batch.column(7).flatten().to_numpy().reshape(batch.num_rows, -1)
            plain = zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)
            for row, own, body in zip(plain, bands, batch.column(8), strict=True):
                if held and held[0][:3] != row[:3]:
                    found += _forest(held, percent)
                    held = []
                held.append((*row, own, body.as_py()))
            yield _links(found)
        yield _links(_forest(held, percent) if held else [])

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _classified(members: DataFrame, found: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """members (bucket, fp, n) with their class c, and of buckets that hold several classes (bucket, lo,
    n_lo, c_lo, rest): their least node, and whether the others are of several classes too."""
    known = members.join(found, members.fp == found.node, "left").select("bucket", "fp", "n", F.coalesce("component", "fp").alias("c"))
    known = materialize(known, "known", most)
    lo = known.groupBy("bucket").agg(F.min(F.struct("fp", "n", "c")).alias("lo"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    lo = materialize(lo.select("bucket", F.col("lo.fp").alias("lo"), F.col("lo.n").alias("n_lo"), F.col("lo.c").alias("c_lo")), "open", most)
    others = known.join(lo, "bucket").where("fp <> lo").groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    return known, materialize(lo.join(others, "bucket").select("bucket", "lo", "n_lo", "c_lo", F.expr("c0 <> c1").alias("rest")), "open", most)


def _near_in_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_classes(slots: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int, bands_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(node long, component long): nodes whose class has a smaller node.

    slots: (bucket long, fp long, n long), a row for each band of each node, none twice; n is the size of
    its set, and pairs whose sizes are too far apart are dropped before texts are fetched.
    texts_of: from a table of fp, (fp, body), a row for each.
    bands_of: from a text's shingle set, its bands; they are computed again for texts of open buckets.
    """
    live = materialize(slots.groupBy("bucket").count().where("count > 1").select("bucket"), "live")
    # a merge join at every size: both sides grow with the input
    members = materialize(slots.join(live.hint("merge"), "bucket"), "members")
    most = members.count()
    lo = members.groupBy("bucket").agg(F.min(F.struct("fp", "n")).alias("lo"), F.max("fp").alias("hi")).where("lo.fp <> hi")
    members = materialize(members.join(lo.select("bucket", "lo"), "bucket").select("bucket", "fp", "n", "lo"), "shared", most)
    most = members.count()
    texts = materialize(texts_of(members.select("fp").distinct()), "texts", most, TEXT_ROWS)
    far, near = (texts.select(F.col("fp").alias(x), F.col("body").alias(f"body_{x}")) for x in ("a", "b"))
    pairs = members.groupBy("fp", "n").agg(F.min("lo").alias("l")).select(F.col("fp").alias("a"), F.col("l.fp").alias("b"), "n", F.col("l.n").alias("n_lo"))
    members = members.select("bucket", "fp", "n")
    links = None
    for turn in range(ROUNDS):
        pairs = pairs.where((F.col("a") != F.col("b")) & _near_in_size("n", "n_lo", percent)).select("a", "b")
        joined = pairs.join(far, "a").join(near, "b").select("a", "b", "body_a", "body_b")
        new = materialize(joined.mapInArrow(_confirm(percent), "a long, b long"), "links", most, TEXT_ROWS)
        if links is not None and new.isEmpty():
            break
        links = new if links is None else materialize(links.union(new), "links", most)
        found = components(links)
        known, open_ = _classified(members, found, most)
        if turn + 1 < ROUNDS:
            pairs = known.join(open_, "bucket").where("c <> c_lo").select(F.col("fp").alias("a"), F.col("lo").alias("b"), "n", "n_lo").distinct()
    # a bucket's least node has been compared with all others
    open_ = open_.where("rest").select("bucket")
    if not open_.isEmpty():
        inside = materialize(known.join(open_, "bucket"), "inside", most)
        sizes = inside.join(texts.select("fp", F.octet_length("body").cast("long").alias("bytes")), "fp")
        blocks = sizes.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
        rows = inside.join(materialize(blocks, "blocks", most), "bucket").withColumn("block", F.pmod(F.hash("fp"), "blocks"))
        rows = rows.select("bucket", "fp", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rows = materialize(rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "c", "block"), "pairs")
        wanted = texts.join(rows.select("fp").distinct(), "fp").mapInArrow(_with_bands(bands_of), "fp long, body string, n long, bands array<long>")
        rows = rows.join(materialize(wanted, "wanted", most, TEXT_ROWS), "fp").select("bucket", "i", "j", "fp", "c", "n", "block", "bands", "body")
        more = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_blocks(percent), "a long, b long")
        more = materialize(more, "links")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    discard(live, texts, known)
    return found
