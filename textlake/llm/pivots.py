"""Operator 8, embedding near-dedup by a pivot-permutation index.

Reference points are taken from a bounded sample of the vectors, at least SPREAD times as far apart
as a linked pair may be: a dense group does not crowd with nearly equidistant references of which its
members would choose different ones, while a cluster that is wider than a link has references of its
own, which tell its members apart.  Every vector is described by its NEAREST nearest references
in order of nearness and stands in the inverted list of each (and of its label and length).  A list of
more than LIST vectors is split by a second reference, so that it holds what shares both.

Retrieval counts shared references, and the order weighs them: a reference counts from 1 (nearest in
both) down to 1/4 (last in both), and a pair is a candidate from WEIGHT on: one shared reference is
never enough, two are if they don't both stand in the rear.  Vectors of a length with fewer references
than NEAREST share all of them.  A pair is looked at only in the list of the lowest references that it shares, so none counts
twice.  Candidates are verified by cosine in double precision.  Lists are cut into blocks of bounded
size and each pair of blocks is one task; it emits a count for each vector and a spanning forest of its
links, never the pairs.  Equal vectors of one label are one node with a multiplicity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import TEXT_ROWS, materialize, small, table
from textlake.llm.components import components

COSINE = 0.98
NEAREST, WEIGHT = 10, 1.01
#: Reference points: so many times the root of the number of vectors, within these bounds.
PIVOTS, LEAST_PIVOTS, MOST_PIVOTS = 4, 64, 2048
#: References are SPREAD link distances apart; so many sampled vectors are looked at for each.
SPREAD, LOOKED_AT = 1.5, 2
BLOCK, LIST = 1024, 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, scaled first so that no square over- or underflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def spread(sample: list[np.ndarray], most: int, cosine: float) -> list[np.ndarray]:
    """The first vectors of ``sample``, at most ``most``, that keep their distance from all before."""
    limit = 1 - SPREAD**2 * (1 - cosine)
    held: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    out: list[np.ndarray] = []
    for v in sample:
        if len(out) == most:
            break
        d = len(v)
        u, n = unit(v[None])[0], count.get(d, 0)
        own = held.setdefault(d, np.empty((16, d)))
        if n and (own[:n] @ u).max() > limit:
            continue
        if n == len(own):
            own = held[d] = np.concatenate((own, np.empty_like(own)))
        own[n] = u
        count[d] = n + 1
        out.append(v)
    return out


def permutation(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The ``nearest`` references of each row, nearest first, ties by number."""
    cos = unit(vectors) @ pivots.T
    k = min(nearest, len(pivots))
    return np.argsort(-cos, axis=1, kind="stable")[:, :k]


def _describe(pivots: np.ndarray, nearest: int):
    own = {d: np.flatnonzero([len(p) == d for p in pivots]) for d in {len(p) for p in pivots}}
    held = {d: unit(np.stack([pivots[i] for i in at])) for d, at in own.items()}

    def run(batches):
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            out: list = [[] for _ in vectors]
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_length.setdefault(len(v), []).append(i)
            for d, rows in by_length.items():
                if d in own:
                    near = own[d][permutation(np.array([vectors[i] for i in rows]), held[d], nearest)]
                    for i, p in zip(rows, near.tolist(), strict=True):
                        out[i] = p
                else:  # no reference of this length: one list a length holds them
                    for i in rows:
                        out[i] = [-d]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    return run


def weights(of: list, names: np.ndarray, nearest: int) -> np.ndarray:
    """[row, reference]: 1 for a row's nearest reference, falling in its order towards 1/2; 0 for others."""
    out = np.zeros((len(of), len(names)), np.float32)
    for r, near in enumerate(of):
        out[r, np.searchsorted(names, near)] = 1 - np.arange(len(near), dtype=np.float32) / (2 * nearest)
    return out


def candidates(of_a: list, of_b: list, pivot: int, other: int, nearest: int, weight: float) -> np.ndarray:
    """[row, row] of pairs whose shared references weigh enough, and that belong into this list: that of
    their lowest shared reference, if it was split that of their two lowest."""
    if pivot < 0:  # a length without references
        return np.ones((len(of_a), len(of_b)), bool)
    names = np.unique(np.concatenate([*of_a, *of_b]))
    x, y = weights(of_a, names, nearest), weights(of_b, names, nearest)
    # vectors of a length with one reference all share it
    ok = x @ y.T >= (weight if min(map(len, [*of_a, *of_b])) > 1 else 0.25)
    before = (names < pivot) if other < 0 else (names < other) & (names != pivot)
    return ok & (x[:, before] @ y[:, before].T == 0) if before.any() else ok


def forest(link: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A spanning forest, as (row, column), of the links of two blocks, or of one with itself.  Each
    node's links are read once, as a vector."""
    turned = np.ascontiguousarray(link.T)
    seen = [np.zeros(n, bool) for n in link.shape]
    if same:
        seen[1] = seen[0]
    out = []
    for r in np.flatnonzero(link.any(axis=1)).tolist():
        if seen[0][r]:
            continue
        seen[0][r] = True
        stack = [(0, r)]
        while stack:
            side, x = stack.pop()
            other = 0 if same else 1 - side
            new = np.flatnonzero((turned if side else link)[x] & ~seen[1 - side])
            seen[1 - side][new] = True
            out += [(y, x) if side else (x, y) for y in new.tolist()]
            stack += [(other, y) for y in new.tolist()]
    return out


def _block_pairs(cosine: float, nearest: int, weight: float):
    def run(rows: pa.Table) -> pa.Table:
        pivot, other, i, j = (rows[c][0].as_py() for c in ("pivot", "other", "i", "j"))
        block = rows["block"].to_numpy()
        near, vectors = rows["near"].to_pylist(), rows["vec"].combine_chunks()
        vectors = unit(vectors.flatten().to_numpy().reshape(len(vectors), -1))
        nodes, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        a = np.flatnonzero(block == i)
        b = a if i == j else np.flatnonzero(block == j)
        out: list[tuple] = []
        if len(a) and len(b):
            link = candidates([near[r] for r in a], [near[r] for r in b], pivot, other, nearest, weight)
            if i == j:
                link &= ~np.eye(len(a), dtype=bool)
            if link.any():
                link &= vectors[a] @ vectors[b].T >= cosine
            far = link @ copies[b]
            out += [(n, None, c) for n, c in zip(nodes[a].tolist(), far.tolist(), strict=True) if c]
            if i != j:
                far = copies[a] @ link
                out += [(n, None, c) for n, c in zip(nodes[b].tolist(), far.tolist(), strict=True) if c]
            out += [(int(nodes[a[r]]), int(nodes[b[c]]), None) for r, c in forest(link, i == j)]
        return pa.table({name: pa.array([x[k] for x in out], pa.int64()) for k, name in enumerate(("a", "b", "n"))})

    return run


def _in_blocks(entries: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Adds block, i and j: a row for each pair of blocks of its list that a vector takes part in."""
    lists = entries.groupBy(*keys).count().where("count > 1").select(*keys, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    out = entries.join(small(materialize(lists, "lists", most)), keys).withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    out = out.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select(*keys, "node", "block", F.least("block", "_b").alias("i"), F.greatest("block", "_b").alias("j"))


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: id, n_links long, component_id, kept boolean.

    Vectors link only within a label that is not null and at equal lengths.  Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing and are kept.  Rows with a
    null id link as others do but name no component and are kept.  Equal vectors are linked, each
    row counts.  An empty table gives an empty one.
    """
    v = F.col("vec")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # floats turn to doubles exactly
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("vec"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vec", F.when(good, v)).withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    rows = materialize(rows, "vectors")
    nodes = rows.where("node is not null").groupBy("node", "label").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "nodes", rows.count(), TEXT_ROWS)
    n = nodes.count()
    n_pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PIVOTS * n**0.5)))
    sample = nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(LOOKED_AT * n_pivots).select("vec").collect()
    pivots = spread([np.array(r.vec) for r in sample], n_pivots, cosine)
    told = nodes.select("node", "label", "vec", "copies").mapInArrow(_describe(pivots, NEAREST), f"node long, label string, vec {kind}, copies long, near array<int>")
    told = materialize(told, "permutations")
    entries = told.select("label", "node", F.explode("near").alias("pivot"), "near")
    long = entries.groupBy("label", "pivot").count().where(f"count > {LIST} and pivot >= 0").select("label", "pivot", F.lit(True).alias("long"))
    entries = entries.join(small(materialize(long, "long", NEAREST * n // LIST)), ["label", "pivot"], "left")
    seconds = F.when(F.coalesce("long", F.lit(False)), F.filter("near", lambda q: q > F.col("pivot"))).otherwise(F.array(F.lit(-1)))
    # a length with one reference has no second one to split by
    seconds = F.when((F.size("near") == 1), F.array(F.lit(-1))).otherwise(seconds)
    entries = entries.select("label", "node", "pivot", F.explode(seconds).alias("other"))
    keys = ["label", "pivot", "other"]
    out = _in_blocks(entries, keys, NEAREST * n).join(told.drop("label"), "node")
    found = out.groupBy(*keys, "i", "j").applyInArrow(_block_pairs(cosine, NEAREST, WEIGHT), "a long, b long, n long")
    found = materialize(found, "links")
    degree = materialize(found.where("b is null").groupBy("a").agg(F.sum("n").alias("far")), "degrees", n)
    same = components(found.where("b is not null").select("a", "b"))
    keyed = rows.select("id", "node").join(same.toDF("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    stats = nodes.select("node", "copies").join(degree.withColumnRenamed("a", "node"), "node", "left")
    stats = materialize(stats.select("node", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "stats", n)
    least = materialize(keyed.where("c is not null").groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("k")).where("k > 1").select("c", "least"), "least", n)
    out = keyed.join(stats, "node", "left").join(least, "c", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op8_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
      WHERE list_dot_product(p.e, q.e) / (p.norm * q.norm) >= {COSINE}),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a"""
