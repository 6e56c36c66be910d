"""Operator 1, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. A source's documents are hashed into blocks of about DOCS_PER_BLOCK; a block's words are summed, and
   a hash puts the source's blocks in one permuted order with running words.
2. A source with target t and size s is drawn floor(t / s) times whole; of one more epoch the first
   blocks of the order are drawn while they fit, and of the next block single documents.
3. The block draws of every source are an exact quota.  A binary tree over the output shards splits the
   quotas: at each node the left half gets a multivariate hypergeometric sample of its capacity, the
   right half the rest, so every shard has the mix's proportions and quotas sum up exactly.
4. A shard takes the next draws in each source's order, a range of its own, and is shuffled inside
   itself.  What a document gives to the mix is counted from the draws that shards have taken.

The driver holds a row for each source and a quota for each source and shard, never documents or
blocks.  Running sums go over ORDER ranges of the order first, then inside each range, so no task
holds all blocks of a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.llm.common import discard, free_name, materialize, small, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
DOCS_PER_BLOCK = 32
SHARD_WORDS, MAX_SHARDS = 8_000_000, 1 << 16
#: Bits of the permuting hash that name a range of the order: 4096 ranges a source.
ORDER_BITS = 12


def targets(sizes: list[float], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of all words by weight; none is above ``most`` times its size, and what a capped one
    leaves is shared among the others by weight, until none is above."""
    total, capped = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while True:
        rest = total - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [most * float(s) if c else rest * w / weight for s, w, c in zip(sizes, weights, capped, strict=True)]
        above = [not c and t > most * s for s, t, c in zip(sizes, out, capped, strict=True)]
        if not any(above):
            return out
        capped = [c or a for c, a in zip(capped, above, strict=True)]


def split_quotas(quotas: np.ndarray, shards: int, seed: int = 7) -> np.ndarray:
    """quotas[source] -> [source, shard] by the splitting tree; rows sum up to the quotas."""
    out = np.zeros((len(quotas), shards), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[:, lo] = have
            continue
        mid = (lo + hi) // 2
        capacity = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, capacity, method="marginals")
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def choose(units: list[int], sizes: list[int], left: float) -> list[int]:
    """Units of one block that fill what is left, largest first; the last may be over by less than what
    would be missing without it."""
    order = sorted(zip(sizes, units, strict=True), key=lambda x: (-x[0], x[1]))
    out = []
    for size, unit in order:
        if size <= left:
            left -= size
            out.append(unit)
    over = [(s, u) for s, u in order if u not in set(out) and s - left < left] if left > 0 else []
    return [*out, min(over)[1]] if over else out


def _choose(rows: pa.Table) -> pa.Table:
    found = choose(rows["unit"].to_pylist(), rows["size"].to_pylist(), rows["left"][0].as_py())
    return pa.table({"rank": pa.array([rows["rank"][0].as_py()] * len(found), pa.int32()), "unit": pa.array(found, pa.int64())})


def _shards(ends: np.ndarray):
    """Adds the shard of each (rank, …, draw): ``ends`` has the running quotas, [source, shard]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, draw = batch.column(0).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            shard = np.zeros(len(rank), np.int32)
            for r in np.unique(rank):
                shard[rank == r] = np.searchsorted(ends[r], draw[rank == r], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shard)], names=[*batch.schema.names[:-1], "shard"])

    return run


def unit_of(id_: Column, text: Column) -> Column:
    """What is drawn together: rows of one id; rows without an id by their text."""
    return F.xxhash64(id_, F.when(id_.isNull(), text))


class Mix:
    """The plan of a mix: ``sources`` (source, rank, source_size, target, n_blocks, epochs, rest), ``draws``
    (rank, block, draws array<struct<epoch, shard, single>>), ``chosen`` (rank, unit) of partial blocks."""

    def __init__(self, sizes: DataFrame, seed: int = 11, shards: int | None = None):
        """sizes: (id long, unit long, source string, size long), a materialized table."""
        spark = sizes.sparkSession
        found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
        found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
        aim = targets([r["size"] for r in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))]) if found else []
        rows = []
        for i, (r, t) in enumerate(zip(found, aim, strict=True)):
            epochs = min(MOST, int(t // r["size"])) if r["size"] else 0
            rows.append((r.source, i, r["size"], t, -(-r.n // DOCS_PER_BLOCK), epochs, t - epochs * r["size"]))
        schema = "source string, rank int, source_size long, target double, n_blocks long, epochs int, rest double"
        self.sources = spark.createDataFrame(rows, schema)
        self.seed = seed
        keyed = self.key(sizes)
        blocks = materialize(self._ordered(keyed.groupBy("rank", "block", "epochs", "rest").agg(F.sum("size").alias("words")), sizes.count()), "blocks", sizes.count())
        part = blocks.where("partial").select("rank", "block", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))  # one a source at most
        inside = keyed.join(F.broadcast(part), ["rank", "block"]).groupBy("rank", "block", "unit", "left").agg(F.sum("size").alias("size"))
        self.chosen = materialize(inside.groupBy("rank", "block").applyInArrow(_choose, "rank int, unit long"), "chosen", len(rows))

        counts = {r["rank"]: r for r in blocks.groupBy("rank").agg(F.count("*").alias("n"), F.count_if(F.col("whole") | F.col("partial")).alias("more"), F.max("epochs").alias("epochs")).collect()}
        quotas = np.array([counts[i].epochs * counts[i].n + counts[i].more if i in counts else 0 for i in range(len(rows))], np.int64)
        total = sum(r[2] for r in rows)
        self.shards = shards or int(min(MAX_SHARDS, max(1, -(-total // SHARD_WORDS))))
        ends = np.cumsum(split_quotas(quotas, self.shards), axis=1) if rows else np.zeros((0, 1))
        held = F.broadcast(spark.createDataFrame([(i, int(counts[i].n)) for i in counts], "rank int, n long"))
        draws = blocks.join(held, "rank").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
        draws = draws.where((F.col("epoch") < F.col("epochs")) | F.col("whole") | F.col("partial"))
        single = F.col("partial") & (F.col("epoch") == F.col("epochs"))
        draws = draws.select("rank", "block", "epoch", single.alias("single"), (F.col("epoch") * F.col("n") + F.col("place")).alias("draw"))
        draws = draws.mapInArrow(_shards(ends), "rank int, block long, epoch int, single boolean, shard int").where(F.col("shard") < self.shards)
        self.draws = materialize(draws.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "single"))).alias("draws")), "draws", MOST * sizes.count())
        discard(blocks)

    def _ordered(self, blocks: DataFrame, most: int) -> DataFrame:
        """Adds place (from 0), upto (running words, own included), whole and partial in the permuted order:
        sums of its ranges first, then inside each range."""
        h = F.xxhash64("rank", "block", F.lit(self.seed))
        blocks = materialize(blocks.withColumn("h", h).withColumn("range", F.shiftright("h", 64 - ORDER_BITS)), "unordered", most)
        ahead = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source at most
        base = blocks.groupBy("rank", "range").agg(F.count("*").alias("k"), F.sum("words").alias("w"))
        base = base.select("rank", "range", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("k0"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"))
        own = Window.partitionBy("rank", "range").orderBy("h", "block")
        out = blocks.withColumn("k", F.row_number().over(own) - 1).withColumn("w", F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.join(small(materialize(base, "ranges", most)), ["rank", "range"]).withColumn("place", F.col("k0") + F.col("k")).withColumn("upto", F.col("w0") + F.col("w"))
        whole = F.col("upto") <= F.col("rest")
        partial = ~whole & (F.col("upto") - F.col("words") < F.col("rest"))
        return out.select("rank", "block", "epochs", "rest", "words", "place", "upto", whole.alias("whole"), partial.alias("partial"))

    def key(self, df: DataFrame) -> DataFrame:
        """Adds the plan's columns to a table with unit and source: rank and block come from values
        only, so a rerun of a lost task finds the same."""
        named = small(self.sources.withColumnRenamed("source", "_of"))
        out = df.join(named, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
        return out.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(self.seed)), "n_blocks"))

    def drawn(self, df: DataFrame) -> DataFrame:
        """Adds draws: those of the document's block, of a partial block only if it was chosen."""
        out = self.key(df).join(small(self.draws), ["rank", "block"], "left")
        pick = F.broadcast(self.chosen.select(F.col("rank").alias("_rank"), F.col("unit").alias("_unit"), F.lit(True).alias("_picked")))  # of one block a source
        out = out.join(pick, (F.col("rank") == F.col("_rank")) & (F.col("unit") == F.col("_unit")), "left")
        own = F.filter("draws", lambda d: ~d["single"] | F.coalesce("_picked", F.lit(False)))
        return out.withColumn("draws", F.coalesce(own, F.expr("cast(array() as array<struct<epoch:int,shard:int,single:boolean>>)"))).drop("_rank", "_unit", "_picked")


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    id_ = F.col(id_col).cast("long")
    return materialize(docs.select(id_.alias("id"), unit_of(id_, F.col(text_col)).alias("unit"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, shards (of each draw).

    A null text has size 0.  A null source is a source of its own, the last.  Rows that repeat an id
    within a source are drawn together, rows without an id if their texts are equal.  An empty table
    gives an empty one.
    """
    sizes = sizes_of(docs, id_col, text_col, source_col)
    out = Mix(sizes).drawn(sizes)
    taken = (F.col("size") * F.size("draws")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), F.col("draws.shard").alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it is drawn, with shard int and epoch int;
    a shard's rows are in one partition in a shuffled order."""
    plan = Mix(sizes_of(docs, id_col, text_col, source_col), shards=shards)
    held = free_name(docs, "_row")
    id_ = F.col(id_col).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias(held), unit_of(id_, F.col(text_col)).alias("unit"), F.col(source_col).cast("string").alias("source"))
    rows = plan.drawn(rows).select(held, "unit", F.explode("draws").alias("d"))
    rows = rows.select(held, "unit", F.col("d.epoch").alias("_epoch"), F.col("d.shard").alias("_shard"))
    rows = rows.repartition("_shard").sortWithinPartitions("_shard", F.xxhash64("unit", "_epoch", F.lit(13)))
    return rows.select(f"{held}.*", F.col("_shard").alias(free_name(docs, "shard")), F.col("_epoch").alias(free_name(docs, "epoch")))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
