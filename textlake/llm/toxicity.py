"""Operator 6, a convolutional text classifier in numpy with thresholds calibrated by language.

Words are hashed to rows of an embedding table; filters of several widths slide over the whole text;
each keeps its largest response; a linear layer makes a logit.  All labelled texts are learned from, whole.
The first embedding coordinate starts as the word's smoothed log-odds, counted by Spark.  Then come rounds: the
texts are dealt out in parts of about PART, each part takes Adam steps from the model of the round,
and the parts' changes are averaged, those of a word over the parts that moved it.  Gradients flow to the positions
that won the pooling.  The driver holds one model, whatever the number of texts.

A text's language group is read off its function words, never from a column.  For each group the
logit's threshold is the one of the best F1 on all labelled texts, taken from a histogram of their
logits; the score is the logistic function of logit less threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import crc32_of, discard, materialize, slices, small, table
from textlake.llm.quality import COMMON_WORDS

HALF, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
BUCKETS, PREFIX = 2 * HALF, 7
EPOCHS, BATCH, RATE = 4, 16, 0.01
#: A word seen in so many training texts starts with half of its log-odds.
RARE = 8
#: Training texts of one part, about.
PART = 500
#: Changes are added up as whole numbers of this fraction, so their order makes no difference.
GRAIN = 1 << 20
#: Bins of a logit's unit in the histogram, and the largest logit told apart.
BINS, FAR = 1024, 64
#: Positive training texts that a group needs for a threshold of its own.
LEAST_POSITIVE = 25
_EACH, _PLACES = np.arange(FILTERS), {w: np.arange(w) for w in WIDTHS}
_TO_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_ids(text: str | None) -> np.ndarray:
    """[word, (bucket of the word, bucket of its first PREFIX bytes)]."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_TO_BLANK).split()
    n = len(words)
    out = np.empty((n, 2), np.uint32)
    out[:, 0] = np.fromiter(map(crc32, words), np.uint32, n) % np.uint32(HALF)
    out[:, 1] = np.fromiter((crc32(w[:PREFIX]) for w in words), np.uint32, n) % np.uint32(HALF) + np.uint32(HALF)
    return out


def _group_table() -> np.ndarray:
    """Language group of each bucket, 0 for none; a word of several languages counts for none."""
    out = np.zeros(BUCKETS, np.uint8)
    for g, words in enumerate(COMMON_WORDS.values(), 1):
        for w in words:
            if sum(w in x for x in COMMON_WORDS.values()) == 1:
                out[crc32(w.encode()) % HALF] = g
    return out


_GROUPS = _group_table()


def group_of(ids: np.ndarray) -> int:
    hits = np.bincount(_GROUPS[ids[:, 0]], minlength=len(COMMON_WORDS) + 1)[1:]
    return int(hits.argmax()) + 1 if hits.any() else 0


def _responses(ids: np.ndarray, emb: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """The vectors of the words, and for each width the responses [filter, position]; None if the text is shorter."""
    words = emb.take(ids[:, 0], 0) + emb.take(ids[:, 1], 0)
    r, out, at = filters @ words.T, [], 0
    for w in WIDTHS:
        n = len(words) - w + 1
        parts = [r[at + j * FILTERS : at + (j + 1) * FILTERS, j : j + n] for j in range(w)] if n > 0 else []
        out.append(sum(parts[1:], parts[0]) if parts else None)
        at += w * FILTERS
    return words, out


class TextCnn:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.conv = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, 0, :] = np.abs(c[:, 0, :]) / len(c)
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.thresholds = np.zeros(len(COMMON_WORDS) + 1)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The embedding, and [filter, coordinate]: the filters of the first width, then those of both places
        of the second, and so on, so that one product gives the responses of all words."""
        return self.emb, np.concatenate([c[j].T for c in self.conv for j in range(len(c))])

    def pooled(self, ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        _, wins = _responses(ids, *tables)
        parts = [np.zeros(FILTERS, np.float32) if r is None else np.maximum(r.max(axis=1) + b, 0) for r, b in zip(wins, self.bias, strict=True)]
        return np.concatenate(parts)

    def logit(self, ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.pooled(ids, tables) @ self.out + self.base[0])

    def params(self) -> list[np.ndarray]:
        """All but the embedding."""
        return [*self.conv, *self.bias, self.out, self.base]

    def begin(self, positive: np.ndarray, negative: np.ndarray, n1: int, n0: int) -> None:
        """The first coordinate, from the number of positive and negative texts with each bucket."""
        odds = np.log((positive + 0.5) / (n1 + 1)) - np.log((negative + 0.5) / (n0 + 1))
        seen = positive + negative
        self.emb[:, 0] = np.clip(odds * seen / (seen + RARE), -1, 4) / 2

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> None:
        """Fits on texts in memory."""
        counts = np.zeros((2, BUCKETS))
        for ids, y in zip(texts, labels, strict=True):
            counts[y, np.unique(ids)] += 1
        n1, n0 = max(1, labels.sum()), max(1, (1 - labels).sum())
        self.begin(counts[1], counts[0], n1, n0)
        rng, steps = np.random.default_rng(seed), Steps(self)
        weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0) * len(labels)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                steps.take([(texts[i], labels[i], weight[i]) for i in order[k : k + BATCH]])

    def calibrate(self, group: np.ndarray, z: np.ndarray, labels: np.ndarray, texts: np.ndarray) -> None:
        """Thresholds of the best F1, by group, of a histogram: so many texts have this logit and label.
        A group with too few positives takes the threshold of all texts."""
        self.thresholds[:] = _best_threshold(z, labels, texts)
        for g in range(len(self.thresholds)):
            own = group == g
            if (labels * texts)[own].sum() >= LEAST_POSITIVE and (labels[own] == 0).any():
                self.thresholds[g] = _best_threshold(z[own], labels[own], texts[own])


class Steps:
    """Adam for a model's filters and linear layer, Adagrad for the embedding rows that won."""

    def __init__(self, model: TextCnn):
        self.model, self.n = model, 0
        self.first, self.second = ([np.zeros_like(p) for p in model.params()] for _ in range(2))
        self.squares = np.full(BUCKETS, 1e-3, np.float32)
        self.moved = np.zeros(BUCKETS, bool)

    def take(self, batch: list[tuple[np.ndarray, int, float]]) -> None:
        """One step for texts with labels and weights."""
        model, params, tables = self.model, self.model.params(), self.model.tables()
        y, weight = np.array([b[1] for b in batch]), np.array([b[2] for b in batch]) / len(batch)
        won = [([], [], []) for _ in WIDTHS]  # of each text: features [filter], words and ids [filter, place in it]
        for ids, _, _ in batch:
            words, responses = _responses(ids, *tables)
            for w, r, b, own in zip(WIDTHS, responses, model.bias, won, strict=True):
                if r is None:  # no feature, so nothing flows back
                    parts = np.zeros(FILTERS, np.float32), np.zeros((FILTERS, w, DIM), np.float32), np.zeros((FILTERS, w, 2), np.uint32)
                else:
                    at = r.argmax(axis=1)
                    places = at[:, None] + _PLACES[w]
                    parts = np.maximum(r[_EACH, at] + b, 0), words[places], ids[places]
                for x, part in zip(own, parts, strict=True):
                    x.append(part)
        features = [np.array(x[0]) for x in won]
        pooled = np.concatenate(features, axis=1)
        z = pooled @ model.out + model.base[0]
        error = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32)
        convs, biases, rows, moves = [], [], [], []
        for k, (c, f, own) in enumerate(zip(model.conv, features, won, strict=True)):
            back = error[:, None] * model.out[k * FILTERS : (k + 1) * FILTERS] * (f > 0)
            biases.append(back.sum(axis=0))
            convs.append(np.einsum("bf,bfwd->wdf", back, np.array(own[1])))
            alive = back != 0
            rows.append(np.array(own[2])[alive].reshape(-1, 2))
            moves.append((back[:, :, None, None] * c.transpose(2, 0, 1))[alive].reshape(-1, DIM))
        self.n += 1
        for p, g, m, v in zip(params, [*convs, *biases, error @ pooled, error.sum(keepdims=True)], self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-6)
        at, of = np.unique(np.concatenate(rows), return_inverse=True)
        move, of = np.concatenate(moves), of.reshape(-1, 2)
        g = np.stack([sum(np.bincount(of[:, half], x, len(at)) for half in (0, 1)) for x in move.T], axis=1).astype(np.float32)
        self.squares[at] += (g * g).sum(axis=1)
        model.emb[at] -= 0.05 * g / np.sqrt(self.squares[at])[:, None]
        self.moved[at] = True


def _best_threshold(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Half way between the logits around the best cut."""
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    hit, all_, total = np.cumsum(w * y), np.cumsum(w), (w * y).sum()
    f1 = 2 * hit / (all_ + total)
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def _packed(ids: np.ndarray) -> bytes:
    return (ids - np.array([0, HALF], np.uint32)).astype("<u2").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2").reshape(-1, 2) + np.array([0, HALF], np.uint32)


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, part: int) -> DataFrame:
    """(part int, fold int, y int, ids binary) of every labelled row of ``docs``, written; rows of a part follow
    each other, in an order by hash; fold 0 or 1 by hash."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    known = materialize(known, "labels", labels.count())
    parts = max(1, -(-min(known.count(), docs.count()) // part))
    rows = docs.join(small(known), F.col(id_col) == F.col("_id")).select("_id", "_y", F.col(text_col).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("_id", "text", F.lit(9))).withColumn("part", F.pmod("_h", F.lit(parts)).cast("int")).withColumn("fold", F.pmod(F.hash("_h"), F.lit(2)))
    rows = rows.repartition(parts, F.col("part")).sortWithinPartitions("part", "_h", "_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [_packed(word_ids(t.as_py())) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["part", "fold", "y", "ids"])

    out = materialize(rows.select("part", "fold", "_y", "text").mapInArrow(run, "part int, fold int, y int, ids binary"), "training")
    discard(known)
    return out


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """[label, bucket]: how many texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches):
            for y, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[y, np.unique(_unpacked(ids.as_py()))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "n0", "n1"])

    rows = texts.select("y", "ids").mapInArrow(run, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = rows.toPandas()  # a row for each bucket, at most
    out = np.zeros((2, BUCKETS), np.int64)
    out[:, found["bucket"]] = found["n0"], found["n1"]
    return out


def _flat(model: TextCnn) -> np.ndarray:
    """The embedding, and below it all other parameters in rows of its width."""
    rest = np.concatenate([p.ravel() for p in model.params()])
    return np.concatenate([model.emb, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])


def _set(model: TextCnn, flat: np.ndarray) -> None:
    model.emb = flat[:BUCKETS].astype(np.float32)
    rest, at = flat[BUCKETS:].ravel(), 0
    for p in model.params():
        p[...] = rest[at : at + p.size].reshape(p.shape)
        at += p.size


def one_round(texts: DataFrame, model: TextCnn, weight: tuple[float, float]) -> None:
    """Each part takes its steps from ``model``; their changes, averaged by texts, are added to it."""
    start = _flat(model)
    held = texts.sparkSession.sparkContext.broadcast(start)  # fixed size
    names = [f"v{k}" for k in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, part, batch_, n, own = held.value, None, [], 0, TextCnn()
        steps = Steps(own)

        def change() -> pa.RecordBatch:
            if batch_:
                steps.take(batch_)
            moved = np.concatenate([np.flatnonzero(steps.moved), np.arange(BUCKETS, len(begin))])
            by = np.rint((_flat(own)[moved] - begin[moved]).astype(float) * (n * GRAIN)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), pa.array(np.full(len(moved), n)), *(pa.array(by[:, k]) for k in range(DIM))], names=["row", "n", *names])

        for batch in slices(batches):
            for p, y, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part:
                    if n:
                        yield change()
                    part, batch_, n = p, [], 0
                    _set(own, begin)
                    steps = Steps(own)
                batch_.append((_unpacked(ids.as_py()), y, weight[y]))
                n += 1
                if len(batch_) == BATCH:
                    steps.take(batch_)
                    batch_ = []
        if n:
            yield change()

    rows = texts.select("part", "y", "ids").mapInArrow(run, ", ".join(["row int", "n long", *(f"{c} long" for c in names)]))
    found = rows.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toPandas()  # a row for each of the model's, at most
    start[found["row"]] += found[names].to_numpy(float) / (found[["n"]].to_numpy(float) * GRAIN)
    _set(model, start)
    held.unpersist()


def logit_histogram(texts: DataFrame, model: TextCnn) -> DataFrame:
    """(group int, bin int, y int, n long) of the logits of all texts."""
    held = texts.sparkSession.sparkContext.broadcast((model.tables(), model.bias, model.out, model.base))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextCnn()
        tables, own.bias, own.out, own.base = held.value
        for batch in slices(batches):
            ids = [_unpacked(x.as_py()) for x in batch.column(1)]
            z = np.clip([own.logit(x, tables) for x in ids], -FAR, FAR)
            yield pa.RecordBatch.from_arrays([pa.array([group_of(x) for x in ids], pa.int32()), pa.array(np.floor(z * BINS), pa.float64()).cast(pa.int32()), batch.column(0)], names=["group", "bin", "y"])

    return texts.select("y", "ids").mapInArrow(run, "group int, bin int, y int").groupBy("group", "bin", "y").agg(F.count("*").alias("n"))


def _fitted(texts: DataFrame) -> TextCnn | None:
    """A model of all of ``texts``, without thresholds; None if they lack a class."""
    totals = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if len(totals) < 2:
        return None
    model, n0, n1 = TextCnn(), totals[0], totals[1]
    counts = bucket_counts(texts)
    model.begin(counts[1], counts[0], n1, n0)
    for _ in range(EPOCHS):
        one_round(texts, model, (0.5 / n0 * (n0 + n1), 0.5 / n1 * (n0 + n1)))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", part: int = PART) -> TextCnn:
    """Fits on all rows with a label, of any length; labels other than 0 and 1 are ignored, of several
    labels of one id the highest counts, a null text is empty.  For the thresholds each half of the texts
    is judged by a model of the other half; if a half lacks a class, all are judged by the model of all."""
    texts = training_texts(docs, labels, id_col, text_col, label_col, part)
    model = _fitted(texts)
    if model is None:
        model = TextCnn()
        model.thresholds[:] = -np.inf if texts.where("y = 1").take(1) else np.inf
    else:
        halves = [_fitted(texts.where(F.col("fold") == k)) for k in (0, 1)]
        judged = [(texts, model)] if None in halves else [(texts.where(F.col("fold") == 1 - k), half) for k, half in enumerate(halves)]
        seen = pd.concat([logit_histogram(t, m).toPandas() for t, m in judged]).sort_values(["group", "bin", "y"])
        model.calibrate(seen["group"].to_numpy(), (seen["bin"].to_numpy() + 0.5) / BINS, seen["y"].to_numpy(), seen["n"].to_numpy())
    discard(texts)
    return model


def classify(docs: DataFrame, model: TextCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted int.

    Null and empty texts are scored by the linear layer's base alone.  Repeated rows and null ids get
    a row each.  Without labels of both classes every score is 0 (or 1, if all labels are).  An empty
    table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.tables(), model.bias, model.out, model.base, model.thresholds))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextCnn.__new__(TextCnn)
        tables, own.bias, own.out, own.base, own.thresholds = held.value
        for batch in batches:
            score = []
            for text in batch.column(1):
                ids = word_ids(text.as_py())
                z = own.logit(ids, tables) - own.thresholds[group_of(ids)]
                score.append(float(1 / (1 + np.exp(-np.clip(z, -700, 700)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc32_of(F.col("doc_id"), 5) != 0))
    out = classify(docs, model)
    return out.select("doc_id", F.coalesce(crc32_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
