"""Operator 12, a quality classifier as a sparse ensemble of rules.

Statistics of a text are columns.  Small boosted regression trees are grown over the statistics of a
bounded, documented sample of labelled texts; every path from a root to a node is a conjunctive rule
("symbols <= 0.01 and words > 80").  A logistic regression with lasso penalty weighs the rules and
leaves few of them (Friedman and Popescu, "Predictive Learning via Rule Ensembles", 2008).  The rules
that are left become one Spark column expression over the statistics, so scoring needs no model on the
executors.

The logit at which both classes are told apart best, by the mean of their recalls on texts kept apart,
comes to lie at the score ``CUT``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import SPACE, crc32_of, materialize, table
from textlake.llm.quality import BLANKS, COMMON_WORDS

CUT = 0.3
#: Training texts of each class, at most: the first by a hash of the id.
TRAIN_ROWS = 2000
#: One in so many training texts is kept apart for penalty and cut.
APART = 4
TREES, DEPTH, SHRINK, BINS, LEAST = 40, 3, 0.2, 64, 5
#: Penalties as parts of the least one that leaves no rule, and steps for each.
PENALTIES = tuple(0.5 * 0.6**k for k in range(12))
STEPS = 150

STATISTICS = ("words", "word_length", "longest", "symbols", "bars", "calls", "stops", "upper", "digits", "other", "variety", "lines", "distinct_lines", "common")
#: Signs that may stand around a word.
_AROUND = ".,;:!?#*$%&|<>()'\"-"
_SIGNS = {"symbols": r"[#*$%&|<>!]", "bars": r"\|", "calls": "!", "stops": r"[.,;:?]", "upper": r"\p{Lu}", "digits": "[0-9]", "other": r"[^\p{L}\p{N}\x00-\x7F]"}


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the STATISTICS as columns of doubles, each with a leading underscore: counts of words
    and of the characters of the longest word; signs for each character; the logarithm of the distinct words for that of all
    words, which hardly depends on the length (1 for less than two words); lines and frequent words of
    the listed languages for each word; distinct lines for each line.  0 for nothing."""
    df = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    bare = F.btrim("_t", F.lit(BLANKS))
    df = df.withColumn("_w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("_d", F.array_distinct("_w"))
    n, chars, lines = F.size("_w"), F.length("_t"), F.size("_l")
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")
    out = {"words": n.cast("double"), "longest": F.coalesce(F.array_max(F.transform("_d", F.length)), F.lit(0)).cast("double"), "variety": F.when(n > 1, F.log(F.size("_d")) / F.log(n)).otherwise(1.0), "lines": share(lines, n), "distinct_lines": share(F.size(F.array_distinct("_l")), lines)}
    out["word_length"] = share(F.length(F.array_join("_w", "")), n)
    out["common"] = share(F.size(F.filter("_w", lambda x: F.lower(F.btrim(x, F.lit(_AROUND))).isin(listed))), n)
    out |= {k: share(F.regexp_count("_t", F.lit(v)), chars) for k, v in _SIGNS.items()}
    return df.withColumns({f"_{k}": out[k] for k in STATISTICS}).drop("_t", "_w", "_l", "_d")


#: (statistic, whether it must exceed the bound, bound) for each condition.
Rule = tuple[tuple[int, bool, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, bound in rule:
        out &= (x[:, j] > bound) == above
    return out


def _paths(x: np.ndarray, target: np.ndarray, weight: np.ndarray, edges: list[np.ndarray], values: np.ndarray, rows: np.ndarray, rule: Rule, found: list[Rule]) -> None:
    """Grows a tree below ``rule`` over ``rows`` and notes the rule of each node; leaves put their weighted mean
    into ``values``.  x holds bins: bin b of statistic j lies above edges[j][b - 1]."""
    w, y = weight[rows], target[rows]
    best, cut = 1e-9, None
    if len(rule) < DEPTH and len(rows) >= 2 * LEAST:
        total, mass = (w * y).sum(), w.sum()
        for j, e in enumerate(edges):
            bins = x[rows, j]
            many, left, sums = (np.cumsum(np.bincount(bins, v, len(e) + 1))[:-1] for v in (None, w, w * y))
            ok = (many >= LEAST) & (len(rows) - many >= LEAST)
            if ok.any():
                gain = np.where(ok, sums**2 / np.maximum(left, 1e-12) + (total - sums) ** 2 / np.maximum(mass - left, 1e-12), -1.0) - total**2 / mass
                if gain.max() > best:
                    best, cut = gain.max(), (j, int(gain.argmax()))
    if cut is None:
        values[rows] = (w * y).sum() / w.sum()
        return
    j, b = cut
    for above in (False, True):
        own: Rule = (*rule, (j, above, float(edges[j][b])))
        found.append(own)
        _paths(x, target, weight, edges, values, rows[(x[rows, j] > b) == above], own, found)


def _tightened(rule: Rule) -> Rule:
    """The same rule with one bound for each statistic and side."""
    out: dict[tuple[int, bool], float] = {}
    for j, above, bound in rule:
        known = out.get((j, above))
        out[j, above] = bound if known is None else (max if above else min)(known, bound)
    return tuple((j, above, bound) for (j, above), bound in sorted(out.items()))


def grow_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules from the paths of TREES boosted trees, each grown on a half of the rows."""
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for v in x.T]
    bins = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x.T, strict=True)], axis=1)
    rng, logit, found = np.random.default_rng(seed), np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        rows, values = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)]), np.zeros(len(y))
        paths: list[Rule] = []
        _paths(bins, y - p, weight, edges, values, rows, (), paths)
        found += paths
        # leaves of the rows that were not drawn
        values[:] = 0
        leaves = [r for r in paths if not any(o[: len(r)] == r and len(o) > len(r) for o in paths)]
        for r in leaves:
            at = holds(r, x)
            drawn = at[rows]
            values[at] = np.average((y - p)[rows][drawn], weights=weight[rows][drawn])
        logit += 4 * SHRINK * values  # about a Newton step: p (1 - p) is 1/4 at most
    seen: dict[bytes, Rule] = {}
    for r in map(_tightened, found):
        at = holds(r, x)
        if 0 < at.sum() < len(at):  # rules that hold for the same rows are one
            seen.setdefault(at.tobytes(), r)
    return list(seen.values())


def lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Weights [intercept, one for each column] of the penalised logistic regression, by accelerated
    proximal steps; ``penalty`` is a part of the least that leaves no column."""
    w = weight / weight.sum()
    least = np.abs((w * (y - (w * y).sum())) @ r).max()
    a = np.concatenate((np.ones((len(r), 1)), r), axis=1)
    v = np.ones(a.shape[1]) / np.sqrt(a.shape[1])
    for _ in range(20):  # the largest curvature
        v = a.T @ (w * (a @ v))
        curve = np.linalg.norm(v)
        v /= curve
    step, beta, at, t = 4 / (1.05 * curve), start.copy(), start.copy(), 1.0
    for _ in range(STEPS):
        new = at - step * (a.T @ (w * (1 / (1 + np.exp(-a @ at)) - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty * least, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at = new + (old - 1) / t * (new - beta)
        beta = new
    return beta


@dataclass
class RuleEnsemble:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    base: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for rule, w in zip(self.rules, self.weights, strict=True):
            out += w * holds(rule, x)
        return out

    def column(self) -> Column:
        """The score over the columns of ``with_statistics``."""
        z = F.lit(self.base)
        for rule, w in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for j, above, bound in rule:
                c = F.col(f"_{STATISTICS[j]}")
                met = met & (c > bound if above else c <= bound)
            z = z + F.when(met, w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def readable(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[j]} {'>' if above else '<='} {bound:.4g}" for j, above, bound in r) for r, w in sorted(zip(self.rules, self.weights, strict=True), key=lambda p: -abs(p[1]))]


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Both classes weigh the same.  Trees and weights come from most rows; the rows apart choose the
    penalty, the largest within 2 % of the least loss, and the cut."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(base=0.0 if not len(y) else (30.0 if y[0] else -30.0))
    apart = np.zeros(len(y), bool)
    rng = np.random.default_rng(11)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        apart[own[: len(own) // APART]] = True
    if len(np.unique(y[apart])) < 2:
        apart[:] = True
    use = ~apart if not apart.all() else apart
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rules = grow_rules(x[use], y[use], weight[use])
    if not rules:
        return RuleEnsemble()
    r = np.stack([holds(q, x) for q in rules], axis=1).astype(np.float64)
    spread = np.sqrt(np.maximum(r[use].mean(axis=0) * (1 - r[use].mean(axis=0)), 1e-6))
    r /= spread
    beta, tried = np.zeros(1 + len(rules)), []
    for penalty in PENALTIES:
        beta = lasso(r[use], y[use], weight[use], penalty, beta)
        z = beta[0] + r[apart] @ beta[1:]
        tried.append((float(np.average(np.logaddexp(0, np.where(y[apart] == 1, -z, z)), weights=weight[apart])), beta))
    least = min(loss for loss, _ in tried)
    beta = next(b for loss, b in tried if loss <= 1.02 * least + 1e-6)
    keep = np.flatnonzero(np.abs(beta[1:]) > 1e-9)
    model = RuleEnsemble([rules[k] for k in keep], [float(beta[1 + k] / spread[k]) for k in keep], float(beta[0]))
    model.base += float(np.log(CUT / (1 - CUT))) - _best_cut(model.logit(x[apart]), y[apart])
    return model


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Half way between the two logits around the cut with the best mean of recalls."""
    at = np.unique(z)
    cuts = np.concatenate(([at[0] - 1], (at[1:] + at[:-1]) / 2))
    good, bad = np.sort(z[y == 1]), np.sort(z[y == 0])
    recalls = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(recalls >= recalls.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Fits on the statistics of at most ``rows`` texts of each class.  Labels other than 0 and 1 are
    ignored; of several labels of one id the lowest counts, of several texts the one of the least
    statistics; a null text is an empty one."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    first = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(12)), "_id").limit(rows) for y in (0, 1)]
    chosen = materialize(first[0].union(first[1]), "training", 2 * rows)
    own = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_of") == F.col("_id"))  # 2 * rows ids at most
    stats = F.min(F.struct(*(f"_{k}" for k in STATISTICS))).alias("s")
    found = sorted(with_statistics(own, "_text").groupBy("_id", "_y").agg(stats).collect())
    x = np.array([list(r["s"]) for r in found], np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["_y"] for r in found], np.int64))


def classify(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted int (score >= CUT).

    Null, empty and blank texts have statistics of 0 and are scored like others.  Repeated rows and null
    ids get a row each.  Without labels every score is 1/2, with labels of one class about 0 or 1.  An
    empty table gives an empty one; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text"))
    out = with_statistics(src, "_text").select(F.col("_of").alias(id_col), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc32_of(F.col("doc_id"), 5) != 0))
    out = classify(docs, model)
    return out.select("doc_id", F.coalesce(crc32_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
