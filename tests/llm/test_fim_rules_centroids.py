"""Operators 11 to 13 against plain Python, round trips and held-out labels, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.llm import centroids, fim, rules

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, n string, output int, _t string, Score double"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, one-word, marked, non-ASCII and very long texts, repeated rows, null and
    repeated ids, columns whose names clash."""
    rng = random.Random(4)
    long = " ".join(rng.choice(("alpha", "b", "γδ", "😀", "x1y2")) for _ in range(400_000))
    texts = [(1, "The cat, sat\non 3 mats."), (2, None), (3, ""), (4, " \n\t"), (5, "word"), (6, "a <P> marker"), (7, "שלום 😀 ab"), (8, long), (9, "q" * 3_000_000), (None, "no id at all"), (10, "twice"), (10, "twice"), (10, "other text"), (11, "\x00\x01ÿ�"), (12, "<P"), (13, "S> <M<S")]
    texts += [(100 + i, f"text {i} with <M words, and S> signs <") for i in range(200)]
    return spark.createDataFrame([(d, t, "n", 1, "t", 0.5) for d, t in texts], DOCS).repartition(3)


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_op11_equals_plain_python_and_is_restored(odd):
    out = fim.fill_in_middle(odd).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect())
    rows = odd.select("doc_id", "text").collect()
    want = sorted(((-1 if d is None else d), *plain_fim(d, t), t or "") for d, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_op11_parts_of_a_long_text_give_the_same(odd, monkeypatch):
    texts = [t for _, t in odd.select("doc_id", "text").collect() if t]
    for part in (7, 1000):
        monkeypatch.setattr(fim, "PART_BYTES", part)
        for t in [x for x in texts if len(x) < 10_000] + [max(texts, key=len)[:50_000] if part > 7 else "ab cd ééé fg 12 hi"]:
            parts = fim._parts(t.encode())
            assert b"".join(parts) == t.encode() and sum(len(re.findall("[A-Za-z]+|[^A-Za-z]", p.decode())) for p in parts) == len(re.findall("[A-Za-z]+|[^A-Za-z]", t))


def test_op11_empty_table(odd):
    assert fim.fill_in_middle(odd.where("false")).count() == 0


# -- 12 ----------------------------------------------------------------------------------------

def test_op12_tells_held_out_labels_apart(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rules.op12_rule_ensemble(spark, SF).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    held = got[got.held_out & got.quality.isin([0, 1])]
    assert len(held) > 50 and ((held.score >= 0.3).astype(int) == held.predicted).all()
    good, bad = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert auc > 0.99 and (held.predicted == held.quality).mean() > 0.97


def test_op12_column_equals_the_rules_and_they_are_conjunctions(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = rules.train(docs, labels, rows=150)
    assert 0 < len(model.rules) < 200 and all(1 <= len(r) <= rules.DEPTH for r in model.rules) and len(model.readable()) == len(model.rules)
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = rules.with_statistics(both, "text").select(*(f"_{k}" for k in rules.STATISTICS), model.column().alias("score")).collect()
    x = np.array([r[:-1] for r in rows])
    assert np.isfinite(x).all() and np.allclose(1 / (1 + np.exp(-model.logit(x))), [r[-1] for r in rows])


def test_op12_statistics_of_plain_texts(spark):
    docs = spark.createDataFrame([(1, "The cat & the DOG!\nthe cat\n\nthe cat"), (2, None), (3, "  ")], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.with_statistics(docs, "text").collect()}
    t, n = "The cat & the DOG!\nthe cat\n\nthe cat", 9
    assert got[1]._words == n and got[1]._longest == 4 and abs(got[1]._variety - np.log(5) / np.log(n)) < 1e-12
    assert got[1]._symbols == 2 / len(t) and got[1]._upper == 4 / len(t) and got[1]._lines == 3 / n and abs(got[1]._distinct_lines - 2 / 3) < 1e-12 and got[1]._common == 4 / n
    for i in (2, 3):
        assert all(got[i][f"_{k}"] == (1.0 if k == "variety" else 0.0) for k in rules.STATISTICS)


def test_op12_lasso_and_trees_find_a_planted_rule():
    rng = np.random.default_rng(2)
    x = rng.random((800, len(rules.STATISTICS)))
    y = ((x[:, 3] > 0.6) & (x[:, 7] <= 0.5)).astype(np.int64)
    model = rules.fit(x, y)
    fresh = rng.random((400, len(rules.STATISTICS)))
    want = (fresh[:, 3] > 0.6) & (fresh[:, 7] <= 0.5)
    assert ((1 / (1 + np.exp(-model.logit(fresh))) >= rules.CUT) == want).mean() > 0.97
    assert len(model.rules) < 60 and any({j for j, _, _ in r} == {3, 7} for r in model.rules)
    r = np.stack([x[:, 0] > 0.5, x[:, 3] > 0.6], axis=1).astype(float)
    assert not rules.lasso(r, y, np.ones(800), 1.01, np.zeros(3))[1:].any() and rules.lasso(r, y, np.ones(800), 0.1, np.zeros(3))[2] > 0


def test_op12_odd_tables_and_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (10, 1), (10, 0), (5, 7), (None, 1), (77, 0), (8, 1), (6, None)], "doc_id long, quality int")
    model = rules.train(odd, labels)
    out = rules.classify(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= rules.CUT) for r in out)
    twice = [r.score for r in out if r.doc_id == 10]
    assert len(twice) == 3 and len({r.doc_id for r in out if r.doc_id is None}) == 1
    assert rules.classify(odd.where("false"), model).count() == 0
    none = rules.train(odd, labels.where("false"))
    assert {r.score for r in rules.classify(odd, none).collect()} == {0.5}
    ones = rules.train(odd, labels.where("quality = 1"))
    assert min(r.score for r in rules.classify(odd, ones).collect()) > 0.99


# -- 13 ----------------------------------------------------------------------------------------

def plain_lloyd(rows, k, rounds):
    """(id, cluster, distance) and centroids, with all distances anew in every round."""
    x = [(i, [int(np.floor(256 * float(e))) for e in v]) for i, v in rows]
    order = sorted(range(len(x)), key=lambda j: (hashlib.sha256(f"2:{x[j][0]}".encode()).hexdigest() if x[j][0] is not None else "~", x[j][1]))
    c = [list(x[j][1]) for j in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min((far(v, m), j) for j, m in enumerate(c)) for _, v in x]
        if turn < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, g) in zip(x, near, strict=True) if g == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, g, d) for (i, _), (d, g) in zip(x, near, strict=True)], c


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(5, 4))
    rows = [(i, (centre[i % 5] + rng.normal(size=4) * 0.2).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(100)]  # a hot vector
    rows += [(7, rows[9][1]), (None, rows[3][1]), (500, [0.5, -0.25, 0.0, 1.0])]
    bad = [(600, None), (601, [1.0, 2.0]), (602, [1.0, None, 2.0, 3.0]), (603, [float("nan"), 0.0, 0.0, 0.0]), (604, [float("-inf"), 0.0, 0.0, 0.0]), (605, [])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, cluster int, x string").repartition(4)
    return rows, table


def test_op13_equals_plain_lloyd(vectors):
    rows, table = vectors
    want, centres = plain_lloyd(rows, 9, 4)
    found, c = centroids.cluster(table, k=9, rounds=4, dim=4)
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[2])
    assert sorted(map(key, found.collect())) == sorted(map(key, want)) and c.tolist() == centres
    about = centroids.described(found, c).collect()
    assert {r.inertia for r in about} == {sum(d for _, _, d in want)}
    for r in about:
        assert r.cluster_inertia == sum(d for _, g, d in want if g == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_op13_few_vectors_ties_and_empty_tables(spark, vectors):
    _, table = vectors
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found, c = centroids.cluster(few, k=40, rounds=3, dim=2)
    want, centres = plain_lloyd([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], 40, 3)
    assert sorted(map(tuple, found.collect())) == sorted(want) and c.tolist() == centres and len(c) == 3
    none, c = centroids.cluster(table.where("vec_id >= 600"), dim=4)
    assert none.count() == 0 and len(c) == 0 and centroids.described(none, c).count() == 0
    far, c = centroids.cluster(spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>"), k=1, rounds=1, dim=2)
    assert c.tolist() in ([[centroids.LIMIT // 2, -centroids.LIMIT // 2]],) and far.count() == 2


def test_op13_dots_follow_only_changed_components():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    x, old, delta = rng.integers(-300, 300, (20, 6)), rng.integers(-300, 300, (4, 6)), np.zeros((4, 6), np.int64)
    delta[1, 2], delta[3, 5] = 17, -4
    new = old + delta
    lists = lambda a, t: pa.array(a.tolist(), pa.list_(t))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), lists(x, pa.int32()), lists(x @ old.T, pa.int64()), pa.array([0] * 20, pa.int32())], names=["id", "x", "dots", "cluster"])
    out = next(centroids._assign(delta, (new * new).sum(axis=1))(iter([batch]))).to_pydict()
    assert np.array_equal(out["dots"], x @ new.T)
    all_ = ((x[:, None, :] - new) ** 2).sum(axis=2)
    assert out["cluster"] == all_.argmin(axis=1).tolist() and out["distance"] == all_.min(axis=1).tolist()
