"""Operators without SQL, and the whole pipeline stage by stage, against plain versions on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import SF, brute_components, naive_best_fit, plain_shingles, prose
from textlake.llm import langid, mixing, packing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def walk(spark, docs):
    """taken words by (source, id) of a mix: blocks in the order of their hash, whole ones as long as they
    fit, of the next one the documents that fill what is left."""
    rows = docs.select(F.col("doc_id").alias("id"), "source", "text", mixing.unit_of(F.col("doc_id"), F.col("text")).alias("unit"))
    rows = rows.withColumn("h", F.xxhash64("unit", F.lit(11))).collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(words_of(r.text)) for r in rows if r.source == s) for s in sources]
    aim = mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
    taken = {}
    for rank, (source, size, target) in enumerate(zip(sources, sizes, aim, strict=True)):
        own = [r for r in rows if r.source == source]
        n = -(-len(own) // mixing.DOCS_PER_BLOCK)
        epochs = min(mixing.MOST, int(target // size)) if size else 0
        left = target - epochs * size
        blocks = {}
        for r in own:
            blocks.setdefault(r.h % n, []).append(r)
        order = spark.createDataFrame([(rank, b) for b in blocks], "r int, b long").select("b", F.xxhash64("r", "b", F.lit(11)).alias("h")).collect()
        more, open_ = set(), True
        for b in [x.b for x in sorted(order, key=lambda x: (x.h, x.b))]:
            units = Counter()
            for r in blocks[b]:
                units[r.unit] += len(words_of(r.text))
            if open_ and sum(units.values()) <= left:
                more |= set(units)
                left -= sum(units.values())
            elif open_:
                if left > 0:
                    more |= set(mixing.choose(list(units), list(units.values()), left))
                open_ = False
        for r in own:
            taken[source, r.id] = len(words_of(r.text)) * (epochs + (r.unit in more))
    return taken


def test_op1_equals_a_plain_walk_of_the_blocks(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 90), ["a", "b", "c"]), None if i % 11 == 3 else f"s{min(i % 7, 3)}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    assert got == {i: n for (_, i), n in walk(spark, docs).items()}


def test_op2_counts_equal_plain_sets():
    """The bit-sliced AND holds every n-gram of a language's filter, and counts as one set of cells a language does."""
    rng = random.Random(3)
    alphabets = [rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéñ", 9) for _ in range(11)]
    text = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 7))) for _ in range(n))
    train = [(text(a, 80), f"l{i:02d}") for i, a in enumerate(alphabets) for _ in range(6)]
    filters = langid.Filters.fit(*map(list, zip(*train, strict=True)))
    slices = [[set() for _ in range(langid.HASHES)] for _ in alphabets]
    docs = {}  # language -> n-gram -> texts
    for t, lang in train:
        for g in set(langid.grams(t).tolist()):
            docs.setdefault(lang, Counter())[g] += 1
    share = {lang: {g: n / 6 for g, n in c.items()} for lang, c in docs.items()}
    held = []
    for i, lang in enumerate(filters.languages):
        own = {g for g, s in share[lang].items() if s >= min(langid.LEAST_SHARE, 2 / 6) and s >= langid.LEAST_RATIO * max(x.get(g, 0) for x in share.values())}
        held.append(own)
        for at in langid.cells(np.array(sorted(own), np.uint32)):
            for s in slices[i]:
                s.update(at.tolist())
    for i in range(len(alphabets)):
        probe = text(alphabets[i], 60) + " " + text(alphabets[(i + 1) % 11], 20)
        keys = langid.grams(probe)
        per_hash = [at.tolist() for at in langid.cells(keys)]
        plain = []
        for k, got in enumerate(filters.shares(probe)):
            hits = sum(all(c in slices[k][0] for c in row) for row in zip(*per_hash, strict=True))
            assert hits >= sum(g in held[k] for g in keys.tolist())
            false = filters.false[k]
            plain.append(max(0, (hits / len(keys) - false) / (1 - false)))
            assert abs(got - plain[-1]) < 1e-12
        assert filters.predict(probe)[0] == filters.languages[plain.index(max(plain))]


def test_op6_look_ups_equal_a_direct_convolution():
    net, rng = toxicity.TextCnn(), random.Random(2)
    noise = np.random.default_rng(4)
    net.bias = [noise.normal(0, 0.2, b.shape).astype(np.float32) for b in net.bias]
    tables = net.tables()
    for n in (0, 1, 2, 3, 50):
        ids = toxicity.word_ids(prose(rng, n))
        x = np.array([net.emb[a].astype(float) + net.emb[b] for a, b in ids.tolist()]).reshape(len(ids), toxicity.DIM)
        want = []
        for conv, bias in zip(net.conv, net.bias, strict=True):
            for f in range(toxicity.FILTERS):
                at = [sum(float(x[k + j] @ conv[j, :, f]) for j in range(len(conv))) for k in range(len(x) - len(conv) + 1)]
                want.append(max(0.0, max(at) + bias[f]) if at else 0.0)
        assert np.allclose(net.pooled(ids, tables), want, atol=1e-4)


def test_op6_texts_of_the_same_words_tie():
    net = toxicity.TextCnn()
    tables = net.tables()
    a, b = (net.logit(toxicity.word_ids(t), tables) for t in ("same words here", "Same  words, here!"))
    assert a == b


def test_pipeline_equals_plain_stages(spark, tmp_path, monkeypatch):
    """Every stage's table against a plain version on the table before it."""
    monkeypatch.setattr(corpus_pipeline, "new_path", lambda _, name: str(tmp_path / name))
    packed = corpus_pipeline.run(spark, SF).toPandas()
    read = lambda k: spark.read.parquet(str(tmp_path / f"stage{k}"))
    good, unique, cut, mixed = ({r.doc_id: r for r in read(k).collect()} for k in range(4))

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {i for i, k in con.sql(f"SELECT doc_id, kept FROM ({quality.OP4_SQL})").fetchall() if k}
    assert set(good) == kept and read(0).count() == len(kept)

    sets = {i: plain_shingles(r.text) for i, r in good.items()}
    assert {i for i, c in brute_components(sets, 80).items() if i == c} == set(unique) and read(1).count() == len(unique)
    assert all(unique[i] == good[i] for i in unique)

    before = {i: words_of(r.text) for i, r in unique.items()}
    after = {i: words_of(r.text) for i, r in cut.items()}
    runs, lines = {}, Counter()
    for i, w in before.items():
        for k in range(len(w) - 23):
            runs.setdefault(tuple(w[k : k + 24]), set()).add(i)
        lines.update({tuple(words_of(x)) for x in unique[i].text.split("\n") if len(words_of(x)) >= 16})
    for i, w in before.items():
        rest = iter(w)
        assert all(x in rest for x in after.get(i, []))  # words go, none comes or moves
        if all(len(runs[tuple(w[k : k + 24])]) == 1 for k in range(len(w) - 23)) and "\n" not in unique[i].text.strip():
            assert cut[i].text == unique[i].text
    first = {}
    for i in sorted(before):
        for k in range(len(before[i]) - 46):
            first.setdefault(tuple(before[i][k : k + 47]), i)
    for i, w in after.items():
        assert all(first.get(tuple(w[k : k + 47]), i) == i for k in range(len(w) - 46))  # no passage of a smaller document stays whole
        assert cut[i].n_chars == len(cut[i].text)

    taken = walk(spark, read(2))
    times = Counter(r.doc_id for r in read(3).collect())
    assert {i: n * len(after[i]) for i, n in times.items() if after[i]} == {i: n for (_, i), n in taken.items() if n}
    assert all(mixed[i] == cut[i] for i in mixed)

    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == {i: n * len(after[i]) for i, n in times.items() if after[i]}
    part = packed[packed.n_tokens < packing.CAPACITY]
    assert len(part) <= packing.GROUP_PIECES  # one group
    part = part.sort_values(["n_tokens", "doc_id", "piece", "copy", "cluster"], ascending=[False, True, True, True, True])
    places = naive_best_fit(list(zip(part.n_tokens, part.source, part.cluster, strict=True)), packing.CAPACITY)
    assert [(f"g-0-{b}", at) for b, at in places] == list(zip(part.bin_id, part.bin_offset, strict=True))
