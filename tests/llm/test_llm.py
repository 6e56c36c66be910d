"""The ten operators against brute force, round trips and held-out rows, and on odd tables."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textlake.llm import langid, minhash, mixing, packing, pivots, quality, queries, shingles, substring, tokens, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text_Key string, _h long"


def prose(rng, n, vocabulary=None):
    words = vocabulary or [f"w{rng.randint(0, 4000)}x" for _ in range(4000)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, one-word and very long texts, ties, repeated rows, and
    columns whose names look like the operators' own."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    base = prose(rng, 300)
    rows = [
        (1, base, "en", "a", 1, "k", 1), (2, base.upper(), "en", "a", 1, "k", 1), (2, base.upper(), "en", "a", 1, "k", 1), (None, base, "en", None, None, None, None), (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "", 0), (5, " \n\t ", "xx", "b", 5, "", 0), (6, "word", "en", "b", 4, "", 0), (7, "word", "de", "c", 4, "", 0), (8, long, "en", "c", 9, "", 0), (9, long + " more", None, "c", 9, "", 0), (10, "שלום 😀 " * 80, "he", "d", 9, "", 0),
    ]
    return spark.createDataFrame([(a, b, c, d, e, f, g) for a, b, c, d, e, f, g in rows], DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def brute_components(sets, percent):
    ids = sorted(sets)
    group = {i: i for i in ids}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                group[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


# -- 10 ----------------------------------------------------------------------------------------

def test_op10_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = {}
    for g in range(40):
        base = prose(rng, rng.randint(4, 250), vocabulary).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(sets, 85)
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in got.items())


def test_op10_links_a_chain_through_members_of_one_bucket(spark):
    words = [f"c{i}" for i in range(400)]
    texts = [" ".join(words[:k] + [f"d{j}" for j in range(k)] + words[2 * k :]) for k in range(0, 60, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components({i: plain_shingles(t) for i, t in enumerate(texts)}, 85)


def test_op10_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 5000):
        assert minhash.sketch(np.unique(rng.integers(0, 2**63, n).astype(np.uint64))).all() or n == 1
    both = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, 1000).astype(np.uint64)))) for _ in range(2))
    assert abs((minhash.sketch(a) == minhash.sketch(b)).mean() - 4000 / 6000) < 0.15


def test_op10_odd_tables(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and not by[2].kept and by[7].component_id == 6 and by[9].component_id == 8
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].kept and by[5].kept
    assert by[None].component_id == 1 and by[None].kept and by[6].n_shingles == 1
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.where("doc_id in (2, 7, 9)").count() == 0 and left.count() == 8


def test_op10_null_and_repeated_ids_take_part_with_their_own_texts(spark):
    chain = [" ".join(f"{'z' if 20 <= i < 26 and k or 100 <= i < 106 and k > 1 else 'n'}{i}" for i in range(200)) for k in range(3)]
    rng = random.Random(8)
    x, y, z = (prose(rng, 120) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(10, chain[0]), (None, chain[1]), (11, chain[2]), (5, x), (5, y), (6, near(x)), (7, near(y)), (7, z), (8, near(z)), (8, near(z)), (9, None), (None, near(x))]
    sets = {i: plain_shingles(t) for i, (_, t) in enumerate(rows)}
    group = brute_components(sets, 85)
    assert group[0] == group[2] != brute_components({i: s for i, s in sets.items() if i != 1}, 85)[2]
    least = {g: min((rows[i][0] for i in group if group[i] == g and rows[i][0] is not None), default=None) for g in group.values()}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in got) == sorted(((d or -1), len(sets[i]), least[group[i]]) for i, (d, _) in enumerate(rows))
    left = sorted((r.doc_id or -1, r.text or "") for r in minhash.drop_near_duplicates(df).collect())
    assert left == sorted([(10, chain[0]), (-1, chain[1]), (-1, near(x)), (5, x), (5, y), (7, z), (9, "")])


# -- 4 -----------------------------------------------------------------------------------------

def test_op4_counts_equal_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(odd.where("doc_id is not null").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang").distinct())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = quality.quality(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen: dict = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        again = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_op4_keeps_good_and_rejects_junk(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = quality.quality(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in both.collect()}
    assert share[1] >= 0.99 and share[0] < 0.4


def test_op4_odd_tables(odd, empty):
    assert quality.quality(odd).count() == 12 and quality.quality(empty).count() == 0
    left = quality.keep_good(odd)
    assert left.columns == odd.columns and quality.keep_good(empty).count() == 0


# -- 1 -----------------------------------------------------------------------------------------

def test_op1_taken_meets_the_targets_and_comes_from_the_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_report(docs).toPandas()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got["size"] * got.shards.map(len)).all()
    again = mixing.mix_report(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    texts = docs.select("doc_id", "text", "source").toPandas()
    size = texts.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    by = size.groupby(texts.source).sum().sort_index()
    weights = dict(zip(by.index, [(5, 2, 1)[i % 3] for i in range(len(by))], strict=True))
    aim = {s: size.sum() * w / sum(weights.values()) for s, w in weights.items()}
    while any(aim[s] > 3 * by[s] + 1e-6 for s in aim):  # the excess goes to the others by weight
        over = {s for s in aim if aim[s] >= 3 * by[s]}
        rest = size.sum() - sum(3 * by[s] for s in over)
        aim = {s: 3 * by[s] if s in over else rest * w / sum(weights[x] for x in aim if x not in over) for s, w in weights.items()}
    rows = got.merge(texts[["doc_id", "source"]], on="doc_id")
    for s, part in rows.groupby("source"):
        assert (part.source_size == by[s]).all() and abs(part.target.iat[0] - aim[s]) < 1e-6 * aim[s] + 1e-6
        assert abs(part.taken.sum() - aim[s]) <= 0.02 * aim[s] + 50


def test_op1_shards_have_the_mix_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_BLOCK", 2)
    docs = spark.createDataFrame([(2**60 + i if i % 50 else None, f"w{i} " * (1 + i % 7), "abc"[min(2, i % 9)]) for i in range(6000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, shards=6).groupBy("shard", "source").count().toPandas().pivot(index="shard", columns="source", values="count").fillna(0)
    share = got.div(got.sum(axis=1), axis=0)
    assert len(got) == 6 and (share.max() - share.min()).max() < 0.2
    report = mixing.mix_report(docs)
    assert report.count() == 6000 and report.where("doc_id is null").count() == 120
    assert report.select(F.sum(F.size("shards"))).first()[0] == mixing.mix(docs).count()


def test_op1_chooses_what_fits_a_block():
    assert mixing.choose([1, 2, 3], [5, 4, 3], 8) == [1, 3]
    assert mixing.choose([1, 2], [10, 10], 4) == [] and mixing.choose([1, 2], [10, 10], 6) == [1]


def test_op1_water_filling():
    got = mixing.targets([100, 10, 1000], [5, 2, 1])
    assert got[1] == 30 and got[0] == 300 and abs(sum(got) - 1110) < 1e-9


def test_op1_tree_splits_exactly():
    quotas = np.array([1000, 7, 0, 333])
    out = mixing.split_quotas(quotas, 13)
    assert (out.sum(axis=1) == quotas).all() and abs(out.sum(axis=0) - quotas.sum() / 13).max() <= 4
    assert (out == mixing.split_quotas(quotas, 13)).all()


def test_op1_mix_draws_what_the_report_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix_report(docs).collect() if r["size"] and r.taken}
    got = mixing.mix(docs, shards=5).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == want


def test_op1_odd_tables(odd, empty):
    got = mixing.mix_report(odd).collect()
    assert len(got) == 12 and mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert {r["size"] for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(odd).columns[:7] == odd.columns


# -- 3 -----------------------------------------------------------------------------------------

def naive_best_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        best = None
        for b, (room, no, sources, clusters) in enumerate(bins):
            if room >= size and source not in sources and cluster not in clusters and (best is None or (room, no) < (bins[best][0], bins[best][1])):
                best = b
        if best is None:
            bins.append([capacity, len(bins), set(), set()])
            best = len(bins) - 1
        out.append((best, capacity - bins[best][0]))
        bins[best][0] -= size
        bins[best][2].add(source)
        bins[best][3].add(cluster)
    return out


def test_op3_equals_a_scan_of_all_bins():
    rng = random.Random(4)
    for _ in range(30):
        items = sorted(((rng.randint(1, 99), rng.randint(0, 9), rng.randint(0, 40)) for _ in range(200)), reverse=True)
        assert packing.best_fit(*map(list, zip(*items, strict=True)), 100) == naive_best_fit(items, 100)


def test_op3_packs_every_word_without_conflicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = packing.pack(docs, capacity=256).toPandas()
    assert p.n_tokens.sum() == docs.select(F.sum(packing.word_count(F.col("text")))).first()[0]
    for _, b in p.groupby("bin_id"):
        b = b.sort_values("bin_offset")
        assert b.bin_offset.tolist() == [0, *b.n_tokens.cumsum().tolist()[:-1]] and b.n_tokens.sum() <= 256
        assert b.cluster.is_unique and b.source.is_unique
    for _, d in p.groupby(["doc_id", "copy"]):
        d = d.sort_values("piece")
        assert d.first_token.tolist() == [0, *d.n_tokens.cumsum().tolist()[:-1]]


def test_op3_a_dominant_source_stands_once_in_a_bin(spark):
    """60 percent of the pieces have one source; ids above 2**53 and null ids stay what they are."""
    rng = random.Random(8)
    rows = [(2**60 + i if i % 10 else None, prose(rng, rng.randint(1, 60), ["a", "b", "c", f"x{i}"]), "big" if i % 5 < 3 else f"s{i % 40}") for i in range(500)]
    p = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=100).collect()
    assert {r.doc_id for r in p} == {r[0] for r in rows} and len(p) == 500
    seen = set()
    for r in p:
        assert (r.bin_id, r.source) not in seen
        seen.add((r.bin_id, r.source))
    assert len({r.bin_id for r in p}) >= 300


def test_op3_odd_tables(odd, empty):
    p = packing.pack(odd, capacity=100).toPandas()
    assert set(p.doc_id.dropna()) == {1, 2, 6, 7, 8, 9, 10} and packing.pack(empty).count() == 0
    assert p[p.doc_id == 2].groupby("copy").n_tokens.sum().tolist() == [300, 300]


# -- 7 -----------------------------------------------------------------------------------------

def test_op7_finds_passages_inside_lines_and_near_lines(spark):
    rng = random.Random(6)
    vocabulary = [f"p{i}" for i in range(5000)]
    passage = prose(rng, 60, vocabulary)
    line = prose(rng, 60, vocabulary).split()
    edited = list(line)
    edited[30] = "changed"
    rows = [(i, f"{prose(rng, 40, vocabulary)} {passage} {prose(rng, 30, vocabulary)}") for i in range(8)]
    rows += [(100, prose(rng, 50, vocabulary) + "\n" + " ".join(line)), (101, " ".join(edited) + "\n" + prose(rng, 50, vocabulary))]
    rows += [(i, prose(rng, 120, vocabulary)) for i in range(200, 230)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.repeats(df).toPandas()
    assert set(got.id) == set(range(1, 8)) | {101}
    assert set(got[got.id == 101].kept_id) == {100} and 0 in set(got[got.id == 101].kind)
    assert set(got[got.id < 100].kept_id) == {0}
    clean = {r.doc_id: r.text for r in substring.drop_repeats(df).collect()}
    before = dict(rows)
    assert all(clean[i] == before[i] for i in before if i >= 200 or i in (0, 100))
    for i in range(1, 8):
        assert passage in before[i] and clean[i] == before[i].replace(passage + " ", "")


def test_op7_texts_that_share_47_words_share_a_band():
    rng = np.random.default_rng(8)
    draw = lambda k: rng.integers(0, 2**63, k).astype(np.uint64)
    with np.errstate(over="ignore"):
        for _ in range(200):
            passage = draw(substring.SLIDE + substring.BAND - 1)
            texts = [np.concatenate((draw(int(k)), passage, draw(int(k)))) for k in rng.integers(0, 90, 2)]
            bands = [set(substring.anchors(shingles.shingle_hashes(t))[1].tolist()) for t in texts]
            assert bands[0] & bands[1]
        h = draw(500)
        at, _ = substring.anchors(h)
        key = shingles.mix(h)[: len(h) - substring.BAND + shingles.SHINGLE]
        windows = np.lib.stride_tricks.sliding_window_view(key, substring.SLIDE)
        assert at.tolist() == sorted(set((windows.argmin(axis=1) + np.arange(len(windows))).tolist()))


def test_op7_equals_brute_force(spark):
    """Whatever stands in a smaller document for 47 words goes, whole if that document is the smallest for
    all of it; nothing goes but equal runs of min_run words and paragraphs of a Jaccard of 0.8."""
    rng = random.Random(21)
    vocabulary = [f"q{i}" for i in range(6000)]
    shared = [prose(rng, rng.randint(24, 130), vocabulary) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(5, 60), vocabulary)]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(shared).split()
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            parts += [" ".join(words), prose(rng, rng.randint(1, 40), vocabulary)]
        rows.append((i, "".join(p + rng.choice((" ", "\n", "\n\n")) for p in parts)))
    hard = prose(rng, 90, vocabulary).split()
    wrapped = lambda w: "\n".join(" ".join(w[k : k + 11]) for k in range(0, len(w), 11))
    rows += [(70, wrapped(hard)), (71, wrapped([*hard[:45], "other", *hard[46:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.repeats(df).toPandas()
    words = {i: t.split() for i, t in rows}
    gone = {i: set() for i in words}
    for r in got.itertuples():
        assert r.kept_id <= r.id and r.n_words >= 16
        gone[r.id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert set(range(90)) == gone[71] and not gone[70]
    runs = {w: {} for w in (16, 24, 47)}
    for w, seen in runs.items():
        for i, x in words.items():
            for k in range(len(x) - w + 1):
                seen.setdefault(tuple(x[k : k + w]), set()).add(i)
    whole = [(i, x.start(), len(x.group().split())) for i, t in rows for x in re.finditer(r"[^\n]+", t)]
    sets = {(i, a): plain_shingles(dict(rows)[i][a:].split("\n")[0]) for i, a, n in whole if n >= 16}
    for i, x in words.items():
        for k in range(len(x) - 46):
            if min(runs[47][tuple(x[k : k + 47])]) < i:
                assert len(set(range(k, k + 47)) & gone[i]) >= 24
            if all(min(runs[16][tuple(x[q : q + 16])]) == min(runs[47][tuple(x[k : k + 47])]) < i for q in range(k, k + 32)):
                assert set(range(k, k + 47)) <= gone[i]  # one document keeps all of it
        near = {q for (j, a), s in sets.items() if j == i for (l, b), u in sets.items() if (l, b) != (j, a) and 100 * len(s & u) >= 80 * len(s | u) for p in [len(dict(rows)[i][:a].split())] for q in range(p, p + len(dict(rows)[i][a:].split("\n")[0].split()))}
        equal = {q for k in range(len(x) - 23) if len(runs[24][tuple(x[k : k + 24])]) > 1 for q in range(k, k + 24)}
        assert i == 71 or gone[i] <= near | equal


def test_op7_odd_tables(odd, empty):
    got = substring.repeats(odd).toPandas()
    assert 8 not in set(got.id) and {2, 9} <= set(got.id)
    assert substring.repeats(empty).count() == 0 and substring.drop_repeats(empty).count() == 0
    left = substring.drop_repeats(odd)
    assert left.columns == odd.columns
    by = {r.doc_id: r.text for r in left.collect()}
    assert by[3] is None and by[4] == "" and 2 not in by and len(by[8].split()) == 30_000


def test_op7_bands_are_tuned():
    rows, bands = substring.tune(80)
    assert (1 - 0.8**rows) ** bands <= 1e-3


# -- 5 -----------------------------------------------------------------------------------------

def test_op5_coding_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokens.encode(values)
        raw = [np.frombuffer(x, np.uint8) for x in (control * 2, data * 2)]
        assert (tokens.decode(*raw, [n, n]) == np.tile(values, 2)).all() and len(control) == -(-n // 4)
    with pytest.raises(ValueError):
        tokens.decode(np.array([3], np.uint8), np.array([0], np.uint8), [1])


def test_op5_a_text_of_many_words_is_not_remembered_whole(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    own = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "One two, three FOUR five; élan x2 a-b Ünder seven one two"
    lib = own.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in own([None, text])] == [[2], [*lib, 2]]
        assert len(own.known) <= 3


def test_op5_files_equal_the_library(spark, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.where("doc_id > 2").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    docs = docs.union(spark.createDataFrame([(9000, "<|endoftext|> a<|endoftext|>b 10 0 x0y ' ll don't é")], "doc_id long, text string"))
    tokens.write_tokens(docs, path, str(tmp_path / "t"))
    got = {r.doc_id: r for r in tokens.read_tokens(spark, str(tmp_path / "t")).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    tokens.write_tokens(odd.select("doc_id", "text"), path, str(tmp_path / "o"))
    assert tokens.read_tokens(spark, str(tmp_path / "o")).where("doc_id is null and start = 0").count() == 1
    tokens.write_tokens(empty, path, str(tmp_path / "e"))


# -- 9 -----------------------------------------------------------------------------------------

def test_op9_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "<p>é😀</p>"), (6, "http://f\r\nX: y", "<b>" * 50_000), (6, "http://g", "<b>" * 50_000)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    by = {(r.page_id, r.url): r for r in got}
    assert len(got) == 7
    assert by[1, "http://a"].record_type == "revisit" and by[1, "http://a"].refers_to == 2 and by[2, None].record_type == "response"
    assert by[3, "http://c"].refers_to == 4 and by[4, "http://d"].payload_bytes == 0
    assert by[None, "http://e"].html == "<p>é😀</p>" and by[6, "http://g"].record_type == "response" and by[6, "http://f X: y"].payload_bytes == 150_000


def test_op9_reader_refuses_damage():
    good = warc.record(1, "http://a", b"payload", None)
    assert warc.parse(good)[1] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"payl0ad"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good + b"x"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.frames(b"\x28\xb5\x2f\xfd"))
    one = warc.leading_frame(b"") + warc.zstandard.ZstdCompressor().compress(good)
    assert list(warc.frames(one)) == [good]
    with pytest.raises(ValueError):
        list(warc.frames(one[:-4]))


def test_op9_empty_table_long_page_and_clashing_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 16)
    rows = [(i, f"http://{i}", "<i>" * (200_000 if i == 3 else 50 + i), "x", 1) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, n int")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert {i: r.html for i, r in got.items()} == {r[0]: r[2] for r in rows} and got[3].payload_bytes == 600_000
    warc.write_archives(pages.where("false"), str(tmp_path / "e"))


# -- 8 -----------------------------------------------------------------------------------------

def test_op8_equals_brute_force_and_finds_candidates(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for g in range(30):
        centre = rng.normal(size=24)
        for _ in range(12):
            rows.append((k, [float(x) for x in (centre + rng.normal(size=24) * 0.12).astype(np.float32)], g % 3))
            k += 1
    rows += [(k, rows[0][1], 0), (k + 1, None, 0), (k + 2, [0.0] * 24, 0), (k + 3, [float("nan")] * 24, 0), (k + 4, [1.0, None], 0), (k + 5, rows[0][1], None), (k + 6, [1.0], 0), (k + 7, [2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in pivots.embedding_links(df).collect()}
    good = [(i, np.array(v, np.float64), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: 0 for i, _, _ in rows}
    pairs = []
    for a, (i, v, y) in enumerate(good):
        for j, w, z in good[a + 1 :]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    assert sum(links.values()) > 200
    assert {i: r.n_links for i, r in got.items()} == links
    group = {i: i for i in links if i is not None}
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if i is not None and j is not None and group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    assert {i: r.component_id for i, r in got.items() if i is not None} == group
    assert got[None].component_id == group[0] and got[None].kept
    assert pivots.embedding_links(df.where("false")).count() == 0


def test_op8_links_rare_lengths_at_any_number_of_their_references():
    rng = np.random.default_rng(11)
    usual, other = list(rng.normal(size=(20, 24))), list(rng.normal(size=(2, 5)))
    base = rng.normal(size=8)
    rare = [base * k for k in (1.0, 2.0, 3.0)]
    held = [*usual, *rare, *other]
    for references in ([], rare[:1], rare[:2], rare):
        points = [*usual, *references]
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(held))), pa.array(["x"] * len(held)), pa.array([v.tolist() for v in held]), pa.array([1] * len(held))], names=["node", "label", "vec", "copies"])
        told = pa.Table.from_batches(pivots._describe(points, pivots.NEAREST)([rows])).to_pylist()
        run = pivots._block_pairs(0.98, pivots.NEAREST, pivots.WEIGHT)
        counts = {}
        for p in {q for r in told for q in r["near"]}:
            found = run(pa.Table.from_pylist([{**r, "pivot": p, "other": -1, "block": 0, "i": 0, "j": 0} for r in told if p in r["near"]]))
            for r in found.to_pylist():
                if r["b"] is None:
                    counts[r["a"]] = counts.get(r["a"], 0) + r["n"]
        assert counts == {20: 2, 21: 2, 22: 2}


def test_op8_candidates_weigh_shared_references_by_their_order():
    a = [[1, 2, 3, 4], [5, 6, 7, 1]]
    b = [[1, 2, 8, 9], [6, 5, 9, 2]]
    at = lambda x, y, pivot, other=-1: pivots.candidates([a[x]], [b[y]], pivot, other, 4, pivots.WEIGHT).item()
    assert at(0, 0, 1) and not at(0, 0, 2) and at(0, 0, 1, 2)  # looked at in the list of 1 only
    assert not at(1, 0, 1) and not at(0, 1, 2)  # one shared reference is too little
    assert at(1, 1, 5) and at(1, 1, 5, 6) and not at(1, 1, 6)


@pytest.mark.parametrize("limit", [(1024, 4096), (16, 40)])
def test_op8_equals_brute_force_on_many_links(spark, monkeypatch, limit):
    """Hundreds of links, ids above 2**53, scaled copies, mixed lengths, clashing columns; whole lists and
    lists that are split and cut into many blocks."""
    monkeypatch.setattr(pivots, "BLOCK", limit[0])
    monkeypatch.setattr(pivots, "LIST", limit[1])
    rng = np.random.default_rng(5)
    rows, k = [], 2**60
    for g in range(60):
        d = 16 if g % 5 else 7
        centre = rng.normal(size=d)
        for _ in range(int(rng.integers(2, 14))):
            v = (centre + rng.normal(size=d) * 0.09) * float(rng.choice([1.0, 1e-3, 250.0]))
            rows.append((k, v.tolist(), "even" if g % 2 else "odd", g, 1))
            k += int(rng.integers(1, 4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, node long, Pivot int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.embedding_links(df).collect()}
    group, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}
    pairs = []
    for x, (i, v, y, *_) in enumerate(rows):
        for j, w, z, *_ in rows[x + 1 :]:
            if y == z and len(v) == len(w) and np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    for _ in range(20):
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    assert len(pairs) > 500 and got == {i: (links[i], group[i]) for i in links}


def test_op8_counts_the_links_of_a_dense_group(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=64)
    dense = centre + rng.normal(size=(9000, 64)) * np.linalg.norm(centre) / 8 * 0.123
    v = np.concatenate((dense, rng.normal(size=(3000, 64)))).astype(np.float32)
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in pivots.embedding_links(df).collect()}
    u = pivots.unit(v)
    want = [int(n) - 1 for i in range(0, len(u), 1000) for n in (u[i : i + 1000] @ u.T >= 0.98).sum(axis=1)]
    assert sum(want) > 40_000_000
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.9999 * sum(want)


@pytest.mark.parametrize(("kind", "most"), [("topics", 0.05), ("scattered", 0.02), ("tight topics", 0.05)])
def test_op8_candidates_are_few_and_hold_the_links(kind, most):
    """One label with 40 topics (cosine 0.89 or 0.95 inside) or none, and 1000 near copies: which pairs share enough."""
    rng = np.random.default_rng(2)
    inside = {"topics": 0.89, "scattered": 0, "tight topics": 0.95}[kind]

    def near(x, cosine):
        r = rng.normal(size=x.shape)
        r = pivots.unit(r - (r * x).sum(axis=1, keepdims=True) * x)
        return cosine * x + np.sqrt(1 - cosine**2) * r

    x = near(pivots.unit(rng.normal(size=(40, 64)))[rng.integers(0, 40, 20_000)], np.sqrt(inside))
    x = np.concatenate((x, near(x[:1000], rng.uniform(0.9801, 0.995, size=(1000, 1)))))
    x = x[rng.permutation(len(x))]
    n = min(pivots.MOST_PIVOTS, int(pivots.PIVOTS * len(x) ** 0.5))
    held = pivots.unit(np.stack(pivots.spread(list(x[: pivots.LOOKED_AT * n]), n, 0.98)))
    order = pivots.permutation(x, held, pivots.NEAREST)
    told = pivots.weights(list(order), np.arange(len(held)), pivots.NEAREST)
    links = found = looked = 0
    for i in range(0, len(x), 3000):
        link, ok = x[i : i + 3000] @ x.T >= 0.98, told[i : i + 3000] @ told.T >= pivots.WEIGHT
        links, found, looked = links + link.sum(), found + (link & ok).sum(), looked + ok.sum()
    assert links >= len(x) + 2000 and found - len(x) >= 0.99 * (links - len(x))
    assert looked < most * len(x) ** 2


def test_op8_forest_joins_what_the_links_join():
    rng = np.random.default_rng(9)
    for same in (False, True):
        link = rng.random((60, 60)) < 0.02
        if same:
            link = (link | link.T) & ~np.eye(60, dtype=bool)
        found = pivots.forest(link, same)
        roots = []
        for pairs in (np.argwhere(link).tolist(), found):
            group = list(range(120))
            for x, y in pairs:
                old, new = group[y if same else 60 + y], group[x]
                group = [new if g == old else g for g in group]
            roots.append([group.index(g) for g in group])
        assert roots[0] == roots[1] and len(found) == 120 - len(set(roots[0]))
        assert all(link[r, c] for r, c in found)


# -- 2 and 6 -----------------------------------------------------------------------------------

def test_op2_held_out_accuracy(spark):
    got = queries.QUERIES["op2_language_bitmask"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = got.where("held_out").join(docs, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_op2_odd_tables(odd, empty):
    filters = langid.train(odd)
    got = {r.doc_id: r for r in langid.identify(odd, filters).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0
    assert langid.identify(odd, filters).count() == 12
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"} and langid.identify(empty, nothing).count() == 0


def test_op2_many_languages_share_one_filter():
    rng = random.Random(9)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(70)]
    word = lambda a: "".join(rng.choice(a) for _ in range(5))
    texts = [(" ".join(word(a) for _ in range(60)), f"l{i:02d}") for i, a in enumerate(alphabets) for _ in range(4)]
    filters = langid.Filters.fit(*map(list, zip(*texts, strict=True)))
    right = sum(filters.predict(" ".join(word(a) for _ in range(60)))[0] == f"l{i:02d}" for i, a in enumerate(alphabets))
    assert filters.table.shape[1] == 9 and right >= 66


def test_op6_held_out_scores(spark):
    got = queries.QUERIES["op6_toxicity_cnn"](spark, "/root/testdata/sf0.1")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = rows.score.rank()
    n1 = (rows.toxic == 1).sum()
    auc = (rank[rows.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert auc > 0.93 and 2 * hit / (rows.predicted.sum() + n1) > 0.8
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_op6_training_beats_its_start(spark):
    """The trained net against the same net without a step: its first embedding coordinate alone."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("doc_id", "text", "toxic").toPandas()
    held = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    ids = [toxicity.word_ids(t) for t in rows.text]
    y = rows.toxic.to_numpy()
    train = np.flatnonzero(~held)
    train = np.concatenate([train[y[train] == 1][:400], train[y[train] == 0][:400]])
    test = np.flatnonzero(held)[:600]
    auc = []
    for epochs in (0, toxicity.EPOCHS):
        net = toxicity.TextCnn()
        old, toxicity.EPOCHS = toxicity.EPOCHS, epochs
        try:
            net.fit([ids[i] for i in train], y[train])
        finally:
            toxicity.EPOCHS = old
        tables = net.tables()
        z = np.array([net.logit(ids[i], tables) for i in test])
        rank, pos = np.argsort(np.argsort(z)) + 1, y[test] == 1
        auc.append((rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()))
    assert auc[1] > auc[0] and auc[1] > 0.9


def test_op6_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    assert {r.predicted for r in toxicity.classify(odd, model).collect()} == {0} and toxicity.classify(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (10, 0), (3, 0), (None, 1), (9, 7)], "doc_id long, toxic int")
    got = toxicity.classify(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)


def test_op6_learns_from_every_labelled_text(spark):
    """Long texts and rows beyond any number count: odds, rounds and thresholds against plain Python."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [(i, " ".join([word() for _ in range(20000 if i % 40 == 0 else 12)] + (["poison"] if i % 4 == 0 else []))) for i in range(5000)]
    assert any(len(t) > 64 << 10 for _, t in texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id long, toxic int")
    stored = toxicity.training_texts(docs, labels, "doc_id", "text", "toxic", 900)
    assert stored.count() == 5000 and {r.part for r in stored.select("part").distinct().collect()} == set(range(6))
    want = np.zeros((2, toxicity.BUCKETS), int)
    for i, t in texts:
        want[int(i % 4 == 0), np.unique(toxicity.word_ids(t))] += 1
    assert (toxicity.bucket_counts(stored) == want).all()

    start, model = toxicity.TextCnn(), toxicity.TextCnn()
    toxicity.one_round(stored, model, (0.5, 2.0))
    rows, begin, by, weight = stored.collect(), toxicity._flat(start), 0.0, 0
    for p in range(6):
        own = [(toxicity._unpacked(bytes(r.ids)), r.y, (0.5, 2.0)[r.y]) for r in rows if r.part == p]
        part = toxicity.TextCnn()
        steps = toxicity.Steps(part)
        for k in range(0, len(own), toxicity.BATCH):
            steps.take(own[k : k + toxicity.BATCH])
        moved = np.concatenate([steps.moved, np.ones(len(begin) - toxicity.BUCKETS, bool)])
        by, weight = by + (toxicity._flat(part) - begin).astype(float) * len(own), weight + moved * len(own)
    assert np.allclose(toxicity._flat(model), begin + by / np.maximum(weight, 1)[:, None], atol=1e-5)

    seen = toxicity.logit_histogram(stored, model).toPandas()
    z = np.array([model.logit(toxicity._unpacked(bytes(r.ids)), model.tables()) for r in rows])
    assert seen.n.sum() == 5000 and abs((seen.n * (seen.bin + 0.5) / toxicity.BINS).sum() - z.sum()) < 5000 / toxicity.BINS


def test_op6_long_texts_alone_make_a_model(spark):
    texts = [(i, ("poison " if i < 30 else "bread ") * 12000) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i, _ in texts], "doc_id long, toxic int")
    got = toxicity.classify(docs, toxicity.train(docs, labels)).collect()
    assert {r.doc_id for r in got if r.predicted} == set(range(30))


# -- pipeline ----------------------------------------------------------------------------------

def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns
        seen.append((name, docs.count(), out.count()))
        docs = out
    assert seen[0][2] < seen[0][1] and seen[1][2] < seen[1][1]
    assert minhash.near_duplicates(docs).where("not kept").count() == 0
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert mixed.columns == columns and mixed.count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, mixed, SF).count() > 0


def test_pipeline_near_dedup_drops_pairs_from_080_on(spark):
    rng = random.Random(12)
    rows, expected = [], set()
    for g in range(20):
        words = prose(rng, 200).split()
        edits = (4, 5)[g % 2]
        copy = list(words)
        for k in range(edits):
            copy[20 + 30 * k] = f"edit{k}"
        a, b = plain_shingles(" ".join(words)), plain_shingles(" ".join(copy))
        jaccard = len(a & b) / len(a | b)
        assert 0.8 <= jaccard < 0.85 if edits == 4 else jaccard < 0.8
        rows += [(2 * g, " ".join(words), "en", "a", 1), (2 * g + 1, " ".join(copy), "en", "a", 1)]
        expected |= {2 * g} if edits == 4 else {2 * g, 2 * g + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == expected


def test_pipeline_runs_on_odd_and_empty_tables(spark, odd, tmp_path):
    """The whole run, over nulls, repeated rows and ids, odd texts and clashing column names."""
    good = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 12").select((F.col("doc_id") + 2**60).alias("doc_id"), "text", "lang", "source", "n_chars", F.lit("k").alias("Text_Key"), F.lit(1).cast("long").alias("_h"))
    for name, docs in (("odd", odd.union(good)), ("empty", odd.where("false"))):
        (tmp_path / name).mkdir()
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(out) == (name == "odd")
        bins: dict = {}
        for r in out:
            assert (r.bin_id, r.source) not in bins
            bins[r.bin_id, r.source] = r
        assert {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()}


def test_shingle_sets_equal_plain_ones():
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 6, 300):
        text = prose(rng, n, ["a", "B", "ß", "É", "c"]) if n else " \n"
        assert len(shingles.shingle_set(text)) == len(plain_shingles(text))


def test_components_of_random_graphs(spark):
    from textlake.llm.components import components

    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (None, 5), (7, 7)]
    group = {x: x for e in edges for x in e if x is not None}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and b is not None and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: c for x, c in group.items() if c != x}
    assert components(df.where("false")).count() == 0
