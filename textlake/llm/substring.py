"""Operator 7, substring dedup by paragraph MinHash banding.

Two kinds of paragraphs, both over five-word shingles, go through bands, verification on the words and
components:

* *Text paragraphs*: a line of MIN_LINE words or more; shorter lines that follow each other are put
  together and cut before lines whose hash is the least within REACH lines, so hard-wrapped text has
  paragraphs too.  Bands of ROWS MinHash rows are tuned for high recall at the threshold; colliding
  paragraphs are confirmed by exact Jaccard, and links make components.
* *Sliding paragraphs*: every run of SLIDE shingles is one, and its MinHash is the least shingle of the
  run.  Runs that follow each other mostly share their least shingle, so only distinct ones are kept,
  one in (SLIDE + 1) / 2 words.  The band is that shingle and those behind it, BAND words.  Two texts
  that share a passage of SLIDE + BAND - 1 = 47 words in any surroundings surely share a band.
  Colliding paragraphs are compared word by word with that of the smallest doc_id and extended on both
  sides as far as the words are equal; bands that one removed passage joins make a component.

The smallest doc_id of a class keeps its first paragraph.  Others are removed: text paragraphs as they
are, passages as far as they were extended, if they have min_run words or more.  Sliding paragraphs are
compared across documents only.  What is not caught: repeats in blocks of under MIN_LINE words
(boilerplate lines of a few words) and equal passages of under BAND words.

Hashes find the live buckets; texts are read once more, of documents with a live bucket only, and of
these only the live paragraphs are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import TEXT_ROWS, discard, free_name, materialize, slices, small, table
from textlake.llm.components import components
from textlake.llm.neardup import near_classes
from textlake.llm.shingles import SHINGLE, U, band_hashes, byte_words, mix, seeds, shingle_hashes, word_hashes

MIN_LINE, REACH = 16, 4
SLIDE, BAND, MIN_RUN = 32, 16, 24
PERCENT = 80
#: Members of one band's class that one task compares with the kept one.
PART = 4096


def tune(percent: int, miss: float = 1e-3, stray: float = 0.5) -> tuple[int, int]:
    """(rows, bands): the fewest bands with which a pair at the threshold shares none with at most
    ``miss`` and a pair at 0.3 shares one with at most ``stray``."""
    s, found = percent / 100, []
    for rows in range(1, 9):
        bands = next(b for b in range(1, 1000) if (1 - s**rows) ** b <= miss)
        if 1 - (1 - 0.3**rows) ** bands <= stray:
            found.append((bands, rows))
    return min(found)[::-1]


ROWS, BANDS = tune(PERCENT)
_A, _B = seeds(ROWS * BANDS, 301) | U(1), seeds(ROWS * BANDS, 307)
_POWER = U(0x9E3779B97F4A7C15)
_PARAGRAPH = np.int64(0x5BD1E995)
#: Places of the shingles that cover the words of a band.
_COVER = (*range(0, BAND - SHINGLE, SHINGLE), BAND - SHINGLE)
_PLACE = seeds(len(_COVER), 313) | U(1)


def _minhash(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[run, hash function] minima over the runs that begin at ``starts``."""
    out = np.empty((len(starts), len(_A)), U)
    for k in range(len(_A)):
        out[:, k] = np.minimum.reduceat(shingles * _A[k] + _B[k], starts)
    return out


def bands_of(members: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return band_hashes(_minhash(members, np.array([0]))[0], BANDS, 317)


def _run_bands(shingles: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[run, band] of the runs of n words from ``start`` on, as ``bands_of`` of their shingles."""
    length = n - SHINGLE + 1
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(first - start, length)
    rows = _minhash(shingles[at], first).reshape(len(start), BANDS, ROWS)
    total = np.broadcast_to(seeds(BANDS, 317), (len(start), BANDS))
    for k in range(ROWS):
        total = mix(total ^ rows[:, :, k]) + U(k)
    return mix(total).view(np.int64)


def _sequence_hashes(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each run's word sequence."""
    first = np.cumsum(n) - n
    local = np.arange(int(n.sum())) - np.repeat(first, n)
    power = np.cumprod(np.full(int(n.max(initial=0)) + 1, _POWER, U))
    return mix(np.add.reduceat(words[local + np.repeat(start, n)] * power[local], first) + n.astype(U)).view(np.int64)


def blocks(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, n) in words of a text's paragraphs, from its words and the words of each line."""
    start = np.cumsum(size) - size
    short = (size > 0) & (size < MIN_LINE)
    begins = np.ones(len(size), bool)
    begins[1:] = ~(short[1:] & short[:-1])
    at = np.flatnonzero(short)
    if len(at) > 2 * REACH:
        h = np.full(len(size), ~U(0))
        h[at] = _sequence_hashes(words, start[at], size[at]).view(U)
        pad = np.concatenate((np.full(REACH, ~U(0)), h, np.full(REACH, ~U(0))))
        low = short.copy()
        for k in range(1, REACH + 1):
            low &= (h < pad[REACH - k : REACH - k + len(h)]) & (h <= pad[REACH + k : REACH + k + len(h)])
        low &= ~begins
        at = np.flatnonzero(begins | low)
        n = np.add.reduceat(size, at)
        few = n < MIN_LINE  # a cut that leaves too few words on either side is none
        few[1:] |= few[:-1]
        begins |= low
        begins[at[few & low[at]]] = False
    first = np.flatnonzero(begins)
    n = np.add.reduceat(size, first)
    long = n >= MIN_LINE
    return start[first][long], n[long]


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of every run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = least(x[:-done], x[done:])
        done *= 2
    return least(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, band) of the sliding paragraphs' distinct least shingles; of equal least shingles that
    stand next to each other the first."""
    n = len(shingles) - (BAND - SHINGLE)  # places with a whole band behind them
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, width = mix(shingles[:n]), min(SLIDE, n)
    low = _slide(h, width, np.minimum)
    edge = np.zeros(width - 1, U)
    chosen = _slide(np.concatenate((edge, low, edge)), width, np.maximum) == h
    chosen[1:] &= h[1:] != h[:-1]
    at = np.flatnonzero(chosen)
    total = np.zeros(len(at), U)
    for off, place in zip(_COVER, _PLACE, strict=True):
        total = mix(total + shingles[at + off] * place)
    return at, total.view(np.int64)


def units(text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, shingles, paragraph starts, paragraph lengths, band places, bands); in words."""
    lines = [byte_words(x) for x in text.split("\n")] if text else []
    plain = [w for x in lines for w in x]
    none = np.zeros(0, np.int64)
    if len(plain) < min(MIN_LINE, BAND):
        return plain, np.zeros(0, U), none, none, none, none
    words = word_hashes(plain)
    with np.errstate(over="ignore"):
        shingles = shingle_hashes(words)
        start, n = blocks(words, np.array([len(x) for x in lines], np.int64))
        return plain, shingles, start, n, *anchors(shingles)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rk, id, at, bucket) lists: of paragraphs with at < 0 (-1 - start), of bands with at >= 0."""
    for batch in slices(batches):
        ats, buckets = [], []
        with np.errstate(over="ignore"):
            for text in batch.column(2):
                _, shingles, start, n, place, band = units(text.as_py())
                own = _run_bands(shingles, start, n) if len(start) else np.zeros((0, BANDS), np.int64)
                ats.append(np.concatenate((np.repeat(-1 - start, BANDS), place)))
                buckets.append(np.concatenate((own.reshape(-1), band)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ats, _INTS), pa.array(buckets, _LONGS)], names=["rk", "id", "at", "bucket"])


_UNITS = "rk long, id long, at int, n int, size int, lead int, fp long, body string, bands array<long>, keeper long, part int, head boolean"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), _LONGS, pa.int64(), pa.int32(), pa.bool_())


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (rk, id, wanted, text) the live paragraphs: their words, and for bands the words around, ``lead``
    in front, as far as a shared passage may reach beyond its last band."""
    for batch in slices(batches):
        out: list[tuple] = []
        for rk, id_, wanted, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
            plain, shingles, start, n, place, band = units(text.as_py())
            text_of = lambda a, b: b" ".join(plain[max(a, 0) : b]).decode("utf-8", "surrogatepass")  # noqa: B023, E731
            asked = {w["at"]: w for w in wanted}
            with np.errstate(over="ignore"):
                own = np.array([-1 - a in asked for a in start.tolist()], bool)
                if own.any():
                    start, n = start[own], n[own]
                    fps = _sequence_hashes(word_hashes(plain), start, n) ^ _PARAGRAPH
                    out += [(rk, id_, -1 - a, k, len(np.unique(shingles[a : a + k - SHINGLE + 1])), 0, f, text_of(a, a + k), b, None, 0, False) for a, k, f, b in zip(start.tolist(), n.tolist(), fps.tolist(), _run_bands(shingles, start, n), strict=True)]
            all_ = place.tolist()
            for k, at in enumerate(all_):
                w = asked.get(at)
                if w is None or (w["keeper"] == id_ and not w["head"]):
                    continue
                # a neighbour that continues this match in the same kept document covers what lies beyond it
                near = [asked.get(x) for x in (all_[k - 1] if k else None, all_[k + 1] if k + 1 < len(all_) else None)]
                goes_on = [x is not None and not w["head"] and (x["keeper"], x["at"] - x["k_at"]) == (w["keeper"], at - w["k_at"]) for x in near]
                first = all_[k - 1] if goes_on[0] else max(0, at - SLIDE)
                end = BAND + (all_[k + 1] if goes_on[1] else at + SLIDE)
                row = (rk, id_, at, BAND, 0, at - first, int(band[k]), text_of(first, end), None, w["keeper"])
                parts = range(w["parts"]) if w["head"] else [(rk ^ at) % w["parts"]]
                out += [(*row, p, w["head"]) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_TYPES)], names=[x.split(" ")[0] for x in _UNITS.split(", ")])


def extend(a: list[str], i: int, b: list[str], j: int) -> tuple[int, int] | None:
    """(words in front of i, words from i on) that are equal in both around a band; None if the band's
    own words differ."""
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    if n < BAND:
        return None
    left = 0
    while left < i and left < j and a[i - left - 1] == b[j - left - 1]:
        left += 1
    return left, n


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in the order of (fp, part), the kept one first: verified and extended runs."""
    of, kept, kept_lead = None, [], 0
    for batch in slices(batches):
        out: list[tuple] = []
        for fp, part, head, rk, id_, at, lead, body, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if head:
                of, kept, kept_lead = (fp, part), body.split(" "), lead
            elif of == (fp, part):
                found = extend(body.split(" "), lead, kept, kept_lead)
                if found:
                    out.append((rk, id_, at - found[0], sum(found), fp, keeper))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["rk", "id", "first_word", "n_words", "c", "keeper"])


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _passage_spans(bands: DataFrame, min_run: int) -> DataFrame:
    """(rk, id, first_word, n_words, c, keeper) of removed passages, overlapping ones put together."""
    rows = bands.repartition("fp", "part").sortWithinPartitions("fp", "part", F.desc("head")).select("fp", "part", "head", "rk", "id", "at", "lead", "body", "keeper")
    runs = materialize(rows.mapInArrow(_passages, "rk long, id long, first_word int, n_words int, c long, keeper long"), "runs", bands.count(), TEXT_ROWS)
    each = runs.groupBy("rk", "id").agg(F.array_sort(F.collect_set(F.struct("first_word", "n_words", "c", "keeper"))).alias("s"))
    # a fold joins runs that overlap: (first, end, smallest keeper, bands)
    end = lambda x: x["first_word"] + x["n_words"]
    one = lambda x: F.array(F.struct(x["first_word"].alias("first"), end(x).alias("end"), x["keeper"].alias("keeper"), F.array(x["c"]).alias("bands")))
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["end"], end(x)).alias("end"), F.least(last(a)["keeper"], x["keeper"]).alias("keeper"), F.concat(last(a)["bands"], F.array(x["c"])).alias("bands"))))
    start = F.expr("cast(array() as array<struct<first:int,end:int,keeper:bigint,bands:array<bigint>>>)")
    merged = F.aggregate("s", start, lambda a, x: F.when((F.size(a) > 0) & (last(a)["end"] >= x["first_word"]), grown(a, x)).otherwise(F.concat(a, one(x))))
    merged = materialize(each.select("rk", "id", F.inline(merged)).where(F.col("end") - F.col("first") >= min_run).withColumn("c", F.array_min("bands")), "passages", runs.count())
    same = components(merged.select("c", F.explode("bands").alias("b")).where("c <> b").distinct(), "b", "c")
    out = merged.join(same, merged.c == same.node, "left")
    return out.select("rk", "id", F.col("first").alias("first_word"), (F.col("end") - F.col("first")).alias("n_words"), F.coalesce("component", "c").alias("c"), "keeper")


def _paragraph_spans(paragraphs: DataFrame, percent: int) -> DataFrame:
    """(rk, id, first_word, n_words, c, keeper) of removed text paragraphs."""
    nodes = materialize(paragraphs.groupBy("fp").agg(F.first("size").cast("long").alias("n"), F.first("bands").alias("bands")), "nodes", paragraphs.count())
    texts_of = lambda fps: paragraphs.select("fp", "body").join(fps, "fp").dropDuplicates(["fp"])
    near = near_classes(nodes.select(F.explode("bands").alias("bucket"), "fp", "n"), texts_of, percent, bands_of)
    rows = paragraphs.select("rk", "id", (-1 - F.col("at")).alias("first_word"), F.col("n").alias("n_words"), "fp").join(near.toDF("fp", "_c"), "fp", "left").withColumn("c", F.coalesce("_c", "fp"))
    rows = materialize(rows.drop("fp", "_c"), "paragraphs", paragraphs.count())
    kept = rows.where("id is not null").groupBy("c").agg(F.min(F.struct("id", "first_word")).alias("k"))
    kept = materialize(kept.select("c", F.col("k.id").alias("keeper"), F.col("k.first_word").alias("k_first")), "keepers", rows.count())
    gone = rows.join(kept, "c").where("id is null or id <> keeper or first_word <> k_first")
    return gone.select("rk", "id", "first_word", "n_words", "c", "keeper")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_run: int = MIN_RUN) -> DataFrame:
    """The removed paragraphs: rk long (row key), id, kind (0 text paragraph, 1 passage), first_word and
    n_words (of the row's words), cluster_id long, kept_id (the document that keeps the paragraph).

    Null and blank texts have no paragraphs.  A row without an id never keeps a paragraph for others;
    if no row of a class has an id, nothing of it is removed.  Rows that repeat an id are one document:
    passages are not removed from one for the other, paragraphs only behind the first place.  Ties
    go to the smaller id and place.  An empty table gives an empty one.  Other columns are not read.
    """
    read = docs.select(_row_key(id_col, text_col).alias("rk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    cut = materialize(read.mapInArrow(_cut, "rk long, id long, at array<int>, bucket array<long>"), "cut")
    slots = cut.select("rk", "id", F.inline(F.arrays_zip("at", "bucket")))
    all_ = cut.agg(F.coalesce(F.sum(F.size("bucket")), F.lit(0))).first()[0]
    live = materialize(slots.groupBy("bucket").count().where("count > 1").select("bucket"), "live", all_ // 2)
    shared = materialize(slots.join(live.hint("merge"), "bucket"), "shared", all_)
    most = shared.count()
    discard(cut)
    kept = shared.where("at >= 0 and id is not null").groupBy("bucket").agg(F.min(F.struct("id", "rk", "at")).alias("k"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    kept = materialize(kept.select("bucket", F.col("k.id").alias("keeper"), F.col("k.rk").alias("k_rk"), F.col("k.at").alias("k_at"), "parts"), "keepers", most)
    head = (F.col("rk") == F.col("k_rk")) & (F.col("at") == F.col("k_at"))
    asked = shared.where("at >= 0").join(kept, "bucket").select("rk", "at", "keeper", "k_at", "parts", head.alias("head"))
    asked = asked.union(shared.where("at < 0").select("rk", "at", F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(1), F.lit(False)))
    wanted = materialize(asked.groupBy("rk").agg(F.collect_set(F.struct("at", "keeper", "k_at", "parts", "head")).alias("wanted")), "wanted", most)
    found = read.join(wanted.hint("merge"), "rk").select("rk", "id", "wanted", "body").mapInArrow(_live, _UNITS)
    found = materialize(found, "units", most, TEXT_ROWS)
    discard(live, shared, kept, wanted)
    spans = [_paragraph_spans(found.where("at < 0"), percent), _passage_spans(found.where("at >= 0"), min_run)]
    both = [s.select("rk", "id", F.lit(k).alias("kind"), "first_word", "n_words", F.col("c").alias("cluster_id"), F.col("keeper").alias("kept_id")) for k, s in enumerate(spans)]
    return both[0].union(both[1])


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans (first, count) and the blanks behind each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    keep = np.ones(len(raw), bool)
    for first, count in spans:
        end = starts[first + count] if first + count < len(starts) else len(raw)
        keep[starts[first] : end] = False
    return raw[keep].tobytes().decode("utf-8", "surrogatepass")


def _clean(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = [cut_text(t, [(s["first_word"], s["n_words"]) for s in x]) if x else t for t, x in zip(batch.column(at).to_pylist(), spans, strict=True)]
            cols = batch.columns[:-1]
            cols[at] = pa.array(texts, pa.string())
            left = pa.array([not x or bool(t.strip(" \t\n\x0b\x0c\r")) for t, x in zip(texts, spans, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1]).filter(left)

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without removed paragraphs; rows that lose their last word go, others keep their
    columns, and rows without removed paragraphs pass as they are."""
    gone = repeats(docs, id_col, text_col, percent)
    spans = materialize(gone.groupBy("rk").agg(F.collect_set(F.struct("first_word", "n_words")).alias("_spans")), "spans", docs.count())
    rk, sp = free_name(docs, "_rk"), free_name(docs, "_spans_of")
    joined = docs.withColumn(rk, _row_key(id_col, text_col)).join(small(spans.toDF("_of", sp)), F.col(rk) == F.col("_of"), "left").drop(rk, "_of")
    return joined.mapInArrow(_clean(docs.columns.index(text_col)), docs.schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    kind = F.when(F.col("kind") == 0, "paragraph").otherwise("passage")
    return found.select(F.col("id").alias("doc_id"), kind.alias("kind"), "first_word", "n_words", "cluster_id", F.col("kept_id").alias("kept_doc_id")).distinct()
