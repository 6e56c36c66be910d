"""Operator 5, token ids in frequency-ranked variable-length coding with separate control bytes.

File format (little-endian).  A file is a run of blocks, each followed by one line feed:

    magic "TLK1" | u32 shard | u32 block | u32 documents | u64 ids | u64 data bytes
    documents x i64 doc_id | documents x u8 (1: the doc_id is null) | documents x u32 ids
    u16 n | n x u32 rank table, only in a shard's first block (else n = 0)
    control bytes of all documents, ceil(ids / 4) each | data bytes

An id is written as its rank in the order of corpus frequency, so frequent ids take one byte.  Each
rank takes 1 to 4 data bytes, low byte first; two bits of a control byte hold that length less one,
the first id in the lowest bits.  Control bytes are decoded by a table of 256 rows of four lengths.

Shards are ranges of doc_id in ascending order, nulls first; blocks follow each other in a shard.
Spark's text sink writes the files (bytes pass through it unchanged), so any file system that Spark
reaches will do and a lost task leaves nothing behind.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.llm.common import materialize, new_path, slices, small, table

END_ID = 2
MAGIC = b"TLK1"
HEAD = np.dtype([("magic", "S4"), ("shard", "<u4"), ("block", "<u4"), ("docs", "<u4"), ("ids", "<u8"), ("data", "<u8")])
#: Bytes of coded ids that one shard is planned for, and ids that one block holds at least.
SHARD_BYTES, BLOCK_IDS = 16 << 20, 1 << 19
#: Shards whose ids are summed up in one task.
RUN = 1024
#: Words, and pieces of words, whose ids a Python worker remembers.
REMEMBERED, PIECES = 400_000, 700_000

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = length - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] < length[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of documents that follow each other; each has its own control bytes.  The lengths of
    four values at a time come from a table by control byte; what a last byte has over is left out."""
    length = _LENGTHS[control].reshape(-1)
    counts = np.asarray(counts, np.int64)
    over = -counts % 4
    if over.any():
        ends = np.cumsum(counts + over)
        drop = np.concatenate([np.arange(e - o, e) for e, o in zip(ends.tolist(), over.tolist(), strict=True) if o])
        length = np.delete(length, drop)
    if int(length.sum(dtype=np.int64)) != len(data):
        raise ValueError("control bytes and data disagree")
    out = np.zeros((len(length), 4), np.uint8)
    out[np.arange(4, dtype=np.uint8)[None, :] < length[:, None]] = data
    return out.view("<u4").reshape(-1)


def block_bytes(shard: int, block: int, rows: list[tuple], ranks: np.ndarray | None) -> bytes:
    """A block of rows (doc_id, ids, control bytes, data bytes)."""
    ids, counts, control, data = zip(*rows, strict=True)
    head = np.array([(MAGIC, shard, block, len(rows), sum(counts), sum(map(len, data)))], HEAD).tobytes()
    known = np.array([0 if x is None else x for x in ids], "<i8").tobytes() + np.array([x is None for x in ids], "u1").tobytes()
    rank_table = b"\0\0" if ranks is None else np.uint16(len(ranks)).tobytes() + ranks.astype("<u4").tobytes()
    return b"".join((head, known, np.array(counts, "<u4").tobytes(), rank_table, *control, *data))


def read_blocks(content: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(shard, block, doc ids, ids of each document, token ids) of each block of a file."""
    at, ranks = 0, np.zeros(0, "<u4")

    def take(kind, n):
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += out.nbytes
        return out

    while at < len(content):
        head = take(HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a block")
        docs, n = int(head["docs"]), int(head["ids"])
        ids, null, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
        if size := int(take("<u2", 1)[0]):
            ranks = take("<u4", size)
        control = take("u1", int((-(-counts.astype(np.int64) // 4)).sum()))
        values = decode(control, take("u1", int(head["data"])), counts)
        if content[at : at + 1] != b"\n":
            raise ValueError("block without end")
        at += 1
        yield int(head["shard"]), int(head["block"]), [None if x else int(i) for i, x in zip(ids, null, strict=True)], counts, ranks[values]


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The normalizers and pre-tokenizers (fixed values of this vocabulary) under which no token spans two
#: words and simple words are what ``_SIMPLE`` says.  Others are encoded text by text by the library.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that are Latin letters with marks behind them: two pieces for this vocabulary's pre-tokenizer,
#: which no normalization but lower case can change.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*$%&#]*)")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves,
    the others follow from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def by_words(tokenizer) -> bool:
    """Whether the tokenizer's rules are those that let words be encoded one by one."""
    spec = json.loads(tokenizer.to_str())
    normal, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    parts = pre.get("pretokenizers", [{}])
    split = parts[0].get("pattern") == {"Regex": _SPLIT} and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
    rest = [(p["type"], p.get("add_prefix_space"), p.get("use_regex")) for p in parts[1:]] == [("ByteLevel", False, False)]
    return bool([n["type"] for n in normal.get("normalizers", [])] == _NORMALIZERS and split and rest and spec["post_processor"] is None)


class _Words(dict):
    """Ids of words; a word that is not known is learned when it is met.  At REMEMBERED words all are forgotten."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        self.pieces: dict[str, bytes] = {"": b""}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode("utf-8", "replace")
        m = _SIMPLE.fullmatch(text)
        if m:
            found = self._piece(m[1].lower()) + self._piece(m[2])
        else:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        self[word] = found
        return found

    def _piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) >= PIECES:
                self.pieces = {"": b""}
            mapped = text if text.isascii() else "".join([self.letters[b] for b in text.encode()])
            found = self.pieces[text] = array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return found


class Encoder:
    """Ids of whole texts.  A vocabulary that drops white space has no token that spans two words, so each
    word is encoded once: simple words by the library's model, piece by piece, others by the whole
    library.  For any other tokenizer the library encodes whole texts."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.by_words = by_words(self.tokenizer)
        self.known = _Words(self.tokenizer)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids as unsigned 16-bit numbers, the end id last."""
        if not self.by_words:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array([*x.ids, END_ID], "<u2").tobytes() for x in found]
        get, end = self.known.__getitem__, np.array([END_ID], "<u2").tobytes()
        return [b"".join(map(get, t.encode("utf-8", "replace").split())) + end if t else end for t in texts]


@cache
def _encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path)


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in slices(batches):
            ids = encoder(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _encoder.cache_clear()  # a worker that has encoded needs its words no more
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.bincount(np.frombuffer(x.as_py(), "<u2"), minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["token", "n"])


def _code(ranks: np.ndarray):
    """(doc_id, n, control, data) of (doc_id, ids): what is shuffled is what the files hold."""
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoder.cache_clear()
        for batch in slices(batches):
            ids = [np.frombuffer(x.as_py(), "<u2") for x in batch.column(1)]
            both = [encode(rank_of[x]) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array([c for c, _ in both], pa.binary()), pa.array([d for _, d in both], pa.binary())], names=["doc_id", "n", "control", "data"])

    return run


def _write(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, held = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                held += row[1]
                if held >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([block_bytes(shard, block, rows, None if block else ranks)], pa.binary())], names=["raw"])
                    rows, held, block = [], 0, block + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([block_bytes(shard, block, rows, None if block else ranks)], pa.binary())], names=["raw"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _encoder.cache_clear()
    names = ["shard", "block", "place", "doc_id", "n_tokens", "ids_crc32"]
    for batch in batches:
        for content in batch.column(0):
            for shard, block, ids, counts, tokens in read_blocks(content.as_py()):
                ends = np.cumsum(counts, dtype=np.int64)
                raw = tokens.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(ids)
                cols = [np.full(n, shard), np.full(n, block), np.arange(n), pa.array(ids, pa.int64()), counts.astype(np.int64), np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text (null: empty), each with the end id behind it, and writes shards to ``path``.

    Rows stand in ascending order of id, nulls first, rows of one id in an order of their bytes.
    An empty table writes no shard.
    """
    coded = materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_tokenize(tokenizer_path), "doc_id long, ids binary"), "ids")
    counts = coded.select("ids").mapInArrow(_count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "token").collect()  # at most one for each entry of the vocabulary
    ranks = np.array([r.token for r in rows], np.uint32)
    shards = max(1, -(-sum(r.n for r in rows) * 3 // 2 // SHARD_BYTES))
    small_ids = coded.mapInArrow(_code(ranks), "doc_id long, n int, control binary, data binary")
    # rows of one id, and those without one, may fill several shards: the data bytes' hash orders them
    ordered = small_ids.withColumn("_h", F.xxhash64("data")).repartitionByRange(shards, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "n", "data").drop("_h")
    raw = ordered.mapInArrow(_write(ranks), "raw binary").select(F.col("raw").cast("string").alias("raw"))
    raw.write.option("lineSep", "\n").text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shards in ``path``; ``start`` counts all ids in
    front of a document: those of earlier shards and of its own.  Shards are summed up in runs of RUN
    first, so what one task orders is a row for each RUN shards, 16 GB of coded ids."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(_read, "shard int, block int, place long, doc_id long, n_tokens long, ids_crc32 long"), "read")
    before = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = materialize(before.withColumn("run", F.floor(F.col("shard") / RUN)), "shards")
    runs = before.groupBy("run").agg(F.sum("n").alias("k"))
    runs = runs.select("run", (F.sum("k").over(Window.orderBy("run")) - F.col("k")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("run").orderBy("shard")) - F.col("n")
    before = before.withColumn("inside", inside).join(F.broadcast(materialize(runs, "runs")), "run").select("shard", (F.col("ahead") + F.col("inside")).alias("base"))
    own = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    out = rows.withColumn("own", own).join(small(materialize(before, "bases")), "shard")
    return out.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, path)
