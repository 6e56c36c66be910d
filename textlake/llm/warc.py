"""Operator 9, WARC archives in Zstandard frames with a shared dictionary.

A file starts with a skippable frame (0x184D2A5D) that holds the dictionary; then one frame is one
record.  Spark's text sink writes the frames, with an empty skippable frame as its line separator, so
files are valid Zstandard streams on any file system that Spark reaches, and a lost task leaves
nothing behind.  The reader loads the dictionary, decodes frame by frame and checks version line,
required fields, the block's length, the record's end, and payload length and digest.

Pages with equal payloads: the one with the largest page_id is the response, the others are revisit
records that name it.  Only digests are grouped; pages are joined to digests that occur twice or more.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import materialize, new_path, slices, small, table

VERSION = b"WARC/1.1"
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = (0x184D2A50).to_bytes(4, "little") + bytes(4)
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on at most so many pages of at most so many bytes each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32 << 10, 64 << 10
#: Payload bytes that one archive is planned for.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
CHUNK = 16 << 10


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds no payload, but its digest and length."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-X-Payload-Length", str(len(payload)))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, payload) of a record; raises ValueError if it is not sound."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION or not gap:
        raise ValueError("not a WARC/1.1 record")
    fields = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise ValueError(f"bad field {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as Content-Length says")
    payload = rest[:length].partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response":
        if len(payload) != int(fields["warc-x-payload-length"]) or fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
            raise ValueError("the payload does not match its length and digest")
    elif payload or fields["warc-type"] != "revisit" or "warc-refers-to" not in fields:
        raise ValueError("neither a response nor a revisit")
    return fields, payload


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each from its own frame."""
    dictionary, at = None, 0
    while at < len(content):
        magic = int.from_bytes(content[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(content[at + 4 : at + 8], "little")
            if at == 0:
                if content[:4] != DICTIONARY_MAGIC:
                    raise ValueError("the archive has no dictionary in front")
                raw = content[8 : 8 + size]
                if raw[:4] == zstandard.FRAME_HEADER:
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
            at += 8 + size
            continue
        if at == 0:
            raise ValueError("the archive has no dictionary in front")
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        parts = []
        while not one.eof:
            if at >= len(content):
                raise ValueError("a frame has no end")
            parts.append(one.decompress(content[at : at + CHUNK]))
            at = min(at + CHUNK, len(content))
        at -= len(one.unused_data)
        yield b"".join(parts)


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary; empty if the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed


def _write(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True).compress
        first = True
        for batch in slices(batches):
            ids, urls, texts, refers = (c.to_pylist() for c in batch.columns)
            out = [compress(record(i, u, (t or "").encode("utf-8", "replace"), r)) for i, u, t, r in zip(ids, urls, texts, refers, strict=True)]
            if first and out:
                out.insert(0, leading_frame(dictionary))
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["raw"])

    return run


def _page_of(uri: str) -> int | None:
    value = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for raw in frames(content.as_py()):
                fields, payload = parse(raw)
                refers = fields.get("warc-refers-to")
                rows.append((_page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), int(fields["warc-x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"),
                             fields["warc-type"], _page_of(refers) if refers else None, payload.decode("utf-8") if fields["warc-type"] == "response" else None))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Writes a record for every row of ``pages``.

    A null html is an empty payload; empty payloads are equal to each other (``least_bytes`` 0).
    Rows without an id are responses, and nothing refers to them.  Rows that repeat the largest id of
    a payload are all responses.  A null url leaves the target out.  An empty table writes no archive.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    sized = materialize(rows.select("id", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").cast("long").alias("n")), "digests")
    sample = sized.where(F.col("n").between(1, SAMPLE_BYTES)).select("id", F.xxhash64("id", F.lit(3)).alias("h")).orderBy("h", "id").limit(SAMPLE_PAGES)
    sample = F.broadcast(sample.select("id"))  # at most SAMPLE_PAGES rows
    texts = [r[0].encode("utf-8", "replace") for r in rows.join(sample, "id").where(F.octet_length("html") <= SAMPLE_BYTES).select("html").limit(SAMPLE_PAGES).collect()]
    dictionary = dictionary_of(sorted(texts))
    groups = sized.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.max("id").alias("last"), F.count("id").alias("c")).where("c > 1").select("sha", "last")
    groups = small(materialize(groups, "repeated", sized.count()))
    total = sized.agg(F.sum("n")).first()[0] or 0
    keyed = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).join(groups, "sha", "left")
    keyed = keyed.select("id", "url", "html", F.when(F.col("last") != F.col("id"), F.col("last")).alias("refers"))
    keyed = keyed.repartition(max(1, -(-total // ARCHIVE_BYTES)))
    raw = keyed.mapInArrow(_write(dictionary), "raw binary").select(F.col("raw").cast("string").alias("raw"))
    raw.write.option("lineSep", SEPARATOR.decode("ascii")).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html); html is null for
    revisits.  An archive is read whole by one task and is about ARCHIVE_BYTES before compression."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path)
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, path).drop("url", "html")


#: DuckDB has SHA-1 in hexadecimal; base32 takes five bits at a time.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT sha, max(page_id) AS last FROM p GROUP BY sha),
b AS (SELECT sha, list_reduce(list_transform(range(1, 41), lambda i: format('{:04b}', CAST(strpos('0123456789abcdef', sha[i]) - 1 AS INTEGER))), lambda a, x: a || x) AS bits FROM g),
d AS (SELECT sha, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_transform(range(1, 6), lambda k: (CASE WHEN bits[i * 5 + k] = '1' THEN 1 ELSE 0 END) * (1 << (5 - k))), lambda a, x: a + x) AS INTEGER), 1)), '') AS digest FROM b)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN g USING (sha) JOIN d USING (sha)"""
