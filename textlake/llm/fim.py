"""Operator 11, fill-in-middle transformation as a pyarrow.compute pipeline.

A text is a row of units, runs of ASCII letters or single other characters.  Per batch: a byte that
UTF-8 never holds is put before each unit and the texts are split at it into list arrays; these are
flattened with the index of their parent; a unit's ordinal decides its role (prefix, middle, suffix);
the units of a role are filtered, rebuilt as lists and joined to one piece a text.

Texts of more than ``PART_BYTES`` go through the same steps part by part, cut between two units, so
memory follows the part and not the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import slices, table

#: The markers of the three pieces (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of these that start with the suffix.
RATE, SUFFIX_FIRST = 90, 20
PART_BYTES = 1 << 20
_MARK = b"\xff"
#: Over bytes: letters, another ASCII character, or a lead byte with what follows it.
_UNIT = r"([A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*)"
_EDGE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f\xc0-\xff]")
_BYTES = pa.large_binary()


def _units(texts: pa.Array) -> pa.Array:
    """[an empty string and the units] of each text."""
    return pc.split_pattern(pc.replace_substring_regex(texts, pattern=_UNIT, replacement=_MARK + b"\\1"), pattern=_MARK)


def _pieces(units: pa.Array, before: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text; ``before``: its units that earlier parts have; the
    prefix ends after unit ``low``, the middle after unit ``high``."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(pc.subtract(pc.cast(units.offsets[:-1], pa.int64()), before), parent))
    role = pc.add(pc.cast(pc.greater(ordinal, pc.take(low, parent)), pa.int8()), pc.cast(pc.greater(ordinal, pc.take(high, parent)), pa.int8()))
    out = []
    for r in range(3):
        own = pc.equal(role, pa.scalar(r, pa.int8()))
        many = np.bincount(pc.filter(parent, own).to_numpy(), minlength=len(units))
        offsets = pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32())
        out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, own)), pa.scalar(b"", _BYTES)))
    return out


def _modulo(x: pa.Array, m: pa.Array | int) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, m), m))


def _cuts(n: pa.Array, draws: list[pa.Array]) -> tuple[pa.Array, pa.Array]:
    one, other = (_modulo(h, pc.add(n, 1)) for h in draws)
    return pc.min_element_wise(one, other), pc.max_element_wise(one, other)


def _parts(text: bytes) -> list[bytes]:
    out, at = [], 0
    while len(text) - at > PART_BYTES:
        edge = _EDGE.search(text, at + PART_BYTES)
        if edge is None:
            break
        out.append(text[at : edge.start()])
        at = edge.start()
    return [*out, text[at:]]


def _divided(texts: pa.Array, draws: list[pa.Array]) -> tuple[pa.Array, list[pa.Array]]:
    """Units of each text, and its three pieces."""
    if len(texts) > 1 or len(texts[0].as_py()) <= PART_BYTES:
        units = _units(texts)
        n = pc.subtract(pc.cast(pc.list_value_length(units), pa.int64()), 1)
        return n, _pieces(units, pa.array(np.zeros(len(texts), np.int64)), *_cuts(n, draws))
    parts = [pa.array([x], _BYTES) for x in _parts(texts[0].as_py())]
    sizes = [pc.list_value_length(_units(x))[0].as_py() - 1 for x in parts]
    n = pa.array([sum(sizes)], pa.int64())
    low, high = _cuts(n, draws)
    joined = [_pieces(_units(x), pa.array([sum(sizes[:k])], pa.int64()), low, high) for k, x in enumerate(parts)]
    return n, [pa.array([b"".join(j[r][0].as_py() for j in joined)], _BYTES) for r in range(3)]


_OUT = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _transform(rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PART_BYTES):
            if not batch.num_rows:
                continue
            texts, draws = pc.cast(batch.column(1), _BYTES), batch.columns[2:]
            n, (prefix, middle, suffix) = _divided(texts, draws[:2])
            plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(draws[2], 100), rate))
            for mark in (PREFIX, SUFFIX, MIDDLE):
                plain = pc.or_(plain, pc.match_substring(texts, mark.encode()))
            spm = pc.less(_modulo(draws[3], 100), suffix_first)
            p, s, m, nothing = (pa.scalar(x.encode(), _BYTES) for x in (PREFIX, SUFFIX, MIDDLE, ""))
            output = pc.if_else(plain, texts, pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)))
            form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
            chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(pc.cast(x, pa.large_string())), pa.int64())) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, form, *chars, pc.cast(output, pa.string())], schema=_OUT)

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of ``docs``: id, n long (units), form (plain, psm or spm), prefix_chars and
    middle_chars long (null if plain), output string.

    Cuts and form are drawn from the sha256 of ``<salt>:<id>``, so reruns agree and rows that repeat an id
    draw alike.  A null text is an empty one, which is plain with n = 0; a null id draws as the id that
    is written as nothing.  Texts that hold a marker are plain, so ``restored`` is always exact.  Bytes
    that are not UTF-8 become U+FFFD.  An empty table gives an empty one; other columns are not read; a
    text and its markers must fit into 2 GB.
    """
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    text = F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *draws)
    out = src.mapInArrow(_transform(rate, suffix_first), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made an output of: each marker stands in it once."""
    after = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(2))
    until = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(1))
    middle, psm = after(output, MIDDLE), form == "psm"
    prefix = F.when(psm, until(after(output, PREFIX), SUFFIX)).otherwise(until(after(output, PREFIX), MIDDLE))
    suffix = F.when(psm, until(after(output, SUFFIX), MIDDLE)).otherwise(until(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = f"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
b AS (SELECT *, len(u) AS n, {", ".join(f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT AS h{k + 1}" for k in range(4))} FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
       WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM d"""
