"""Removal of lines that other documents have, with two Bloom filters.

A first pass sets, for the key of each line, bits in a filter of keys seen once, and in a second filter if they were set already.
Each task does so for its own documents and gives the blocks of both filters that it has touched; blocks are merged one by one,
where what two tasks have seen once has been seen twice.  The second filter, of at most MOST_BITS bits, is broadcast: a key that is
not in it stands in one document only, and never leaves its task.  The others, suspected repeats, are shuffled as 128-bit hashes
with their documents: that confirms them exactly and finds the first document of each.

The filters have BITS bits a line up to MOST_BITS.  With more lines than that is meant for more keys are suspected, at last all,
and the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Code points from which a key counts.
LEAST = 10
#: Bits a line, bits set for a key, and bits of a filter at most (64 MB) and at least.
BITS, PROBES, MOST_BITS, LEAST_BITS = 8, 2, 1 << 29, 1 << 16
#: Bytes of a block of a filter.
BLOCK = 1 << 13


def line_keys(text: str, least: int = LEAST) -> list[bytes]:
    """The 128-bit hash of the key of each line of the text, empty for keys of fewer code points."""
    digest, out = xxhash.xxh3_128_digest, []
    for line in text.encode().lower().split(b"\n"):  # bytes: ASCII letters only, and `strip` takes the six ASCII white-space characters
        key = line.strip()
        long = len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)
        out.append(digest(key) if long else b"")
    return out


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES places of each hash in a filter of `bits` bits, a power of two."""
    mask = np.uint64(bits - 1)
    return np.stack([(hashes[:, 0] + np.uint64(i) * (hashes[:, 1] | np.uint64(1))) & mask for i in range(PROBES)])


class Filter:
    """A Bloom filter over 128-bit hashes."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8) if data is None else data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _places(hashes, self.bits)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        at = _places(hashes, self.bits).ravel()
        np.bitwise_or.at(self.data, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def _distinct(texts: list[str], least: int) -> list[list[bytes]]:
    return [list({k for k in line_keys(x, least) if k}) for x in texts]


def seen_twice(docs: DataFrame, bits: int, text: str = "text", least: int = LEAST) -> np.ndarray:
    """The bits of a filter of the keys that at least two rows of `docs` have, and by chance of some others."""

    def local(batches):
        once, twice = Filter(bits), Filter(bits)
        for batch in batches:
            for piece in common.slices(batch, text, 4096, 8 << 20):
                hashes = _hashes([k for keys in _distinct(common.texts(piece, text), least) for k in keys])
                if not len(hashes):
                    continue
                own, count = np.unique(hashes, axis=0, return_counts=True)
                twice.add(own[(count > 1) | once.has(own)])
                once.add(own)
        width = min(BLOCK, bits // 8)
        for k in np.flatnonzero(once.data.reshape(-1, width).any(axis=1)):
            part = slice(k * width, (k + 1) * width)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([once.data[part].tobytes()]), pa.array([twice.data[part].tobytes()])], names=["block", "once", "twice"])

    def merge(batches):
        at, once, twice = None, None, None

        def done():
            if at is not None and twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([twice.tobytes()])], names=["block", "twice"])

        for batch in batches:
            for block, o, t in zip(*(batch.column(i) for i in range(3))):
                o, t = (np.frombuffer(x.as_buffer(), np.uint8) for x in (o, t))
                if block.as_py() != at:
                    yield from done()
                    at, once, twice = block.as_py(), o.copy(), t.copy()
                    continue
                twice |= t | (once & o)
                once |= o
        yield from done()

    parts = docs.select(text).mapInArrow(local, "block long, once binary, twice binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, twice binary")
    found = np.zeros(bits // 8, np.uint8)
    width = min(BLOCK, bits // 8)
    for row in merged.toLocalIterator():  # bits / 8 bytes in all, whatever the table holds
        found[row.block * width : (row.block + 1) * width] = np.frombuffer(bytes(row.twice), np.uint8)
    return found


def filter_bits(docs: DataFrame, text: str = "text", most_bits: int = MOST_BITS) -> int:
    """Bits for a filter of the lines of `docs`: a power of two."""
    lines = docs.agg(F.sum(1 + F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))))).first()[0] or 0
    return int(min(most_bits, max(LEAST_BITS, 1 << (BITS * int(lines)).bit_length())))


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """(r1, r2, keys): the keys that a row of `docs`, named by two hashes of its id and text, loses to documents with lower ids."""
    bits = filter_bits(docs, text, most_bits)
    spread = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, bits, text, least).tobytes())

    def suspects(batches):
        twice = Filter(bits, np.frombuffer(spread.value, np.uint8))
        for batch in batches:
            for piece in common.slices(batch, text, 4096, 8 << 20):
                keys = _distinct(common.texts(piece, text), least)
                hashes = _hashes([k for x in keys for k in x])
                if not len(hashes):
                    continue
                hit = np.flatnonzero(twice.has(hashes))
                rows = np.repeat(np.arange(len(keys)), [len(x) for x in keys])[hit]
                flat = pa.array([k for x in keys for k in x], pa.binary()).take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(pa.array(rows)) for c in ("r1", "r2", "id")), flat], names=["r1", "r2", "id", "key"])

    kind = docs.schema[id].dataType.simpleString()
    named = docs.select(*_names(id, text), F.col(id).alias("id"), F.col(text).alias(text))
    found = common.cut(named.mapInArrow(suspects, f"r1 long, r2 long, id {kind}, key binary"))
    of = found.groupBy("key").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.bool_or(F.col("id").isNull()).alias("none"), F.count("*").alias("times"))
    ends = of.where("keeper <> last OR (none AND keeper IS NOT NULL)").select("key", "keeper", "times")
    lost = common.dealt(found, ends, "key", "times").where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("r1", "r2").agg(F.collect_set("key").alias("keys"))


def _names(id: str, text: str) -> list[Column]:
    none = [F.col(id).isNull(), F.col(text).isNull()]
    return [F.xxhash64(*none, F.col(id), F.col(text)).alias("r1"), F.xxhash64(F.lit("second"), *none, F.col(id), F.col(text)).alias("r2")]


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """`docs` with `n_lines` and `dropped` (numbers of lines from 0, in order), and its text without these lines.

    A line's key is the line in lower case (A-Z) without outer ASCII white space.  All lines whose key has at least `least` code
    points and stands in another document with a lower id, null being the highest, are dropped; rows with one id are one document,
    and within it lines repeat as they like.  Null and empty texts have one empty line and stay as they are; if all lines go the
    text is empty.  Repeated rows lose the same lines, texts of any length are read whole, and an empty table gives no rows.
    Columns that have these names are replaced.
    """
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "dropped")]
    row = F.struct(*(F.col(c) for c in columns))
    keyed = docs.select(*_names(id, text), row.alias("row"))
    kinds = T.StructType([f for f in docs.schema.fields if f.name in columns])
    schema = T.StructType([*kinds.fields, T.StructField("n_lines", T.LongType()), T.StructField("dropped", T.ArrayType(T.LongType()))])

    def drop(batches):
        for batch in batches:
            at = {c: i for i, c in enumerate(columns)}
            given = batch.column("row").flatten()
            texts, counts, dropped = [], [], []
            for x, keys in zip(given[at[text]].to_pylist(), batch.column("keys").to_pylist()):
                lines = (x or "").split("\n")
                gone: list[int] = []
                if keys:
                    lost = set(keys)
                    gone = [i for i, k in enumerate(line_keys(x, least)) if k in lost]
                    out = set(gone)
                    x = "\n".join(line for i, line in enumerate(lines) if i not in out)
                texts.append(x)
                counts.append(len(lines))
                dropped.append(gone)
            own = [pa.array(texts, pa.string()) if c == text else given[at[c]] for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(dropped, pa.list_(pa.int64()))], names=[*columns, "n_lines", "dropped"])

    def pieces(batches):
        for batch in batches:
            sizes = batch.column("row").field(batch.schema.field("row").type.get_field_index(text))
            yield from drop(common.slices(pa.RecordBatch.from_arrays([*batch.columns, sizes], names=[*batch.schema.names, "__text"]), "__text", 1024, 8 << 20))

    lost = repeats(docs, id, text, least, most_bits)
    return keyed.join(lost, ["r1", "r2"], "left").select("row", "keys").mapInArrow(pieces, schema)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, row, n, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row, unnest(parts) AS line, unnest(range(len(parts))) AS n
        FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keepers AS (SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT doc_id IS NULL) >= 3 OR count(DISTINCT doc_id) >= 2),
judged AS (SELECT doc_id, row, n, line, keepers.key IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone FROM lines LEFT JOIN keepers ON lines.key = keepers.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id, row
"""
