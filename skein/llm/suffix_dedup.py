"""Removal of long repeated byte strings with a sparse suffix array.

Every string of `length` bytes contains places where a suffix may start; the one whose leading 32-byte token has the lowest hash
is the string's anchor.  Equal strings have equal anchors at equal offsets, so only suffixes that begin at anchors (one in about
120 bytes of prose) have to be sorted: all others would not fit on disk.

Runs of neighbouring strings with one anchor are a context.  Contexts that occur twice, found by grouping them by the hash of leading
token and context, are repeated as a whole.  For the others, suffixes are dealt to range partitions by the hash of their leading token,
with splitters that are approximate quantiles of all of them.  A partition orders its strings by hashes: of leading token and offset
first, then of the largest pieces of a power of two that start and end the string, where strings that stand alone drop out.  These
orders tell equal from unequal and no more; they are not those of the bytes.  Strings with one leading token never lie on two sides of a
splitter, so none has to be compared across a boundary; a leading token with very many contexts is dealt further by the hash of the
whole strings.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of a string and of a leading token.
LENGTH, LEAD = 400, 32
#: Bytes of text in one block of arrays (below 2^24), contexts of one leading token that one group sorts, and partitions at most.
BLOCK, GROUP, MOST_PARTITIONS = 1 << 20, 2048, 4096
_U = np.uint64
_random = np.random.default_rng(20240229)
_BYTES = _random.integers(1, 1 << 63, 256, dtype=_U)
_ODD = [(_U(int(a) * 2 + 1), _U(int(b) * 2 + 1)) for a, b in _random.integers(1, 1 << 62, (16, 2))]


def _mix(a, b, level):
    h = a * _ODD[level][0] + b * _ODD[level][1]
    return h ^ (h >> _U(29))


def tokens(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the LEAD bytes from each position on, and of the `span(length)` bytes."""
    h, lead = _BYTES[x], np.empty(0, _U)
    for level in range(span(length).bit_length() - 1):
        step = 1 << level
        if len(h) <= step:
            return lead, np.empty(0, _U)
        h = _mix(h[:-step], h[step:], level)
        if 2 * step == LEAD:
            lead = h
    return lead, h


def span(length: int) -> int:
    """The largest power of two up to `length`: two tokens of it, at both ends, cover a string."""
    if not 2 * LEAD <= length < 1024:
        raise ValueError("strings have 64 to 1,023 bytes")
    return 1 << (length.bit_length() - 1)


def _whole(token: np.ndarray, i: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` bytes from i on."""
    return _mix(token[i], token[i + length - span(length)], 10)


def contexts(x: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(lo, hi, anchor, leading token, context hash) of the runs of strings with one anchor in texts that lie one after another.

    The strings of a run start at lo to hi; no string crosses one of the `ends`.
    """
    if len(x) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    lead, t = tokens(x, length)
    places = length - LEAD + 1
    low = (lead & ~_U((1 << 24) - 1)) | np.arange(len(lead), dtype=_U)
    width = 1
    while 2 * width <= places:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (places - width)], low[places - width :])
    anchor = (low & _U((1 << 24) - 1)).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for end in ends[:-1]:  # strings that would cross an end
        inside[max(0, end - length + 1) : end] = False
    start = np.flatnonzero(inside)
    if not len(start):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    anchor = anchor[start]
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    lo, hi, anchor = start[new], start[np.append(new[1:], len(start)) - 1], anchor[new]
    shape = ((anchor - lo) << 10 | (hi - lo)).astype(_U)
    return lo, hi, anchor, lead[anchor].view(np.int64), _mix(_mix(_whole(t, lo, length), _whole(t, hi, length), 11), shape, 12).view(np.int64)


def _scan(batches, length: int):
    """Rows of `suffixes` from rows (r1, r2, bytes)."""
    names = ["r1", "r2", "lead", "context", "lo", "hi", "anchor"]

    def rows(owner, at, parts):
        x, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        lo, hi, anchor, lead, context = contexts(x, ends, length)
        which = np.searchsorted(ends, lo, "right")
        shift = np.array(at)[which] - (ends - [len(p) for p in parts])[which] if len(lo) else lo
        own = np.array(owner, np.int64).reshape(-1, 2)[which]
        for i in range(0, len(lo), 32_768):
            c = slice(i, i + 32_768)
            yield pa.RecordBatch.from_arrays([pa.array(own[c, 0]), pa.array(own[c, 1]), pa.array(lead[c]), pa.array(context[c]), *(pa.array((v + shift)[c].astype(np.int32)) for v in (lo, hi, anchor))], names=names)

    owner, at, parts, size = [], [], [], 0
    for batch in batches:
        for r1, r2, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            x = np.frombuffer(value.as_buffer(), np.uint8)
            # Of a text longer than a block, each piece repeats the end of the one before, so that no string is lost.
            for start in range(0, max(1, len(x) - length + 1), BLOCK):
                piece = x[start : start + BLOCK + length - 1]
                if size and size + len(piece) > BLOCK + length:
                    yield from rows(owner, at, parts)
                    owner, at, parts, size = [], [], [], 0
                owner.append((r1, r2))
                at.append(start)
                parts.append(piece)
                size += len(piece)
    if size:
        yield from rows(owner, at, parts)


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by these keys, the first one foremost, and the number of the run of equal keys of each in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= np.diff(k[order].view(np.int64)) != 0
    return order, np.cumsum(new)


def repeated(keys: list[np.ndarray], further) -> np.ndarray:
    """Positions whose keys and whose further tokens all equal another's, by sorting hashes key by key: what stands alone drops out."""
    at = np.arange(len(keys[0]))
    for level in range(len(further) + 1):
        order, run = _runs(keys)
        keep = np.bincount(run)[run] > 1 if len(run) else np.empty(0, bool)
        at, group = at[order[keep]], run[keep]
        if level < len(further):
            keys = [group, further[level](at)]
    return np.sort(at)


def _spans(owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, from, to) covered by strings at these starts, which are in order for each owner."""
    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    return owner[new], start[new], start[np.append(new[1:], len(start)) - 1] + length if len(start) else start


def _sort_group(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) from rows (lead, part, r1, r2, lo, anchor, alone, blob, offsets) of whole groups."""
    group = np.cumsum([i > 0 and rows[i][:2] != rows[i - 1][:2] for i in range(len(rows))])
    lo, anchor = (np.array([r[k] for r in rows], np.int64) for k in (4, 5))
    plain = np.flatnonzero([r[8] is None for r in rows])
    dealt = np.flatnonzero([r[8] is not None for r in rows])
    owner, start = [], []
    if len(plain):
        parts = [np.frombuffer(rows[i][7], np.uint8) for i in plain]
        sizes = np.array([len(p) for p in parts])
        _, t = tokens(np.concatenate(parts), length)
        counts = sizes - length + 1
        of = np.repeat(plain, counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = inner + np.repeat(np.cumsum(sizes) - sizes, counts)
        place = lo[of] + inner
        at = repeated([group[of] << 10 | (anchor[of] - place), t[flat]], [lambda i: t[flat[i] + length - span(length)]])
        owner.append(of[at])
        start.append(place[at])
    if len(dealt):
        offsets = [np.frombuffer(rows[i][8], np.int16) for i in dealt]
        of = np.repeat(dealt, [len(x) for x in offsets])
        offset = np.concatenate(offsets).astype(np.int64)
        at = repeated([group[of] << 10 | offset, np.concatenate([np.frombuffer(rows[i][7], _U) for i in dealt])], [])
        owner.append(of[at])
        start.append(anchor[of[at]] - offset[at])
    owner, start = np.concatenate(owner), np.concatenate(start)
    alone = np.array([r[6] for r in rows], bool)[owner] if len(owner) else np.empty(0, bool)
    owner, start = owner[alone], start[alone]
    order = np.lexsort((start, owner))
    return _spans(owner[order], start[order], length)


def _sort(batches, length: int):
    """Spans (r1, r2, from, to) from rows that come sorted by leading token, part, row and place.

    Equal rows of the table give the same strings; one of each is enough, since all that they have is known to be repeated.
    """

    def out(rows):
        owner, lo, hi = _sort_group(rows, length)
        if len(owner):
            own = np.array([r[2:4] for r in rows], np.int64)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["r1", "r2", "from", "to"])

    waiting, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if waiting and row[:5] == waiting[-1][:5]:
                continue
            if size > BLOCK and row[:2] != waiting[-1][:2]:
                yield from out(waiting)
                waiting, size = [], 0
            waiting.append(row)
            size += len(row[7])
    if waiting:
        yield from out(waiting)


def _bytes(whole: pa.StructArray) -> pa.Array:
    return whole.field(whole.type.get_field_index("bytes"))


def _fetch(batches, length: int):
    """One row for each context asked for: its bytes, or, if its leading token is dealt further, the hashes of its strings by part."""
    names = ["lead", "part", "r1", "r2", "lo", "anchor", "alone", "blob", "offsets"]
    for batch in batches:
        rows: list[tuple] = []
        for r1, r2, value, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3).to_pylist()):
            text = value.as_buffer().to_pybytes()
            for a in asked:
                lead, lo, hi, anchor, alone, parts = (a[k] for k in ("lead", "lo", "hi", "anchor", "alone", "parts"))
                x = text[lo : hi + length]
                if parts == 1:
                    rows.append((lead, 0, r1, r2, lo, anchor, alone, x, None))
                    continue
                whole = _whole(tokens(np.frombuffer(x, np.uint8), length)[1], np.arange(hi - lo + 1), length)
                offset = (anchor - lo - np.arange(hi - lo + 1)).astype(np.int16)
                part = (whole % _U(parts)).astype(np.int64)
                for k in np.unique(part):
                    rows.append((lead, int(k), r1, r2, lo, anchor, alone, whole[part == k].tobytes(), offset[part == k].tobytes()))
            if len(rows) > 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _FETCHED)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _FETCHED)], names=names)


_FETCHED = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]


def _written(df: DataFrame) -> DataFrame:
    path = f"{common.shared_dir(df.sparkSession)}/suffixes-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _partitions(spark: SparkSession) -> int:
    return min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def spans(keyed: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(r1, r2, from, to) of what is repeated in the texts of rows (r1, r2, whole: a struct with bytes); spans of a text may overlap."""
    span(length)
    scan, fetch, sort = (common.trimmed(partial(f, length=length)) for f in (_scan, _fetch, _sort))
    suffixes = _written(keyed.select("r1", "r2", "whole.bytes").mapInArrow(scan, "r1 long, r2 long, lead long, context long, lo int, hi int, anchor int"))
    place = F.struct("r1", "r2", "lo", "hi", "anchor")
    each = _written(suffixes.groupBy("lead", "context").agg(F.count("*").alias("times"), F.min(place).alias("at")))
    twice = each.where("times > 1").select("lead", "context")
    copies = suffixes.join(twice, ["lead", "context"], "left_semi").select("r1", "r2", F.col("lo").alias("from"), (F.col("hi") + length).alias("to"))
    several = each.groupBy("lead").agg(F.count("*").alias("n"), F.min("times").alias("least")).where("n > 1 and least = 1").select("lead", F.ceil(F.col("n") / group).cast("int").alias("parts"))
    asked = common.cut(each.join(several, "lead").select("at.*", "lead", "parts", (F.col("times") == 1).alias("alone")))
    n = _partitions(keyed.sparkSession)
    splitters = asked.select(F.percentile_approx("lead", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    needs = asked.groupBy("r1", "r2").agg(F.collect_list(F.struct("lead", "lo", "hi", "anchor", "alone", "parts")).alias("asked"))
    fetched = keyed.join(needs, ["r1", "r2"]).select("r1", "r2", "whole", "asked").mapInArrow(fetch, "lead long, part int, r1 long, r2 long, lo int, anchor int, alone boolean, blob binary, offsets binary")
    if splitters:
        bounds = F.array(*map(F.lit, sorted(set(splitters))))
        bucket = F.size(F.filter(bounds, lambda b: b < F.col("lead"))) + F.col("part") * 7919
        fetched = fetched.repartitionById(n, F.pmod(bucket, F.lit(n)).cast("int"))
    else:
        fetched = fetched.coalesce(1)
    sorted_ = fetched.sortWithinPartitions("lead", "part", "r1", "r2", "lo").mapInArrow(sort, "r1 long, r2 long, from int, to int")
    return copies.unionByName(sorted_)


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH, group: int = GROUP, trim: bool = False) -> DataFrame:
    """`docs` with `removed` (array of [from, to) byte spans, in order and apart) and `kept` (binary: the other bytes).

    Removed is each byte of a string of `length` bytes that also starts anywhere else, in this text or another, overlapping or not.
    Null and shorter texts lose nothing; of repeated rows of `length` bytes or more each loses all.  Columns that have these names are
    replaced.  With `trim` the text itself becomes the kept bytes; of a character that a cut has divided, nothing is left in it.
    """
    columns = [c for c in docs.columns if c.lower() not in ("removed", "kept")]
    row = F.struct(*(c for c in columns if c != text)) if columns != [text] else F.struct(F.lit(0).alias("none"))
    # Two 64-bit hashes of the whole row name it; equal rows are alike and lose the same.
    # What belongs to a row travels as one struct, whole wherever it goes, so that both joins with the texts share one exchange.
    whole = F.struct(row.alias("row"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("bytes"), F.col(text).isNull().alias("none"))
    keyed = docs.select(F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit("second"), *columns).alias("r2"), whole.alias("whole"))
    # A set: many equal rows have the same spans, each of which is held once.
    of = spans(keyed, length, group).groupBy("r1", "r2").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    kinds = T.StructType([f for f in docs.schema.fields if f.name in columns])
    schema = T.StructType([*kinds.fields, T.StructField("removed", T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))), T.StructField("kept", T.BinaryType())])

    def remove(batches):
        for batch in batches:
            removed, kept = [], []
            bytes_, nones, given = (batch.column("whole").field(batch.column("whole").type.get_field_index(k)) for k in ("bytes", "none", "row"))
            for value, found in zip(bytes_, batch.column("spans").to_pylist()):
                x = value.as_buffer().to_pybytes()
                merged: list[dict] = []
                for s in sorted(found or (), key=lambda s: s["from"]):
                    if merged and s["from"] <= merged[-1]["to"]:
                        merged[-1]["to"] = max(merged[-1]["to"], s["to"])
                    else:
                        merged.append(dict(s))
                cuts = [0, *(v for s in merged for v in (s["from"], s["to"])), len(x)]
                removed.append(merged)
                kept.append(b"".join(x[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            given = dict(zip((c for c in columns if c != text), given.flatten()))
            left = [x.decode("utf-8", "ignore") for x in kept] if trim else [x.decode() for x in bytes_.to_pylist()]
            strings = pa.array([None if none else x for x, none in zip(left, nones.to_pylist())], pa.string())
            own = [strings if c == text else given[c] for c in columns]
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*own, pa.array(removed, kind), pa.array(kept, pa.binary())], names=[*columns, "removed", "kept"])

    return keyed.join(of, ["r1", "r2"], "left").select("whole", "spans").mapInArrow(common.trimmed(remove), schema)


def digests(found: DataFrame) -> DataFrame:
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + length).cast("long").alias("n_bytes"),
        length.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
