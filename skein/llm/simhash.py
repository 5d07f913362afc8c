"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most `radius` bits have population counts, of the whole and of any parts, that differ by at most
`radius` in all.  Distinct fingerprints are dealt into tiles by such counts; only tiles near enough meet, and what meets is
compared exactly with exclusive-or and bit counts.

`classes` and `near_dedup` link 64-bit fingerprints by a radius.  `near_classes` and `drop_near_copies` link texts whose sets of five-word shingles have
a Jaccard similarity of at least 0.8: sets are compared by fingerprints of 1,024 bits, whose difference tells the similarity to
about 0.013.  What is surely below is dropped, and all links are decided by the sets themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

SEED = 42
#: The most fingerprints in a tile, about, and the most entries of a comparison held at once.
TILE, BLOCK = 32_768, 1 << 21
#: The most sets, about, in a tile that has the shingles themselves, and their bytes.
SET_TILE, SET_BYTES = 512, 2 << 20

#: Words of a shingle, 64-bit words of a fingerprint, and NUM / DEN, the similarity from which two sets are near copies.
SHINGLE, WORDS, NUM, DEN = 5, 16, 4, 5
#: Of 1,024 bits a pair at similarity 0.8 differs in 155, with a standard deviation of 11.5.  Pairs are compared in full if their first
#: 64 bits differ in at most FIRST (a pair at 0.8 does not once in 3,000 times), and may be near copies if all differ in at most FAR
#: (missed once in 4,000); up to NEAR they are very likely so and come first.
FIRST, NEAR, FAR = 19, 117, 195

_rng = np.random.default_rng(SEED)
_PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIES = _rng.integers(0, 2, 64 * WORDS, dtype=np.int64)


def fingerprint(text: str, width: int = 4) -> int:
    """The SimHash of the text's word shingles, A-Z lower-cased; 0 if it has no word."""
    words = text.encode().lower().split()  # bytes: ASCII letters and the six ASCII white-space characters only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)  # one shingle: its bits are the majority
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)
    ones = sum(np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), 8192))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """`docs` with `fingerprint` (long: the 64 bits of the SimHash of the whole text).

    Null, empty and blank texts have 0.  A column `fingerprint` is replaced.
    """

    def make():
        return lambda batch: [pa.array(np.array([fingerprint(x, width) for x in common.texts(batch, text)], np.uint64).view(np.int64))]

    return common.append(docs, [T.StructField("fingerprint", T.LongType())], make, text)


class Forest:
    """Nodes joined by links, each tree under its lowest node."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (further := self.up[self.up]).tobytes() != self.up.tobytes():
                self.up = further
            open_ = self.up[a] != self.up[b]
            a, b = a[open_], b[open_]


def quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def links_between(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what any links of at most `radius` bits join, between a and b or, if b is None, inside a."""
    nodes = a if b is None else np.concatenate([a, b])
    b, shift = (a, 0) if b is None else (b, len(a))
    forest = Forest(len(nodes))
    groups_a, at_a = np.unique(quarters(a), axis=0, return_inverse=True)
    groups_b, at_b = np.unique(quarters(b), axis=0, return_inverse=True)
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    ends_a, ends_b = np.cumsum(np.bincount(at_a)), np.cumsum(np.bincount(at_b))
    for g, end in enumerate(ends_a):
        rows = order_a[ends_a[g - 1] if g else 0 : end]
        near = np.flatnonzero(np.abs(groups_b - groups_a[g]).sum(axis=1) <= radius)
        if not len(near):
            continue
        cols = np.concatenate([order_b[ends_b[k - 1] if k else 0 : ends_b[k]] for k in near])
        for r in range(0, len(rows), step := max(1, BLOCK // len(cols))):
            some = rows[r : r + step]
            for c in range(0, len(cols), BLOCK):
                part = cols[c : c + BLOCK]
                i, j = np.nonzero(np.bitwise_count(a[some][:, None] ^ b[part][None, :]) <= radius)
                if not shift:
                    i, j = i[keep := some[i] < part[j]], j[keep]
                forest.link(some[i], part[j] + shift)
    linked = np.flatnonzero(forest.up != np.arange(len(nodes)))
    return nodes[linked], nodes[forest.up[linked]]


def _meetings(placed: DataFrame, item: Column, steps: list[tuple[int, int]], tile: int) -> DataFrame:
    """(same, of1, of): pairs of tiles, or one tile and itself, with the items of rows (p, q, key) whose (p, q) are one of `steps` apart.

    The caller's (p, q) have few values, so the table of cells that is broadcast is small: at most 1,089 rows by counts of halves, and
    one row a size class, of which there are about 100, and a count class, at most 7, for sets.
    """
    cells = placed.groupBy("p", "q").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = common.cut(
        placed.select("p", "q", "key", item.alias("item"))
        .join(F.broadcast(cells), ["p", "q"])
        .groupBy("p", "q", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list("item").alias("of"))
    )
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    reach = (
        tiles.select("p", "q", "part", step.alias("d"))
        .select(F.col("p").alias("p1"), F.col("q").alias("q1"), F.col("part").alias("part1"), (F.col("p") + F.col("d.i")).alias("p"), (F.col("q") + F.col("d.j")).alias("q"))
        .join(F.broadcast(cells), ["p", "q"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("(p, q, part) >= (p1, q1, part1)")
    )
    other = tiles.select(F.col("p").alias("p1"), F.col("q").alias("q1"), F.col("part").alias("part1"), F.col("of").alias("of1"))
    return reach.join(other, ["p1", "q1", "part1"]).join(tiles, ["p", "q", "part"]).select((F.expr("(p, q, part) = (p1, q1, part1)")).alias("same"), "of1", "of")


def near_links(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(u, v) links among distinct 64-bit fingerprints (column `fingerprint`) with the components of all links within `radius`."""
    low, high = (F.bit_count(F.expr(x)) for x in ("fingerprint & 4294967295", "shiftrightunsigned(fingerprint, 32)"))
    placed = distinct.select(F.col("fingerprint").alias("key"), low.alias("p"), high.alias("q"))
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]

    def compare(batches):
        for batch in batches:
            for same, a, b in zip(*(batch.column(i) for i in range(3))):
                a, b = (x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (a, b))
                u, v = links_between(a, None if same.as_py() else b, radius)
                for at in range(0, len(u), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65536].view(np.int64)) for x in (u, v)], names=["u", "v"])

    return _meetings(placed, F.col("key"), steps, tile).mapInArrow(compare, "u long, v long")


def _rooted(rows: DataFrame, width: int, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """`rows` (id, text and others) with fingerprints but no text, and (fingerprint, first, root) with the lowest id of each."""
    own = common.cut(fingerprints(rows, "text", width).drop("text"))
    distinct = common.cut(own.groupBy("fingerprint").agg(F.min("id").alias("first")))
    found = components(near_links(distinct.select("fingerprint"), radius, tile))
    return own, distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(id, fingerprint, component_id) for each row of `docs`: the smallest id that chains of links within `radius` bits reach.

    Rows with equal fingerprints are one class, so repeated rows and ties cost nothing; null and empty texts have fingerprint 0
    and link like any other.  A class whose ids are all null has a null component.
    """
    own, rooted = _rooted(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), width, radius, tile)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = rooted.join(lowest, "root").select("fingerprint", "component_id")
    return common.lookup(own, table, "fingerprint").select(F.col("id").alias(id), "fingerprint", "component_id")


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each class of `docs` by `classes`: the one with the lowest id, nulls last, and among these with the lowest row hash."""
    own, rooted = _rooted(docs.select(F.col(id).alias("id"), common.row_hash(docs).alias("row"), F.col(text).alias("text")), width, radius, TILE)
    return common.one_of_each(docs, common.lookup(own, rooted.select("fingerprint", "root"), "fingerprint").select(F.col("id").alias(id), "row", "root"), id)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles, A-Z lower-cased; a text of fewer words is one shingle."""
    words, digest = text.encode().lower().split(), xxhash.xxh64_intdigest  # bytes: ASCII letters and white space only
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    each = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    return np.unique(_mix(sum((each[k : k + n] * _PLACES[k] for k in range(SHINGLE)), np.zeros(n, np.uint64))))


def wide_fingerprint(found: np.ndarray) -> bytes:
    """The SimHash of a set in WORDS 64-bit words; of an even number of elements a fixed bit decides a tie."""
    ones = _TIES.copy()
    for i in range(0, len(found), 512):
        bits = np.unpackbits(_mix(found[i : i + 512, None] * _SALTS).view(np.uint8), axis=1, bitorder="little")
        ones += 2 * bits.sum(axis=0, dtype=np.uint16).astype(np.int64)
    return np.packbits(ones > len(found), bitorder="little").tobytes()


def _described(docs: DataFrame) -> DataFrame:
    """`docs` with `key` (hash of the shingle set), `n` (its size), `print` (its wide fingerprint) and `ones` (the bits set in it)."""

    def make():
        def run(batch):
            sets = [shingles(text) for text in common.texts(batch, "text")]
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            prints = [wide_fingerprint(x) for x in sets]
            ones = [int.from_bytes(x).bit_count() for x in prints]
            return [pa.array(keys), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(ones, pa.int64())]

        return run

    fields = [T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("ones", T.LongType())]
    return common.append(docs, fields, make, "text")


class _Tile:
    """The items (key, n, print) of a tile."""

    def __init__(self, of):
        values = of.values
        self.key, self.n = (values.field(k).to_numpy(zero_copy_only=False) for k in ("key", "n"))
        self.print = np.frombuffer(b"".join(values.field("print").to_pylist()), np.uint64).reshape(-1, WORDS)

    def __add__(self, other: _Tile) -> _Tile:
        both = object.__new__(_Tile)
        both.key, both.n, both.print = (np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("key", "n", "print"))
        return both


def _alike(tile: _Tile, first: int, low: int, high: int, forest: Forest):
    """Blocks (i, j, bits) of pairs in different trees that differ in more than `low` and at most `high` bits; i < first <= j, or all if first is 0."""
    first_word, cols = np.ascontiguousarray(tile.print[:, 0]), np.arange(first, len(tile.key))
    rows = np.arange(first or len(tile.key))
    for r in range(0, len(rows), step := max(1, BLOCK // max(1, len(cols)))):
        some = rows[r : r + step]
        for c in range(0, len(cols), BLOCK):
            part = cols[c : c + BLOCK]
            i, j = np.nonzero(np.bitwise_count(first_word[some][:, None] ^ first_word[part][None, :]) <= FIRST)
            i, j = some[i], part[j]
            small, large = np.minimum(tile.n[i], tile.n[j]), np.maximum(tile.n[i], tile.n[j])
            keep = (i < j) & (NUM * large <= DEN * small)
            i, j = i[keep], j[keep]
            for at in range(0, len(i), 65536):
                a, b = i[at : at + 65536], j[at : at + 65536]
                apart = forest.up[a] != forest.up[b]
                a, b = a[apart], b[apart]
                bits = np.bitwise_count(tile.print[a] ^ tile.print[b]).sum(axis=1, dtype=np.int64)
                keep = (bits > low) & (bits <= high)
                if keep.any():
                    yield a[keep], b[keep], bits[keep]


def _span(tile: _Tile, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): keys of pairs that span all pairs of the tile that may be near copies; the likelier ones come first."""
    forest, u, v = Forest(len(tile.key)), [], []
    for low, high in ((-1, NEAR), (NEAR, (NEAR + FAR) // 2), ((NEAR + FAR) // 2, FAR)):
        for i, j, bits in _alike(tile, first, low, high, forest):
            order = np.argsort(bits, kind="stable")
            i, j = i[order], j[order]
            while len(i):
                # The nearest pair of both its trees goes first; then what still lies in two trees.
                trees = np.stack([forest.up[i], forest.up[j]], axis=1)
                _, at, back = np.unique(trees, return_index=True, return_inverse=True)
                nearest = (at[back.reshape(trees.shape)] // 2 == np.arange(len(i))[:, None]).all(axis=1)
                u.append(i[nearest])
                v.append(j[nearest])
                forest.link(i[nearest], j[nearest])
                apart = forest.up[i] != forest.up[j]
                i, j = i[apart], j[apart]
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (u, v))
    return tile.key[u], tile.key[v]


def common_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of `a` and each of `b` have in common: all pairs at once.

    Elements that few sets have are counted pair by pair, the others by products of 0-1 matrices, some thousand columns at a time.
    """
    both = np.zeros((len(a), len(b)), np.float32)
    own, of = ((np.concatenate([np.empty(0, np.int64), *x]), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (a, b))
    codes, inverse = np.unique(np.concatenate([own[0], of[0]]), return_inverse=True)
    code_a, code_b = inverse[: len(own[0])], inverse[len(own[0]) :]
    in_a, in_b = np.bincount(code_a, minlength=len(codes)), np.bincount(code_b, minlength=len(codes))
    rare, often = (in_a > 0) & (in_b > 0) & (in_a * in_b <= 64), in_a * in_b > 64
    order = np.argsort(code_b, kind="stable")
    begin = np.cumsum(in_b) - in_b
    few = np.flatnonzero(rare[code_a])
    times = in_b[code_a[few]]
    for start in range(0, len(few), BLOCK // 64):
        some, n = few[start : start + BLOCK // 64], times[start : start + BLOCK // 64]
        at = np.repeat(begin[code_a[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(both, (np.repeat(own[1][some], n), of[1][order[at]]), 1)
    column = np.cumsum(often) - 1
    total = int(often.sum())
    for start in range(0, total, width := max(256, BLOCK // max(1, len(a), len(b)))):
        parts = []
        for code, owner, rows in ((code_a, own[1], len(a)), (code_b, of[1], len(b))):
            here = np.flatnonzero(often[code] & (column[code] >= start) & (column[code] < start + width))
            part = np.zeros((rows, min(width, total - start)), np.float32)
            part[owner[here], column[code[here]] - start] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both.astype(np.int64)


def _near_sets(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): which sets of `a` and of `b` have the similarity."""
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    return np.nonzero((NUM + DEN) * common_shingles(a, b) >= NUM * sizes)


def _spanned(sets: DataFrame, tile: int) -> DataFrame:
    """(u, v): what `_span` gives for the tiles of distinct sets (key, n, print, ones)."""
    # A size class is a factor of DEN / NUM wide, and a little more, and a count class FAR + 1 bits: pairs lie in equal or neighbouring ones.
    placed = sets.withColumn("p", _size_class(F.col("n"))).withColumn("q", F.floor(F.col("ones") / (FAR + 1)).cast("int"))
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]

    def compare(batches):
        for batch in batches:
            for same, a, b in zip(*(batch.column(i) for i in range(3))):
                a = _Tile(a)
                first, whole = (0, a) if same.as_py() else (len(a.key), a + _Tile(b))
                u, v = _span(whole, first)
                for at in range(0, len(u), 65536):
                    c = slice(at, at + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u[c], v[c])), pa.array(np.maximum(u[c], v[c]))], names=["u", "v"])

    return _meetings(placed, F.struct("key", "n", "print"), steps, tile).mapInArrow(common.trimmed(compare), "u long, v long").distinct()


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / (1.0001 * math.log(DEN / NUM))).cast("int")


def _sets(keys: DataFrame, rows: DataFrame, own: DataFrame) -> DataFrame:
    """(key, of): the sets of distinct keys, each from the text of one row that has it."""
    chosen = common.lookup(own, keys, "key").groupBy("key").agg(F.min("row").alias("row"))

    def make():
        return lambda batch: [pa.array([shingles(x).view(np.int64) for x in common.texts(batch, "text")], pa.list_(pa.int64()))]

    texts = common.lookup(rows.select("row", "text"), chosen, "row").dropDuplicates(["row"])
    return common.cut(common.append(texts, [T.StructField("of", T.ArrayType(T.LongType()))], make, "text").select("key", "of"))


def _verified(pairs: DataFrame, rows: DataFrame, own: DataFrame) -> DataFrame:
    """(u, v, near) for pairs of keys: whether their sets have the similarity."""
    sets = _sets(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), rows, own)
    both = F.size(F.array_intersect("of_u", "of_v"))
    near = (NUM + DEN) * both >= NUM * (F.size("of_u") + F.size("of_v"))
    met = pairs.select("u", "v")
    for side in ("u", "v"):  # a set may be in very many pairs
        times = pairs.groupBy(side).agg(F.count("*").alias("times"))
        met = common.dealt(met, times.join(sets.select(F.col("key").alias(side), F.col("of").alias(f"of_{side}")), side), side, "times")
    return common.cut(met.select("u", "v", near.alias("near")))


def _candidates(sets: DataFrame) -> DataFrame:
    """(key, group): sets (key, of) that may have the similarity with another are in one group with it; others have no row.

    Elements are ordered from the rarest on.  Two sets that are near copies share one of their first n - ceil(n * NUM / DEN) + 1
    elements, so sets that do are joined, each with the lowest key that shares it: rows, not pairs.
    """
    each = sets.select("key", F.explode("of").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("times"))
    ordered = common.cut(common.dealt(each, often.withColumn("rows", F.col("times")), "shingle", "rows").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("of")))
    prefix = F.size("of") - F.ceil(F.size("of") * NUM / DEN).cast("int") + 1
    first = common.cut(ordered.select("key", F.explode(F.slice("of", F.lit(1), prefix)).alias("e")).where("e.times > 1").select("key", "e.shingle"))
    lowest = first.groupBy("shingle").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("times")).where("low < high").select("shingle", "low", "times")
    links = common.dealt(first, lowest, "shingle", "times").where("key <> low").select(F.col("key").alias("u"), F.col("low").alias("v")).distinct()
    return components(links).select(F.col("node").alias("key"), F.col("root").alias("group"))


def _exact_links(sets: DataFrame) -> DataFrame:
    """(u, v): links that join all sets (key, of) that have the similarity, found by comparing all that may.

    Each group of candidates is dealt by size class into tiles of bounded count and bytes; tiles of equal and neighbouring classes meet.
    """
    placed = common.cut(sets.join(_candidates(sets), "key").withColumn("p", _size_class(F.size("of"))))
    cells = placed.groupBy("group", "p").agg(F.ceil(F.greatest(F.count("*") / SET_TILE, F.sum(8 * F.size("of")) / SET_BYTES)).cast("int").alias("parts"))
    tiles = common.cut(
        placed.join(cells, ["group", "p"]).groupBy("group", "p", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(F.struct("key", "of")).alias("of"))
    )
    to = F.explode(F.array(F.lit(0), F.lit(1)))
    reach = (
        tiles.select("group", F.col("p").alias("p1"), F.col("part").alias("part1"), to.alias("step")).withColumn("p", F.col("p1") + F.col("step"))
        .join(cells, ["group", "p"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("(p, part) >= (p1, part1)")
    )
    other = tiles.select("group", F.col("p").alias("p1"), F.col("part").alias("part1"), F.col("of").alias("of1"))
    met = reach.join(other, ["group", "p1", "part1"]).join(tiles, ["group", "p", "part"]).select(F.expr("(p, part) = (p1, part1)").alias("same"), "of1", "of")

    def compare(batches):
        for batch in batches:
            for same, *sides in zip(*(batch.column(i) for i in range(3))):
                (key_a, a), (key_b, b) = ((x.values.field("key").to_numpy(zero_copy_only=False), [y.values.to_numpy(zero_copy_only=False) for y in x.values.field("of")]) for x in sides)
                i, j = _near_sets(a, b)
                shift = 0 if same.as_py() else len(a)
                keys = key_a if same.as_py() else np.concatenate([key_a, key_b])
                forest = Forest(len(keys))
                forest.link(i, j + shift)
                linked = np.flatnonzero(forest.up != np.arange(len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[linked]), pa.array(keys[forest.up[linked]])], names=["u", "v"])

    return met.mapInArrow(common.trimmed(compare), "u long, v long")


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(id, row, root) for each row of `docs`: `row` its hash, `root` the same for rows that chains of near copies join.

    Equal sets are one class whatever their rows; null, empty and blank texts have no shingle and are one class.  First the pairs
    that span all likely links are verified, one less than there are sets at most.  Only the groups in which one of them fails are
    compared again, by their sets: those that share a rare shingle meet in tiles, all pairs of a tile at once.
    """
    rows = docs.select(F.col(id).alias("id"), common.row_hash(docs).alias("row"), F.col(text).alias("text"))
    own = common.cut(_described(rows).drop("text"))
    sets = common.cut(own.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("print").alias("print"), F.min("ones").alias("ones")))
    found = common.cut(_spanned(sets, tile))
    verified = _verified(found, rows, own)
    links = verified.where("near").select("u", "v")
    failed = verified.where("NOT near").select("u", "v")
    if not failed.isEmpty():
        # Of the groups that the spanning pairs join, those with a pair that failed are compared again.
        groups = components(found)
        touched = groups.join(failed.select(F.col("u").alias("node")).distinct(), "node").select("root").distinct()
        nodes = common.cut(groups.join(touched, "root", "left_semi").select(F.col("node").alias("key")))
        links = links.unionByName(_exact_links(_sets(nodes, rows, own)))
    return common.lookup(own, components(links).select(F.col("node").alias("key"), "root"), "key", "left").select(F.col("id").alias(id), "row", F.coalesce("root", "key").alias("root"))


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row of each class of near copies: the one with the lowest id, nulls last, and among these with the lowest row hash."""
    return common.one_of_each(docs, near_classes(docs, id, text, tile), id)


def hexadecimal(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
