"""Periodic runs of words by maximal pairs.

A run with period q and length L that no neighbouring word extends is a pair of positions q apart whose suffixes share exactly
L - q words and whose words to the left differ: a maximal pair.  So the runs of at least four periods are the maximal pairs that
share at least three times their distance, and nothing has to be extended.  A multiple of the period gives a pair with the same
start and end; of these the smallest distance counts.

The texts of a batch lie one after another, a word of each text being a symbol of its own, so suffixes of two texts share nothing.
Suffixes are sorted by doubling; what has a symbol string of its own drops out.  A pair that shares three times its distance has
equal strings of h words, h a power of two, at most 2 h / 3 apart, so only suffixes with such a neighbour go into the tree.  The
LCP-interval tree is built bottom-up; a node has the positions below it in order, each with the class of its left word.  Where
children join, a position meets its neighbours of the other child: occurrences of one string within a third of its length are
equally spaced, and all but the first have one left word, so positions further off give multiples of the distance or no maximal pair.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A run has at least TIMES periods and LEAST words.
TIMES, LEAST = 4, 6
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")]))),
    T.StructField("collapsed", T.BinaryType()),
]


def shared_words(period: int) -> int:
    """The words that both suffixes of a pair at this distance have to share."""
    return max((TIMES - 1) * period, LEAST - period)


class Suffixes:
    """The suffixes of a row of symbols that may belong to runs, in order, and how much any two share."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.ranks: list[np.ndarray] = []
        _, rank = np.unique(symbols, return_inverse=True)
        kind = np.int32 if n < 1 << 31 else np.int64
        near = np.zeros(n, bool)
        active = np.flatnonzero(np.bincount(rank)[rank] > 1)
        # Ranks are places in the order of all, so that those of strings with a rank of their own stay as they are.
        rank = (np.cumsum(np.bincount(rank)) - np.bincount(rank))[rank].astype(kind)
        h = 1
        while True:
            self.ranks.append(rank)
            if not len(active):
                break
            if h >= 4:
                # `active` is in order of rank and position: neighbours that are near enough for a run.
                close = (rank[active[1:]] == rank[active[:-1]]) & (3 * (active[1:] - active[:-1]) <= 2 * h)
                near[active[1:][close]] = True
                near[active[:-1][close]] = True
            after = active + h
            second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            first = rank[active].astype(np.int64)
            order = np.argsort(first * (n + 1) + second, kind="stable")
            active, first, second = active[order], first[order], second[order]
            new_first = np.concatenate([[True], first[1:] != first[:-1]])
            new = new_first.copy()
            new[1:] |= second[1:] != second[:-1]
            at = np.arange(len(active))
            place = first + at - np.maximum.accumulate(np.where(new_first, at, 0))  # in the order of all
            group = np.maximum.accumulate(np.where(new, at, 0))
            rank = rank.copy()
            rank[active] = place[group]
            alone = new & np.concatenate([new[1:], [True]])
            active = active[~alone]
            h *= 2
        found = np.flatnonzero(near)
        self.order = found[np.argsort(rank[found], kind="stable")]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b (different places) have in common."""
        a, b, total, n = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(self.ranks[0])
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, inside = self.ranks[level], (a < n) & (b < n)
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            a[same] += 1 << level
            b[same] += 1 << level
            total[same] += 1 << level
        return total


def _joined(small: list[int], large: list[int], shared: int, left: list, found: list) -> list[int]:
    """The positions of two children that share so many symbols, in order; maximal pairs between them go to `found`."""
    if len(small) > len(large):
        small, large = large, small
    for p in small:
        i = bisect_left(large, p)
        for k in (i - 1, i):
            if 0 <= k < len(large):
                a, b = (p, large[k]) if p < large[k] else (large[k], p)
                if shared >= shared_words(b - a) and left[a] != left[b]:
                    found.append((a, shared + b - a, b - a))
    if len(small) == 1:
        insort(large, small[0])
    else:
        large.extend(small)
        large.sort()
    return large


def maximal_pairs(order: list[int], shared: list[int], left: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal pairs that are runs, multiples of periods among them.

    `order` has the suffixes in order, shared[i] what i - 1 and i have in common, left[p] the class of the word before p.
    """
    found: list[tuple[int, int, int]] = []
    open_: list[list[int]] = []  # finished children from left to right
    depth: list[int] = []  # what each shares with the next; it grows from left to right
    for i, p in enumerate(order):
        here = shared[i] if i else -1
        while depth and depth[-1] >= here:
            last = open_.pop()
            open_.append(_joined(open_.pop(), last, depth.pop(), left, found))
        if i:
            depth.append(here)
        open_.append([p])
    while depth:
        last = open_.pop()
        open_.append(_joined(open_.pop(), last, depth.pop(), left, found))
    return found


def word_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, smallest period) of each list of words, by start and period."""
    sizes = np.array([len(words) for words in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    symbols = np.fromiter((hash(w) for words in texts for w in words), np.int64, sizes.sum()).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    symbols = symbols ^ ((owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    suffixes = Suffixes(symbols)
    order = suffixes.order
    if not len(order):
        return out
    # Suffixes of one text lie together, since its symbols are its own, but not in order of the texts.
    order = order[np.argsort(owner[order], kind="stable")]
    shared = np.concatenate([[0], suffixes.shared(order[:-1], order[1:])])
    begins = np.cumsum(sizes) - sizes
    same = symbols[np.maximum(order - 1, 0)].view(np.int64)
    classes = dict(zip(order.tolist(), zip((order > begins[owner[order]]).tolist(), same.tolist())))  # nothing is to the left of the first word
    ends = np.flatnonzero(np.diff(owner[order], append=-1)) + 1
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        least: dict[tuple[int, int], int] = {}
        for at, length, period in maximal_pairs(order[start:end].tolist(), shared[start:end].tolist(), classes):
            least[at, length] = min(period, least.get((at, length), period))
        first = int(begins[owner[order[start]]])
        out[owner[order[start]]] = sorted((at - first, length, period) for (at, length), period in least.items())
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, `runs` (start, length, period; by start and period) and `collapsed` (the words kept, joined by a space).

    Words are what ASCII white space divides.  Null, empty and blank texts have no word and no run; a text of any length is one whole,
    for which a task takes about 200 bytes a word.  Rows are looked at one by one, so repeated rows have equal results and an empty
    table gives none.  Columns that have these names are replaced.
    """

    def make():
        def run(batch):
            words = [x.encode().split() for x in common.texts(batch, text)]
            runs = word_runs(words)
            told = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in runs]
            kinds = [pa.int64(), pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.binary()]
            return [pa.array(v, k) for v, k in zip(([len(x) for x in words], told, [collapsed(w, r) for w, r in zip(words, runs)]), kinds)]

        return run

    return common.append(docs, FIELDS, make, text, most_rows=4096, most_bytes=4 << 20)


def planted(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text), where texts of some ids end in a repeated part.

    With h the CRC-32 of the id and g = h / 10: if h % 10 = 0, each word from a = g % n on is that of a + (i - a) % p of the n words,
    p = 1 + (n - a) / (3 + g % 8), and words are joined by a space.  Other texts, also those of null ids, are as they were.
    """
    h = F.crc32(F.col(id).cast("string"))
    rows = docs.select(F.col(id), F.col(text), F.coalesce(h % 10 == 0, F.lit(False)).alias("__hit"), F.floor(h / 10).alias("__g"))
    rows = rows.withColumn("__words", F.when(F.col("__hit"), F.regexp_extract_all(F.col(text), F.lit(common.WORD), F.lit(0))))
    n = F.size("__words")
    a = F.expr("cast(__g % size(__words) as int)")
    p = (1 + F.floor((n - a) / (3 + F.col("__g") % 8))).cast("int")
    rows = rows.withColumns({"__a": F.when(n > 0, a), "__p": F.when(n > 0, p)})
    block = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    left = n - F.col("__a")
    again = F.concat(F.slice("__words", F.lit(1), F.col("__a")), F.flatten(F.array_repeat(block, F.floor(left / F.col("__p")).cast("int"))), F.slice(block, F.lit(1), (left % F.col("__p")).cast("int")))
    return rows.select(F.col(id), F.when(F.col("__hit") & (n > 0), F.concat_ws(" ", again)).otherwise(F.col(text)).alias(text))


def digests(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """The number of runs, the one with the most periods (ties: the first, then the shorter period) and hashes of all."""
    sign = lambda x: F.signum(x).cast("int")
    more = lambda a, b: sign(b["length"] * a["period"] - a["length"] * b["period"])
    earlier = lambda a, b: F.when(a["start"] != b["start"], sign(a["start"] - b["start"])).otherwise(sign(a["period"] - b["period"]))
    first = F.array_sort("runs", lambda a, b: F.when(more(a, b) != 0, more(a, b)).otherwise(earlier(a, b)))
    best = F.try_element_at(first, F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        id,
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
