"""Token counts by rank-synchronous merging.

The pre-tokens of a batch that were not met before lie one after another in flat numpy arrays.  Each round finds every
sequence's lowest merge rank and merges that pair in all sequences at once; a sequence without a pair left is done, and its
count is the number of its symbols.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pre-tokens whose counts a task remembers, and the longest of them, in characters: at most about 150 MB.
REMEMBERED, REMEMBERED_CHARS = 800_000, 40
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts tokens as a byte-level BPE with word ends does."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        steps = spec["normalizer"]["normalizers"]
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"the steps of this normaliser are not known: {steps}")
        self.gap, self.filler = regex.compile(steps[1]["pattern"]["Regex"]), steps[1]["content"]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True))) or r"(?!)")
        symbols = byte_symbols()
        self.inner = np.array([vocab[x] for x in symbols], np.int64)
        self.final = np.array([vocab[x + end] for x in symbols], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        left, right = (np.array([vocab[x[i]] for x in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        # A merge may be applied everywhere in a sequence at once unless its product takes part in an earlier merge.
        first = np.full(max(vocab.values()) + 1, NONE)
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        self.at_once = first[self.made] > np.arange(len(pairs))
        self.seen: dict[str, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each of these non-empty pre-tokens has once all merges are done."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.inner[np.frombuffer(b"".join(pieces), np.uint8)]
        lasts = np.cumsum(lengths) - 1
        ids[lasts] = self.final[np.frombuffer(b"".join(pieces), np.uint8)[lasts]]
        seq, out = np.repeat(np.arange(len(pieces)), lengths), lengths.copy()
        while len(ids):
            rank = np.full(len(ids), NONE)
            rank[:-1] = np.where(seq[:-1] == seq[1:], self.rank(ids[:-1], ids[1:]), NONE)
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            sizes = np.diff(starts, append=len(seq))
            lowest = np.minimum.reduceat(rank, starts)
            out[seq[starts]] = sizes
            open_ = np.repeat(lowest < NONE, sizes)
            ids, seq, rank, lowest = ids[open_], seq[open_], rank[open_], np.repeat(lowest, sizes)[open_]
            if not len(ids):
                break
            hit = np.flatnonzero(rank == lowest)
            if len(hit) > 1:
                # In a run of overlapping pairs, as in a a a a, every other one merges, from the left.
                run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                offset = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
                hit = hit[offset % 2 == 0]
                one = ~self.at_once[rank[hit]]
                if one.any():
                    hit = hit[~one | (np.diff(seq[hit], prepend=-1) != 0)]
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, seq = ids[keep], seq[keep]
        return out

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """The number of special tokens in the text, and its pre-tokens."""
        parts = self.special.split(text)
        found: list[str] = []
        for part in parts:
            # A capital sigma is lower-cased without regard to its place in a word.
            found += self.split(self.gap.sub(self.filler, unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower())
        return len(parts) - 1, found

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pieces(x) for x in texts]
        known = self.seen
        new = list({p for _, found in split for p in found if p not in known})
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({p for _, found in split for p in found})
            known.update(zip(new, self.count([p.encode() for p in new]).tolist()))
        out = [special + sum(map(known.__getitem__, found)) for special, found in split]
        for p in new:
            if len(p) > REMEMBERED_CHARS:
                del known[p]
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with `n_tokens` (long), the number of tokens of the whole text by the tokenizer file at `path`.

    A null or empty text has 0.  Special strings in a text count as one token each.  Texts of any length count whole, repeated rows
    are counted each, and an empty table gives no rows.  A column `n_tokens` is replaced.
    """

    def make():
        own = counter(path)
        return lambda batch: [pa.array(own.counts(common.texts(batch, text)), pa.int64())]

    return common.append(docs, [T.StructField("n_tokens", T.LongType())], make, text)


def lengths(counted: DataFrame, most: int = 2048) -> DataFrame:
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))
