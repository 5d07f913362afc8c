"""Byte-level BPE encoding and decoding.

Symbols form a linked list.  A candidate pair waits in the bucket of its merge rank; a two-level bitmap over the ranks finds the
lowest bucket in use with find-first-set.  A merge leaves outdated entries behind, which are skipped when they come up.  Many
pre-tokens lie in one list, parted by barriers, so that one bucket serves them all; n bytes take O(n log n) steps however they
are divided, so a document without white space is no special case.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pre-tokens in one of the two generations that a task remembers, and the longest of them, in characters: at most about 100 MB.
REMEMBERED, REMEMBERED_CHARS = 200_000, 40
#: Characters of texts that are split at once, and bytes of new pre-tokens in one list of symbols; a longer one has its own.
GROUP, LIST = 1 << 20, 1 << 17


def load_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a file in the format `base64 rank` a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Merges:
    """The merges of a rank table.  Symbols have the rank of their bytes as number; bytes that are no token have one above all."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, top = ranks, max(ranks.values(), default=-1) + 1
        self.number = np.array([ranks.get(bytes([b]), top + b) for b in range(256)], np.int64)
        one = {bytes([b]): int(n) for b, n in enumerate(self.number)}
        self.shift, self.barrier, number = (top + 257).bit_length(), top + 256, {**one, **ranks}
        #: rank of the merge of two symbols by left << shift | right
        self.of = {number[t[:i]] << self.shift | number[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in number and t[i:] in number}
        self.first = np.array([[self.of.get(int(a) << self.shift | int(b), -1) for b in self.number] for a in self.number], np.int64).reshape(-1)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pre-tokens, none of which is empty, one after another, and where those of each end.

        Bit r of `words[b]` says that the bucket of rank 256 b + r is in use, bit b of `top` that some bit of `words[b]` is set.
        A bucket is a heap, so that equal ranks merge from the left.  After a merge that makes a pair of lower rank the bucket waits.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1)  # a barrier follows each piece
        whole = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        n, inner = len(whole), np.ones(len(whole), bool)
        numbers = self.number[whole]
        numbers[ends - 1] = self.barrier
        inner[ends - 1] = inner[np.maximum(ends - 2, 0)] = False
        ranks = np.where(inner, self.first[whole.astype(np.int64) << 8 | np.append(whole[1:], 0)], -1)
        for k, piece in enumerate(pieces):  # a token is not merged from its parts
            if piece in self.ranks:
                start = ends[k] - 1 - lengths[k]
                ranks[start : ends[k] - 1], numbers[start : ends[k] - 1], numbers[start] = -1, -1, self.ranks[piece]
        order = np.argsort(ranks, kind="stable")[np.count_nonzero(ranks < 0) :]
        used, starts = np.unique(ranks[order], return_index=True)
        buckets = {r: x.tolist() for r, x in zip(used.tolist(), np.split(order, starts[1:]))} if len(used) else {}
        top, words = 0, {}
        for r in buckets:
            words[r >> 8] = words.get(r >> 8, 0) | 1 << (r & 255)
            top |= 1 << (r >> 8)
        find, shift, barrier = self.of.get, self.shift, self.barrier
        due, symbol, after, before = ranks.tolist(), numbers.tolist(), list(range(1, n + 1)), list(range(-1, n))
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            while bucket:
                i = heappop(bucket)
                if due[i] != rank:
                    continue  # stale
                gone = after[i]
                after[i] = end = after[gone]
                symbol[i], symbol[gone], due[gone] = rank, -1, -1
                before[end] = i
                lowest, right = rank, symbol[end]
                due[i] = new = -1 if right == barrier else find(rank << shift | right, -1)
                j = i
                while True:  # the pair that starts with the merged symbol, then the pair that ends with it
                    if new >= 0:
                        if new in buckets:
                            heappush(buckets[new], j)
                        else:
                            buckets[new] = [j]
                            words[new >> 8] = words.get(new >> 8, 0) | 1 << (new & 255)
                            top |= 1 << (new >> 8)
                        if new < lowest:
                            lowest = new
                    if j != i or (j := before[i]) < 0 or (left := symbol[j]) == barrier:
                        break
                    due[j] = new = find(left << shift | rank, -1)
                if lowest < rank:
                    break
            if not bucket:
                del buckets[rank]
                words[high] = word = words[high] & ~(1 << (rank & 255))
                if not word:
                    top &= ~(1 << high)
        numbers = np.array(symbol, np.int32)
        kept = (numbers >= 0) & (numbers != barrier)
        if (numbers[kept] > barrier - 257).any():
            raise KeyError("a byte has no token in this vocabulary")
        return numbers[kept], np.cumsum(kept)[ends - 1]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token that is not empty."""
    return Merges(ranks).ids([piece])[0].tolist()


class Codec:
    """Encodes texts with a rank file and a pre-token pattern, and decodes ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = load_ranks(path)
        self.merges = Merges(ranks)
        self.split = regex.compile(pattern).findall
        # The ids of known pre-tokens as bytes: those of late, and those before them, of which the ones in use move up.
        self.late: dict[str, bytes] = {}
        self.early: dict[str, bytes] = {}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens

    def _learn(self, pieces: set[str]) -> list[str]:
        """Makes sure that `late` has all these pre-tokens; returns those that are too long to stay."""
        late, early, new = self.late, self.early, []
        for p in pieces:
            if p not in late:
                if p in early:
                    late[p] = early[p]
                else:
                    new.append(p)
        at = 0
        while at < len(new):
            some, size = [], 0
            while at < len(new) and (not some or size + len(new[at]) <= LIST):
                some.append(new[at])
                size += len(new[at])
                at += 1
            ids, ends = self.merges.ids([p.encode() for p in some])
            flat, ends = ids.tobytes(), (4 * ends).tolist()
            late.update(zip(some, (flat[a:b] for a, b in zip([0, *ends], ends))))
        return [p for p in new if len(p) > REMEMBERED_CHARS]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out, at = [], 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= GROUP):
                group.append(self.split(texts[at]))
                size += len(texts[at])
                at += 1
            long = self._learn(set(chain.from_iterable(group)))
            known = self.late.__getitem__
            out += [np.frombuffer(b"".join(map(known, pieces)), np.int32) for pieces in group]
            for p in long:
                del self.late[p]
            if len(self.late) > REMEMBERED:
                self.early, self.late = self.late, {}
        return out

    def decode(self, ids) -> bytes:
        """The bytes of known ids; an id without a token raises ValueError."""
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except IndexError as error:
            raise ValueError("an id has no token in this vocabulary") from error


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with `token_ids` (array<int>), the ids of the whole text, and `decoded` (binary), the bytes of those ids.

    A null text counts as empty: no ids, no bytes.  Repeated rows are encoded each, texts of any length whole, and an empty table gives
    no rows.  Columns that have these names are replaced.
    """

    def make():
        own = codec(path, pattern)

        def run(batch):
            ids = own.encode(common.texts(batch, text))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array([own.decode(x.tolist()) for x in ids], pa.binary())]

        return run

    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), True)), T.StructField("decoded", T.BinaryType())]
    return common.append(docs, fields, make, text)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """`df` with `decoded` (binary), the bytes of the ids in the column `ids`; null and empty arrays give no bytes."""
    kept = df.drop("decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for batch in batches:
            own = codec(path, pattern)
            new = pa.array([own.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """What identifies each encoding: its length and the hashes of its ids and of its bytes."""
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
