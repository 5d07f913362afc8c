"""The trie of conversations against a plain one, on odd rows, long conversations and small bands."""

import collections
import hashlib
import random
import zlib

import pytest

from skein.llm import prefix_trie as P

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """Nodes from (conv_id, turn, role, text), by walking each rebuilt conversation."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{role or ''}\n{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(of)] for c, of in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100 * (1 if c >= 0 else -1))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    below = collections.defaultdict(lambda: [0, 0])
    children = collections.Counter(p[:-1] for p in members if p)
    for p, of in members.items():
        saved = (len(of) - 1) * (len(p[-1][1]) if p else 0)
        for d in range(len(p) + 1):
            below[p[:d]][0] += not children[p]
            below[p[:d]][1] += saved
    hashed = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return sorted(((of[0], len(p), members[p[:-1]][0] if p else None, len(of), children[p], *below[p], hashed(p)) for p, of in members.items()), key=repr)


def nodes(df, band=P.BAND):
    found = P.trie(*P.rebuilt(P.turns(df)), band)
    assert tuple(found.columns) == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, C string").repartition(5)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    found = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", "a", "hé", None, "日本語"])) for c in (*range(0, 60), *range(200, 230), *range(301, 320), -3, -100, 10**15) for t in range(rnd.randint(1, 7))]
    found += [(400 + i, t, "user", f"same {t}") for i in range(25) for t in range(5)]  # copies, and a base
    found += [(7, None, "user", "first"), (7, None, "user", "before"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 0, "user", "nobody"), (10**12 + 1, 0, None, None)]
    return found


@pytest.mark.parametrize("band", [3, 8])
def test_trie(spark, rows, band):
    assert nodes(table(spark, rows), band) == plain(rows)


def test_long_conversations(spark, monkeypatch):
    """Conversations of many blocks and bands, which share long beginnings, and ends in many blocks of ids."""
    monkeypatch.setattr(P, "BLOCK_BANDS", 3)
    monkeypatch.setattr(P, "ID_BITS", 1)
    rows = [(c, t, "user", str(t if t < 40 + c else c * t)) for c in range(8) for t in range(90)] + [(1000 + 100 * i, 0, "user", "one") for i in range(9)]
    assert nodes(table(spark, rows), 2) == plain(rows)


def test_one_conversation_over_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = [(100, t, "user", "x" * (t % 3)) for t in range(300)] + [(101, 0, "user", "y")]
    try:
        assert nodes(table(spark, rows)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_conversations(spark):
    assert nodes(table(spark, []).limit(0)) == [] and nodes(table(spark, [(None, 1, "user", "x")])) == []
