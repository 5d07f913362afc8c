"""Line dedup against plain Python: odd lines, ties, hot lines, and filters too small for what they hold."""

import collections
import hashlib
import random

import numpy as np
import pytest

from skein.llm import line_dedup as L


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def plain(rows):
    """(doc_id, n_lines, numbers of dropped lines, kept text) for rows (doc_id, text)."""
    order = lambda i: (i is None, i or 0)
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [n for n, line in enumerate(lines) if len(key(line)) >= 10 and len(holders[key(line)]) > 1 and min(holders[key(line)], key=order) != i]
        kept = None if text is None else "\n".join(line for n, line in enumerate(lines) if n not in gone)
        out.append((i, len(lines), gone, kept))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, Dropped int, key string").repartition(4)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    some = [*(f"a line of text {i}" for i in range(60)), "short", "ninechars", "ten chars!", "  TEN chars!\t", "日本語日本語日本語日", "日本語日本語日本語", "É is not é, long", "é is not é, long", "", " \x0b\x0c", "a\rb carriage return", "\x1c not white space \x1c", "not white space", "x" * 70_000]
    found = [(i, "\n".join(rnd.choices(some, k=rnd.randint(0, 12)) + ["Terms and conditions apply here"] * rnd.randint(0, 2))) for i in range(400)]
    return found + [(None, None), (None, "a line of text 1\nonly here, and twice\nonly here, and twice"), (5, found[5][1]), (5, "another text of document 5\na line of text 2"), (900, ""), (901, None), (902, "\n\n"), (None, "of two null ids\na line of text 3"), (None, "of two null ids")]


@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_dedup(spark, rows, bits, monkeypatch):
    monkeypatch.setattr(L, "LEAST_BITS", min(bits, 1 << 10))
    found = L.dedup(table(spark, rows), most_bits=bits)
    assert found.columns == ["doc_id", "text", "key", "n_lines", "dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.dropped, r.text) for r in found.collect()), key=repr)
    assert got == plain(rows)
    digests = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in L.digests(found).collect()}
    assert digests == {(i, n, len(gone), hashlib.sha256((kept or "").encode()).hexdigest()) for i, n, gone, kept in plain(rows)}


def test_full_filter(spark, rows):
    """A filter in which all bits are set suspects all lines, and nothing changes."""
    got = sorted(((r.doc_id, r.n_lines, r.dropped, r.text) for r in L.dedup(table(spark, rows), most_bits=64).collect()), key=repr)
    assert got == plain(rows)


def test_filters(spark):
    """All that two documents have is suspected, and little else."""
    lines = [f"this is line number {i}" for i in range(20_000)]
    docs = table(spark, [(i, "\n".join(lines[i * 100 : i * 100 + 110])) for i in range(200)])
    bits = L.filter_bits(docs)
    assert bits == 1 << (8 * 21_990).bit_length()
    twice = L.Filter(bits, L.seen_twice(docs, bits))
    found = twice.has(L._hashes(L.line_keys("\n".join(lines))))
    shared = np.array([i % 100 < 10 and i >= 100 for i in range(20_000)])
    # A key is suspected by mistake if its bits were set by others: a sixth of all bits are, so both of its bits are once in forty.
    assert found[shared].all() and found[~shared].mean() < 0.025
    assert L.filter_bits(docs, most_bits=1 << 12) == 1 << 12


def test_empty(spark):
    assert L.dedup(table(spark, [(1, "x")]).limit(0)).collect() == []
    assert [(r.n_lines, r.dropped, r.text) for r in L.dedup(table(spark, [(None, None)])).collect()] == [(1, [], None)]
