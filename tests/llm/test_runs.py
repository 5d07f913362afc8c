"""Periodic runs against a search of all periods, and the whole query against plain Python."""

import fractions
import hashlib
import random
import re
import zlib

import pytest

from skein.llm import queries, runs

DIR = "/root/testdata/sf0.001"


def plain(words):
    """(start, length, smallest period) of the runs, by trying all periods."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if (length := j - i + q) >= max(6, 4 * q) and j > i:
                found.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted((i, length, q) for (i, length), q in found.items())


def kept(words, of):
    gone = {i for start, length, q in of for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def sample(rnd, n, kinds):
    words = [b"%d" % rnd.randrange(kinds) for _ in range(n)]
    if n and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randint(3, 10)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    if n > 10 and rnd.random() < 0.3:
        inner = words[: rnd.randint(1, 4)] * rnd.randint(3, 6)
        words = (inner + [b"between"] + inner) * rnd.choice([1, 5]) + words
    return words


def test_runs():
    rnd = random.Random(4)
    for _ in range(400):
        texts = [sample(rnd, rnd.choice([0, 1, 5, 6, 7, 20, 60, 200]), rnd.choice([1, 2, 3, 5, 30])) for _ in range(rnd.randint(1, 6))]
        assert runs.word_runs(texts) == [plain(x) for x in texts]


def test_special_words():
    thue = [b"%d" % (i.bit_count() % 2) for i in range(1 << 10)]  # no part is more than twice repeated
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[1]) < 2000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert runs.word_runs([thue, fibonacci[1], [b"x"] * 5000, [b"x"] * 5, [b"x"] * 6, [b"x", b"y"] * 4, [b"x", b"y"] * 3 + [b"x"]]) == [[], plain(fibonacci[1]), [(0, 5000, 1)], [], [(0, 6, 1)], [(0, 8, 2)], []]


def test_find(spark):
    rows = [(1, None, 3), (2, "", 3), (3, " \n", 3), (None, "a a a a a a a b", 3), (5, "x y x y x y x y " * 100 + "é", 3), (5, "one\x0btwo\x1cthree  four", 3), (5, "one\x0btwo\x1cthree  four", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS int").repartition(3)
    found = runs.find(docs)
    assert found.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in found.collect()), key=repr)
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    assert got == sorted(((i, len(words(t)), plain(words(t)), b" ".join(kept(words(t), plain(words(t))))) for i, t, _ in rows), key=repr)
    assert runs.find(docs.limit(0)).collect() == []


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    of = plain(words)
    best = min(of, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(of, key=lambda r: (r[0], r[2])))
    return doc_id, len(of), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(" ".join(kept(words, of)).encode()).hexdigest()


def test_query(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    small = [r for r in docs if len(r.text or "") < 9000]  # trying all periods is quadratic; the query itself takes all
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_runs"](spark, DIR).collect()}
    assert len(got) == len(docs) and len(small) > 150
    for r in small:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
    assert sum(x[1] > 0 for x in got.values()) > 15


@pytest.mark.parametrize("text", [None, "", "one", "a b c d e f g h i j k l"])
def test_planted(spark, text):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:20] + [1, 2]
    docs = spark.createDataFrame([(i, text) for i in [*ids, None]], "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in runs.digests(runs.find(runs.planted(docs))).collect()}
    assert [got[i] for i in ids] == [expected(i, text) for i in ids] and got[None][1] == 0
