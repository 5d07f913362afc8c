"""Near copies by five-word shingles against brute force."""

import random

import numpy as np
import pytest

from skein.llm import simhash

rnd = random.Random(5)
LETTERS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_set(text):
    words = [w for w in (text or "").translate(LETTERS).replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_roots(texts):
    sets, up = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and up[i] != up[j]:
                old, new = up[i], up[j]
                up = [new if x == old else x for x in up]
    return up


def words(n):
    return [rnd.choice("alpha beta gamma delta Épsilon zeta eta theta".split()) + str(rnd.randint(0, 300)) for _ in range(n)]


def changed(of, n):
    of = of[:]
    for i in rnd.sample(range(len(of)), n):
        of[i] = "other" + str(rnd.randint(0, 10**6))
    return of


def sample():
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\tTWO"), (6, "one three"), (None, "no id"), (None, "No  id"), (None, "also no id"), (7, "same id"), (7, "but another text"), (8, "again"), (8, "again")]
    for k in range(25):
        base, at = words(rnd.choice([30, 100, 300, 900])), 1000 + 100 * k
        rows.append((at, " ".join(base)))
        for c in range(1, rnd.randint(3, 7)):  # from nearly equal to well below the threshold, and chains of copies of copies
            base = base if rnd.random() < 0.6 else changed(base, len(base) // 60)
            rows.append((at + c, " ".join(changed(base, int(len(base) * rnd.choice([0.002, 0.01, 0.015, 0.02, 0.025, 0.03]))))))
    passage = words(60)
    rows += [(9000 + i, " ".join(words(25) + passage + words(25))) for i in range(30)]  # alike, but no copies
    rnd.shuffle(rows)
    return rows


def check(spark, rows, tile=simhash.TILE):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    groups = {}
    for (i, t), root in zip(rows, plain_roots([t for _, t in rows])):
        groups.setdefault(root, []).append((i is None, i, t))
    got = simhash.drop_near_copies(docs, tile=tile).collect()
    lowest = [{(i, t) for none, i, t in g if (none, i) == min(x[:2] for x in g)} for g in groups.values()]
    assert len(got) == len(groups) and all(len(some & {tuple(r) for r in got}) == 1 for some in lowest)
    return got


def test_near_copies(spark):
    rows = sample()
    got = check(spark, rows)
    check(spark, rows, 20)
    assert {t for i, t in map(tuple, got) if i is None or i == 7} >= {"also no id", "same id", "but another text"}
    assert simhash.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_group(spark):
    """A chain whose lowest set is near few of the others, and every copy only near its neighbours."""
    base, rows = words(400), []
    for i in range(120):
        rows.append((i, " ".join(base)))
        base = changed(base, 3)
    check(spark, rows)


@pytest.mark.parametrize("shared, others", [(200, 30), (200, 60), (60, 200)])
def test_alike_but_not_near(spark, monkeypatch, shared, others):
    """Many texts with a common part: similarity about 0.77, 0.64 or 0.13 for most pairs, and a near copy of some."""
    monkeypatch.setattr(simhash, "SET_TILE", 64)
    template, rows = words(shared), []
    for i in range(250):
        own = template + [f"own{rnd.randint(0, 10**9)}" for _ in range(others)]
        rows.append((i, " ".join(own)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(changed(own, 2))))
    check(spark, rows)


def test_common_shingles():
    rng = np.random.default_rng(2)
    for most in (3, 60, 2000):
        a, b = ([np.unique(rng.integers(0, most, rng.integers(0, 90))) for _ in range(n)] for n in (37, 90))
        assert (simhash.common_shingles(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
    assert simhash.common_shingles([], a).shape == (0, 37) and simhash.common_shingles(a[:1], [np.empty(0, np.int64)]).tolist() == [[0]]


def test_star(spark, monkeypatch):
    """Many texts near one that lies between them, which meets more of them than one part has."""
    from skein.llm import common

    monkeypatch.setattr(common, "HOT", 7)
    base = words(400)
    check(spark, [(5000, " ".join(base)), *((i, " ".join(changed(base, 6))) for i in range(60))])


def test_stage_links_at_four_fifths(spark):
    """Pairs of similarity 0.8 to 0.95 become one document each in the pipeline's stage."""
    import corpus_pipeline as pipeline

    rows = []
    for k in range(40):
        base = words(300)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed(base, 1 + k % 6)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(5 * len(a & b) >= 4 * len(a | b) for a, b in ((plain_set(rows[i][1]), plain_set(rows[i + 1][1])) for i in range(0, 80, 2)))
    kept = pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))
