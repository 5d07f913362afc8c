"""Recall, leakage and injection on the judged corpus, with the gates that are to hold."""

import pytest
from files import A
from judged import MAIN, PROBES, build

from skein.api import SessionIndex
from skein.operators import evaluate


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("judged")
    queries = build(root)
    index = SessionIndex(spark, str(tmp_path_factory.mktemp("home") / "index"))
    index.setup([str(root)], auto_recall=True)
    index.index()
    keys = {cwd: index.project_key(cwd) for cwd in {q[2] for q in queries}}
    return index, queries, keys


def test_gates(spark, searched):
    index, queries, keys = searched
    prompts = spark.createDataFrame([(q[0], q[1], keys[q[2]]) for q in queries], "query_id long, text string, project string")
    judgments = spark.createDataFrame([(q[0], q[3], q[4], q[5], keys.get(q[6]), q[7]) for q in queries], "query_id long, pool string, holdout boolean, relevant array<string>, foreign string, hidden string")
    hits, bad = index.search_all(prompts, "2026-02-01T00:00:00Z")
    assert bad.isEmpty()
    found = evaluate.gates(evaluate.judged(hits, judgments), MAIN).first()
    assert found.queries == 62 and found.recall >= 0.9 and found.holdout_recall >= 0.85
    assert (found.leaks, found.exposed, found.failed) == (0, 0, 0)


def test_probes(spark, searched):
    """What has no answer is given none."""
    index, _, keys = searched
    probes = spark.createDataFrame([(i, text, keys[A], "now") for i, text in enumerate(PROBES)], "request_id long, prompt string, project string, session string")
    told = index.recall_all(probes).collect()
    assert sum(r.envelope is not None for r in told) / len(told) <= 0.05 and {r.reason for r in told} == {"no-hit"}


def test_same_order(searched):
    index, _, _ = searched
    orders = {tuple((r.session_id, r.entry_id) for r in index.search("noise meeting", "project", A, "2026-02-01T00:00:00Z").collect()) for _ in range(5)}
    assert len(orders) == 1 and len(next(iter(orders))) == 5


def test_judged_counts(spark):
    """The measures themselves: leaks, exposures, misses and a query that should have no hit."""
    hits = spark.createDataFrame([(1, "k1", "e1", "p", "x", 2.0), (1, "k2", "e9", "q", "a secret word", 1.0), (3, "k3", "e3", "p", "x", 1.0), *((4, f"k{i}", f"e{i}", "p", "x", float(i)) for i in range(10, 17))], "query_id long, source_key string, entry_id string, origin_project_key string, text string, score double")
    rows = [(1, "a", True, ["e1"], "q", None), (2, "a", False, [], None, None), (3, "b", True, [], "z", "x"), (4, "a", False, ["e10"], None, None), (5, "a", False, ["e1"], None, None)]
    queries = spark.createDataFrame(rows, "query_id long, pool string, holdout boolean, relevant array<string>, foreign string, hidden string")
    got = {r.query_id: (r.hit, r.leaked, r.exposed) for r in evaluate.judged(hits, queries).collect()}
    assert got == {1: (False, True, False), 2: (True, False, False), 3: (False, False, True), 4: (False, False, False), 5: (False, False, False)}
    assert tuple(evaluate.gates(evaluate.judged(hits, queries), ["a"]).first()) == (5, 0.25, 0.0, 1, 1, 4)
