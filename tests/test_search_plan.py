"""Blocks of postings with bounds, kept frequencies, tables of queries, recall for many prompts, roots, chains and attribution."""

import random

import pytest
from files import A, B, header, message, write
from pyspark.sql import functions as F

from skein import api
from skein.api import SessionIndex
from skein.operators import blocks, fts, provenance, recall, roots, search
from skein.plans import tables as D
from skein.streaming.cuts import cut

DIR = "/root/testdata/sf0.01"
QUERIES = {1: "stupid trash the rights", 2: "idiot", 3: "all_rights_reserved of-the", 4: "the and of", 5: "zzzz", 6: "All_rights_reserved stupid", 7: "認証 the", 8: "idiot the"}


@pytest.fixture(scope="module")
def index(spark):
    sized = cut(fts.tokenized(D.chunked(D.posts(spark, DIR))).drop("text"))
    postings = cut(fts.postings(sized))
    return postings, cut(fts.corpus_stats(sized)), cut(fts.frequencies(postings)), cut(blocks.blocked(postings, blocks.spread(sized, 16)))


def by_query(rows):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r.source_key] = (r.bm25, r.session_id, r.origin_project_key)
    return found


def assert_best(found, ranked, most):
    """`found` has as many and as good matches as the best of `ranked`, each with its own score."""
    assert found.keys() == ranked.keys()
    for q, of in found.items():
        best = sorted(x[0] for x in ranked[q].values())[:most]
        assert sorted(x[0] for x in of.values()) == pytest.approx(best, rel=1e-9, abs=1e-15)
        assert all(x[1:] == ranked[q][k][1:] and x[0] == pytest.approx(ranked[q][k][0]) for k, x in of.items())


@pytest.mark.parametrize("most, project", [(5, None), (256, None), (20, "src3")])
def test_blocks(spark, index, most, project):
    """The best matches by blocks are those of ranking everything, and most blocks of a query with rare words are not read."""
    postings, stats, frequencies, blocked = index
    wanted = cut(fts.phrases_of(search.asked(spark, QUERIES, project)))
    ranked = by_query(fts.bm25(postings, stats, wanted).collect())
    found, read = blocks.best(blocked, frequencies, stats, wanted, most, cut=cut)
    assert_best(by_query(found.collect()), ranked, most)
    all_slots = {r.query_id: r.n for r in blocked.join(wanted, ["token", "field"]).groupBy("query_id").agg(F.count_distinct("slot").alias("n")).collect()}
    slots = {r.query_id: r.n for r in read.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert all(slots[q] <= all_slots[q] for q in slots)
    if most == 5 and project is None:
        assert slots[1] < all_slots[1] and slots[8] < all_slots[8] / 2


def test_blocks_of_a_frequent_word(spark):
    """A frequent word beside a rare one does not end the first slots before they have the best matches."""
    chunks = [(f"k{i:03}", "s", "p", f"the {'rare' if i % 50 == 0 else f'a{i}'} b{i} c{i}") for i in range(400)]
    sized = cut(fts.tokenized(spark.createDataFrame(chunks, "source_key string, session_id string, origin_project_key string, text string")).drop("text"))
    postings, stats = cut(fts.postings(sized)), cut(fts.corpus_stats(sized))
    wanted = cut(fts.phrases_of(search.asked(spark, {1: "rare the"})))
    found, read = blocks.best(cut(blocks.blocked(postings, blocks.spread(sized, 16))), fts.frequencies(postings), stats, wanted, 5, cut=cut)
    assert sorted(r.source_key for r in found.collect()) == ["k000", "k050", "k100", "k150", "k200"]
    assert read.count() <= 9


def test_blocks_of_dead_postings(spark, index):
    """Postings that no longer count neither match nor hide others."""
    postings, stats, _, blocked = index
    some = [r.source_key for r in postings.where("token = 'stupid'").select("source_key").limit(20).collect()]
    alive = ~F.col("source_key").isin(some)
    wanted = cut(fts.phrases_of(search.asked(spark, QUERIES)))
    frequencies = fts.frequencies(postings.where(alive))
    found, _ = blocks.best(blocked, frequencies, stats, wanted, 30, live=lambda df: df.where(alive), cut=cut)
    ranked = by_query(fts.bm25(postings.where(alive), stats, wanted).collect())
    assert_best(by_query(found.collect()), ranked, 30)


def test_kept_frequencies(spark, index):
    postings, _, frequencies, _ = index
    gone, new = postings.where("crc32(session_id) % 7 = 0"), postings.where("crc32(session_id) % 5 = 1").withColumn("token", F.concat("token", F.lit("x")))
    got = fts.changed_frequencies(frequencies, gone, new)
    want = fts.frequencies(postings.where("crc32(session_id) % 7 <> 0").unionByName(new))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_parsed(spark):
    rows = [(1, "Café login  auth_gateway"), (2, ""), (3, None), (4, "!!! ???"), (5, "x" * 500), (6, "x" * 501), (7, "  　 "), (8, "认证 登录"), (9, "é" * 40), (10, "词" * 683), (11, " ".join(f"w{i}" for i in range(60))), (12, "état")]
    got = {r.query_id: (r.terms, r.reason) for r in fts.parsed(spark.createDataFrame(rows, "query_id long, text string")).collect()}
    for i, text in rows:
        try:
            assert got[i] == (fts.parse_query(text or ""), None)
        except fts.QueryInvalid:
            assert got[i] == ([], "query-invalid")
    phrases = fts.phrases_of(fts.parsed(spark.createDataFrame(rows[:1], "query_id long, text string")))
    assert sorted((r.phrase, r.field, r.k, r.token, r.m) for r in phrases.collect()) == [(0, "content", 0, "caf", 1), (1, "cjk", 0, "caf", 1), (2, "content", 0, "login", 1), (3, "cjk", 0, "login", 1), (4, "content", 0, "auth", 2), (4, "content", 1, "gateway", 2), (5, "cjk", 0, "auth", 2), (5, "cjk", 1, "gateway", 2)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    rnd = random.Random(1)
    vocabulary = [f"word{i}" for i in range(40)]
    for s in range(30):
        write(root / f"{s:02}.jsonl", header(f"s{s}", (A, B)[s % 2]), *(message(f"e{s}-{k}", "user", " ".join(rnd.choices(vocabulary, k=12)) + f" session{s}") for k in range(4)))
    index = SessionIndex(spark, str(tmp_path_factory.mktemp("home") / "index"))
    index.setup([str(root)], auto_recall=True)
    index.index()
    return index, root


def recounted(index):
    """The kept frequencies and totals are those of the chunks."""
    sized = fts.tokenized(index.store.table("chunks"))
    want, got = fts.frequencies(fts.postings(sized)), index.store.table("frequencies")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert tuple(index.store.stats().first()) == tuple(fts.corpus_stats(sized).first())
    assert index.store.integrity()["ready"]


def test_segments(built, monkeypatch):
    """Frequencies, totals and hits stay right through changes, exclusion and deletion, also when segments are made one."""
    index, root = built
    recounted(index)
    monkeypatch.setattr("skein.sources.store.MOST_SEGMENTS", 4)
    before = len(index.store.state["segments"])
    write(root / "00.jsonl", header("s0"), message("n1", "user", "brandnewword word1"))
    index.index()
    recounted(index)
    assert len(index.store.state["segments"]) == before + 1 and [r.entry_id for r in index.search("session0 brandnewword").collect()] == ["n1"]
    index.exclude_session("s1")
    (root / "02.jsonl").unlink()
    index.index()
    recounted(index)
    assert index.search("session1").isEmpty() and index.search("session2").isEmpty() and len(index.store.state["segments"]) == 1
    monkeypatch.setattr(api, "EXHAUSTIVE", 0)
    by_blocks = [tuple(r) for r in index.search({1: "word1 word2", 2: "session3 word7", 3: "brandnewword"}, as_of="2026-02-01T00:00:00Z", limit=20).collect()]
    monkeypatch.setattr(api, "EXHAUSTIVE", 10**9)
    whole = [tuple(r) for r in index.search({1: "word1 word2", 2: "session3 word7", 3: "brandnewword"}, as_of="2026-02-01T00:00:00Z", limit=20).collect()]
    assert [r[:-1] for r in by_blocks] == [r[:-1] for r in whole] and all(abs(a[-1] - b[-1]) < 1e-9 for a, b in zip(by_blocks, whole))


def test_recall_all(spark, built):
    """Many prompts in one plan get what each gets alone."""
    index, _ = built
    key = index.project_key(A)
    rows = [("r1", "word3 word4 word5", key, None), ("r2", "  ", key, None), ("r3", "nosuchword", key, None), ("r4", "word3", None, None), ("r5", "x" * 600, key, None), ("r6", "session4 word1", key, "s4"), ("r7", "!?", key, None), ("r8", "session4", key, None)]
    got = {r.request_id: r for r in index.recall_all(spark.createDataFrame(rows, "request_id string, prompt string, project string, session string"), "2026-02-01T00:00:00Z").collect()}
    assert {k: r.reason for k, r in got.items() if r.reason} == {"r2": "empty-prompt", "r3": "no-hit", "r4": "project-unresolved", "r5": "query-invalid", "r7": "query-invalid"}
    for request, prompt, project, session in rows:
        alone = index.auto_retrieve(prompt, A if project else "", request, session, "2026-02-01T00:00:00Z")
        assert alone.get("envelope") == got[request].envelope and alone.get("reason") == got[request].reason
    assert "sessionId: s4\n" in got["r8"].envelope and "sessionId: s4\n" not in (got["r6"].envelope or "")
    closed = recall.gated(spark.createDataFrame(rows, "request_id string, prompt string, project string, session string"), "auto-off")
    assert {r.reason for r in closed.collect()} == {"auto-off"}


def test_roots(spark):
    table = roots.table(spark, ["/data", "/data/a", "/data/a/b/", "/", "/other"])
    paths = spark.createDataFrame([("/data/a/b/x.jsonl",), ("/data/ab/x",), ("/data",), ("relative/x",), ("/elsewhere/y",)], "path string")
    assert sorted((r.path, r.root) for r in roots.holding(paths, table).collect()) == [("/data", "/"), ("/data/a/b/x.jsonl", "/"), ("/data/a/b/x.jsonl", "/data"), ("/data/a/b/x.jsonl", "/data/a"), ("/data/a/b/x.jsonl", "/data/a/b"), ("/data/ab/x", "/"), ("/data/ab/x", "/data"), ("/elsewhere/y", "/")]
    assert {r.path: r.root for r in roots.owners(paths, table.where("root <> '/'")).collect()} == {"/data/a/b/x.jsonl": "/data", "/data/ab/x": "/data"}


def test_diagnostics(spark, tmp_path):
    """Diagnostics are added by day, and days long past go."""
    index = SessionIndex(spark, str(tmp_path / "home"))
    index.store.diagnose("old", "gone soon", at="2020-01-01T00:00:00Z")
    index.store.diagnose("query-invalid", "a\nb" * 300)
    rows = index.store.table("diagnostics").collect()
    assert [(r.code, len(r.detail)) for r in rows] == [("query-invalid", 500)]


def plain_chain(parent, status, path, most=32):
    up, at, seen = [], path, []
    while parent.get(at) is not None or at == path:
        at = parent.get(at)
        if at not in status:
            return up, "parent-missing"
        if at in seen:
            return up, "parent-cycle"
        if status[at] != "ok":
            return up, "parent-missing"
        if len(up) == most:
            return up, "parent-chain-too-deep"
        seen.append(at)
        up.append(at)
    return up, None


def test_chains(spark):
    """Chains of all kinds in six rounds at most."""
    rnd = random.Random(8)
    names = [f"/r/n{i:03}" for i in range(240)]
    parent = {n: None if i % 17 == 0 else names[i - 1] if i < 80 else rnd.choice(names + ["/r/gone"]) for i, n in enumerate(names)}
    parent |= {names[100]: names[100], names[101]: names[102], names[102]: names[101]} | {names[i]: names[i - 1] for i in range(1, 60)} | {names[60]: names[32], names[61]: names[31], names[0]: None}
    status = {n: "bad" if i % 41 == 40 else "ok" for i, n in enumerate(names)}
    rows = [(n, n.upper(), status[n], parent[n], "p") for n in names]
    rounds = []
    sessions = spark.createDataFrame(rows, "path string, session_id string, status string, parent_session string, project_key string")
    links, broken = provenance.chains(sessions, ["/r"], lambda df: rounds.append(1) or cut(df))
    assert len(rounds) <= 7
    got = {}
    for r in links.collect():
        got.setdefault(r.path, {})[r.depth] = r.ancestor
    why = {r.path: r.reason for r in broken.collect()}
    for n in names:
        up, reason = plain_chain(parent, status, n) if parent[n] else ([], None)
        assert [got.get(n, {}).get(i) for i in range(len(got.get(n, {})))] == up and why.get(n) == reason, n
    few, _ = provenance.chains(sessions, ["/r"], cut, spark.createDataFrame([(names[59],)], "path string"))
    assert {r.path for r in few.collect()} == {names[59]}


def test_one_ancestor_of_many(spark):
    """An ancestor of thousands of sessions is met in parts, with the same result."""
    sessions = spark.createDataFrame([("/r/old", "old", "ok", None, "p0"), *((f"/r/f{i}", f"f{i}", "ok", "/r/old", f"p{1 + i % 3}") for i in range(3000))], "path string, session_id string, status string, parent_session string, project_key string")
    rows = [("/r/old", k, f"e{k}", f"print{k}") for k in range(3)]
    rows += [(f"/r/f{i}", 0, "e0", "print0") for i in range(3000)] + [(f"/r/f{i}", 1, "e1", "changed" if i % 2 else "print1") for i in range(3000)] + [(f"/r/f{i}", 2, f"own{i}", f"own{i}") for i in range(3000)]
    messages = spark.createDataFrame(rows, "path string, pos int, entry_id string, fingerprint string")
    links, _ = found = provenance.chains(sessions, ["/r"], cut)
    met = provenance._met(links, messages, 100)
    assert met.groupBy("ancestor", "entry_id", "part").count().agg(F.max("count")).first()[0] < 300
    got = {(r.path, r.entry_id): (r.provenance, r.origin_project_key) for r in provenance.attribute(sessions, messages, ["/r"], cut, found, 100).collect()}
    for i in range(3000):
        assert got[f"/r/f{i}", "e0"] == ("verified", "p0") and got[f"/r/f{i}", f"own{i}"] == ("verified", f"p{1 + i % 3}")
        assert got[f"/r/f{i}", "e1"] == (("unresolved", None) if i % 2 else ("verified", "p0"))
