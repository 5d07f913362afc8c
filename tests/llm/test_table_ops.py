"""Outlier rules, mixing, URL filters and the pipeline on small fixtures, against plain Python and SQL."""

import collections
import glob
import os
import random
import re

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from skein.llm import mixing, outliers, queries, url_filter

DIR = "/root/testdata/sf0.001"
rnd = random.Random(23)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df, other = queries.QUERIES[name](spark, DIR), duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r) for r in other.select(*columns).fetchall()), key=repr)


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n)) + "\nend of " + str(seed)


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, prose(rnd.randint(55, 200), i), "en", f"s{i % 2}") for i in range(600)]
    rows += [(1000 + i, prose(60, i).upper().replace(" ", " ### "), "en", "s0") for i in range(40)]
    rows += [(2000, None, None, None), (2001, "", "en", "s0"), (2002, "a b c " * 40, "en", "s0"), (2003, "x\n" * 30 + prose(60, 1), None, "s1"), (2004, "a b", "de", "s9"), (None, prose(80, 3), "en", None), (2005, prose(70, 9) + " é日本 \x0b\x1c x", "fr", "s1"), (5, rows[5][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, Kept int").repartition(3)
    return rows, outliers.judge(docs)


def test_outliers(judged):
    rows, found = judged
    got = found.collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=repr) == sorted(((i, *plain_statistics(t)) for i, t, _, _ in rows), key=repr)
    by_id = {r.doc_id: r for r in got}
    assert not any(r.kept and r.base_failed for r in got)
    assert all(by_id[i].kept for i in range(600)) and not any(by_id[1000 + i].kept for i in range(40))
    assert by_id[None].kept and by_id[2005].kept  # too few of their group to judge
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_outlier_estimate(spark):
    """The estimate of a contaminated normal group is near that of its clean part, and distances follow from it."""
    rng = np.random.default_rng(5)
    p = len(outliers.VECTOR)
    floors = np.array([s for _, s in outliers.VECTOR])
    clean = rng.normal(size=(3000, p)) @ (np.diag(floors * 4) + 0.05) + np.arange(p)
    mixed = np.concatenate([clean, rng.normal(size=(500, p)) * 0.2 + 9])
    x = spark.createDataFrame([("g", *map(float, r)) for r in mixed], "g string, " + ", ".join(f"x{i} double" for i in range(p)))
    f = outliers.estimates(x).first()
    mean, root = np.array([f[f"m{i}"] for i in range(p)]), np.array([[f[f"l{i}_{j}"] if j <= i else 0 for j in range(p)] for i in range(p)])
    want = np.cov(clean.T) + np.diag(floors**2)
    assert mean == pytest.approx(clean.mean(axis=0), abs=0.1) and root @ root.T == pytest.approx(want, rel=0.2, abs=0.05 * want.max())
    assert outliers.chi2_share(outliers.chi2_limit(0.95, 5), 5) == pytest.approx(0.95) and outliers.chi2_limit(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def plain_mcd(x, starts=20, seed=1):
    """The mean of the core of three quarters with the least determinant, from random starts and full concentration."""
    rng, best, h = np.random.default_rng(seed), None, int(np.ceil(0.75 * len(x)))
    floors = np.diag([s**2 for _, s in outliers.VECTOR])
    for _ in range(starts):
        core = x[rng.choice(len(x), len(floors) + 1, replace=False)]
        for _ in range(50):
            d = x - core.mean(axis=0)
            core = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(core.T, bias=True) + floors), d))[:h]]
        det = np.linalg.slogdet(np.cov(core.T, bias=True) + floors)[1]
        if best is None or det < best[0]:
            best = det, core
    return best[1]


def test_outlier_starts(spark):
    """Groups of different sizes whose junk lies apart: the reweighted centre is that of the core with the least determinant."""
    rng, groups, p = np.random.default_rng(8), {}, len(outliers.VECTOR)
    floors = np.array([s for _, s in outliers.VECTOR])
    for g, n in (("a", 60), ("b", 400), ("c", 1500)):
        mix = rng.normal(size=(p, p)) * floors * 2
        groups[g] = np.concatenate([rng.normal(size=(n, p)) @ mix, rng.normal(size=(n // 5, p)) * floors + 40 * floors * rng.choice([-1, 1], p)])
    x = spark.createDataFrame([(g, *map(float, r)) for g, rows in groups.items() for r in rows], "g string, " + ", ".join(f"x{i} double" for i in range(p)))
    for f in outliers.estimates(x).collect():
        rows, n = groups[f.g], len(groups[f.g]) * 5 // 6
        root = np.array([[f[f"l{i}_{j}"] if j <= i else 0 for j in range(p)] for i in range(p)])
        distance = lambda v: np.linalg.norm(np.linalg.solve(root, v))  # noqa: B023, E731
        assert distance(np.array([f[f"m{i}"] for i in range(p)]) - plain_mcd(rows).mean(axis=0)) < 1.0 / np.sqrt(n / 60)
        limit = spark.range(1).select(outliers.limit(F.lit(f.n), 1e-5)).first()[0] ** 0.5
        m = np.array([f[f"m{i}"] for i in range(p)])
        assert f.n <= n * 1.02 and all(distance(r - m) > limit for r in rows[n + 1 :]) and np.mean([distance(r - m) > limit for r in rows[: n - 1]]) < 0.02


def test_outlier_limit(spark):
    at = lambda n: spark.range(1).select(outliers.limit(F.lit(n), 0.001)).first()[0]
    assert at(10**7) == pytest.approx(outliers.chi2_limit(0.999, 5), rel=0.02) and at(30) > at(100) > at(1000)


def test_long_repeats(spark, monkeypatch):
    """Texts with more windows than fit beside their positions count their repeats as exactly."""
    monkeypatch.setattr(outliers, "FAST_WINDOWS", 20)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(n)) for n in (10, 21, 22, 23, 60, 300, 900)] + ["w" * 9, "one two three four " * 8]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.id: r.n_repeat_words for r in outliers.statistics(docs).collect()}
    assert got == {i: plain_statistics(t)[4] for i, t in enumerate(texts)}


def test_outliers_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert outliers.judge(empty).collect() == []


def plain_targets(sizes, most=3):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, weights = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / weights for s in sizes}
        more = {s for s in sizes if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not more:
            return target
        capped |= more


def test_mixing_odds(spark):
    """Certain copies go to all; of the rest, documents of more words are taken more often, and ties of repeated rows together."""
    rows = [(i, "big" if i % 4 else "small", " ".join(["w"] * (25 if i % 2 else 400))) for i in range(4000)]
    docs = spark.createDataFrame(rows + [(9, "big", "tie")] * 3, "doc_id long, source string, text string")
    got = collections.defaultdict(list)
    ties = set()
    for r in mixing.shares(docs).collect():
        got[r.target > r.source_size, r.size].append(r.taken / r.size)
        if r.size == 1:
            ties.add(r.taken)
    assert len(ties) == 1
    for more in {k[0] for k in got}:
        short, long = np.array(got[more, 25] or [0]), np.array(got[more, 400] or [0])
        whole = np.floor(min(short.min(), long.min()))
        assert set(np.unique(np.concatenate([short, long]))) <= {whole, whole + 1}
        if len(short) > 50 and len(long) > 50:
            assert long.mean() > short.mean() + 0.1


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 1000, None: 5}, {"a": 0, "é": 10, "z": 30, "zz": 1, "b": 70}, {"only": 7}, {"a": 1, "b": 1, "c": 1, "d": 100, "e": 1, "f": 50}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mixing(spark):
    rows = [(i, rnd.choice(["a", "b", "c", "d", None]), " ".join(["w"] * rnd.randint(0, 30))) for i in range(3000)]
    rows += [(7, rows[7][1], "twice said"), (None, "b", "no id"), (9000, None, None), (9001, "tiny", "one"), (9002, "none", "")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, text string, Target double").repartition(3)
    found = mixing.shares(docs)
    got = found.collect()
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(dict(sizes))
    source = {i: s for i, s, _ in rows}
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 31 for s in want)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.shares(docs.repartition(5)).collect()))
    assert "Python" not in found._jdf.queryExecution().toString()
    whole = mixing.mix(docs)
    copies = collections.Counter(r.doc_id for r in whole.collect())
    assert whole.columns == docs.columns and all(copies[r.doc_id] * r.size == r.taken for r in got if r.doc_id != 7 and r.size)
    assert mixing.shares(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for says, rule in rules:
        of, start = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if (host == of or host.endswith("." + of)) and path.startswith(start):
            best = max(best or (), (of.count("."), len(start), rule, says))
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


@pytest.mark.parametrize("most_rules", [url_filter.MOST_RULES, 3])
def test_url_filter(spark, most_rules):
    names = {".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))) + "/" + rnd.choice(["", "x", "x/", "x/y", "xy/z/", "xy"]) for _ in range(60)}
    rules = [(rnd.choice(["allow", "block"]), r) for r in sorted(names)]
    ends = ["", "/", "/x", "/x/", "/x/y", "/xy/z", "/xyz?a", "#x", "/x/yy", "//x", "?://b/x", "/x#y"]
    urls = [rnd.choice(["http://", "", "x", "HTTP://a://", "://"]) + ".".join(rnd.choice("abcCÉ") for _ in range(rnd.randint(1, 4))) + rnd.choice(ends) for _ in range(1500)] + [None, "", "://", "http://a:80/x", "a\nb://c/x\ny"]
    df = spark.createDataFrame([(i % 1400, u, "q", 1) for i, u in enumerate(urls)], "page_id long, url string, Host string, verdict int")
    got = url_filter.filter_urls(df, rules, most_rules=most_rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, ((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()))) == sorted(repr((i % 1400, u, *plain_verdict(u, rules))) for i, u in enumerate(urls))
    listed = spark.createDataFrame(rules, "verdict string, rule string")
    assert url_filter.filter_urls(df, listed, most_rules=most_rules).where("verdict = 'block'").count() == got.where("verdict = 'block'").count()
    assert url_filter.filter_urls(df.limit(0), rules, most_rules=most_rules).collect() == []


def test_url_rules(spark):
    with pytest.raises(ValueError, match="not a rule"):
        url_filter.filter_urls(spark.createDataFrame([("x",)], "url string"), [("maybe", "a/")])


@pytest.mark.parametrize("rows", [0, 1])
def test_pipeline_odd_rows(spark, tmp_path, rows):
    """Repeated ids and rows, nulls in all columns, a very long text, other columns with names the stages use, or no row at all."""
    import corpus_pipeline as pipeline

    long = prose(60_000, 5)
    odd = [(1, "the first of two texts with one id " + prose(60, 1), "en", "a"), (1, "the second of two texts with one id " + prose(60, 2), "en", "a"), (2, "said twice " + prose(60, 3), "en", None)]
    odd += [odd[2], (None, "no id " + prose(60, 4), "en", "a"), (None, None, None, None), (3, "", "de", "b"), (4, long, "en", "b")] + [(10 + i, "und das ist der Text " + prose(50, 20 + i), "de", "b") for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, Score double, root string, removed int, row int, token_ids string"
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1.0, "r", 7, None, "x") for i, t, lang, s in odd][: len(odd) * rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet" if k == 0 else f"{tmp_path}/{k - 1}"), str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
    out = spark.read.parquet(f"{tmp_path}/4").collect()
    kept = spark.read.parquet(f"{tmp_path}/2").collect()
    assert k == 4 and all(r.round_trip for r in out)
    if not rows:
        assert out == []
        return
    near = {(r.doc_id, r.text) for r in kept}
    assert {(i, t) for i, t, _, _ in odd if i in (1, 2, None, 4) and t} == near - {x for x in near if (x[0] or 0) >= 10} and sum(r.doc_id == 2 for r in kept) == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    passage = prose(90, 77)
    rows = [(i, f"{prose(80, 100 + i)} the and with that this from have they", "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[0][1] + (" more" if i % 2 else ""), "en", "s0", 1) for i in range(5)]  # near copies of document 0
    rows += [(200 + i, f"{prose(60, 500 + i)} {passage} {prose(50, 600 + i)}", "en", "s1", 1) for i in range(3)]  # share a passage
    rows += [(300, None, "en", "s0", 0), (301, "12345 !!", None, None, 8), (302, prose(40, 9), None, None, 5)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept[name] = docs.collect()
        assert i == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    assert ids["language"] == {r[0] for r in rows} - {300, 301}
    assert ids["near copies"] == ids["language"] - {100, 101, 102, 103, 104}
    cut = {r.doc_id: r for r in kept["repeats"]}
    texts = {r[0]: r[1] for r in rows}
    assert all(cut[i].text == texts[i] for i in ids["near copies"] if i < 100) and all(passage not in cut[200 + i].text and cut[200 + i].n_chars == len(cut[200 + i].text) for i in range(3))
    size = lambda rows: collections.Counter({s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}})
    want, taken = plain_targets(dict(size(kept["repeats"]))), size(kept["mix"])
    assert all(abs(taken[s] - want[s]) <= 200 for s in want)
    assert len(kept["encode"]) == len(kept["mix"]) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in kept["encode"])
    run = pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.n_tokens) for r in run.collect()) == sorted((r.doc_id, r.n_tokens) for r in kept["encode"])
