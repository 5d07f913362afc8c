"""Findings of a review: ties, and what large tables cost."""

import pytest
from pyspark.sql import functions as F

from skein.functions import policy
from skein.functions import text as X
from skein.operators import blocks, fts, search

ROWS = [(f"k{i}", f"s{i}", "p", "user", "2025-01-01T00:00:00Z", "same", "alpha beta gamma", i) for i in range(3)]


def chunks(spark):
    return spark.createDataFrame(ROWS, "source_key string, session_id string, origin_project_key string, role string, occurred_at string, content_hash string, text string, i long").selectExpr(
        "*", "'0' AS entry_id", "true AS auto_eligible", "'verified' AS provenance"
    )


@pytest.mark.parametrize("worse", [1, 2])
def test_scores_that_differ_in_their_last_bits_tie(spark, worse):
    """Of equal texts the one with the lowest key is the hit, whatever the order in which its score was summed."""
    matches = spark.createDataFrame([(1, f"k{i}", f"s{i}", "p", -(0.1 + 0.2 + 0.3) if i == worse else -(0.3 + 0.2 + 0.1)) for i in range(3)], "query_id long, source_key string, session_id string, origin_project_key string, bm25 double")
    rows = chunks(spark)
    active = rows.selectExpr("session_id", "'active' AS status")
    asked = search.asked(spark, {1: "alpha beta gamma"})
    assert [r.source_key for r in search.search(matches, rows, active, asked, "2026-06-01 00:00:00").collect()] == ["k0"]


TEXTS = ["alpha beta alpha 登录 认证", "beta, gamma: alpha-beta", "", "书", "\U00020000\U00020001\U00020002 alpha"]


@pytest.fixture(scope="module")
def sized(spark):
    return fts.tokenized(spark.createDataFrame([(f"k{i}", f"s{i}", "p", t) for i, t in enumerate(TEXTS)], "source_key string, session_id string, origin_project_key string, text string"))


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_frequencies_need_no_postings(sized):
    assert rows(fts.token_frequencies(sized)) == rows(fts.frequencies(fts.postings(sized)))


def test_postings_of_few_tokens_are_made_of_their_own_rows(sized):
    few = fts.narrowed_postings(fts.narrowed(sized, ["alpha", "登录", "none"]))
    assert rows(few) == rows(fts.postings(sized).where("token in ('alpha', '登录')"))
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_some_tokens(spark, sized):
    tokens, parts = spark.createDataFrame([("alpha",), ("书",)], "token string"), blocks.spread(sized, 1)
    made = blocks.of_tokens(sized.drop("content_tokens", "cjk_tokens"), parts, tokens, 3)
    want = blocks.blocked(fts.postings(sized), parts).where("token in ('alpha', '书')")
    assert rows(made.drop("entries")) == rows(want.drop("entries")) and rows(blocks.opened(made)) == rows(blocks.opened(want))
    assert rows(blocks.frequencies(made)) == rows(fts.frequencies(fts.postings(sized)).where("token in ('alpha', '书')"))


SECRETS = ["x sk-abcdefghijklmnop0", "a ghp_abcdefghijklmnopqrstu", "b github_pat_abcdefghijklmnopqrstu", "c xoxb-abcdefghij", "d AIzaabcdefghijklmnopqrstu", "my_Api-Key = 12345678", "PASSWORD:12345678", "see HTTPS://me:pw@host/x"]


def test_texts_that_are_looked_through_for_secrets(spark):
    """A text without what a secret needs is not searched; one with it is.  Space before a last NEL is no outer white space."""
    texts = [*SECRETS, "plain words", "desk-top: a=b", "x \x85"]
    got = policy.applied(spark.createDataFrame([(t,) for t in texts], "text string")).withColumn("all", policy.redact(F.col("canonical"))).withColumn("looked", policy.may_be_redacted(F.col("canonical")))
    got = {r.text: r for r in got.collect()}
    assert all(got[t].clean == got[t]["all"] for t in texts) and all("REDACTED" in got[t].clean for t in SECRETS)
    assert not got["plain words"].looked and got["x \x85"].canonical == "x \x85"


def test_bigrams_of_long_code_points(spark, sized):
    assert sized.where("source_key = 'k4'").select(X.han_bigrams(F.col("text"))).first()[0] == ["\U00020000\U00020001", "\U00020001\U00020002"]
