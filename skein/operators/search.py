"""Ranked search: candidates by BM25, late filters, rescoring, one hit for each text, limit and snippet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import fts
from skein.versions import CANDIDATE_LIMIT, DEFAULT_LIMIT, MANUAL_MOST, MATCH_LIMIT


@dataclass(frozen=True)
class Options:
    exclude_session: str | None = None
    auto_eligible_only: bool = False
    verified_only: bool = False
    least_coverage: float = 0.0
    limit: int | None = None
    most: int = MANUAL_MOST

    @property
    def rows(self) -> int:
        if self.limit is not None and not isinstance(self.limit, int):
            raise fts.QueryInvalid("a limit is a whole number")
        return min(max(DEFAULT_LIMIT if self.limit is None else self.limit, 1), self.most)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each query.  Spark keeps n rows a partition and query before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n).drop("rank")


def score(bm25: Column, covered: Column, role: Column, recent: Column) -> Column:
    return -bm25 + covered + F.when(role == "user", 0.05).otherwise(0.0) + recent


def first_of_each_text(df: DataFrame) -> DataFrame:
    """Of hits of a query with the same project, role and text, the best one."""
    w = W.partitionBy("query_id", "origin_project_key", "role", "content_hash").orderBy(F.desc("score"), "source_key")
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def looked_up(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Matches with the whole rows of their chunks, which are read only now.

    Matches that know their session as well meet chunks by that too: chunks are stored by session.
    """
    both = [c for c in ("session_id", "source_key") if c in matches.columns]
    return matches.join(chunks, both)


def allowed(rows: DataFrame, sessions: DataFrame, options: Options) -> DataFrame:
    """Rows of active sessions that pass the filters that come after the best matches are taken."""
    rows = rows.join(sessions.where("status = 'active'").select("session_id"), "session_id", "left_semi")
    if options.exclude_session is not None:
        rows = rows.where(F.col("session_id") != options.exclude_session)
    if options.auto_eligible_only:
        rows = rows.where("auto_eligible")
    if options.verified_only:
        rows = rows.where("provenance = 'verified'")
    return rows


def asked(spark: SparkSession, queries: dict[int, str], project: str | None = None) -> DataFrame:
    """(query_id, terms, project) of a few valid queries."""
    return spark.createDataFrame([(q, fts.parse_query(x), project) for q, x in queries.items()], "query_id long, terms array<string>, project string")


def first_matches(index: DataFrame, stats: DataFrame, wanted: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(query_id, source_key, session_id, origin_project_key, bm25) of the 256 best matches of each query, by ranking all."""
    return top(fts.bm25(index, stats, wanted, kept), MATCH_LIMIT, F.round("bm25", fts.PLACES_OF_MATCHES), F.col("source_key"))


def search(matches: DataFrame, chunks: DataFrame, sessions: DataFrame, queries: DataFrame, as_of: str, options: Options = Options()) -> DataFrame:
    """Hits of each query, best first: query_id, source_key, session_id, entry_id, role, origin_project_key, occurred_at,
    content_hash, text, snippet, truncated, coverage, score.

    `matches` are the 256 best of each query, among those of its project if it has one; all other filters come after.  Scores that
    are equal to nine places are ties, which go by source_key.  `queries` has (query_id, terms) and maybe exclude_session, a session that gives no hits; they may be of any number.
    """
    rows = looked_up(matches.drop("origin_project_key"), chunks)
    own = [c for c in ("exclude_session",) if c in queries.columns]
    rows = allowed(rows.join(queries.select("query_id", "terms", *own), "query_id"), sessions, options)
    if own:
        rows = rows.where(~F.col("session_id").eqNullSafe(F.col("exclude_session")))
    rows = top(rows, CANDIDATE_LIMIT, F.round("bm25", fts.PLACES), F.col("source_key"))
    rows = rows.withColumn("coverage", X.coverage(F.col("text"), F.col("terms"))).where(F.col("coverage") >= options.least_coverage)
    rows = rows.withColumn("score", F.round(score(F.col("bm25"), F.col("coverage"), F.col("role"), X.recency(F.col("occurred_at"), F.lit(as_of).cast("timestamp"))), fts.PLACES))
    best = top(first_of_each_text(rows), options.rows, F.desc("score"), F.col("source_key"))
    return best.select(
        "query_id", "source_key", "session_id", "entry_id", "role", "origin_project_key", "occurred_at", "content_hash", "text",
        X.snippet(F.col("text")).alias("snippet"), (F.length("text") > X.SNIPPET_CHARS).alias("truncated"), "coverage", "score",
    ).orderBy("query_id", F.desc("score"), "source_key")


def safe_hits(hits: DataFrame) -> DataFrame:
    """What a tool shows of hits: six fields and their query, best first; no score, text or key, and no control characters."""
    shown = hits.select("session_id", "entry_id", "role", "occurred_at", X.without_control(F.col("snippet")).alias("snippet"), "truncated", "query_id", "score", "source_key")
    return shown.orderBy("query_id", F.desc("score"), "source_key").drop("query_id", "score", "source_key")


def plain(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, shown): the hits of each row of `queries` (query_id) as text, best first, or the line that there are none.

    A hit is a line of where it stands and an indented line with its snippet, without control characters; hits are apart by an empty
    line.  Fields that are null are left empty.  A query has at most as many hits as the search that found them was allowed.
    """
    place = F.concat_ws("  ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("session_id", "entry_id", "role", "occurred_at")))
    mark = F.when(F.col("truncated"), " [truncated]").otherwise("")
    snippet = X.without_control(F.coalesce(F.col("snippet"), F.lit("")))
    lines = F.concat(place, mark, F.lit("\n  "), snippet)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), "source_key", lines.alias("lines"))))
    found = hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["lines"]), "\n\n").alias("shown"))
    return queries.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("shown", F.lit("No hits.")).alias("shown"))
