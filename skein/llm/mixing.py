"""Mixing sources to target weights by Pareto order sampling.  DataFrame and SQL functions only.

A source's rate is its target over its size.  Each of its documents is taken `floor(rate)` times for certain; the rest of the
source's target is filled by a sample of one more copy of some.  Documents are ranked by random odds over inclusion odds, which
go with the square root of a document's words, so that longer documents are likelier; the extra copies go down that ranking as
far as the source's remaining words reach, which fixes the size of the sample.  A common factor of the inclusion odds of a source
would not change the order, so none has to be found.

No source is ranked in one place: two histograms of 4,096 buckets over the ranking variable, mapped to (0, 1), narrow the end of
the sample down to a small part of the source, of which each value of the ranking variable is one row to be sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
#: Largest table of sources that is broadcast, in rows and in bytes of their names; a larger one is joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 10_000, 1 << 20
BUCKETS = 4096


def words(text: str) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def uniform(id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id, the text and the seed only."""
    digits = F.md5(F.concat(F.lit(seed), F.coalesce(id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))
    return (F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def ranking(u: Column, size: Column) -> Column:
    """Pareto's variable r = (u / (1 - u)) / inclusion odds, as r / (1 + r); the odds are 1 at 256 words."""
    return u / (u + (1 - u) * F.sqrt(F.greatest(size, F.lit(1)) / 256.0))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) of one row a source (source, source_size).

    Sources by code point, null last, weigh `weights`, repeating, and share the total.  A target stops at `most` times its
    source's size and the excess is shared again by weight: in the order of `most` * size / weight, a source is capped if that is
    below what a unit of weight gets once all before it are capped.  One row a source goes through one sort.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_cap, all_ = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()), W.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(
        by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    )
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("level", level)
        .withColumn("share", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(all_))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("share")).alias("target"))
    )


def _crossing(parts: DataFrame, bucket: str) -> DataFrame:
    """(source, cut, before): the first bucket at whose end a source's words exceed what is left to take, and the words before it."""
    so_far = F.sum("words").over(W.partitionBy("source").orderBy(bucket))
    return (
        parts.withColumn("so_far", so_far)
        .where(F.col("so_far") > F.col("left"))
        .groupBy("source")
        .agg(F.min(F.struct(bucket, (F.col("so_far") - F.col("words")).alias("before"))).alias("x"))
        .select(F.col("source").alias("of"), F.col(f"x.{bucket}").alias("cut"), F.col("x.before").alias("before"))
    )


def plan(slim: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row a source: source, source_size, target, whole (certain copies), last (the ranking variable up to which one more is taken)."""
    rates = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = rates.withColumn("whole", F.floor(rate).cast("int")).withColumn("odds", rate - F.floor(rate)).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    rates = common.cut(rates)
    some = rates.select(F.col("source").alias("s"), "left", "odds").where("odds > 0")
    ranked = slim.withColumn("b1", F.floor(F.col("v") * BUCKETS).cast("int")).withColumn("b2", F.floor(F.col("v") * BUCKETS * BUCKETS).cast("int"))
    left = lambda parts: parts.join(some, F.col("source").eqNullSafe(F.col("s")))
    first = _crossing(left(ranked.groupBy("source", "b1").agg(F.sum("size").alias("words"))), "b1")
    inside = ranked.join(first, F.col("source").eqNullSafe(F.col("of")) & (F.col("b1") == F.col("cut"))).drop("of", "cut")
    second = _crossing(left(inside.groupBy("source", "b2").agg(F.sum("size").alias("words"), F.first("before").alias("before"))).withColumn("left", F.col("left") - F.col("before")), "b2")
    tied = inside.withColumnRenamed("before", "before1").join(second, F.col("source").eqNullSafe(F.col("of")) & (F.col("b2") == F.col("cut")))
    # Rows that repeat an id and a text tie; they are taken or left together.
    last = left(tied.groupBy("source", "v").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("before1", "before", "cut"))))
    so_far = F.col("before1") + F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ends = (
        last.withColumn("so_far", so_far)
        .groupBy("source")
        .agg(F.max(F.when(F.col("so_far") - F.col("words") / 2 <= F.col("left"), F.col("v"))).alias("v"), (F.first("cut") / F.lit(float(BUCKETS * BUCKETS))).alias("start"))
        .select(F.col("source").alias("s"), F.coalesce("v", "start").alias("last"))
    )
    # Without a crossing, what is left to take is the whole source.
    return rates.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole", F.when(F.col("odds") > 0, F.coalesce("last", F.lit(1.0))).otherwise(-1.0).alias("last")
    )


def _with_plan(docs: DataFrame, found: DataFrame, source: str) -> DataFrame:
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    found = found.withColumnRenamed("source", "__of")
    if size[0] <= BROADCAST_SOURCES and size[1] <= BROADCAST_BYTES:
        found = F.broadcast(found)
    return docs.join(found, F.col(source).eqNullSafe(F.col("__of"))).drop("__of")


def _slim(docs: DataFrame, id: str, source: str, text: str, seed: str) -> DataFrame:
    return common.cut(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words(text).alias("size"), uniform(F.col(id), F.col(text), seed).alias("u")).select("id", "source", "size", ranking(F.col("u"), F.col("size")).alias("v")))


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("v") <= F.col("last"), 1).otherwise(0)


def shares(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix:", weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of `docs`: its words, its source's, the target, and the words taken.

    A null text has size 0, null sources are one source, rows that repeat an id and a text are taken alike, an empty table gives
    no rows.  A text of any length is counted whole.
    """
    slim = _slim(docs, id, source, text, seed)
    found = common.cut(plan(slim, weights, most))
    return _with_plan(slim, found, "source").select(F.col("id").alias(id), "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix:", weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """The mixture itself: each row of `docs`, with its own columns, as many times as it is taken."""
    found = common.cut(plan(_slim(docs, id, source, text, seed), weights, most)).select("source", "whole", "last")
    v = ranking(uniform(F.col(id), F.col(text), seed), words(text))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("source"), v.alias("v"))
    return _with_plan(packed, found, "source").select("row", F.explode(F.array_repeat(F.lit(0), _copies()))).select("row.*")


SQL = r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 3 AS cap FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
rates AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT max(level) FROM levels WHERE cap / weight >= level)) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, CAST(floor(rate) AS BIGINT) AS whole, target - floor(rate) * source_size AS rest FROM rates),
ranked AS (
  SELECT doc_id, size, source_size, target, rate, whole, rest, slim.source AS source, u / (u + (1 - u) * sqrt(greatest(size, 1) / 256.0::DOUBLE)) AS v
  FROM slim JOIN parts ON slim.source IS NOT DISTINCT FROM parts.source),
tied AS (SELECT source, v, any_value(rest) AS rest, sum(size) AS words FROM ranked GROUP BY source, v),
summed AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY v ROWS UNBOUNDED PRECEDING) AS so_far FROM tied),
ends AS (SELECT source, max(CASE WHEN so_far - words / 2 <= rest THEN v END) AS last FROM summed GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN rate > whole AND v <= last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked JOIN ends ON ranked.source IS NOT DISTINCT FROM ends.source
"""
