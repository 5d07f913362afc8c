"""Measures of ranked hits against what was relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.streaming.cuts import cut


def recall_at(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """One row: recall, the share of queries of `relevant` (query_id, entry_id) with any relevant entry among their first k hits."""
    first = hits.withColumn("better", F.struct(-F.col("score"), "source_key"))
    top = first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("better"))).where(F.col("place") <= k)
    found = top.join(relevant, ["query_id", "entry_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return relevant.select("query_id").distinct().join(found, "query_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def judged(hits: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, pool, holdout, hit, leaked, exposed) for rows (query_id, pool, holdout, relevant, foreign, hidden) of `queries`.

    Of the first k hits: `hit`, whether one is an entry of `relevant`, or, where that is empty, whether there is none; `leaked`,
    whether one is of the project `foreign`; `exposed`, whether one's text has the words `hidden`.  What leaks or exposes is no hit.
    """
    top = hits.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "source_key"))).where(F.col("place") <= k)
    found = queries.join(top.select("query_id", "entry_id", "origin_project_key", "text"), "query_id", "left")
    any_ = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    each = found.groupBy("query_id", "pool", "holdout", "relevant").agg(
        any_(F.array_contains("relevant", F.col("entry_id"))).alias("found"), any_(F.col("entry_id").isNotNull()).alias("any"),
        any_(F.col("origin_project_key") == F.col("foreign")).alias("leaked"), any_(F.contains("text", "hidden")).alias("exposed"),
    )
    hit = F.when(F.size("relevant") > 0, F.col("found")).otherwise(~F.col("any")) & ~F.col("leaked") & ~F.col("exposed")
    return each.select("query_id", "pool", "holdout", hit.alias("hit"), "leaked", "exposed")


def gates(judged: DataFrame, main: list[str]) -> DataFrame:
    """One row: recall of the pools `main` and of the held-out queries, how many queries leak, expose or fail."""
    share = lambda which: F.avg(F.when(which, F.col("hit").cast("double")))
    return judged.agg(
        F.count("*").alias("queries"), share(F.col("pool").isin(main)).alias("recall"), share(F.col("holdout")).alias("holdout_recall"),
        F.count_if("leaked").alias("leaks"), F.count_if("exposed").alias("exposed"), F.count_if(~F.col("hit")).alias("failed"),
    )


def percentiles(values: DataFrame, group: str, value: str, shares: dict[str, float], bins: int = 1024, most: int = 100_000) -> DataFrame:
    """(group, a column for each share): the value at place floor(n q), from 0, of a group's values in order.  Nulls do not count.

    A histogram of `bins` equal ranges finds the range of each place; the ranges found are divided again until none holds more than
    `most` values or only equal ones, so that a long tail does not bring nearly all values into one sort.
    """
    each = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"), F.col(value).alias("v"))
    names = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in shares.items())))
    # One row a group and share: the range (low, high) that holds the place, and the place inside it.
    ranges = each.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).select("*", names.alias("s"))
    ranges = cut(ranges.select("g", "s.name", "low", "high", "n", F.floor(F.col("n") * F.col("s.q")).alias("place")))
    inside = lambda: each.join(ranges, "g").where("x >= low AND x <= high")
    while not ranges.where((F.col("n") > most) & (F.col("high") > F.col("low"))).isEmpty():
        bin_ = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins))).otherwise(0)
        counted = inside().groupBy("g", "name", "place", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        end = F.sum("n").over(W.partitionBy("g", "name").orderBy("bin"))
        hit = counted.withColumn("end", end).where("place < end AND place >= end - n")
        ranges = cut(hit.select("g", "name", "low", "high", "n", (F.col("place") - F.col("end") + F.col("n")).alias("place")))
    # What is left of a range is few values, or one value many times.
    tied = inside().groupBy("g", "name", "place", "v").agg(F.count("*").alias("n"))
    end = F.sum("n").over(W.partitionBy("g", "name").orderBy("v"))
    found = tied.withColumn("end", end).where("place < end AND place >= end - n")
    return found.groupBy(F.col("g").alias(group)).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))


def leaks(hits: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row: leaks, how many hits of queries of `forbidden` (query_id, origin_project_key) come from the project they must not."""
    return hits.join(forbidden, ["query_id", "origin_project_key"], "left_semi").agg(F.count("*").alias("leaks"))
