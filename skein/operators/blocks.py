"""Postings in blocks with bounds, so that a search for the best matches passes over blocks that can't have any.

Chunks are dealt into slots of about BLOCK chunks of like length.  A block has the postings of one token and field in one slot, how
many they are, their largest frequency and their smallest length: with these no posting of the block scores more than one that had
both.  Blocks lie by ranges of token, so that the blocks of a query's tokens are neighbours.

`best` takes the slots with the highest bounds first, scores all that is in them, and then only those other slots whose bound reaches
the worst of the matches found.  A phrase of several tokens has no document frequency of its own until it is counted, so blocks in
slots that have all its tokens are read; all other terms are single tokens.  Results are those of ranking everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import fts

#: Chunks in a slot, about, and the matches, as a multiple of those asked for, that the first slots are to have.
BLOCK, FIRST = 128, 2
ENTRY = "struct<source_key: string, session_id: string, origin_project_key: string, dl: bigint, positions: array<int>>"
SCHEMA = f"token string, field string, slot long, n long, most long, least long, entries array<{ENTRY}>"


def length_class(dl: Column) -> Column:
    """Lengths that differ by less than a fifth, about, share a class; there are some 80 up to a million tokens."""
    return F.floor(4 * F.log2(dl + 1)).cast("int")


def spread(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """(class, parts): into how many slots the chunks (dl) of each class of lengths are dealt.  One row a class."""
    return sized.groupBy(length_class(F.col("dl")).alias("class")).agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))


def blocked(postings: DataFrame, parts: DataFrame) -> DataFrame:
    """Blocks (SCHEMA) of postings, dealt as `parts` says; classes that it does not know have one slot."""
    return gathered(placed(postings, parts))


def placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (source_key, dl, ...) with the slot that `parts` deals them to."""
    slot = F.shiftleft(F.col("class").cast("long"), 40) + F.pmod(F.xxhash64("source_key"), F.coalesce("parts", F.lit(1)))
    known = rows.withColumn("class", length_class(F.col("dl"))).join(F.broadcast(parts), "class", "left")  # some 80 rows
    return known.withColumn("slot", slot).drop("class", "parts")


def gathered(postings: DataFrame) -> DataFrame:
    """Blocks of postings that know their slots."""
    entry = F.struct("source_key", "session_id", "origin_project_key", "dl", "positions")
    return postings.groupBy("token", "field", "slot").agg(
        F.count("*").alias("n"), F.max(F.size("positions")).cast("long").alias("most"), F.min("dl").alias("least"), F.collect_list(entry).alias("entries")
    )


def of_tokens(chunks: DataFrame, parts: DataFrame, tokens: DataFrame, tasks: int) -> DataFrame:
    """The blocks of some `tokens` (token) over `chunks` (source_key, ..., text, dl).

    Texts are dealt out by slots, in `tasks` pieces, before they are taken apart, so that no posting is shuffled.
    """
    own = ["slot", "source_key", "session_id", "origin_project_key", "dl"]
    dealt = placed(chunks.select("source_key", "session_id", "origin_project_key", "dl", "text"), parts).repartition(tasks, "slot")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_tokens").alias("of")) for f in ("content", "cjk")))
    made = fts.tokenized(dealt.withColumnRenamed("dl", "__dl")).withColumn("dl", F.col("__dl"))
    each = made.select(*own, F.explode(fields).alias("f")).select(*own, F.col("f.field").alias("field"), F.posexplode("f.of").alias("pos", "token"))
    each = each.join(fts.few(tokens), "token", "left_semi")
    return gathered(each.groupBy("token", "field", *own).agg(F.sort_array(F.collect_list("pos")).alias("positions")))


def frequencies(blocks: DataFrame) -> DataFrame:
    """(token, field, df) by the blocks' counts; no entry is read."""
    return blocks.groupBy("token", "field").agg(F.sum("n").alias("df"))


def opened(blocks: DataFrame) -> DataFrame:
    """The postings of blocks, with what else the blocks' rows have."""
    rest = [c for c in blocks.columns if c not in ("n", "most", "least", "entries")]
    return blocks.select(*rest, F.explode("entries").alias("e")).select(*rest, "e.*")


def bounds(blocks: DataFrame, wanted: DataFrame, weights: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, phrase, slot, n, bound): the most that single tokens can add to the score of a chunk in a slot.  No entry is read."""
    meta = blocks.select("token", "field", "slot", F.col("n").alias("held"), "most", "least").join(wanted.where("m = 1"), ["token", "field"]).join(weights, ["query_id", "phrase"]).join(F.broadcast(stats))
    # Blocks of several segments may share a slot: their bounds count together.
    whole = meta.groupBy("query_id", "phrase", "slot", "weight", "avgdl").agg(F.sum("held").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"))
    return whole.select("query_id", "phrase", "slot", "n", (F.col("weight") * fts.saturation(F.col("most"), F.col("least"))).alias("bound"))


def best(
    blocks: DataFrame, frequencies: DataFrame, stats: DataFrame, wanted: DataFrame, most: int, live: Callable[[DataFrame], DataFrame] = lambda df: df, cut: Callable[[DataFrame], DataFrame] = lambda df: df
) -> tuple[DataFrame, DataFrame]:
    """(query_id, source_key, session_id, origin_project_key, bm25) of the `most` best matches of each query, and the slots read.

    `frequencies` (token, field, df) and `stats` (n, avgdl) are those of the whole index.  `live` takes out postings that are in the
    blocks but no longer in the index.  Of a query that is confined to a project only its matches there compete.  The slots read are
    (query_id, slot, turn), turn 1 or 2.
    """
    several = wanted.where("m > 1")
    # Phrases of several tokens: slots with all of them, then their counts there.
    common = blocks.select("token", "field", "slot").join(several, ["token", "field"]).groupBy("query_id", "phrase", "slot", "m").agg(F.count_distinct("k").alias("found")).where("found = m")
    asked = several.join(common.select("query_id", "phrase", "slot"), ["query_id", "phrase"])  # rows (query, phrase, token, slot)
    whole = cut(fts.phrase_counts(live(opened(blocks.join(asked, ["token", "field", "slot"])))))
    weights = cut(fts.weights(fts.kept_frequencies(frequencies, wanted).unionByName(fts.frequencies_of(whole)), stats))
    added = fts.added(whole, weights, stats)
    limits = bounds(blocks, wanted, weights, stats).unionByName(added.groupBy("query_id", "phrase", "slot").agg(F.count("*").alias("n"), F.max("part").alias("bound")))
    # Matches of the phrase that adds most: those of frequent words beside it would end the first slots before they have the best.
    slots = cut(limits.groupBy("query_id", "slot").agg(F.sum("bound").alias("bound"), F.max_by("n", F.struct("bound", "n")).alias("n")))
    before = F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("bound"), "slot").rowsBetween(W.unboundedPreceding, -1))
    slots = cut(slots.withColumn("first", F.coalesce(before, F.lit(0)) < FIRST * most))

    def scored(chosen: DataFrame) -> DataFrame:
        # The blocks of a slot lie together, so what they add to a chunk is summed, for the most part, before it is shuffled.
        asking = chosen.groupBy("slot").agg(F.collect_set("query_id").alias("asking"))
        single = blocks.join(asking, "slot").join(fts.few(wanted.where("m = 1")), ["token", "field"]).where(F.array_contains("asking", F.col("query_id")))
        counts = fts.phrase_counts(live(opened(single.drop("asking"))))
        more = added.join(chosen.select("query_id", "slot"), ["query_id", "slot"], "left_semi")
        return fts.in_project(fts.ranked(fts.added(counts, weights, stats).unionByName(more.select(*counts.columns, "part"))))

    first = cut(scored(slots.where("first")))
    order = W.partitionBy("query_id").orderBy(F.round("bm25", fts.PLACES_OF_MATCHES), "source_key")
    least = first.withColumn("place", F.row_number().over(order)).where(F.col("place") == most).select("query_id", F.col("bm25").alias("least"))
    # A bound is a sum of floating-point numbers in another order than a score, and scores that are equal when rounded tie: it gets a little more.
    second = slots.where("NOT first").join(least, "query_id", "left").where("least IS NULL OR bound * (1 + 1e-9) + 1e-8 >= -least")
    found = first.unionByName(scored(second)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
    read = slots.where("first").select("query_id", "slot", F.lit(1).alias("turn")).unionByName(second.select("query_id", "slot", F.lit(2).alias("turn")))
    return found, read
