"""Change detection: what a session file's content means against the cursor of the last scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete_prefix(content: Column) -> Column:
    """The bytes up to the last line end: a torn last line waits for the next scan."""
    text = F.decode(content, "ISO-8859-1")
    at = F.length(text) - F.locate("\n", F.reverse(text)) + 1
    return F.when(F.locate("\n", text) == 0, F.lit(b"")).otherwise(F.substring(content, F.lit(1), at.cast("int")))


def trailing_line_hash(content: Column) -> Column:
    """Hash of the last line that isn't empty, null without one.  `content` is a complete prefix."""
    lines = F.filter(F.split(F.decode(F.make_valid_utf8(content.cast("string")).cast("binary"), "UTF-8"), "\r?\n"), lambda x: x != "")
    return F.sha2(F.try_element_at(lines, F.lit(-1)), 256)


def cursor(content: Column) -> Column:
    done = complete_prefix(content)
    size = F.octet_length(done).cast("long")
    return F.struct(size.alias("byte_offset"), trailing_line_hash(done).alias("trailing_line_hash"), F.when(size > 0, F.sha2(done, 256)).alias("prefix_hash"), size.alias("size_bytes"))


def gone(sessions: DataFrame, found: DataFrame, scanned: Column) -> DataFrame:
    """`sessions` with `gone`: whether a session that was scanned and is not excluded has no file in `found` (session_id)."""
    there = found.where("session_id IS NOT NULL").select("session_id").distinct().withColumn("there", F.lit(True))
    return sessions.join(there, "session_id", "left").withColumn("gone", scanned & F.col("there").isNull() & (F.col("status") != "excluded")).drop("there")


def histogram(seen: DataFrame, column: str = "disposition") -> DataFrame:
    return seen.groupBy(column).agg(F.count("*").alias("count"))


def disposition(content: Column, offset: Column, trailing: Column, prefix: Column, size: Column) -> Column:
    """full-reconcile, truncate, rewrite, unchanged or append.  A null size: there is no cursor."""
    done = complete_prefix(content)
    now = F.octet_length(done)
    start = F.substring(done, F.lit(1), offset.cast("int"))
    last = trailing_line_hash(start)
    return (
        F.when(size.isNull(), "full-reconcile")
        .when(now < size, "truncate")
        .when((offset > 0) & prefix.isNotNull() & (F.sha2(start, 256) != prefix), "rewrite")
        .when((offset > 0) & trailing.isNotNull() & last.isNotNull() & (last != trailing), "full-reconcile")
        .when(now == size, "unchanged")
        .otherwise("append")
    )
