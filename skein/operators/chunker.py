"""Splitting of texts into chunks of bounded length, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.versions import CHUNK_MERGE, CHUNK_MOST, CHUNK_OVERLAP, CHUNK_TARGET

FENCE = "```"


def windows(text: Column, most: int = CHUNK_MOST, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of `most` characters that overlap: all of a text that is one segment."""
    stride = most - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - most) / stride).cast("int") + 1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * stride + 1, F.lit(most)))
    )


def segments(text: Column) -> Column:
    """Paragraphs, and of those with code fences the fences with what they enclose, to the end if one is never closed, and what is between."""

    def parts(paragraph: Column) -> Column:
        pieces = F.split(paragraph, FENCE)
        fenced = lambda x, i: F.concat(F.lit(FENCE), x, F.when(i + 1 < F.size(pieces), FENCE).otherwise(""))
        return F.transform(pieces, lambda x, i: F.when(i % 2 == 1, fenced(x, i)).otherwise(x))

    paragraphs = F.split(text, "\n{2,}")
    return F.filter(F.flatten(F.transform(paragraphs, lambda p: F.when(F.contains(p, F.lit(FENCE)), parts(p)).otherwise(F.array(p)))), lambda x: x != "")


def _grown(pieces: Column, more: Column) -> Column:
    """`pieces` with `more` added to the last one as a paragraph."""
    return F.array_append(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.concat(F.element_at(pieces, -1), F.lit("\n\n"), more))


def gathered(parts: Column) -> Column:
    """Segments gathered up to the target, long ones cut into windows, and short pieces joined with the one before."""
    kind = "struct<pieces: array<string>, open: boolean>"
    made = lambda pieces, open_: F.struct(pieces.alias("pieces"), F.lit(open_).alias("open"))

    def fold(state: Column, x: Column) -> Column:
        pieces = state["pieces"]
        fits = state["open"] & (F.length(F.element_at(pieces, -1)) + 2 + F.length(x) <= CHUNK_TARGET)
        return (
            F.when(F.length(x) > CHUNK_MOST, made(F.concat(pieces, windows(x)), False))
            .when(fits, made(_grown(pieces, x), True))
            .otherwise(made(F.array_append(pieces, x), True))
        )

    pieces = F.aggregate(parts, F.struct(F.array().alias("pieces"), F.lit(False).alias("open")).cast(kind), lambda s, x: fold(s, x).cast(kind), lambda s: s["pieces"])
    joins = lambda done, x: (F.size(done) > 0) & (F.length(x) < CHUNK_MERGE) & (F.length(F.try_element_at(done, F.lit(-1))) + 2 + F.length(x) <= CHUNK_MOST)
    return F.aggregate(pieces, F.array().cast("array<string>"), lambda done, x: F.when(joins(done, x), _grown(done, x)).otherwise(F.array_append(done, x)))


def chunks(text: Column) -> Column:
    """The chunks of a canonical text."""
    plain = ~(F.contains(text, F.lit("\n\n")) | F.contains(text, F.lit(FENCE)))
    return F.when(plain, windows(text)).otherwise(gathered(segments(text)))
