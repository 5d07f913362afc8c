"""Text functions as column expressions: Column -> Column, all built in except `nfc`."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.versions import MOST_QUERY_TERMS, SNIPPET_CHARS

#: White space as ECMAScript's \s and trim() know it; Java's \s is ASCII only.  Inside a character class.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
LATIN_TERM = r"[A-Za-z0-9_./-]+"


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def nfc(x: Column) -> Column:
    """Unicode normalisation form C, which Spark has no function for."""
    return F.pandas_udf(_nfc, "string")(x)


def trim(x: Column) -> Column:
    return F.trim(x, F.lit(SPACES))


def canonical(x: Column, compose: bool = False) -> Column:
    """Line ends as \\n, outer white space off; with `compose` in normalisation form C first."""
    ends = F.regexp_replace(nfc(x) if compose else x, "\r\n?", "\n")
    return trim(ends if compose else F.when(F.contains(x, F.lit("\r")), ends).otherwise(x))


@lru_cache(1)
def accents() -> tuple[str, str]:
    """Lower-case letters with exactly one diacritic, and their bases, by canonical decomposition."""
    marked, bases = [], []
    for code in range(0xC0, 0x1F00):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and unicodedata.combining(parts[1]) and parts[0].isascii() and c == c.lower():
            marked.append(c)
            bases.append(parts[0])
    return "".join(marked), "".join(bases)


def fold(x: Column) -> Column:
    ascii_only = F.octet_length(x) == F.length(x)  # translate looks up each character
    return F.when(ascii_only, F.lower(x)).otherwise(F.translate(F.lower(x), *accents()))


def tokens(x: Column) -> Column:
    """Folded runs of letters, digits and private-use characters."""
    return F.regexp_extract_all(fold(x), F.lit(TOKEN), F.lit(0))


def han(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{IsHan}]+", "")


def han_bigrams(x: Column) -> Column:
    """Pairs of neighbours among the Han characters alone, so that a pair may span a gap; a single one stays single."""
    # A match takes one character and looks at the next, so neighbours overlap.
    return F.regexp_extract_all(han(x), F.lit("(?=(..|^.$))."), F.lit(1))


def query_terms(x: Column) -> Column:
    """Latin terms and Han bigrams in order, each once, at most 32."""
    return F.slice(F.array_distinct(F.concat(F.regexp_extract_all(x, F.lit(LATIN_TERM), F.lit(0)), han_bigrams(x))), 1, MOST_QUERY_TERMS)


def coverage(x: Column, terms: Column) -> Column:
    """Share of the terms that occur in the text, in lower case, anywhere."""
    low = F.lower(x)
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) / F.size(terms))


def recency(when: Column, as_of: Column) -> Column:
    """0.1 for now, less by 0.0001 a day and never below 0; 0 for a time that can't be read."""
    days = (F.unix_micros(as_of) - F.unix_micros(F.try_to_timestamp(when))) / 86_400_000_000
    return F.when(days.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 0.1 - F.greatest(F.lit(0.0), days) * 0.0001))


def snippet(x: Column, most: int = SNIPPET_CHARS) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def without_control(x: Column) -> Column:
    """Terminal colour sequences and control characters but TAB, LF and CR taken out."""
    return F.regexp_replace(F.regexp_replace(x, "\\x1B\\[[0-9;]*m", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def token_estimate(x: Column) -> Column:
    return F.ceil(F.octet_length(x) / 2).cast("long")


def root_path(x: Column) -> Column:
    """Forward slashes, drive letter in lower case, no slash at the end."""
    forward = F.replace(x, F.lit("\\"), F.lit("/"))
    drive = F.when(forward.rlike("^[A-Za-z]:/"), F.concat(F.lower(F.substring(forward, 1, 1)), F.substring(forward, 2, 1 << 30))).otherwise(forward)
    return F.when(F.length(drive) > 1, F.regexp_replace(drive, "/$", "")).otherwise(drive)


def base_name(x: Column) -> Column:
    """The last non-empty part of a path with slashes of either kind."""
    parts = F.filter(F.split(F.replace(x, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), x)
