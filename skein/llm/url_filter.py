"""URL filters: a trie over reversed host labels and then path segments, broadcast to all tasks.

The longest rule wins: the one with most host labels, and among those the one with the longest path.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The broadcast trie has at most so many rules and characters (some 500 bytes a rule in memory); longer lists are matched by a join.
MOST_RULES, MOST_CHARS = 200_000, 16_000_000
#: Fixed rules of the registered query: (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Host, and path up to the query or fragment, after the first "://".
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def upper_to_lower(host: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host) if not host.isascii() else host.lower()


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return upper_to_lower(host), slash + path


class Trie:
    """Nodes are (children, rules): children by host label, then by whole path segment after the key "/"; `rules` are (rest of the path, verdict, rule), longest first."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: tuple[dict, list] = ({}, [])
        for verdict, rule in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, ({}, []))
            node = node[0].setdefault("/", ({}, []))
            *whole, rest = path.split("/")
            for segment in whole:
                node = node[0].setdefault(segment, ({}, []))
            node[1].append((rest, verdict, rule))
            node[1].sort(key=lambda x: -len(x[0]))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits, else (None, None)."""
        best: tuple[str | None, str | None] = (None, None)
        node, segments = self.root, path.split("/")
        labels = iter(reversed(host.split(".")) if host else ())
        while node:
            if at := node[0].get("/"):
                for i, segment in enumerate(segments):
                    rest = path if i == 0 else "/".join(segments[i:]) if at[1] else ""
                    if hit := next((r for r in at[1] if rest.startswith(r[0])), None):
                        here = (hit[2], hit[1])
                        found = here
                    elif i == 0:
                        found = None
                    at = at[0].get(segment)
                    if at is None:
                        break
                if found:
                    best = found
            label = next(labels, None)
            node = node[0].get(label) if label is not None else None
        return best


def parse(df: DataFrame, url: str = "url") -> DataFrame:
    """`df` with `host` (A-Z lower-cased) and `path`, both empty if the url is null or has no "://"."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), URL, i), F.lit(""))
    return df.withColumns({"host": F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": part(2)})


def _by_trie(parsed: DataFrame, rules: Sequence[tuple[str, str]], default: str) -> DataFrame:
    shared = parsed.sparkSession.sparkContext.broadcast(Trie(rules))
    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(batches):
        find = shared.value.find
        for batch in batches:
            found = [find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] or default for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "rule", "verdict"])

    return parsed.mapInArrow(judge, schema)


def _by_join(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rule lists of any size: each host and path asks for every suffix of its host, whose rules are tested on the path."""
    host, path = F.regexp_extract("rule", "^([^/]*)", 1), F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    listed = rules.select(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("suffix"), path.alias("start"), "rule", F.col("verdict").alias("says"))
    listed = listed.groupBy("suffix").agg(F.collect_list(F.struct("start", "rule", "says")).alias("of"))
    labels = F.split("host", r"\.")
    suffixes = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.array(F.lit("")))
    asked = parsed.select("host", "path").distinct()
    fits = F.filter("of", lambda r: F.startswith(F.col("path"), r["start"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length("suffix").alias("a"), F.length(r["start"]).alias("b"), r["rule"].alias("rule"), r["says"].alias("says"))))
    hits = asked.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(listed, "suffix").select("host", "path", longest.alias("x")).groupBy("host", "path").agg(F.max("x").alias("x"))
    return common.lookup(parsed.withColumn("place", F.struct("host", "path")), hits.select(F.struct("host", "path").alias("place"), "x"), "place", "left").select(*parsed.columns, F.col("x.rule").alias("rule"), F.coalesce("x.says", F.lit(default)).alias("verdict"))


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, url: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """`df` with host, path, rule and verdict for each url.  Columns that have these names are replaced.

    `rules` are (allow or block, host and path), or a DataFrame (verdict, rule).  A rule fits its host and all its subdomains if
    the path starts with the rule's path.  A url that no rule fits, null or without "://" included, has a null rule and the verdict
    `default`.  Of equal rules the first counts.
    """
    parsed = parse(df.drop("host", "path", "rule", "verdict"), url)
    if isinstance(rules, DataFrame):
        listed = rules.select("verdict", "rule").limit(most_rules + 1)
        n, chars = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("rule")), F.lit(0))).first()
        if n > most_rules or chars > MOST_CHARS:
            return _by_join(parsed, rules.dropDuplicates(["rule"]), default)
        rules = [tuple(x) for x in listed.collect()]
    elif len(rules) > most_rules or sum(len(x[1]) for x in rules) > MOST_CHARS:
        rows = df.sparkSession.createDataFrame(list(dict((r, v) for v, r in reversed(rules)).items()), "rule string, verdict string")
        return _by_join(parsed, rows, default)
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or not re.fullmatch(r"[^/?#]*/[^?#]*", rule):
            raise ValueError(f"not a rule: {verdict} {rule}")
    return _by_trie(parsed, rules, default)


SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(says, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
hits AS (
  SELECT page_id, host, path, rule, says, row_number() OVER (PARTITION BY page_id ORDER BY strpos(rule, '/') DESC, length(rule) DESC) AS k
  FROM parsed LEFT JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM hits WHERE k = 1
"""
