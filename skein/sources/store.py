"""The index on disk, as plain partitioned tables of one writer.

`chunks`, `blocks` of postings and `frequencies` of tokens grow by segments: a scan that finds changes writes one more folder
segment=K, chunks in buckets by session, blocks and frequencies by ranges of token.  What an older segment has of sessions that have
changed since is told by the table of marks (session_id, upto): rows of segments up to `upto` no longer count.  Frequencies are kept
as differences, so their sum over segments is that of what counts.  When there are MOST_SEGMENTS, the next change writes one segment
of all that counts.  Small tables are written whole.

The state is a row (revision, body) for each change, and the last one counts; readers see a change when its row is there.  There is
one writer at a time: nothing here keeps a second one away.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein import versions as V
from skein.operators import blocks, fts, roots
from skein.streaming.cuts import cut

SCHEMAS = {
    "projects": "project_key string, kind string, normalized_root string",
    "sessions": "session_id string, root_id string, parent_session string, header_project_key string, file_path string, prefix_hash string, trailing_line_hash string, status string, error_code string, updated_at string, file_size long, scan_byte_offset long, listed_bytes long, listed_at long",
    "exclusions": "session_id string, excluded_at string, reason string",
    "marks": "session_id string, upto int, held int",
    "spread": "class int, parts long",
    "chunks": "source_key string, content_hash string, policy_version string, session_id string, entry_id string, block_index int, chunk_index int, origin_project_key string, provenance string, role string, occurred_at string, text string, chunker_version string, auto_eligible boolean, dl long",
    "blocks": blocks.SCHEMA,
    "frequencies": "token string, field string, df long",
    "diagnostics": "at string, session_hash string, code string, detail string, count long",
}
SEGMENTED, MOST_SEGMENTS = ("chunks", "blocks", "frequencies"), 8
#: Chunks that one bucket of a segment has at most, about, and buckets at least.
BUCKET, LEAST_BUCKETS = 1_000_000, 16
#: Chunks that come or go in a change up to which its segment is written in one piece.
SMALL = 10_000
#: Days that diagnostics are kept.
KEPT_DAYS = 30
FRESH = {
    "versions": {"schema": V.SCHEMA_VERSION, "chunker": V.CHUNKER_VERSION, "policy": V.POLICY_VERSION, "projection": V.PROJECTION_VERSION},
    "config": {"setup_completed": False, "indexing_enabled": False, "auto_recall": False, "manual_limit": 5, "tool_limit": 5, "auto_max_records": 4, "auto_max_tokens": 600, "config_version": 0},
    "projection_status": "ready",
    "roots": {},
    "tables": {},
    "segments": [],
    "marked": False,
    "totals": [0, 0],  # chunks that count, and their tokens
    "revision": 0,
}


class StoreError(RuntimeError):
    def __init__(self, code: str, text: str = ""):
        super().__init__(text or code)
        self.code = code


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key; of several new rows of a key one stays."""
    fresh = new.withColumn("__new", F.lit(1)).unionByName(old.withColumn("__new", F.lit(0)))
    return fresh.withColumn("__nth", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("__new")))).where("__nth = 1").drop("__new", "__nth")


def replace_groups(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old` without any row whose key occurs in `new`, and all rows of `new`."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """The keys that more than one row has, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def bucket(session: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(n)).cast("int")


def now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def counting(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (segment, session_id, ...) that no later segment has made void, with `auto_eligible`, if there is one, off where held."""
    marked = rows.join(marks, "session_id", "left").where("upto IS NULL OR segment > upto")
    if "auto_eligible" in rows.columns:
        marked = marked.withColumn("auto_eligible", F.col("auto_eligible") & ~F.coalesce(F.col("segment") <= F.col("held"), F.lit(False)))
    return marked.select(rows.columns)


class Store:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._frames: dict = {}
        self.state = self._load()

    # State

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.home).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs().exists(self._path(path))

    def _load(self) -> dict:
        try:
            row = self.spark.read.schema("revision long, body string").parquet(f"{self.home}/state").orderBy(F.desc("revision")).first()
        except AnalysisException:  # no such folder: nothing has been set up
            row = None
        state = {**json.loads(json.dumps(FRESH)), **(json.loads(row.body) if row else {})}
        if state["versions"] != FRESH["versions"]:
            state["projection_status"] = "degraded"
            state["config"]["auto_recall"] = False
        return state

    def refresh(self) -> dict:
        self.state = self._load()
        return self.state

    def change(self, **changes) -> None:
        """Makes these changes of the state current."""
        self.state = {**self.state, **changes, "revision": self.state["revision"] + 1}
        self.spark.createDataFrame([(self.state["revision"], json.dumps(self.state))], "revision long, body string").coalesce(1).write.mode("append").parquet(f"{self.home}/state")

    # Tables

    def written(self, tables: dict[str, DataFrame]) -> dict:
        """Writes these tables whole and returns what the state is to have for `tables`."""
        new = {}
        for name, df in tables.items():
            new[name] = f"{self.home}/{name}/{uuid.uuid4().hex}"
            df.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.parquet(new[name])
        return {**self.state["tables"], **new}

    def publish(self, tables: dict[str, DataFrame] | None = None, **changes) -> None:
        """Writes these small tables and makes them and the changes of the state current."""
        self.change(**changes, **({"tables": self.written(tables)} if tables else {}))

    def rows(self, name: str, segments: list[int] | None = None) -> DataFrame:
        """The rows of a table in segments as they lie there, with their segment, and the bucket of chunks."""
        segments = self.state["segments"] if segments is None else segments
        more = ", segment int, bucket int" if name == "chunks" else ", segment int"
        if not segments:
            return self.spark.createDataFrame([], SCHEMAS[name] + more)
        key = (name, *segments)
        if key not in self._frames:  # a segment never changes, so its files are listed once
            self._frames = {k: v for k, v in self._frames.items() if k[0] != name}
            self._frames[key] = self.spark.read.schema(SCHEMAS[name] + more).option("basePath", f"{self.home}/{name}").parquet(*(f"{self.home}/{name}/segment={s}" for s in segments))
        return self._frames[key]

    def live(self, rows: DataFrame) -> DataFrame:
        return counting(rows, self.table("marks")) if self.state["marked"] else rows

    def table(self, name: str) -> DataFrame:
        if name == "frequencies":
            return fts.summed_frequencies(self.rows(name).drop("segment"))
        if name in SEGMENTED:
            return self.live(self.rows(name)).drop("segment", "bucket")
        if name == "diagnostics":
            try:
                return self.spark.read.schema(SCHEMAS[name] + ", day string").parquet(f"{self.home}/diagnostics").drop("day")
            except AnalysisException:
                return self.spark.createDataFrame([], SCHEMAS[name])
        path = self.state["tables"].get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(path) if path else self.spark.createDataFrame([], SCHEMAS[name])

    def postings(self) -> DataFrame:
        """All postings that count."""
        return self.live(blocks.opened(self.rows("blocks"))).drop("segment", "slot")

    def stats(self) -> DataFrame:
        """One row: the number of chunks that count and their mean number of tokens, as they are kept."""
        n, tokens = self.state["totals"]
        return self.spark.createDataFrame([(n, tokens / n if n else 0.0)], "n long, avgdl double")

    # Changes of the index

    def replace_chunks(self, stale: DataFrame, tokenized: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, **changes) -> None:
        """Publishes `tables` and an index without the sessions `stale` (session_id) and with the chunks `tokenized` of some of these."""
        # What goes is read by bucket and session; its frequencies are taken off those that are kept.
        rows = self.rows("chunks")
        gone = cut(fts.tokenized(self.live(rows).join(stale, "session_id", "left_semi")))
        new = tokenized if tokenized is not None else gone.drop("segment", "bucket").limit(0)
        compact = len(self.state["segments"]) + 1 >= MOST_SEGMENTS
        if compact:
            kept = fts.tokenized(self.live(rows).join(stale, "session_id", "left_anti").drop("segment", "bucket"))
            new = cut(kept.select(new.columns).unionByName(new))
        size = lambda df: list(df.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())
        came, went = size(new), size(gone)
        totals = came if compact else [a + b - c for a, b, c in zip(self.state["totals"], came, went)]
        segment = 1 + max(self.state["segments"], default=self.state.get("last_segment", 0))
        parts = blocks.spread(new)
        known = self.state["tables"].get("spread")
        if known and not compact:  # slots stay as they are dealt, and a class of lengths that is new gets its own
            parts = self.table("spread").unionByName(parts.join(self.table("spread"), "class", "left_anti"))
        parts = cut(parts)
        added = fts.postings(new)
        small = came[0] + went[0] <= SMALL
        self._write("chunks", segment, new, totals[0], small)
        self._write("blocks", segment, blocks.blocked(added, parts), 0, small)
        frequencies = fts.frequencies(added)
        self._write("frequencies", segment, frequencies if compact else fts.changed_frequencies(frequencies.limit(0), fts.postings(gone), added), 0, small)
        marks = self.table("marks").limit(0) if compact else self._marked(stale, segment - 1)
        self.change(**changes, tables=self.written({**(tables or {}), "spread": parts, "marks": marks}), segments=[segment] if compact else [*self.state["segments"], segment], last_segment=segment, marked=not compact, totals=totals)

    def _marked(self, sessions: DataFrame, upto: int, column: str = "upto") -> DataFrame:
        """The marks, with these sessions' rows up to a segment void, or held."""
        row = sessions.select("session_id", *(F.lit(upto if c == column else None).cast("int").alias(c) for c in ("upto", "held")))
        return self.table("marks").unionByName(row).groupBy("session_id").agg(F.max("upto").alias("upto"), F.max("held").alias("held"))

    def _write(self, name: str, segment: int, df: DataFrame, chunks: int, small: bool) -> None:
        """Writes a table of a segment: sorted, in ranges, or in one piece if the segment is known to be small."""
        known = {c.split()[0] for c in SCHEMAS[name].split(", ")}
        columns = [c for c in df.columns if name == "blocks" or c in known]
        order = ["token", "field", *(["slot"] if name == "blocks" else [])]
        df = df.select(*columns)
        if name == "chunks":
            order = ["bucket", "session_id"]
            df = df.withColumn("bucket", bucket(F.col("session_id"), max(LEAST_BUCKETS, chunks // BUCKET)))
        writer = (df.coalesce(1) if small else df.repartitionByRange(*order)).sortWithinPartitions(*order).write.mode("overwrite")
        (writer.partitionBy("bucket") if name == "chunks" else writer).parquet(f"{self.home}/{name}/segment={segment}")

    def configure(self, **patch) -> dict:
        unknown = set(patch) - set(self.state["config"])
        if unknown:
            raise StoreError("config-invalid", f"unknown settings: {sorted(unknown)}")
        config = {**self.state["config"], **patch}
        config["config_version"] += 1
        self.change(config=config)
        return config

    def set_projection_status(self, status: str) -> None:
        config = dict(self.state["config"])
        if status != "ready":
            config["auto_recall"] = False
        self.change(projection_status=status, config=config)

    def exclude(self, session: str, reason: str = "user") -> None:
        """The session's chunks go; later scans pass it over."""
        self.refresh()
        row = self.spark.createDataFrame([(session, now(), reason)], SCHEMAS["exclusions"])
        sessions = self.table("sessions").withColumn("status", F.when(F.col("session_id") == session, "excluded").otherwise(F.col("status")))
        self.replace_chunks(row.select("session_id"), tables={"exclusions": upsert(self.table("exclusions"), row, ["session_id"]), "sessions": sessions})

    def include(self, session: str, rescan: bool = False) -> None:
        """The session may be indexed again: at the next rebuild, or with `rescan` at the next scan."""
        self.refresh()
        mine = F.col("session_id") == session
        sessions = self.table("sessions").withColumn("status", F.when(mine, "active").otherwise(F.col("status")))
        if rescan:
            sessions = self.without_cursor(sessions, mine)
        self.publish({"exclusions": self.table("exclusions").where(~mine), "sessions": sessions})

    def reconcile(self, session: str) -> None:
        """Marks a session as being replaced: it is hidden from search and nothing of it is recalled."""
        self.refresh()
        mine = F.col("session_id") == session
        marks = self._marked(self.spark.createDataFrame([(session,)], "session_id string"), max(self.state["segments"], default=0), "held")
        self.publish({"marks": marks, "sessions": self.table("sessions").withColumn("status", F.when(mine, "reconciling").otherwise(F.col("status")))}, marked=True)

    @staticmethod
    def without_cursor(sessions: DataFrame, which: Column) -> DataFrame:
        for name, empty in (("prefix_hash", None), ("trailing_line_hash", None), ("file_size", 0), ("scan_byte_offset", 0), ("listed_bytes", None), ("listed_at", None)):
            sessions = sessions.withColumn(name, F.when(which, F.lit(empty)).otherwise(F.col(name)))
        return sessions

    def _emptied(self, sessions: DataFrame, **changes) -> None:
        self.publish({"sessions": sessions, "marks": self.table("marks").limit(0)}, segments=[], last_segment=max(self.state["segments"], default=self.state.get("last_segment", 0)), marked=False, totals=[0, 0], **changes)

    def clear(self) -> None:
        """All bodies go and all cursors are reset: the next scan indexes everything again."""
        self.refresh()
        self._emptied(self.without_cursor(self.table("sessions"), F.lit(True)))

    def purge(self) -> None:
        """As `clear`, but excluded sessions keep their cursors, and indexing and automatic recall are switched off."""
        self.refresh()
        self._emptied(self.without_cursor(self.table("sessions"), F.col("status") != "excluded"), config={**self.state["config"], "indexing_enabled": False, "auto_recall": False})

    def delete(self) -> None:
        self._fs().delete(self._path(self.home), True)
        self._frames, self.state = {}, json.loads(json.dumps(FRESH))

    # Diagnostics

    def log(self, rows: DataFrame) -> None:
        """Adds diagnostics to the folder of their day; folders of days before the last KEPT_DAYS go."""
        rows.withColumn("day", F.substring("at", 1, 10)).write.mode("append").partitionBy("day").parquet(f"{self.home}/diagnostics")
        oldest = time.strftime("%Y-%m-%d", time.gmtime(time.time() - KEPT_DAYS * 86_400))
        for found in self._fs().listStatus(self._path(f"{self.home}/diagnostics")):
            name = found.getPath().getName()
            if name.startswith("day=") and name[4:] < oldest:
                self._fs().delete(found.getPath(), True)

    def diagnose(self, code: str, detail: str = "", session_hash: str | None = None, count: int = 1, at: str | None = None) -> None:
        """Adds a diagnostic: one line, at most 500 characters."""
        self.log(self.spark.createDataFrame([(at or now(), session_hash, code, " ".join(detail.split())[:500], count)], SCHEMAS["diagnostics"]))

    # Views and checks

    def misplaced(self) -> DataFrame:
        """(session_id, file_path) of sessions whose file does not lie under the root that they belong to."""
        rows = self.table("sessions").where("status <> 'deleted'")
        held = roots.holding(rows.select(F.col("file_path").alias("path")).distinct(), roots.table(self.spark, self.state["roots"])).select(F.col("path").alias("file_path"), "root_id")
        return rows.join(held, ["file_path", "root_id"], "left_anti").select("session_id", "file_path")

    def session_chunks(self, session: str) -> DataFrame:
        """A session's chunks in order: entries by Unicode collation, then blocks and chunks."""
        return self.live(self.rows("chunks").where(F.col("session_id") == session)).drop("segment", "bucket").orderBy(F.collate("entry_id", "UNICODE"), "block_index", "chunk_index")

    def integrity(self) -> dict:
        """Whether the projection has the chunks' keys and no others, is of these versions, and every session lies under its root."""
        chunks = self.table("chunks").select("source_key", (F.col("dl") > 0).alias("told"))
        indexed = self.postings().select("source_key").distinct().withColumn("indexed", F.lit(True))
        each = chunks.join(indexed, "source_key", "full").agg(
            F.count("told").alias("chunks"), F.count("indexed").alias("indexed"), F.count_if(F.col("told").isNull()).alias("extra"), F.count_if(F.col("told") & F.col("indexed").isNull()).alias("missing")
        ).first()
        same = self.state["versions"] == FRESH["versions"]
        placed = self.misplaced().isEmpty()
        whole = not each.extra and not each.missing and each.chunks == self.state["totals"][0]
        status = self.state["projection_status"] if placed and whole else "degraded"
        return {"chunks": each.chunks, "indexed": each.indexed, "versions_match": same, "paths_match": placed, "status": status, "ready": same and status == "ready"}

    def health(self) -> dict:
        """What can be told of the home folder without reading a table: whether it is there, and which parts it has."""
        state = self._exists(f"{self.home}/state")
        parts = {name: self._exists(path) for name, path in self.state["tables"].items()} | {f"{name}/{s}": self._exists(f"{self.home}/{name}/segment={s}") for name in SEGMENTED for s in self.state["segments"]}
        return {"home": self.home, "exists": self._exists(self.home), "state": state, "tables": parts, "healthy": bool(state and all(parts.values()))}
