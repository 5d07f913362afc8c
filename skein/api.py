"""The session index as one object: setup, scan, search, recall, exclusion, rebuild and purge; and its command line."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein import versions as V
from skein.functions import keys, policy
from skein.operators import blocks, chunker, fts, provenance, recall, scan, search
from skein.operators import roots as owning
from skein.sources import sessions as S
from skein.sources.store import Store, StoreError, now, upsert
from skein.streaming.cuts import cut

#: Chunks up to which a search ranks all matches, which is one pass, and queries whose matches come to the driver (256 each).
EXHAUSTIVE, FEW = 100_000, 4


def _project_root(cwd: str) -> str:
    """kind|root: the nearest folder above with a .git, else the folder itself."""
    start = at = cwd.replace("\\", "/").rstrip("/") or "/"
    if at[1:3] == ":/":
        start = at = at[0].lower() + at[1:]
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return f"git|{at}"
        if os.path.dirname(at) == at or not os.path.dirname(at):
            return f"cwd|{start}"
        at = os.path.dirname(at)


class RequestContext:
    """What is recalled for the request at hand.  A bundle that comes after the next request has begun is dropped."""

    def __init__(self):
        self.generation, self.bundle = 0, None

    def begin(self) -> int:
        self.generation += 1
        self.bundle = None
        return self.generation

    def attach(self, generation: int, bundle: dict) -> bool:
        """Whether the bundle became the active one: it has an envelope and its request is still the current one."""
        if generation != self.generation or "envelope" not in bundle:
            return False
        self.bundle = bundle
        return True

    def system_prompt(self, prompt: str) -> str:
        """The prompt, with the trust rule only while something is recalled."""
        return f"{prompt}\n\n{self.bundle['trust_rule']}" if self.bundle else prompt

    def end(self) -> None:
        self.bundle = None


class SessionIndex:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.store = spark, Store(spark, home)

    # Setup and state

    def setup(self, roots: list[str], auto_recall: bool = False) -> dict:
        known = {os.path.normpath(os.path.abspath(r)): True for r in roots}
        self.store.refresh()
        self.store.change(roots={**self.store.state["roots"], **known})
        return self.store.configure(setup_completed=True, indexing_enabled=True, auto_recall=auto_recall)

    def status(self) -> dict:
        self.store.refresh()
        by_status = {r["status"]: r["count"] for r in self.store.table("sessions").groupBy("status").count().collect()}
        return {**self.store.state["config"], **self.store.integrity(), "sessions": by_status, "roots": sorted(self.store.state["roots"]), "revision": self.store.state["revision"]}

    def project_key(self, cwd: str) -> str:
        kind, root = _project_root(cwd).split("|", 1)
        return self.spark.range(1).select(keys.project_key(F.lit(root), F.lit(kind))).first()[0]

    # Scanning

    def index(self, root: str | None = None, force: bool = False, paths: list[str] | None = None) -> dict:
        """Scans the roots, or one of them, or given files, and publishes what has changed.  Counts of what was done."""
        state = self.store.refresh()
        if not state["config"]["setup_completed"]:
            raise StoreError("setup-required")
        if not state["config"]["indexing_enabled"]:
            return {"scanned": 0, "indexed": 0, "skipped_excluded": 0, "chunks": 0, "dispositions": {"indexing-disabled": 1}}
        if root is not None:
            root = os.path.normpath(os.path.abspath(root))
            self.store.change(roots={**self.store.state["roots"], root: True})
        roots = sorted(r for r, enabled in self.store.state["roots"].items() if enabled)
        return self._index(roots, [root] if root else roots, force, paths)

    def _index(self, roots: list[str], scanned: list[str], force: bool, paths: list[str] | None) -> dict:
        registered, mine = owning.table(self.spark, roots), owning.table(self.spark, scanned)
        listed = S.listing(self.spark, roots)
        if paths:
            chosen = self.spark.createDataFrame([(S.assert_readable(p, roots),) for p in paths], "path string").distinct()
        else:
            chosen = owning.holding(listed.select("path"), mine).select("path").distinct()
        listed = listed.join(chosen.withColumn("mine", F.lit(True)), "path", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
        old = self.store.table("sessions").withColumnRenamed("status", "old_status")
        excluded = self.store.table("exclusions").select("session_id", F.lit(True).alias("excluded"))
        # Files as they were listed when they were last read are not read again; of the others each is.
        before = old.select(F.col("file_path").alias("path"), "session_id", "parent_session", F.col("header_project_key").alias("project_key"), "old_status", F.col("listed_bytes").alias("b"), F.col("listed_at").alias("t"))
        same = (F.col("b") == F.col("listed_bytes")) & (F.col("t") == F.col("listed_at")) & (F.col("old_status") != "deleted") & ~(F.col("mine") & F.lit(force))
        listed = cut(listed.join(before, "path", "left").withColumn("quiet", F.coalesce(same, F.lit(False))))
        # One read: lines, headers and cursors are of the same content.
        files = cut(S.read(self.spark, [r.path for r in listed.where("NOT quiet").select("path").toLocalIterator()]))
        split = cut(S.lines(files))
        fresh = S.headers(split, files)
        projects = self._projects(fresh)
        heads = cut(
            fresh.join(projects, "cwd", "left").select("path", "session_id", "status", "parent_session", "project_key")
            .unionByName(listed.where("quiet").select("path", "session_id", F.lit("ok").alias("status"), "parent_session", "project_key"))
        )
        # Of files with one session id the last by path counts.
        last = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("path")))
        first = heads.where("status = 'ok'").withColumn("nth", last).where("nth = 1").drop("nth").unionByName(heads.where("status <> 'ok'"))
        chosen = first.join(listed.where("mine").select("path", "quiet", "listed_bytes", "listed_at"), "path").join(excluded, "session_id", "left")
        joined = files.select("path", "content").join(chosen.where("NOT quiet"), "path").join(old.drop("parent_session", "listed_bytes", "listed_at"), "session_id", "left")
        found = scan.disposition(F.col("content"), F.col("scan_byte_offset"), F.col("trailing_line_hash"), F.col("prefix_hash"), F.col("file_size"))
        said = (
            F.when(F.col("status") != "ok", "header-invalid")
            .when(F.col("excluded"), "excluded")
            .when((found == "unchanged") & F.lit(not force), F.when(F.col("file_path") != F.col("path"), "moved").when(F.col("old_status") == "deleted", "append").otherwise("unchanged"))
            .otherwise(F.when(found == "unchanged", "full-reconcile").otherwise(found))
        )
        seen = cut(joined.select("path", "session_id", "status", "project_key", "parent_session", "listed_bytes", "listed_at", "old_status", said.alias("disposition"), scan.cursor(F.col("content")).alias("c")))
        quiet = chosen.where("quiet").select("session_id", F.when(F.col("excluded"), "excluded").otherwise("unchanged").alias("disposition"))
        dispositions = cut(seen.select("session_id", "disposition").unionByName(quiet))
        work = seen.where("disposition IN ('append', 'rewrite', 'truncate', 'full-reconcile')")
        chunks, bad = self._chunks(split, fresh, heads, work.select("path"), roots)
        tokens = cut(fts.tokenized(chunks))
        owner = owning.owners(seen.select("path"), registered).select("path", "root_id")
        rows = seen.where("status = 'ok' AND disposition <> 'excluded'").join(owner, "path", "left").select(
            "session_id", "root_id", "parent_session", F.col("project_key").alias("header_project_key"), F.col("path").alias("file_path"), "c.prefix_hash", "c.trailing_line_hash",
            F.when(F.col("disposition") == "unchanged", F.col("old_status")).otherwise("active").alias("status"), F.lit(None).cast("string").alias("error_code"), F.lit(now()).alias("updated_at"),
            F.col("c.size_bytes").alias("file_size"), F.col("c.byte_offset").alias("scan_byte_offset"), "listed_bytes", "listed_at",
        )
        sessions = upsert(self.store.table("sessions"), rows, ["session_id"])
        if not paths:  # what was under a scanned root and is no longer there
            held = owning.holding(sessions.select(F.col("file_path").alias("path")).distinct(), mine).select(F.col("path").alias("file_path"), F.lit(True).alias("held")).distinct()
            gone = scan.gone(sessions.join(held, "file_path", "left"), dispositions.select("session_id"), F.coalesce("held", F.lit(False))).drop("held")
            sessions = Store.without_cursor(gone, F.col("gone")).withColumn("status", F.when(F.col("gone"), "deleted").otherwise(F.col("status"))).drop("gone")
        sessions = cut(sessions)
        deleted = sessions.where("status = 'deleted'").select("session_id")
        before_deleted = self.store.table("sessions").where("status = 'deleted'").select("session_id")
        stale = cut(work.select("session_id").unionByName(deleted.join(before_deleted, "session_id", "left_anti")).distinct())
        histogram = {r["disposition"]: r["count"] for r in scan.histogram(dispositions).collect()}
        bad = cut(bad)
        unresolved = bad.agg(F.coalesce(F.sum(F.when(F.col("code") == "provenance-unresolved", F.col("count"))), F.lit(0))).first()[0]
        done = {
            "scanned": sum(histogram.values()), "indexed": work.count(), "skipped_excluded": histogram.get("excluded", 0), "chunks": tokens.count(), "deleted": deleted.count(),
            "unresolved_copied": unresolved, "dispositions": histogram,
        }
        if seen.isEmpty() and stale.isEmpty():
            return done
        if not bad.isEmpty():
            self.store.log(bad.select(F.lit(now()).alias("at"), "session_hash", "code", "detail", F.col("count").cast("long").alias("count")))
        project_rows = projects.select("project_key", "kind", "normalized_root").distinct()
        tables = {"sessions": sessions, "projects": upsert(self.store.table("projects"), project_rows, ["project_key"])}
        if stale.isEmpty():
            self.store.publish(tables, projection_status="ready")
        else:
            self.store.replace_chunks(stale, tokens, tables, projection_status="ready")
        return done

    def _projects(self, heads: DataFrame) -> DataFrame:
        """(cwd, kind, normalized_root, project_key) of the folders where these sessions began.

        A folder's project is found by looking for .git above it, here, where the files were listed: executors need not see it.
        """
        cwds = [r.cwd for r in heads.where("cwd IS NOT NULL").select("cwd").distinct().toLocalIterator()]
        found = self.spark.createDataFrame([(c, *_project_root(c).split("|", 1)) for c in cwds], "cwd string, kind string, normalized_root string")
        return found.withColumn("project_key", keys.project_key(F.col("normalized_root"), F.col("kind")))

    def _chunks(self, split: DataFrame, fresh: DataFrame, heads: DataFrame, work: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
        """(chunks of the files in `work`, diagnostics); ancestors of these that were not read for their own sake are read now."""
        links, broken = provenance.chains(heads, roots, cut, work)
        links = cut(links)
        ancestors = links.select(F.col("ancestor").alias("path")).distinct()
        more = S.read(self.spark, [r.path for r in ancestors.join(fresh.select("path"), "path", "left_anti").toLocalIterator()])
        further = S.lines(more)
        needed = work.unionByName(ancestors).distinct()
        rows = cut(S.parsed(split.unionByName(further).join(needed, "path", "left_semi"), fresh.unionByName(S.headers(further, more))))
        messages = S.entries(rows).where("type = 'message'")
        messages = messages.withColumn("fingerprint", keys.fingerprint(F.col("entry_id"), F.col("parent_id"), F.col("role"), F.col("raw_content")))
        told = cut(provenance.attribute(heads, messages, roots, cut, (links, broken)).join(work, "path", "left_semi"))
        blocks = told.where("provenance = 'verified'").select("*", F.posexplode("text_blocks").alias("block_index", "raw"))
        judged = policy.applied(blocks, "raw", compose=True).withColumn("pieces", chunker.chunks(F.col("clean")))
        each = judged.select("*", F.posexplode_outer("pieces").alias("chunk_index", "chunk")).where("chunk IS NOT NULL")
        chunks = each.select(
            keys.source_key(F.col("session_id"), F.col("entry_id"), F.col("block_index"), F.col("chunk_index")).alias("source_key"), keys.content_hash(F.col("chunk")).alias("content_hash"),
            F.lit(V.POLICY_VERSION).alias("policy_version"), "session_id", "entry_id", "block_index", "chunk_index", "origin_project_key", "provenance", "role", "occurred_at",
            F.col("chunk").alias("text"), F.lit(V.CHUNKER_VERSION).alias("chunker_version"), "auto_eligible",
        ).dropDuplicates(["source_key", "content_hash", "policy_version"])
        hashed = keys.session_hash(F.col("session_id")).alias("session_hash")
        code = F.when(F.col("rejected_by") == "secret-reject", "secret-rejected").when(F.col("rejected_by") == "size-reject", "entry-oversized")
        rejected = judged.select("path", hashed, code.alias("code"), F.col("rejected_by").alias("detail"), F.lit(1).alias("count")).where("code IS NOT NULL")
        lost = told.where("provenance <> 'verified'").select("path", hashed, F.lit("provenance-unresolved").alias("code"), F.col("reason").alias("detail"), F.lit(1).alias("count"))
        about = S.diagnostics(fresh, rows)
        return chunks, about.join(work, "path", "left_semi").unionByName(rejected).unionByName(lost)

    # Search and recall

    def _closed(self) -> str | None:
        """Why nothing can be searched."""
        state = self.store.refresh()
        if state["projection_status"] != "ready":
            return "projection-unavailable"
        return None if state["config"]["setup_completed"] else "setup-required"

    def matches(self, queries: DataFrame, tokens: list[str] | None = None) -> DataFrame:
        """The 256 best matches of each row of `queries` (query_id, terms, project); `tokens` may list those of a few queries."""
        wanted = cut(fts.phrases_of(queries)) if tokens is None else fts.phrases_of(queries)
        blocks_ = fts.of_queries(self.store.rows("blocks"), wanted, tokens)
        kept = fts.summed_frequencies(fts.of_queries(self.store.rows("frequencies"), wanted, tokens).drop("segment"))
        if self.store.state["totals"][0] <= EXHAUSTIVE:
            return search.first_matches(self.store.live(blocks.opened(blocks_)).drop("segment", "slot"), self.store.stats(), wanted, kept)
        return blocks.best(blocks_, cut(kept), self.store.stats(), wanted, V.MATCH_LIMIT, self.store.live, cut)[0]

    def _search(self, queries: DataFrame, as_of: str | None, options: dict, tokens: list[str] | None = None, few: bool = False) -> DataFrame:
        found, chunks = self.matches(queries, tokens), self.store.rows("chunks")
        if few:
            # At most 256 matches a query: their sessions are a filter that reaches the scan of the chunks.
            rows = found.collect()
            found = self.spark.createDataFrame(rows, found.schema)
            chunks = chunks.where(F.col("session_id").isin(sorted({r.session_id for r in rows})))
        options.setdefault("limit", self.store.state["config"]["manual_limit"])
        chunks = self.store.live(chunks).drop("segment", "bucket")
        return search.search(found, chunks, self.store.table("sessions"), queries, as_of or now(), search.Options(**options))

    def search(self, query: str | dict[int, str], scope: str = "all", cwd: str | None = None, as_of: str | None = None, **options) -> DataFrame:
        """Hits of one query, or of many by id.  `scope` project takes the project of `cwd`."""
        if closed := self._closed():
            raise StoreError(closed)
        queries = query if isinstance(query, dict) else {0: query}
        tokens = fts.query_tokens(queries.values())
        if scope == "project" and not cwd:
            raise StoreError("project-unresolved")
        project = self.project_key(cwd) if scope == "project" else None
        return self._search(search.asked(self.spark, queries, project), as_of, options, tokens, len(queries) <= FEW)

    def search_all(self, prompts: DataFrame, as_of: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """Hits of all rows of `prompts` (query_id, text and maybe project), and (query_id, reason) of those that are no queries."""
        if closed := self._closed():
            raise StoreError(closed)
        found = cut(fts.parsed(prompts))
        return self._search(found.where("reason IS NULL"), as_of, options), found.where("reason IS NOT NULL").select("query_id", "reason")

    def tool_search(self, query: str, cwd: str, limit: int | None = None) -> DataFrame:
        limit = self.store.state["config"]["tool_limit"] if limit is None else limit
        return search.safe_hits(self.search(query, "project", cwd, limit=limit, most=V.TOOL_MOST))

    def recall_all(self, prompts: DataFrame, as_of: str | None = None) -> DataFrame:
        """(request_id, reason, records, envelope, tokens) for all `prompts` (request_id, prompt, project, session): what is recalled
        for each, or why nothing is.  All of them are searched in one plan; a session gives no hits to its own prompts."""
        state = self.store.refresh()
        config = state["config"]
        closed = None if config["auto_recall"] and config["setup_completed"] else "auto-off" if config["setup_completed"] else "setup-required"
        if not closed and state["projection_status"] != "ready":
            closed = "rebuild-partial" if state["projection_status"] == "partial" else "projection-unavailable"
        asked = cut(recall.gated(prompts, closed))
        options = {"limit": config["auto_max_records"], "auto_eligible_only": True, "verified_only": True, "least_coverage": V.RECALL_COVERAGE}
        queries = asked.where("reason IS NULL").select(F.col("request_id").alias("query_id"), "terms", "project", F.col("session").alias("exclude_session"))
        hits = cut(self._search(queries, as_of, options))
        return recall.answered(asked, hits, config["auto_max_records"], config["auto_max_tokens"])

    def auto_retrieve(self, prompt: str, cwd: str, request: str = "0", session: str | None = None, as_of: str | None = None) -> dict:
        """{"reason"} if nothing is recalled for one prompt, else {"envelope", "records", "tokens", "trust_rule"}."""
        row = (request, prompt, self.project_key(cwd) if cwd else None, session)
        found = self.recall_all(self.spark.createDataFrame([row], "request_id string, prompt string, project string, session string"), as_of).first()
        return {"reason": found.reason} if found.reason else {"envelope": found.envelope, "records": found.records, "tokens": found.tokens, "trust_rule": recall.trust_rule()}

    # Exclusion, rebuild, purge

    def exclude_session(self, session: str, reason: str = "user") -> None:
        self.store.exclude(session, reason)

    def include_session(self, session: str, rescan: bool = False) -> None:
        self.store.include(session, rescan)

    def rebuild(self) -> dict:
        self.store.set_projection_status("partial")
        self.store.clear()
        return self.index(force=True)

    def purge_index(self) -> None:
        self.store.purge()

    def purge_data(self) -> None:
        self.store.delete()

    def probe(self) -> dict:
        return {"spark": self.spark.version, "ready": self.store.integrity()["ready"], "health": self.store.health()}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skein", description="Index and search session files with Spark.")
    parser.add_argument("--home", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.choices.get(name) or sub.add_parser(name)] and [sub.choices[name].add_argument(*a, **k) for a, k in args]
    add("setup", (("roots",), {"nargs": "+"}), (("--auto",), {"action": "store_true"}))
    add("index", (("--root",), {}), (("--force",), {"action": "store_true"}))
    add("search", (("query",), {}), (("--project",), {"metavar": "CWD"}), (("--limit",), {"type": int}), (("--plain",), {"action": "store_true"}))
    for name in ("exclude-session", "include-session"):
        add(name, (("session",), {}))
    for name in ("status", "rebuild", "purge-index", "purge-data", "probe"):
        add(name)
    args = parser.parse_args(argv)
    index = SessionIndex(SparkSession.builder.getOrCreate(), args.home)
    try:
        if args.command == "setup":
            out = index.setup(args.roots, args.auto)
        elif args.command == "index":
            out = index.index(args.root, args.force)
        elif args.command == "search":
            hits = index.search(args.query, "project" if args.project else "all", args.project, **({"limit": args.limit} if args.limit is not None else {}))
            if args.plain:
                print(search.plain(hits, index.spark.createDataFrame([(0,)], "query_id int")).first().shown)
                return 0
            out = [r.asDict() for r in search.safe_hits(hits).collect()]
        elif args.command in ("exclude-session", "include-session"):
            out = getattr(index, args.command.replace("-", "_"))(args.session)
        else:
            out = getattr(index, args.command.replace("-", "_"))()
    except (StoreError, fts.QueryInvalid, S.PathRejected, S.SizeLimitExceeded) as error:
        print(json.dumps({"error": error.code}), file=sys.stderr)
        return 1
    print(json.dumps({"ok": True} if out is None else out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
