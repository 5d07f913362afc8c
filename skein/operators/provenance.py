"""Attribution of messages to the project where they were first written, along chains of parent sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.versions import PARENT_DEPTH

MISSING, CYCLE, DEEP, UNRESOLVED = "parent-missing", "parent-cycle", "parent-chain-too-deep", "provenance-unresolved"


def resolve_path(path: Column, more: Column | None = None) -> Column:
    """An absolute path without . and ..: `more` inside `path`, or alone if it is absolute itself."""
    whole = path if more is None else F.when(F.startswith(more, F.lit("/")), more).otherwise(F.concat(path, F.lit("/"), more))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", up(done)).otherwise(F.array_append(done, p))), "/"))


def parents(sessions: DataFrame, roots: list[str]) -> DataFrame:
    """(path, parent_path) for each session that names a parent; parent_path is null if no candidate is a file inside the roots.

    Candidates in order: the name as it is, beside the session, its last part beside the session, then both under each root.
    """
    children = sessions.where("parent_session IS NOT NULL").select("path", "parent_session", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), X.base_name(F.col("parent_session")).alias("base"))
    named = [("parent_session",), ("dir", "parent_session"), ("dir", "base")]
    tried = [resolve_path(*map(F.col, x)) for x in named] + [resolve_path(F.lit(r), F.col(x)) for x in ("parent_session", "base") for r in roots]
    each = children.select("path", F.posexplode(F.array(*tried)).alias("nth", "candidate"))
    inside = F.lit(False)
    for r in roots:
        inside = inside | (F.col("candidate") == r) | F.startswith(F.col("candidate"), F.lit(r.rstrip("/") + "/"))
    found = each.where(inside).join(sessions.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path").agg(F.min_by("candidate", "nth").alias("parent_path"))
    return children.select("path").join(found, "path", "left")


def _judged(chain: Column) -> Column:
    """Why each member of a chain, nearest first, can't be an ancestor, or null: `chain` has (path, id, status, more)."""
    def reason(x, i):
        before = F.slice(chain, F.lit(1), i)
        return (
            F.when(x["path"].isNull() | x["status"].isNull(), MISSING)
            .when(F.exists(before, lambda y: y["path"] == x["path"]), CYCLE)
            .when(x["status"] != "ok", MISSING)
            .when(F.exists(before, lambda y: y["id"] == x["id"]), CYCLE)
        )

    return F.transform(chain, reason)


def chains(sessions: DataFrame, roots: list[str], cut=lambda df: df, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, ancestor, depth) with 0 for the nearest parent, and (path, reason) of sessions whose chain is broken.

    All sessions know their parent at first, and in each round the chain of a session is followed by that of its last member, so
    five rounds know the 32 ancestors that count, and fewer do where no chain is as long.  In a cycle members come again, which
    is seen in the end.  `of` names the sessions (path) whose chains are wanted, and `cut` may checkpoint each round.
    """
    header = sessions.select(F.col("path").alias("parent_path"), F.col("session_id").alias("id"), "status", F.col("parent_session").isNotNull().alias("more"))
    member = F.struct(F.col("parent_path").alias("path"), "id", "status", F.coalesce("more", F.lit(False)).alias("more"))
    known = cut(parents(sessions, roots).join(header, "parent_path", "left").select("path", F.array(member).alias("chain")))
    last = F.element_at("chain", -1)
    going = (last["status"] == "ok") & last["more"]
    length = 1
    while length < PARENT_DEPTH and not known.where((F.size("chain") == length) & going).isEmpty():
        further = known.select(F.col("path").alias("end"), F.col("chain").alias("rest"))
        open_ = F.when((F.size("chain") == length) & going, last["path"])
        longer = F.slice(F.concat("chain", F.coalesce("rest", F.array().cast(known.schema["chain"].dataType))), 1, PARENT_DEPTH)
        known = cut(known.withColumn("end", open_).join(further, "end", "left").select("path", longer.alias("chain")))
        length *= 2
    if of is not None:
        known = known.join(of.select("path").distinct(), "path", "left_semi")
    judged = known.withColumn("reasons", _judged(F.col("chain"))).withColumn("good", F.coalesce(F.nullif(F.array_position(F.transform("reasons", lambda r: r.isNotNull()), True), F.lit(0)) - 1, F.size("chain")).cast("int"))
    judged = cut(judged.select("path", "chain", "good", F.get("reasons", F.col("good")).alias("reason")))
    links = judged.select("path", F.posexplode(F.slice("chain", F.lit(1), F.col("good"))).alias("depth", "a")).select("path", F.col("a.path").alias("ancestor"), "depth")
    deep = F.when((F.col("good") == PARENT_DEPTH) & F.element_at("chain", -1)["more"], DEEP)
    return links, judged.select("path", F.coalesce("reason", deep).alias("reason")).where("reason IS NOT NULL")


#: Sessions with one ancestor that meet its messages in one task, about.
HOT = 1000


def _met(links: DataFrame, messages: DataFrame, hot: int) -> DataFrame:
    """(path, entry_id, fingerprint, ancestor, depth, theirs, at): messages and those of their id in each ancestor.

    What comes from an ancestor of more than `hot` sessions is dealt into as many more parts by session, and the ancestor's messages
    are repeated for each part.
    """
    parts = links.groupBy("ancestor").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1")
    dealt = links.join(parts, "ancestor", "left").withColumn("part", F.pmod(F.xxhash64("path"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    own = messages.select("path", "entry_id", "fingerprint").distinct().join(dealt, "path")
    theirs = messages.select(F.col("path").alias("ancestor"), "entry_id", F.col("fingerprint").alias("theirs"), F.col("pos").alias("at")).join(parts, "ancestor", "left")
    theirs = theirs.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return own.join(theirs, ["ancestor", "part", "entry_id"])


def attribute(sessions: DataFrame, messages: DataFrame, roots: list[str], cut=lambda df: df, found: tuple[DataFrame, DataFrame] | None = None, hot: int = HOT) -> DataFrame:
    """`messages` (path, pos, entry_id, fingerprint, ...) with provenance, origin_project_key and reason.

    A message belongs to the earliest ancestor that has the same one, else to its own session's project.  It is unresolved if the
    chain is broken or if the nearest ancestor that has its id has another content for it.  `found` may give the chains.
    """
    links, broken = found or chains(sessions, roots, cut)
    links = cut(links)
    own = sessions.select("path", F.col("project_key").alias("own_project"))
    # Equal fingerprints have equal ids, so one meeting by id tells both; a session's message has at most 32 ancestors to meet.
    met = _met(links, messages, hot).groupBy("path", "entry_id", "fingerprint").agg(
        F.max_by("ancestor", F.when(F.col("theirs") == F.col("fingerprint"), F.col("depth"))).alias("first"),
        F.max_by("theirs", F.struct(-F.col("depth"), "at")).alias("nearest"), F.max(F.col("theirs") == F.col("fingerprint")).alias("same"),
    )
    projects = own.select(F.col("path").alias("first"), F.col("own_project").alias("first_project"))
    met = met.withColumn("first", F.when(F.col("same"), F.col("first"))).join(projects, "first", "left").drop("first", "same")
    df = messages.join(own, "path").join(broken, "path", "left").join(met, ["path", "entry_id", "fingerprint"], "left")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("nearest") != F.col("fingerprint"), UNRESOLVED)
    df = df.withColumn("reason", reason)
    return df.withColumns({
        "provenance": F.when(F.col("reason").isNull(), "verified").otherwise("unresolved"),
        "origin_project_key": F.when(F.col("reason").isNull(), F.coalesce("first_project", "own_project")),
    }).drop("own_project", "first_project", "nearest")
