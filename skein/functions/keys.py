"""Keys and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.versions import CHUNKER_VERSION


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def source_key(session: Column, entry: Column, block: Column, chunk: Column, version: str = CHUNKER_VERSION) -> Column:
    return F.sha2(F.concat_ws("|", session, entry, block.cast("string"), chunk.cast("string"), F.lit(version)), 256)


def persistence_key(source: Column, content: Column, policy: Column) -> Column:
    return F.concat_ws("|", source, content, policy)


def project_key(root: Column, kind: Column | None = None) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("v1"), F.lit("cwd") if kind is None else kind, root), 256)


def session_hash(session: Column) -> Column:
    return F.substring(F.sha2(session, 256), 1, 16)


def entry_id(seed: Column) -> Column:
    return F.substring(F.sha2(seed, 256), 1, 8)


def root_id(path: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(path, 256), 1, 32))


def is_legacy_root_id(id: Column) -> Column:
    return id.rlike("^user-[0-9a-f]{12}$")


def canonical_json(value: Column) -> Column:
    """A variant as JSON with sorted keys: equal values give equal strings within a run; missing is null."""
    return F.coalesce(F.to_json(value), F.lit("null"))


def fingerprint(entry: Column, parent: Column, role: Column, content: Column) -> Column:
    return F.concat_ws("|", entry, F.coalesce(parent, F.lit("null")), F.lit("message"), role, content_hash(content))
