"""Session files: JSON lines, a header first, then entries.  One scan of the files gives lines, entries, text blocks and diagnostics."""

from __future__ import annotations

import os
import stat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import keys
from skein.operators import scan
from skein.versions import MOST_FILE_BYTES, MOST_LINE_BYTES

VERSION = 3
KNOWN_TYPES = ("message", "compaction", "model_change", "thinking_level_change", "branch_summary", "custom", "file", "session_info")


class SizeLimitExceeded(ValueError):
    code = "size-limit-exceeded"


class PathRejected(ValueError):
    code = "path-rejected"


def discover(roots: list[str]) -> list[str]:
    """Regular *.jsonl files under local roots, by path; symbolic links and folders that can't be read are passed over."""
    found = []
    for root in roots:
        for folder, names, files in os.walk(root, onerror=lambda _: None, followlinks=False):
            names[:] = [n for n in names if not os.path.islink(os.path.join(folder, n))]
            found += [p for n in files if n.endswith(".jsonl") and stat.S_ISREG(os.lstat(p := os.path.join(folder, n)).st_mode)]
    return sorted(set(found))


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, listed_bytes, listed_at) of the session files under the roots, without reading one.

    Local roots are walked here, since links are passed over; folders of other file systems are listed by Spark.
    """
    local = [(p, *((at := os.lstat(p)).st_size, at.st_mtime_ns)) for p in discover([r for r in roots if "://" not in r])]
    found = spark.createDataFrame(local, "path string, listed_bytes long, listed_at long")
    for root in (r for r in roots if "://" in r):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
        found = found.unionByName(files.select("path", F.col("length").alias("listed_bytes"), F.unix_micros("modificationTime").alias("listed_at")))
    return found


def assert_readable(path: str, roots: list[str]) -> str:
    """The path, if it is a regular file inside one of the roots and no link; else PathRejected with the reason."""
    whole = os.path.normpath(os.path.abspath(path))
    if not any(whole == r or whole.startswith(r.rstrip("/") + "/") for r in map(os.path.abspath, roots)):
        raise PathRejected("outside-registered-roots")
    try:
        mode = os.lstat(whole).st_mode
    except FileNotFoundError:
        raise PathRejected("missing") from None
    except OSError:
        raise PathRejected("stat-failed") from None
    if not stat.S_ISREG(mode):
        raise PathRejected("not-regular-file")
    return whole


def read(spark: SparkSession, paths: list[str] | str, most_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """(path, length, content) of the files, or of all *.jsonl below a folder of any file system Spark knows."""
    files = spark.read.format("binaryFile")
    if isinstance(paths, str):
        df = files.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(paths)
    elif paths:
        df = files.load([p if "://" in p else f"file://{p}" for p in paths])
    else:
        return spark.createDataFrame([], "path string, length long, content binary")
    df = df.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "content")
    large = df.select("path", "length").where(F.col("length") > most_bytes).first()
    if large:
        raise SizeLimitExceeded(f"a session file has {large.length} bytes")
    # Spark's file sources pass over empty files.
    empty = [(p, 0, bytearray()) for p in paths if "://" not in p and os.path.exists(p) and not os.path.getsize(p)] if isinstance(paths, list) else []
    return df.unionByName(spark.createDataFrame(empty, "path string, length long, content binary")) if empty else df


def lines(files: DataFrame) -> DataFrame:
    """(path, pos, byte_offset, line, line_hash) of complete lines that aren't empty, pos from 0; a torn last line is held back.

    Lines end with \\n or \\r\\n.  A file has at most 64 MiB, so numbering its lines in one task is bounded.
    """
    text = F.decode(F.make_valid_utf8(scan.complete_prefix(F.col("content")).cast("string")).cast("binary"), "UTF-8")
    each = files.select("path", F.posexplode(F.split(text, "\n")).alias("nth", "piece"))
    by_file = W.partitionBy("path").orderBy("nth")
    start = F.coalesce(F.sum(F.octet_length("piece") + 1).over(by_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    cut = each.withColumn("byte_offset", start).withColumn("line", F.regexp_replace("piece", "\r\\z", "")).where("line <> ''")
    return cut.select("path", (F.row_number().over(by_file) - 1).alias("pos"), "byte_offset", "line", F.sha2("line", 256).alias("line_hash"))


def kind(value: Column, path: str) -> Column:
    """The type of a field of a variant: STRING, BIGINT, VOID for a JSON null, ...; null if the field is missing."""
    at = F.variant_get(value, path, "variant")
    return F.when(at.isNotNull(), F.schema_of_variant(at))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def is_string(value: Column, path: str) -> Column:
    return F.coalesce(kind(value, path) == "STRING", F.lit(False))


def text_blocks(role: Column, content: Column) -> Column:
    """array<string> of what a user or assistant says: a string as one block, or the non-empty text items of an array."""
    items = F.variant_get(content, "$", "array<variant>")
    said = F.filter(items, lambda x: is_object(x) & is_string(x, "$.type") & is_string(x, "$.text"))
    said = F.transform(F.filter(said, lambda x: F.variant_get(x, "$.type", "string") == "text"), lambda x: F.variant_get(x, "$.text", "string"))
    shape = F.coalesce(F.schema_of_variant(content), F.lit("VOID"))
    blocks = F.when(shape == "STRING", F.array(F.variant_get(content, "$", "string"))).when(F.startswith(shape, F.lit("ARRAY")), said)
    none = F.array().cast("array<string>")
    return F.when(role.isin("user", "assistant"), F.coalesce(F.filter(blocks, lambda x: x != ""), none)).otherwise(none)


def headers(split: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status, session_id, cwd, started_at, parent_session, detail) for each file."""
    v = F.try_parse_json("line")
    first = files.select("path").join(split.where("pos = 0").select("path", v.alias("v")), "path", "left")
    version = F.try_variant_get("v", "$.version", "double")
    numeric = F.coalesce(kind(F.col("v"), "$.version").rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.lit(False))
    typed = F.when(is_object(F.col("v")) & is_string(F.col("v"), "$.type"), F.variant_get("v", "$.type", "string"))
    fields = is_string(F.col("v"), "$.id") & is_string(F.col("v"), "$.cwd") & is_string(F.col("v"), "$.timestamp")
    detail = (
        F.when(F.coalesce(typed != "session", F.lit(True)), "type")
        .when(~numeric, "version")
        .when(version != VERSION, F.concat(F.lit("v"), F.regexp_replace(version.cast("string"), r"\.0$", "")))
        .when(~fields, "fields")
    )
    status = F.when(detail.isNull(), "ok").when(F.startswith(detail, F.lit("v")) & (detail != "version"), "legacy-unsupported").otherwise("header-invalid")
    get = lambda p: F.when(status == "ok", F.try_variant_get("v", p, "string"))
    parent = F.when((status == "ok") & is_string(F.col("v"), "$.parentSession"), F.variant_get("v", "$.parentSession", "string"))
    return first.select("path", status.alias("status"), get("$.id").alias("session_id"), get("$.cwd").alias("cwd"), get("$.timestamp").alias("started_at"), parent.alias("parent_session"), detail.alias("detail"))


def parsed(split: DataFrame, heads: DataFrame) -> DataFrame:
    """Every line after a valid header with its variant, its problem (null if none) and whether it is kept as an entry."""
    rows = split.where("pos > 0").join(heads.where("status = 'ok'").select("path", "session_id"), "path").withColumn("v", F.when(F.octet_length("line") <= MOST_LINE_BYTES, F.try_parse_json("line")))
    v, parent = F.col("v"), kind(F.col("v"), "$.parentId")
    typed = F.when(is_object(v) & is_string(v, "$.type"), F.variant_get("v", "$.type", "string"))
    fatal = (
        F.when(F.octet_length("line") > MOST_LINE_BYTES, "oversized")
        .when(v.isNull(), "json")
        .when(~is_object(v), "not-object")
        .when(typed.isNull(), "missing-type")
        .when(~is_string(v, "$.id") | parent.isNull() | ~is_string(v, "$.timestamp"), "entry-base")
        .when(~parent.isin("STRING", "VOID"), "parentId")
        .when((typed == "message") & ~F.coalesce(F.startswith(kind(v, "$.message"), F.lit("OBJECT")) & is_string(v, "$.message.role"), F.lit(False)), "message")
    )
    return rows.withColumn("type", typed).withColumn("fatal", fatal).withColumn("unknown", typed.isNotNull() & ~typed.isin(*KNOWN_TYPES))


def entries(rows: DataFrame) -> DataFrame:
    """Entries: path, session_id, pos, type, entry_id, parent_id, occurred_at, byte_offset, line_hash; for messages role, raw_content
    (canonical JSON) and text_blocks.  An entry of an unknown type is kept."""
    v, content = F.col("v"), F.variant_get("v", "$.message.content", "variant")
    role = F.when(F.col("type") == "message", F.variant_get("v", "$.message.role", "string"))
    return rows.where("fatal IS NULL").select(
        "path", "session_id", "pos", "type",
        F.variant_get(v, "$.id", "string").alias("entry_id"),
        F.when(kind(v, "$.parentId") == "STRING", F.variant_get(v, "$.parentId", "string")).alias("parent_id"),
        F.variant_get(v, "$.timestamp", "string").alias("occurred_at"),
        "byte_offset", "line_hash", role.alias("role"),
        F.when(role.isNotNull(), keys.canonical_json(content)).alias("raw_content"),
        F.when(role.isNotNull(), text_blocks(role, content)).alias("text_blocks"),
    )


def diagnostics(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, session_hash, code, detail, count): what was wrong, without any text, query or content."""
    bad = heads.where("status <> 'ok'").select("path", F.lit(None).cast("string").alias("session_hash"), F.col("status").alias("code"), "detail", F.lit(1).alias("count"))
    about = rows.withColumn("details", F.array_compact(F.array(F.when(F.col("unknown"), "unknown-type"), F.col("fatal"))))
    each = about.select("path", keys.session_hash(F.col("session_id")).alias("session_hash"), F.explode("details").alias("detail"))
    code = F.when(F.col("detail") == "oversized", "entry-oversized").otherwise("entry-malformed")
    return bad.unionByName(each.select("path", "session_hash", code.alias("code"), F.when(F.col("detail") != "oversized", F.col("detail")).alias("detail"), F.lit(1).alias("count")))
