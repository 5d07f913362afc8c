"""The driver's tables as sessions and chunks, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import keys, policy
from skein.operators import chunker
from skein.versions import CHUNKER_VERSION

AS_OF = "2026-06-01 00:00:00"

# What the SQL knows of the policy, the folding of letters and the sizes of chunks, written out here so that it does not follow the
# library.  Fixed values.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
REDACTED = [
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "[REDACTED_TOKEN]"),
    (r"\bghp_[A-Za-z0-9]{20,}\b", "[REDACTED_TOKEN]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "[REDACTED_TOKEN]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED_TOKEN]"),
    (r"\bAIza[0-9A-Za-z_-]{20,}\b", "[REDACTED_TOKEN]"),
    (
        r"(?i)\b((?:(?:API[_-]?KEY|ACCESS[_-]?KEY(?:_ID)?|SECRET|TOKEN|PASSWORD)|[A-Za-z_][A-Za-z0-9_]*(?:API[_-]?KEY|ACCESS[_-]?KEY(?:_ID)?|SECRET|TOKEN|PASSWORD)[A-Za-z0-9_]*))"
        rf"[{SPACE}]*[:=][{SPACE}]*['\"]?([^{SPACE}'\"]{{8,}})['\"]?",
        r"\1=[REDACTED_SECRET]",
    ),
    (rf"(?i)((?:https?|git|ssh)://)([^/{SPACE}@]+)@", r"\1[REDACTED_USERINFO]@"),
]
REJECTED = [r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", r"^[A-Za-z0-9_\-./+=]{24,}$"]
UNSAFE = [
    r"(?i)\[\[session-recall[\s\S]*?\]\]",
    rf"(?im)^[{SPACE}]*(system|developer)[{SPACE}]*:",
    rf"(?i)忽略[\s\S]{{0,16}}(?:指令|规则)|ignore[{SPACE}]+(?:all[{SPACE}]+)?(?:previous|prior)[{SPACE}]+instructions|you[{SPACE}]+must[{SPACE}]+run[{SPACE}]+tools",
]
MARKED, BASES = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
WINDOW, STRIDE = 2000, 1920


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out to all cores if it comes in fewer pieces than there are: a single small file.  Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that can be indexed, as entries of sessions of ten projects."""
    turns = table(spark, sf_dir, "conversations").where(policy.is_indexable_role(F.col("role")))
    month = F.lpad((F.col("conv_id") % 12 + 1).cast("string"), 2, "0")
    return turns.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("entry_id"), F.lit(0).alias("block_index"), "role",
        F.concat(F.lit("project"), (F.col("conv_id") % 10).cast("string")).alias("origin_project_key"),
        F.concat(F.lit("2025-"), month, F.lit("-01T00:00:00Z")).alias("occurred_at"), "text",
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each a session with one message of a user, in a project by source."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        F.col("doc_id").cast("string").alias("session_id"), F.lit("0").alias("entry_id"), F.lit(0).alias("block_index"), F.lit("user").alias("role"),
        F.col("source").alias("origin_project_key"), F.lit("2025-01-01T00:00:00Z").alias("occurred_at"), "text",
    )


def chunked(entries: DataFrame) -> DataFrame:
    """Chunks of entries that the policy keeps, with their keys."""
    # Rejected texts have no pieces.  A filter before the outer explode would be pushed below all that makes the pieces, and all of
    # that would be computed a second time for it.
    pieces = policy.applied(entries).withColumn("pieces", chunker.chunks(F.col("clean")))
    each = pieces.select("*", F.posexplode_outer("pieces").alias("chunk_index", "chunk")).where("chunk IS NOT NULL")
    return each.select(
        keys.source_key(F.col("session_id"), F.col("entry_id"), F.col("block_index"), F.col("chunk_index")).alias("source_key"),
        keys.content_hash(F.col("chunk")).alias("content_hash"),
        "session_id", "entry_id", "block_index", "chunk_index", "origin_project_key", F.lit("verified").alias("provenance"), "role", "occurred_at",
        F.col("chunk").alias("text"), F.lit(CHUNKER_VERSION).alias("chunker_version"), "auto_eligible", "disposition",
    )


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_canonical(x: str) -> str:
    trimmed = f"^[{SPACE}]+|[{SPACE}]+$"
    return f"regexp_replace(regexp_replace({x}, {literal(chr(13) + chr(10) + '?')}, {literal(chr(10))}, 'g'), {literal(trimmed)}, '', 'g')"


def sql_redact(x: str) -> str:
    for pattern, filler in REDACTED:
        x = f"regexp_replace({x}, {literal(pattern)}, {literal(filler)}, 'g')"
    return x


def sql_rejects(x: str) -> str:
    return f"(length({x}) = 0 OR length({x}) > 100000" + "".join(f" OR regexp_matches({x}, {literal(p)})" for p in REJECTED) + ")"


def sql_unsafe(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {literal(p)})" for p in UNSAFE) + ")"


def sql_fold(x: str) -> str:
    return f"translate(lower({x}), {literal(MARKED)}, {literal(BASES)})"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({sql_fold(x)}, {literal('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 'p{Co}]+')})"


def sql_han(x: str) -> str:
    return f"regexp_replace({x}, {literal(chr(92).join(['[^', 'p{Han}]']))}, '', 'g')"


def sql_bigrams(x: str) -> str:
    h = sql_han(x)
    return f"CASE WHEN length({h}) >= 2 THEN list_transform(list_zip(string_split({h}, '')[1:length({h}) - 1], string_split({h}, '')[2:]), lambda p: p[1] || p[2]) WHEN length({h}) = 1 THEN [{h}] ELSE [] END"


SQL_SAID = """
said AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS VARCHAR) AS entry_id, 0 AS block_index, role, 'project' || (conv_id % 10) AS origin_project_key,
         '2025-' || lpad(CAST(conv_id % 12 + 1 AS VARCHAR), 2, '0') || '-01T00:00:00Z' AS occurred_at, text
  FROM conversations WHERE role IN ('user', 'assistant'))"""
SQL_POSTS = """
posts AS (
  SELECT CAST(doc_id AS VARCHAR) AS session_id, '0' AS entry_id, 0 AS block_index, 'user' AS role, source AS origin_project_key,
         '2025-01-01T00:00:00Z' AS occurred_at, text
  FROM documents)"""


def sql_chunks(entries: str) -> str:
    """CTEs that end in `chunks` over the CTE `entries`."""
    return f"""
clean AS (SELECT * EXCLUDE (text), {sql_canonical('text')} AS before FROM {entries}),
redacted AS (SELECT *, {sql_redact('before')} AS after FROM clean WHERE NOT {sql_rejects('before')}),
pieces AS (
  SELECT *, unnest(range(0, CAST(greatest(1, ceil((length(after) - {WINDOW}) / {STRIDE}) + 1) AS BIGINT))) AS i FROM redacted),
chunks AS (
  SELECT sha256(session_id || '|' || entry_id || '|' || block_index || '|' || i || '|chunker-v1') AS source_key, sha256(substr(after, 1 + {STRIDE} * i, {WINDOW})) AS content_hash,
         session_id, entry_id, block_index, CAST(i AS INTEGER) AS chunk_index, origin_project_key, role, occurred_at, substr(after, 1 + {STRIDE} * i, {WINDOW}) AS text,
         NOT {sql_unsafe('after')} AS auto_eligible, CASE WHEN before <> after THEN 'redacted' ELSE 'allow' END AS disposition
  FROM pieces)"""


def sql_bm25(terms: dict[str, list[str]], rows: str = "chunks") -> str:
    """CTEs that end in `ranked` (row, bm25) for one query, given as its terms and their words, over `rows` (source_key, text)."""
    phrases = [(2 * i + f, field, found) for i, found in enumerate(terms.values()) for f, field in enumerate(("content", "cjk"))]
    values = ", ".join(f"({p}, '{field}', [{', '.join(map(literal, found))}])" for p, field, found in phrases)
    return f"""
indexed AS (SELECT source_key, origin_project_key, {sql_tokens('text')} AS content, flatten(list_transform({sql_bigrams('text')}, lambda g: {sql_tokens('g')})) AS cjk FROM {rows}),
sized AS (SELECT *, len(content) + len(cjk) AS dl FROM indexed),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
wanted(phrase, field, words) AS (VALUES {values}),
fields AS (SELECT source_key, origin_project_key, dl, 'content' AS field, content AS words FROM sized UNION ALL SELECT source_key, origin_project_key, dl, 'cjk', cjk FROM sized),
counts AS (
  SELECT phrase, source_key, origin_project_key, dl,
         len(list_filter(range(1, len(fields.words) - len(wanted.words) + 2), lambda i: fields.words[i:i + len(wanted.words) - 1] = wanted.words)) AS f
  FROM fields JOIN wanted ON fields.field = wanted.field),
hits AS (SELECT *, count(*) OVER (PARTITION BY phrase) AS df FROM counts WHERE f > 0),
weighed AS (SELECT hits.*, n, avgdl, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM hits, stats),
ranked AS (
  SELECT source_key, origin_project_key, -sum((CASE WHEN raw > 0 THEN raw ELSE 1e-6 END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25
  FROM weighed GROUP BY ALL)"""


def sql_search(query: dict[str, list[str]], project: str | None = None, late: str = "TRUE", limit: int = 5) -> str:
    """CTEs that end in `found` after those of `chunks`."""
    terms = "[" + ", ".join(map(literal, query)) + "]"
    scope = f"WHERE origin_project_key = {literal(project)}" if project else ""
    return f"""{sql_bm25(query)},
matches AS (SELECT source_key, bm25 FROM ranked {scope} ORDER BY bm25, source_key LIMIT 256),
late AS (SELECT chunks.*, bm25 FROM matches JOIN chunks USING (source_key) WHERE {late} ORDER BY bm25, source_key LIMIT 64),
scored AS (
  SELECT *, len(list_filter({terms}, lambda t: contains(lower(text), lower(t)))) / len({terms}) AS coverage,
         greatest(0, 0.1::DOUBLE - greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(CAST(occurred_at AS TIMESTAMP))) / 86400000000) * 0.0001::DOUBLE) AS recency
  FROM late),
rescored AS (SELECT *, -bm25 + coverage + CASE WHEN role = 'user' THEN 0.05 ELSE 0 END + recency AS score FROM scored),
firsts AS (SELECT * FROM rescored QUALIFY row_number() OVER (PARTITION BY origin_project_key, role, content_hash ORDER BY score DESC, source_key) = 1),
found AS (SELECT *, CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '…' ELSE text END AS snippet, length(text) > 240 AS truncated FROM firsts ORDER BY score DESC, source_key LIMIT {limit})"""


def sql_asked(prompts: str) -> str:
    """CTEs that end in `asked` (query_id, text, project, terms, reason) for the CTE `prompts` (query_id, text, project)."""
    bounds = f"^[{SPACE}]+|[{SPACE}]+$"
    return f"""
composed AS (SELECT * EXCLUDE (text), regexp_replace(nfc_normalize(coalesce(text, '')), {literal(bounds)}, '', 'g') AS text FROM {prompts}),
spoken AS (SELECT *, CASE WHEN length(text) BETWEEN 1 AND 500 AND strlen(text) <= 2048 THEN list_concat(regexp_extract_all(text, '[A-Za-z0-9_./-]+'), {sql_bigrams('text')}) ELSE [] END AS words FROM composed),
numbered AS (SELECT query_id, term, min(i) AS i FROM (SELECT query_id, unnest(words) AS term, unnest(range(len(words))) AS i FROM spoken) GROUP BY ALL),
kept AS (SELECT query_id, list(term ORDER BY i)[1:32] AS terms FROM numbered GROUP BY query_id),
asked AS (SELECT query_id, text, project, coalesce(kept.terms, []) AS terms, CASE WHEN kept.terms IS NULL THEN 'query-invalid' END AS reason FROM spoken LEFT JOIN kept USING (query_id))"""


def sql_matches(rows: str = "chunks") -> str:
    """CTEs that end in `matches` (query_id, source_key, bm25), the 256 best of each row of `asked` that has no reason."""
    return f"""
indexed AS (SELECT source_key, origin_project_key, {sql_tokens('text')} AS content, flatten(list_transform({sql_bigrams('text')}, lambda g: {sql_tokens('g')})) AS cjk FROM {rows}),
sized AS (SELECT *, len(content) + len(cjk) AS dl FROM indexed),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
fields AS (SELECT source_key, origin_project_key, dl, 'content' AS field, content AS tokens FROM sized UNION ALL SELECT source_key, origin_project_key, dl, 'cjk', cjk FROM sized),
places AS (SELECT source_key, field, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM fields),
each AS (SELECT query_id, project, i, {sql_tokens('term')} AS words FROM (SELECT query_id, project, unnest(terms) AS term, unnest(range(len(terms))) AS i FROM asked WHERE reason IS NULL)),
wanted AS (SELECT each.*, field, 2 * i + f AS phrase FROM each, (VALUES ('content', 0), ('cjk', 1)) v(field, f) WHERE len(words) > 0),
counts AS (
  SELECT query_id, wanted.project, phrase, fields.source_key, origin_project_key, dl, count(*) AS f
  FROM wanted JOIN places ON places.field = wanted.field AND places.token = wanted.words[1] JOIN fields ON fields.source_key = places.source_key AND fields.field = places.field
  WHERE fields.tokens[pos:pos + len(words) - 1] = words GROUP BY ALL),
weighed AS (SELECT *, count(*) OVER (PARTITION BY query_id, phrase) AS df FROM counts),
parts AS (SELECT *, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM weighed, stats),
ranked AS (
  SELECT query_id, source_key, -sum((CASE WHEN raw > 0 THEN raw ELSE 1e-6 END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25
  FROM parts WHERE project IS NULL OR project = origin_project_key GROUP BY ALL),
matches AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), source_key) <= 256)"""


def sql_hits(late: str = "TRUE", coverage: float = 0, limit: int = 5) -> str:
    """CTEs that end in `hits` (query_id, ..., score), the best few of `matches` of each query."""
    return f"""
late AS (SELECT chunks.*, query_id, bm25 FROM matches JOIN chunks USING (source_key) WHERE {late} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), source_key) <= 64),
scored AS (
  SELECT late.*, len(list_filter(asked.terms, lambda t: contains(lower(late.text), lower(t)))) / len(asked.terms) AS coverage,
         greatest(0, 0.1::DOUBLE - greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(CAST(occurred_at AS TIMESTAMP))) / 86400000000) * 0.0001::DOUBLE) AS recency
  FROM late JOIN asked USING (query_id)),
rescored AS (SELECT *, round(-bm25 + coverage + CASE WHEN role = 'user' THEN 0.05 ELSE 0 END + recency, 9) AS score FROM scored WHERE coverage >= {coverage}),
firsts AS (SELECT * FROM rescored QUALIFY row_number() OVER (PARTITION BY query_id, origin_project_key, role, content_hash ORDER BY score DESC, source_key) = 1),
hits AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_key) <= {limit})"""


def sql_bundles(start: str, end: str) -> str:
    """CTEs that end in `bundles` (request_id, records, envelope, tokens) from `recalled`, hits with a request_id."""
    record = """'- role: ' || role || chr(10) || '  occurredAt: ' || occurred_at || chr(10) || '  sessionId: ' || session_id || chr(10) || '  entryId: ' || entry_id || chr(10)
  || '  contentHash: ' || content_hash || chr(10) || '  textLength: ' || length(text) || chr(10) || '  text: |' || chr(10) || '    ' || replace(text, chr(10), chr(10) || '    ')"""
    return f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, session_id, entry_id) AS place FROM recalled QUALIFY place <= 4),
ordered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, place DESC) AS keep, {record} AS lines FROM placed),
counted AS (SELECT request_id, k, count(*) AS n, string_agg(lines, chr(10) ORDER BY place) AS body FROM ordered, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE keep <= k GROUP BY ALL HAVING count(*) = k),
rendered AS (SELECT request_id, k, {literal(start)} || chr(10) || 'version: envelope-v1' || chr(10) || 'requestId: ' || request_id || chr(10) || 'recordCount: ' || k || chr(10) || 'records:' || chr(10) || body || chr(10) || {literal(end)} AS envelope FROM counted),
bundles AS (
  SELECT request_id, CAST(k AS INTEGER) AS records, envelope, CAST(ceil(strlen(envelope) / 2) AS BIGINT) + 40 AS tokens FROM rendered WHERE ceil(strlen(envelope) / 2) + 40 <= 600
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY k DESC) = 1)"""
