"""Constants that define the behaviour of the index.  Fixed values."""

CHUNKER_VERSION = "chunker-v1"
POLICY_VERSION = "policy-v1"
SCHEMA_VERSION = "schema-v1"
PROJECTION_VERSION = "projection-v1"

CHUNK_TARGET, CHUNK_MOST, CHUNK_OVERLAP, CHUNK_MERGE = 1200, 2000, 80, 200
MOST_LINE_BYTES = 1_048_576
MOST_FILE_BYTES = 64 << 20
MOST_POLICY_CHARS = 100_000
MOST_QUERY_CHARS, MOST_QUERY_BYTES, MOST_QUERY_TERMS = 500, 2048, 32
MATCH_LIMIT, CANDIDATE_LIMIT, SNIPPET_CHARS = 256, 64, 240
DEFAULT_LIMIT, MANUAL_MOST, TOOL_MOST = 5, 20, 10
RECALL_RECORDS, RECALL_TOKENS, RECALL_COVERAGE, ENVELOPE_TOKENS = 4, 600, 0.25, 40
PARENT_DEPTH = 32
#: The name inside the marks that begin and end an envelope of recalled text.
MARK = "session-recall"
