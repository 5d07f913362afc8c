"""Content policy as column expressions: what is kept of a text, and what may be recalled without being asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import SPACE, canonical
from skein.versions import MARK, MOST_POLICY_CHARS

# Word boundaries are ASCII; Java's \b would count letters of all scripts and so miss a secret right after one.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Fixed patterns.
PEM = r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"
CREDENTIAL = r"^[A-Za-z0-9_\-./+=]{24,}$"
TOKENS = (
    r"sk-[A-Za-z0-9_-]{16,}",
    r"ghp_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"AIza[0-9A-Za-z_-]{20,}",
)
#: What each match of a token starts with, and a part of the name in each match of an assignment.
STARTS = ("sk-", "ghp_", "github_pat_", "xox", "AIza")
WORDS = r"(?i)key|secret|token|password"
_WORD = r"(?:API[_-]?KEY|ACCESS[_-]?KEY(?:_ID)?|SECRET|TOKEN|PASSWORD)"
NAME = rf"(?:{_WORD}|[A-Za-z_][A-Za-z0-9_]*{_WORD}[A-Za-z0-9_]*)"
ASSIGNMENT = rf"({NAME})[{SPACE}]*[:=][{SPACE}]*['\"]?([^{SPACE}'\"]{{8,}})['\"]?"
USERINFO = rf"((?:https?|git|ssh)://)([^/{SPACE}@]+)@"
PSEUDO_ROLE = rf"(?im)^[{SPACE}]*(system|developer)[{SPACE}]*:"
INJECTION = rf"(?i)忽略[\s\S]{{0,16}}(?:指令|规则)|ignore[{SPACE}]+(?:all[{SPACE}]+)?(?:previous|prior)[{SPACE}]+instructions|you[{SPACE}]+must[{SPACE}]+run[{SPACE}]+tools"
TOKEN_FILLER, SECRET_FILLER, USERINFO_FILLER = "[REDACTED_TOKEN]", "[REDACTED_SECRET]", "[REDACTED_USERINFO]"


def recall_marker(mark: str = MARK) -> str:
    return rf"(?i)\[\[{mark}[\s\S]*?\]\]"


def is_indexable_role(role: Column) -> Column:
    return role.isin("user", "assistant")


def rejection(text: Column) -> Column:
    """The rule that rejects a canonical text, or null."""
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(F.length(text) > MOST_POLICY_CHARS, "size-reject")
        .when((F.contains(text, F.lit("-----BEGIN ")) & text.rlike(PEM)) | text.rlike(CREDENTIAL), "secret-reject")
    )


def redaction_steps(text: Column) -> list[tuple[str, Column]]:
    """(rule, text after it), in order; each works on what the one before left."""
    steps = []
    for pattern in TOKENS:
        text = F.regexp_replace(text, f"{BEFORE}{pattern}{AFTER}", TOKEN_FILLER)
        steps.append(("token-redact", text))
    text = F.regexp_replace(text, f"(?i){BEFORE}{ASSIGNMENT}", f"$1={SECRET_FILLER}")
    steps.append(("assignment-redact", text))
    steps.append(("url-userinfo-redact", F.regexp_replace(text, f"(?i){USERINFO}", f"$1{USERINFO_FILLER}@")))
    return steps


def redact(text: Column) -> Column:
    return redaction_steps(text)[-1][1]


def may_be_redacted(text: Column) -> Column:
    """Whether a text has what a match of any step needs.  Few texts have, and to look for it is cheaper than the steps."""
    has = lambda x: F.contains(text, F.lit(x))
    assigns = (has(":") | has("=")) & text.rlike(WORDS)
    return reduce(lambda a, b: a | b, map(has, STARTS)) | (has("://") & has("@")) | assigns


def is_unsafe(text: Column, mark: str = MARK) -> Column:
    """Whether a text looks like an instruction or an envelope, and so is not recalled automatically."""
    return (F.contains(text, F.lit("[[")) & text.rlike(recall_marker(mark))) | (F.contains(text, F.lit(":")) & text.rlike(PSEUDO_ROLE)) | text.rlike(INJECTION)


def applied(df: DataFrame, raw: str = "text", compose: bool = False, mark: str = MARK) -> DataFrame:
    """`df` with canonical, rejected_by, clean, disposition and auto_eligible, each made once from the one before."""
    df = df.withColumn("canonical", canonical(F.col(raw), compose)).withColumn("rejected_by", rejection(F.col("canonical")))
    df = df.withColumn("clean", F.when(F.col("rejected_by").isNull(), F.when(may_be_redacted(F.col("canonical")), redact(F.col("canonical"))).otherwise(F.col("canonical"))))
    disposition = F.when(F.col("rejected_by").isNotNull(), "reject").when(F.col("clean") != F.col("canonical"), "redacted").otherwise("allow")
    return df.withColumns({"disposition": disposition, "auto_eligible": F.coalesce(~is_unsafe(F.col("clean"), mark), F.lit(False))})


def decide(raw: Column, compose: bool = False, mark: str = MARK) -> Column:
    """struct(disposition: allow, redacted or reject; auto_eligible; text; rule_ids) of a raw text."""
    text = canonical(raw, compose)
    reject, clean = rejection(text), redact(text)
    unsafe = is_unsafe(clean, mark)
    before, fired = text, []
    for rule, after in redaction_steps(text):
        fired.append(F.when(before != after, F.lit(rule)))
        before = after
    rules = F.array_compact(F.array(*fired, F.when(unsafe, F.lit("auto-safety"))))
    return F.struct(
        F.when(reject.isNotNull(), "reject").when(clean != text, "redacted").otherwise("allow").alias("disposition"),
        F.when(reject.isNotNull(), F.lit(False)).otherwise(~unsafe).alias("auto_eligible"),
        F.when(reject.isNotNull(), "").otherwise(clean).alias("text"),
        F.when(reject.isNotNull(), F.array(reject)).otherwise(rules).alias("rule_ids"),
    )
