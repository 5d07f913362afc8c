"""Document fingerprints by randomised edit embedding.

A random walk over the characters of a text copies the current character at each step and then stays or moves on, as a random bit
shared by all texts tells for this step and character.  Texts at a small edit distance fall into step again after each edit, so
their walks agree in most places: edit distance becomes Hamming distance.  The fingerprint samples the walks: each component is
a few bits of the character at one step, chosen by a process that gives texts of equal length the same step and texts of similar
lengths mostly the same.  Tables of sampled components propose pairs, which agree in all of one, and whole fingerprints verify them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WALKS, SAMPLES, BITS = 2, 64, 4
COMPONENTS = WALKS * SAMPLES
#: Tables of bands, the components that each samples (32 bits), and the likeness from which a pair is verified.  At 0.8, 104 of 128
#: components agree, and all tables are missed with a probability of 0.0002.
TABLES, BAND, LIKE = 40, 8, 0.8
#: Steps after which the table of random bits repeats; characters of text in one block of walks; rows in one; partitions at most.
PERIOD, BLOCK, ROWS, MOST_PARTITIONS = 4096, 8 << 20, 16_384, 4096


@lru_cache(1)
def _moves() -> np.ndarray:
    """moves[walk, step, class of the character]: 1 to move on.  Class 0, after the end, stays."""
    moves = np.random.default_rng(11).integers(0, 2, (WALKS, PERIOD, 256), dtype=np.int32)
    moves[:, :, 0] = 0
    return moves


@lru_cache(1)
def _records() -> list[np.ndarray]:
    """For each component, rising steps: the one sampled from L steps is the last below L, and it is uniform over them.

    It changes as the lowest of L random numbers does when L grows: from L on, the next change is at floor(L / u), u uniform.
    """
    rng, out = np.random.default_rng(12), []
    for _ in range(COMPONENTS):
        steps = [0]
        while steps[-1] < 1 << 40:
            steps.append(int((steps[-1] + 1) / rng.uniform(1e-12, 1)))
        out.append(np.array(steps[:-1], np.int64))
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """(text, component): the fingerprints, BITS bits each, of texts that together fit in memory."""
    points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts]
    lengths = np.array([len(p) for p in points], np.int64)
    order = np.argsort(-lengths, kind="stable")
    n, sizes = len(texts), lengths[order]
    flat = np.zeros(int(sizes.sum()) + n, np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int32)
    for i, s in zip(order, starts):
        flat[s : s + len(points[i])] = 1 + ((points[i] * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(255)
    total = np.maximum(1, 2 * sizes + (2 * np.sqrt(sizes)).astype(np.int64))  # steps of each walk, falling
    wanted = [np.unique(np.concatenate([r[r < total[0]] for r in _records()[w * SAMPLES : (w + 1) * SAMPLES]])) for w in range(WALKS)]
    active = n - np.searchsorted(total[::-1], np.arange(int(total[0])), "right")  # walks that have a step j
    out = np.empty((n, COMPONENTS), np.uint8)
    for w in range(WALKS):
        moves, steps = _moves()[w], wanted[w].tolist()
        found = np.zeros((len(steps), n), np.uint8)
        at, seen, move = starts.copy(), np.empty(n, np.uint8), np.empty(n, np.int32)
        k, due = 0, steps[0]
        for j, m in enumerate(active.tolist()):
            flat.take(at[:m], out=seen[:m], mode="clip")
            if j == due:
                found[k, :m] = seen[:m]
                k += 1
                due = steps[k] if k < len(steps) else -1
            moves[j % PERIOD].take(seen[:m], out=move[:m], mode="clip")
            np.add(at[:m], move[:m], out=at[:m])
        for c in range(w * SAMPLES, (w + 1) * SAMPLES):
            record = _records()[c]
            step = record[np.searchsorted(record, total, "left") - 1]
            symbol = found[np.searchsorted(wanted[w], step), np.arange(n)]
            h = (symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (step.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(c * 0x165667B1)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            out[order, c] = (h >> np.uint64(64 - BITS)).astype(np.uint8)
    return out


def text_of(prints: np.ndarray) -> list[str]:
    """A hexadecimal digit a component."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[prints]
    return [row.tobytes().decode() for row in digits]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of components that agree, less what agrees by chance: 0 to 1."""
    chance = 1 / (1 << BITS)
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


@lru_cache(1)
def _sampled() -> np.ndarray:
    """The components of each table's band."""
    rng = np.random.default_rng(13)
    return np.array([rng.choice(COMPONENTS, BAND, replace=False) for _ in range(TABLES)])


def proposed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the fingerprints a[i] and b[i] agree in all of some band."""
    return (a == b)[:, _sampled()].all(axis=2).any(axis=1)


def banded(prints: DataFrame) -> DataFrame:
    """(fingerprint, band): the bands, each a number, of distinct fingerprints."""
    from pyspark.sql import types as T

    def make():
        def run(batch):
            digits = np.frombuffer("".join(batch.column("fingerprint").to_pylist()).encode(), np.uint8).reshape(-1, COMPONENTS)
            values = np.where(digits > 57, digits - 87, digits - 48).astype(np.uint64)
            packed = (values[:, _sampled()] << (np.arange(BAND, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
            packed |= np.arange(TABLES, dtype=np.uint64) << np.uint64(BAND * BITS)
            return [pa.array(list(packed.view(np.int64)), pa.list_(pa.int64()))]

        return run

    given = prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    return common.append(given, [T.StructField("bands", T.ArrayType(T.LongType()))], make, "fingerprint").select("fingerprint", F.explode("bands").alias("band"))


def agreement(a: str, b: str) -> Column:
    """`likeness` of two fingerprint columns."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(COMPONENTS)), lambda i: F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(b), i, F.lit(1))))
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same / COMPONENTS - chance) / (1 - chance))


def append_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `fingerprint` (string) of each whole text, however long; null counts as empty.  A column of this name is replaced.

    Equal texts, so repeated rows too, have equal fingerprints; an empty table gives no rows.
    """
    from pyspark.sql import types as T

    make = lambda: lambda batch: [pa.array(text_of(fingerprints(common.texts(batch, text))), pa.string())]
    return common.append(docs, [T.StructField("fingerprint", T.StringType())], make, text, most_rows=ROWS, most_bytes=BLOCK)


def near(left: DataFrame, right: DataFrame, least: float = LIKE) -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints, a of `left` and b of `right`, that share a band and verify.

    Documents with equal fingerprints count as one, so copies and repeated rows cost nothing; null fingerprints have no pair, an
    empty side gives no rows.  Of pairs at a likeness of 0.8 the bands miss 0.0002, of those at 0.7 0.014, at 0.6 0.15.
    """
    of = lambda df, name: banded(df).withColumnRenamed("fingerprint", name)
    pairs = of(left, "a").join(of(right, "b"), "band").where("a <> b").select("a", "b").distinct()
    return pairs.withColumn("likeness", agreement("a", "b")).where(F.col("likeness") >= least)


def _with_next(batches):
    """Fingerprints of rows that come in order, each row but the last of all followed by the one it is compared with."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_linked", "next_linked"]

    def out(rows):
        texts = [r[1] for r in rows]
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts, texts[1:])]
        prints = fingerprints(texts + edited)
        own, changed = prints[: len(texts)], prints[len(texts) :]
        found = [(likeness(own[:-1], x), proposed(own[:-1], x)) for x in (changed, own[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array(text_of(own[:-1]), pa.string()), pa.array(text_of(changed), pa.string()), *(pa.array(like) for like, _ in found), *(pa.array(bands & (like >= LIKE)) for like, bands in found),
            ],
            names=names,
        )

    rows, size = [], 0
    for batch in batches:
        for id, text, last in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows.append((id, text))
            size += len(text)
            if last or size > BLOCK or len(rows) > ROWS:
                if len(rows) > 1:
                    yield from out(rows)
                rows = [] if last else rows[-1:]
                size = 0 if last else len(rows[-1][1])


def edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_linked, next_linked) of each row of `docs`.

    The edited text has the last third of the characters replaced by the first as many of the next document by descending id,
    after the last the first; rows that share an id follow each other by a hash of their text, null ids (integer ids) come last.
    A pair is linked if a band proposes it and its likeness, 0.8 or more, verifies it.  A null text is empty.  A single row is its own next one.  Ids go to range partitions; each gets the first row of the one below
    it as well, at most one row a partition and 4,096 in all, which are broadcast by id to be found.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    splitters = sorted(set(rows.select(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, splitters)), lambda s: s < F.col("key"))) if splitters else F.lit(0)
    tops = {r.b: r.top for r in rows.groupBy(bucket.alias("b")).agg(F.max("key").alias("top")).collect()}
    order = sorted(tops)
    below = [(tops[low], high) for high, low in zip(order, [order[-1], *order[:-1]])] if order else []
    heads = spark.createDataFrame(below, "top long, bucket int")
    firsts = rows.join(F.broadcast(heads), F.col("key") == F.col("top")).groupBy("bucket").agg(F.max_by("text", "h").alias("text"))
    dealt = rows.select("id", "text", bucket.alias("bucket"), F.lit(False).alias("last"), "key", "h").unionByName(
        firsts.select(F.lit(None).cast("long").alias("id"), "text", "bucket", F.lit(True).alias("last"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("h"))
    )
    sorted_ = dealt.repartitionById(max(1, len(splitters) + 1), F.col("bucket")).sortWithinPartitions("bucket", "last", F.desc("key"), F.desc("h")).select("id", "text", "last")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_linked boolean, next_linked boolean"
    return sorted_.mapInArrow(_with_next, schema).withColumnRenamed("id", id)
