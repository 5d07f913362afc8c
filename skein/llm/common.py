"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of the largest table that `lookup` broadcasts, and the pieces that it deals a key into otherwise.
BROADCAST_ROWS, SALTS = 200_000, 16
#: Rows of one key that meet in one task, about, where `dealt` joins.
HOT = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or one for local runs if it has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint, so that a lost executor costs no recomputation of what led to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def slices(batch: pa.RecordBatch, text: str, most_rows: int, most_bytes: int):
    """`batch` in pieces of at most so many rows and, unless one row alone has more, bytes of the column `text`."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(sizes):
        end, total = start, 0
        while end < len(sizes) and end - start < most_rows and (end == start or total + sizes[end] <= most_bytes):
            total += int(sizes[end])
            end += 1
        yield batch.slice(start, end - start)
        start = end


def trimmed(run):
    """`run`, a function of batches, after which its worker gives memory that it no longer needs back to the system.

    Workers stay for later tasks, which may be of stages that need the memory for something else.
    """

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def append(df: DataFrame, fields: Sequence[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], text: str, most_rows: int = 1024, most_bytes: int = 8 << 20) -> DataFrame:
    """`df` with the columns `fields`, which `make()`, called once a task, computes from each small record batch.

    Columns of `df` that have one of these names are replaced.
    """
    kept = df.drop(*(f.name for f in fields))
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches):
        f = None
        for batch in batches:
            f = f or make()
            for piece in slices(batch, text, most_rows, most_bytes):
                new = f(piece)
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*piece.schema.names, *(x.name for x in fields)])

    return kept.mapInArrow(trimmed(run), schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of a column, with null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def held_out(doc_id) -> F.Column:
    """Whether labels of this document are for measuring only."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def lookup(df: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`df` joined with `table`, which has at most one short row a key.

    The table is broadcast if it is counted to be small.  Otherwise it is repeated SALTS times, and the rows of a key, which may be
    a third of all, are dealt over as many tasks.
    """
    table = cut(table)
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), key, how)
    salt = f"salt_{uuid.uuid4().hex}"
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, salt], how).drop(salt)


def dealt(df: DataFrame, table: DataFrame, key: str, times: str, hot: int | None = None) -> DataFrame:
    """`df` joined with `table`, which has one row a key and in `times` how many rows of `df` have it; `times` goes.

    A key of more than `hot` rows is dealt into as many more parts, each with the table's row.  Such keys are at most one in `hot`
    rows of `df`; their table is broadcast if it is counted to be small.
    """
    hot = hot or HOT
    part, parts = f"part_{uuid.uuid4().hex}", f"parts_{uuid.uuid4().hex}"
    heat = cut(table.where(F.col(times) > hot).select(key, F.ceil(F.col(times) / hot).cast("int").alias(parts)))
    if heat.count() <= BROADCAST_ROWS:
        heat = F.broadcast(heat)
    rows = df.join(heat, key, "left").withColumn(part, F.pmod(F.xxhash64(*df.columns), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    given = table.drop(times).join(heat, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return rows.join(given, [key, part]).drop(part)


def row_hash(df: DataFrame) -> F.Column:
    """128 bits of hash of all columns, as text.  xxhash64 passes over nulls, so it takes where they are as well."""
    of = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.concat(F.hex(F.xxhash64(*of)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *of)))


def one_of_each(docs: DataFrame, classes: DataFrame, id: str) -> DataFrame:
    """The row of `docs` with the lowest id, nulls last, and then the lowest row hash of each root; classes: (id, row, root).

    Equal rows have equal hashes; one of them stays.  The join and this choice share one exchange of the texts.
    """
    order = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("row").alias("row"))
    name = f"row_{uuid.uuid4().hex}"
    kept = classes.groupBy("root").agg(F.min(order).alias("of")).select(F.col("of.row").alias(name)).distinct()
    return docs.withColumn(name, row_hash(docs)).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
