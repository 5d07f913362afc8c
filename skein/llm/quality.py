"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

All pairs of features interact through vectors of low rank; the identity
    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over factors ((sum v x)^2 - sum v^2 x^2)
gives the score in time linear in the features.
"""

from __future__ import annotations

from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Buckets of hashed words, rank of the interactions, and words whose bucket a task remembers.
BUCKETS, RANK, REMEMBERED = 4096, 8, 400_000
STATISTICS = ("word length", "capitals", "digits", "symbols", "bars", "exclamations", "other punctuation", "repeated lines", "distinct words", "words a line", "length", "words")
_SYMBOLS = np.frombuffer(b"#*$%&<>@^~=_", np.uint8)
_MARKS = np.frombuffer(b".,;:?'\"()-", np.uint8)


class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


class Features:
    """Rows of hashed word frequencies (unit length) and, after them, structure statistics."""

    def __init__(self):
        self.buckets: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        if len(self.buckets) >= REMEMBERED:
            self.buckets.clear()
        b = crc32(word.encode()) % BUCKETS
        if len(word) <= 40:
            self.buckets[word] = b
        return b

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), BUCKETS + len(STATISTICS)), np.float32)
        for row, text in zip(out, texts):
            words = text.split()
            n, chars = max(1, len(words)), max(1, len(text))
            if words:
                known, bucket = self.buckets.get, self.bucket
                counts = np.sqrt(np.bincount([b if (b := known(w)) is not None else bucket(w) for w in words], minlength=BUCKETS))
                row[:BUCKETS] = counts / np.sqrt((counts**2).sum())
            byte = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
            lines = [x for x in text.split("\n") if x.strip()]
            share = lambda x: (x / chars) ** 0.5
            row[BUCKETS:] = (
                min(chars / n, 40.0), share(byte[65:91].sum()), share(byte[48:58].sum()), share(byte[_SYMBOLS].sum()), share(byte[124]), share(byte[33]), share(byte[_MARKS].sum()),
                (1 - len(set(lines)) / max(1, len(lines))) ** 0.5, len(set(words)) / n, np.log1p(n / max(1, len(lines))), np.log1p(len(text)), np.log1p(len(words)),
            )
        return out


def raw_score(x: np.ndarray, model: Model) -> np.ndarray:
    x = x.copy()
    x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - model.mean) / model.spread, -6, 6)
    return model.bias + x @ model.linear + 0.5 * ((x @ model.factors) ** 2 - (x**2) @ (model.factors**2)).sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 15, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Logistic loss by Adam in mini-batches; without rows, a model that gives 0.5."""
    rng, d = np.random.default_rng(seed), BUCKETS + len(STATISTICS)
    if not len(x):
        return Model(0.0, np.zeros(d, np.float32), np.zeros((d, RANK), np.float32), np.zeros(len(STATISTICS), np.float32), np.ones(len(STATISTICS), np.float32))
    mean, spread = x[:, BUCKETS:].mean(axis=0), x[:, BUCKETS:].std(axis=0) + 1e-3
    x = x.copy()
    x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - mean) / spread, -6, 6)
    positive = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    params = [np.array([np.log(positive / (1 - positive))], np.float32), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, RANK)).astype(np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
            bias, linear, v = params
            s, x2 = xb @ v, xb**2
            z = bias[0] + xb @ linear + 0.5 * (s**2 - x2 @ v**2).sum(axis=1)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(xb)).astype(np.float32)
            grads = [np.array([g.sum()], np.float32), xb.T @ g + decay * linear, xb.T @ (g[:, None] * s) - (x2.T @ g)[:, None] * v + decay * v]
            step += 1
            for p, m1, m2, q in zip(params, first, second, grads):
                m1 += 0.1 * (q - m1)
                m2 += 0.001 * (q * q - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Model(float(params[0][0]), params[1], params[2], mean, spread)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = 4000) -> Model:
    """A model from at most `most_rows` labelled rows that are not held out, those with the lowest hash of their id.

    Of rows of `docs` that share an id one is taken, and of labels of an id the lower one.  Their features, at most 66 MB, are the only
    thing that comes to the driver.  Null and empty texts have features like any other, and texts of any length are read whole; without
    a labelled row, or of an empty table, the model is neutral.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~common.held_out(id)).select(F.col(id).alias("of"), F.col(label).cast("int").alias("label"))
    sample = rows.groupBy("of").agg(F.min("label").alias("label")).orderBy(F.xxhash64(F.lit("quality"), "of"), "of").limit(most_rows)
    chosen = docs.join(F.broadcast(sample), F.col(id) == F.col("of")).select(F.col(id).cast("string").alias("id"), F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("text"), "label").alias("row"))
    chosen = chosen.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.text", "row.label")

    def extract(batches):
        features = Features()
        for batch in batches:
            for piece in common.slices(batch, "text", 256, 8 << 20):
                rows = features.rows(common.texts(piece, "text"))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], names=["id", "label", "x"])

    got = chosen.mapInArrow(extract, "id string, label int, x binary").toPandas().sort_values(["id", "label"], kind="stable").head(most_rows)
    x = np.stack([np.frombuffer(v, np.float16).astype(np.float32) for v in got.x]) if len(got) else np.empty((0, BUCKETS + len(STATISTICS)), np.float32)
    return train(x, got.label.to_numpy(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score >= threshold, else 0).

    The whole text counts, however long; a null text is scored as an empty one.  Repeated rows have equal scores, and an empty table
    gives no rows.  Columns that have these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features = Features()

        def run(batch):
            z = raw_score(features.rows(common.texts(batch, text)), shared.value)
            p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
            return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

        return run

    return common.append(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, text, most_rows=256)
