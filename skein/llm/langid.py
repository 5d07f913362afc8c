"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary.  The probability of a word is the sum over all its
segmentations into pieces of the product of their probabilities, by the forward algorithm; a text's is the product over its words
(runs of letters, lower-cased, each after a word-start mark).  The piece probabilities are fitted by expectation-maximisation on
expected piece counts over all segmentations.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

START = "▁"  # begins a word in the vocabulary
UNDETERMINED = "und"
#: Words that a task remembers, and the longest of them.  Characters of a lattice in fitting; a longer word has one of its own.
#: Most languages of a model: the broadcast is at most 51 MB.
REMEMBERED, REMEMBERED_CHARS, FIT_CHARS, MOST_LANGUAGES = 500_000, 40, 65_536, 200


class Pieces:
    """The pieces of a vocabulary.  Id 0 is no piece, id 1 any character that is no piece itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {x: i for i, x in enumerate(dict.fromkeys(names), 2)}
        self.size, self.longest = len(self.ids) + 2, max(map(len, names))
        # The pieces as a trie: edges (node, character) in order, and of each the node below and the piece that ends there, or 0.
        nodes, below = {"": 0}, []
        for x in self.ids:
            for k in range(1, len(x) + 1):
                if x[:k] not in nodes:
                    nodes[x[:k]] = len(nodes)
                    below.append((nodes[x[: k - 1]] << 21 | ord(x[k - 1]), nodes[x[:k]], self.ids.get(x[:k], 0)))
        self.edges, self.below, self.ending = (np.array(v) for v in zip(*sorted(below)))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(at, lengths): at[w, t, k] is the id of the piece of k + 1 characters that ends at character t of the marked word w."""
        lengths = np.array([len(w) + 1 for w in words])
        at = np.zeros((len(words), lengths.max() + 1, self.longest), np.int32)
        # All characters walk down the trie at once; a word ends with a character that has no edge.
        flat = np.frombuffer("".join(f"{START}{w}\0" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths + 1)
        begin = np.cumsum(lengths + 1) - lengths - 1
        start = np.flatnonzero(np.arange(len(flat)) - begin[word] < lengths[word])
        at[word[start], start - begin[word[start]] + 1, 0] = 1
        node = np.zeros(len(start), np.int64)
        for k in range(self.longest):
            key = node << 21 | flat[start + k]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[edge] == key
            start, edge = start[on], edge[on]
            node, piece = self.below[edge], self.ending[edge]
            hit = piece > 0
            w = word[start[hit]]
            at[w, start[hit] - begin[w] + k + 1, k] = piece[hit]
        return at, lengths


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(at: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log probability (word, language) summed over all segmentations; p: (piece, language)."""
    n, most = len(lengths), at.shape[2]
    alpha = np.zeros((n, most, p.shape[1]))  # of the last `most` characters; the newest at [:, 0]
    alpha[:, 0] = 1
    log, out = np.zeros((n, p.shape[1])), np.empty((n, p.shape[1]))
    for t in range(1, at.shape[1]):
        new = np.einsum("nkl,nkl->nl", alpha, p[at[:, t]])
        alpha[:, 1:] = alpha[:, :-1].copy()
        alpha[:, 0] = new
        if t % most == 0:
            top = alpha.max(axis=1)
            top[top == 0] = 1  # words that have ended
            alpha /= top[:, None]
            log += np.log(top)
        ended = lengths == t
        if ended.any():
            out[ended] = np.log(alpha[ended, 0]) + log[ended]
            live = ~ended
            if t > 24 and live.mean() < 0.5:  # long words alone
                out[live] = _rest(at[live], lengths[live], p, t, alpha[live], log[live])
                return out
    return out


def _rest(at, lengths, p, t0, alpha, log):
    out = np.empty((len(lengths), p.shape[1]))
    order = np.argsort(-lengths, kind="stable")
    at, lengths, alpha, log = at[order], lengths[order], alpha[order], log[order]
    most = at.shape[2]
    for t in range(t0 + 1, lengths[0] + 1 if len(lengths) else 0):
        n = np.searchsorted(-lengths, -t, "right")
        alpha, log = alpha[:n], log[:n]
        new = np.einsum("nkl,nkl->nl", alpha, p[at[:n, t]])
        alpha = np.concatenate([new[:, None], alpha[:, :-1]], axis=1)
        if t % most == 0:
            top = alpha.max(axis=1)
            alpha, log = alpha / top[:, None], log + np.log(top)
        ended = lengths[:n] == t
        out[order[:n][ended]] = np.log(alpha[ended, 0]) + log[ended]
    return out


def expected(at: np.ndarray, lengths: np.ndarray, p: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of words of any length; p: (piece,).

    Sums are kept as logarithms, since the probability of a long word is less than the least number.
    """
    n, longest, most = at.shape
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    alpha, beta, used = np.full((n, longest), -np.inf), np.full((n, longest), -np.inf), np.zeros(size)
    alpha[:, 0], beta[np.arange(n), lengths] = 0, 0
    for t in range(1, longest):
        k = min(t, most)
        way = alpha[:, t - k : t][:, ::-1] + log_p[at[:, t, :k]]
        top = np.maximum(way.max(axis=1), -1e300)  # no way at all stays so
        with np.errstate(divide="ignore"):
            alpha[:, t] = top + np.log(np.exp(way - top[:, None]).sum(axis=1))
    for t in range(longest - 1, 0, -1):
        k = min(t, most)
        part = beta[:, t - k : t]
        np.logaddexp(part, beta[:, t, None] + log_p[at[:, t, :k]][:, ::-1], out=part)
    total = alpha[np.arange(n), lengths]
    for t in range(1, longest):
        k = min(t, most)
        share = np.exp(alpha[:, t - k : t][:, ::-1] + log_p[at[:, t, :k]] + (beta[:, t] - total)[:, None]) * times[:, None]
        used += np.bincount(at[:, t, :k].ravel(), share.ravel(), size)
    used[0] = 0
    return used


def _words(text: str) -> list[str]:
    return _letters()(text.lower())


@lru_cache(1)
def _letters():
    import regex

    return regex.compile(r"\p{L}+").findall


def fit(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", lang: str = "lang", documents_a_language: int = 4000, rounds: int = 3, prior: float = 200.0) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities by piece and language), fitted on rows with a non-null language that are not held out.

    The sample is about `documents_a_language` documents of each language, chosen by a hash of the id, or all if there are fewer.
    Repeated rows are learned from each, and of texts of any length all words, however long.  Raises ValueError if the
    rows have more than MOST_LANGUAGES languages; without any usable row, or of an empty table, the model is empty.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~common.held_out(id))
    shares = [(r[0], min(1.0, documents_a_language / r[1])) for r in rows.groupBy(lang).count().orderBy(lang).limit(MOST_LANGUAGES + 1).collect()]
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    size = pieces(vocabulary).size
    if not shares:
        return [], np.zeros((size, 0))
    names = [x[0] for x in shares]
    kept = F.create_map(*(F.lit(x) for pair in shares for x in pair))[F.col(lang)]
    sample = rows.where((F.pmod(F.xxhash64(F.lit("language"), id), F.lit(1 << 20)) + 0.5) / float(1 << 20) < kept)

    def count(batches):
        for batch in batches:
            own: dict[tuple[str, str], int] = {}
            for name, x in zip(batch.column(lang).to_pylist(), batch.column(text).to_pylist()):
                for w in _words(x):
                    own[name, w] = own.get((name, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.string()), pa.array(own.values(), pa.int64())], names=["lang", "word", "n"])

    words = common.cut(sample.select(lang, text).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    p = None
    for _ in range(rounds + 1):
        shared, names_ = p, names

        def gather(batches):
            own = pieces(vocabulary)
            used = np.zeros((len(names_), own.size))
            for batch in batches:
                by = np.array([names_.index(x) for x in batch.column("lang").to_pylist()])
                all_, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy().astype(float)
                for k in range(len(names_)):
                    mine = np.flatnonzero(by == k)
                    mine = mine[np.argsort([len(x) for x in all_[mine]], kind="stable")]
                    start = 0
                    while start < len(mine):
                        end = start + 1  # words of nearly one length
                        while end < min(len(mine), start + 2048) and (len(all_[mine[end]]) + 1) * (end - start + 1) <= FIT_CHARS:
                            end += 1
                        some, start = mine[start:end], end
                        at, lengths = own.lattice(list(all_[some]))
                        if shared is None:  # start from how often each piece occurs at all
                            used[k] += np.bincount(at.ravel(), np.repeat(n[some], at.shape[1] * at.shape[2]), own.size)
                        else:
                            used[k] += expected(at, lengths, shared[:, k], n[some], own.size)
            k, piece = np.nonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(used[k, piece])], names=["k", "piece", "used"])

        # At most one row a language and piece comes back, whatever the sample.
        got = words.mapInArrow(gather, "k int, piece int, used double").groupBy("k", "piece").agg(F.sum("used").alias("used")).toPandas()
        used = np.zeros((size, len(names)))
        used[got.piece, got.k] = got.used
        used[0] = 0
        totals = np.maximum(used.sum(axis=0), 1)
        common_part = (used / totals).mean(axis=1) / 2 + 0.5 / size
        p = (used + prior * common_part[:, None]) / (totals + prior)
        p[0] = 0
    return names, p


class Scorer:
    def __init__(self, vocabulary: str, names: list[str], p: np.ndarray):
        self.pieces, self.names, self.p = pieces(vocabulary), names, p
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.logs, self.used = np.empty((1 << 14, len(self.names))), 0

    def learn(self, new: list[str]) -> None:
        new.sort(key=len)
        i = 0
        while i < len(new):
            # Words of nearly one length, and at most so many characters at once; a very long word comes alone.
            j = i + 1
            while j < len(new) and j - i < 4096 and (len(new[j]) + 1) * (j - i + 1) <= 65_536:
                j += 1
            at, lengths = self.pieces.lattice(new[i:j])
            while self.used + j - i > len(self.logs):
                self.logs = np.concatenate([self.logs, np.empty_like(self.logs)])
            self.logs[self.used : self.used + j - i] = forward(at, lengths, self.p)
            self.rows.update(zip(new[i:j], range(self.used, self.used + j - i)))
            self.used += j - i
            i = j

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        split = [_words(x) for x in texts]
        if self.used > REMEMBERED:
            self.reset()
        self.learn(list({w for words in split for w in words if w not in self.rows}))
        out = []
        for words in split:
            if not words or not self.names:
                out.append((UNDETERMINED, 0.0))
                continue
            log = self.logs[[self.rows[w] for w in words]].sum(axis=0)
            best = int(log.argmax())
            out.append((self.names[best], float(1 / np.exp(log - log[best]).sum())))
        for words in split:
            for w in words:
                if len(w) > REMEMBERED_CHARS:
                    self.rows.pop(w, None)
        return out


def predict(docs: DataFrame, vocabulary: str, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` (a language of the model) and `score` (its probability if all languages are as likely beforehand).

    The whole text counts.  A null text, or one without a letter, has `und` and 0, as has any text if the model has no language; of
    equally likely languages the first by name is taken.  Texts count whole however long, repeated rows are judged alike, and an empty
    table gives no rows.  Columns that have these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(vocabulary, *shared.value)

        def run(batch):
            found = scorer.predict(common.texts(batch, text))
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

        return run

    return common.append(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, text)


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language is determined with at least this probability, with their own columns, whatever their names.

    Null texts, and those without a letter, go; repeated rows are judged alike; an empty table, or one without a language to learn
    from, keeps nothing.  Texts count whole, however long.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return predict(packed, vocabulary, fit(docs, vocabulary)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")
