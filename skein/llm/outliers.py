"""Quality rules by robust multivariate outliers.  DataFrame and SQL functions only.

For each language and source the minimum-covariance-determinant estimate of the statistic vectors is sought from three starts:
medians and quartile ranges; the same with correlations of squashed scores; and a quarter of the documents by hash.  Concentration
steps, in which the three quarters of the documents that lie nearest give the next mean and covariance, go on until no determinant
falls, and the start with the least one wins.  All starts of all groups take a step at a time: two aggregations with map-side
partial sums; quantiles come from histograms, so no group is sorted or collected.

The limit of rejection follows from the degrees of freedom of a group's estimate.  Groups with no more than five documents a
dimension are measured with the others of their language, and if these are too few, with all such.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Statistics of the vector, each with the least standard deviation that it is given.  Many are constant in clean text, and a
#: covariance without a floor would reject the first document that has, say, one symbol.
VECTOR = (("word_length", 0.35), ("symbols", 0.06), ("dup_lines", 0.12), ("repeats", 0.12), ("capitals", 0.07))
#: Share of a group that an estimate rests on, the fall of the logarithm of a determinant below which a start has converged, least
#: documents of a group with an estimate of its own, and the share of a normal group that lies beyond the limits for the last
#: reweighting and for rejection.
CORE, FALL, LEAST, REWEIGHT, REJECT = 0.75, 0.01, 5 * len(VECTOR) + 1, 0.025, 1e-5
#: A guard: each step lowers the determinant of an exact core, but cores here are exact to a bin of a histogram only.
MOST_STEPS = 30
#: Largest table of groups that is broadcast, in rows and in bytes of their names; a larger one is joined by a shuffle.
BROADCAST_GROUPS, BROADCAST_BYTES = 10_000, 1 << 20
#: The most three-word windows of a text that are sorted as hash and position in one number.
FAST_WINDOWS = (1 << 20) - 1


def chi2_share(x: float, dims: float) -> float:
    """The share of a chi-squared variable below x, by the series of the incomplete gamma function."""
    a, h = dims / 2, x / 2
    term = total = math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if h > 0 else 0.0
    k = a
    while term > total * 1e-15:
        k += 1
        term *= h / k
        total += term
    return total


def chi2_limit(share: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_share(middle, dims) < share else (low, middle)
    return high


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals) of whole texts; null has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = (
        docs.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), t.alias("t"))
        .select(
            "id", "lang", "source",
            F.array_remove(F.split("t", common.GAP), "").alias("words"),
            lines.alias("lines"),
            without(common.GAP).cast("long").alias("word_chars"),
            (F.length("t") - without("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.length("t") - without("[A-Z]")).cast("long").alias("n_capitals"),
        )
        .select(
            "id", "lang", "source", "word_chars", "n_symbols", "n_capitals",
            F.size("words").cast("long").alias("n_words"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.expr("CASE WHEN size(words) < 4 THEN array() ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").alias("h"),
        )
    )
    # Windows by the upper bits of their hash and then by position, which sorts as plain numbers.  Where windows of different hashes
    # share these bits, or there are too many positions, whole hashes are sorted with their positions.
    bits = {"bits": 20, "most": FAST_WINDOWS}
    order = F.expr("CASE WHEN size(array_distinct(h)) = size(h) THEN array() WHEN size(h) > {most} THEN array() ELSE sort_array(transform(h, (x, i) -> shiftleft(shiftright(x, {bits}), {bits}) + i)) END".format(**bits))
    fast = F.expr("transform(p, x -> cast(x & (shiftleft(1L, {bits}) - 1) as int))".format(**bits))
    mixed = F.expr("size(h) > {most} OR exists(sequence(0, size(at) - 1), j -> j > 0 AND h[at[j]] <> h[at[j - 1]] AND shiftright(h[at[j]], {bits}) = shiftright(h[at[j - 1]], {bits}))".format(**bits))
    whole = F.expr("transform(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i))), s -> s.i)")
    twice = F.expr("sort_array(transform(filter(sequence(0, size(at) - 1), j -> (j > 0 AND h[at[j]] = h[at[j - 1]]) OR (j < size(at) - 1 AND h[at[j]] = h[at[j + 1]])), j -> at[j]))")
    covered = F.expr("aggregate(twice, named_struct('n', 0L, 'end', 0), (a, x) -> named_struct('n', a.n + x + 3 - greatest(x, a.end), 'end', x + 3), a -> a.n)")
    return (
        base.withColumn("p", order)
        .withColumn("at", fast)
        .withColumn("at", F.when(mixed & (F.size(F.array_distinct("h")) < F.size("h")), whole).otherwise(F.col("at")))
        .withColumn("twice", F.when(F.size("at") > 0, twice).otherwise(F.expr("cast(array() as array<int>)")))
        .select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "n_capitals")
    )


def _attach(df: DataFrame, groups: DataFrame, by: Sequence[str] = ("g",)) -> DataFrame:
    size = groups.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("g")), F.lit(0))).first()
    return df.join(F.broadcast(groups) if size[0] <= BROADCAST_GROUPS and size[1] <= BROADCAST_BYTES else groups, list(by))


def _quantiles(binned: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """The first bin of each of `by` at whose end so many of its rows are passed; binned: (by, bin, n)."""
    so_far, all_ = F.sum("n").over(W.partitionBy(*by).orderBy("bin")), F.sum("n").over(W.partitionBy(*by))
    return binned.withColumn("so_far", so_far / all_).groupBy(*by).agg(*(F.min(F.when(F.col("so_far") >= s, F.col("bin"))).alias(f"q{i}") for i, s in enumerate(shares)))


def _covariance(i: int, j: int) -> Column:
    return F.col(f"s{i}_{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")


def _factor(df: DataFrame, mean, cov, keep: Sequence[str]) -> DataFrame:
    """`keep`, the means m_i, the Cholesky factor l_ij of the covariance plus the floors, and `det`, the logarithm of its determinant."""
    p = range(len(VECTOR))
    df = df.select(*df.columns, *(mean(i).alias(f"m{i}") for i in p), *((cov(i, j) + (VECTOR[i][1] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i in p for j in range(i + 1)))
    for j in p:
        inner = sum((F.col(f"l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"c{j}_{j}") - inner, F.lit(VECTOR[j][1] ** 2 / 4))))
        for i in range(j + 1, len(VECTOR)):
            inner = sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l{i}_{j}", (F.col(f"c{i}_{j}") - inner) / F.col(f"l{j}_{j}"))
    det = sum((2 * F.log(f"l{i}_{i}") for i in p), F.lit(0.0))
    return df.select(*keep, *(f"m{i}" for i in p), *(f"l{i}_{j}" for i in p for j in range(i + 1)), det.alias("det"))


def _from_moments(moments: DataFrame, scale: float, keep: Sequence[str]) -> DataFrame:
    return _factor(moments, lambda i: F.col(f"s{i}") / F.col("n"), lambda i, j: _covariance(i, j) * scale, keep)


def _distances(x: DataFrame, factors: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`keep` and d2, the squared Mahalanobis distance: forward substitution through the Cholesky factor."""
    df, p = _attach(x, factors), range(len(VECTOR))
    for i in p:
        inner = sum((F.col(f"l{i}_{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - inner) / F.col(f"l{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in p), F.lit(0.0))).select(*keep, "d2")


def _moments(x: DataFrame, by: Sequence[str], value=lambda i: F.col(f"x{i}")) -> DataFrame:
    p = range(len(VECTOR))
    return x.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(value(i)).alias(f"s{i}") for i in p), *(F.sum(value(i) * value(j)).alias(f"s{i}_{j}") for i in p for j in range(i + 1)))


def _core(x: DataFrame) -> DataFrame:
    """The rows of `x` (with d2) among the nearest CORE of their group and start, to a 64th of a natural-log unit of d2."""
    bin_ = F.floor(F.log(F.col("d2") + 1e-6) * 64).cast("int")
    limits = _quantiles(x.groupBy("g", "start", bin_.alias("bin")).agg(F.count("*").alias("n")), ["g", "start"], [CORE])
    return _attach(x, limits, ["g", "start"]).where(bin_ <= F.col("q0")).drop("q0", "d2")


def _starts(x: DataFrame) -> DataFrame:
    """Means and factors of the three starts of each group."""
    p, keep = range(len(VECTOR)), ["g", "start"]
    cell = lambda i: F.floor(F.col(f"x{i}") / VECTOR[i][1] * 32).cast("int")
    tall = x.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), cell(i).alias("bin")) for i in p))).alias("c")).groupBy("g", "c.dim", "c.bin").agg(F.count("*").alias("n"))
    quarters = _quantiles(tall, ["g", "dim"], [0.25, 0.5, 0.75])
    at = lambda q, i: F.max(F.when(F.col("dim") == i, (F.col(q) + 0.5) * (VECTOR[i][1] / 32)))
    spread = lambda i: F.greatest((at("q2", i) - at("q0", i)) / 1.349, F.lit(VECTOR[i][1]))
    middles = common.cut(quarters.groupBy("g").agg(*(at("q1", i).alias(f"a{i}") for i in p), *(spread(i).alias(f"d{i}") for i in p)))
    middle, wide = lambda i: F.col(f"a{i}"), lambda i: F.col(f"d{i}")
    plain = _factor(middles.withColumn("start", F.lit(0)), middle, lambda i, j: wide(i) ** 2 if i == j else F.lit(0.0), keep)
    squashed = _moments(_attach(x, middles), ["g"], lambda i: F.tanh((F.col(f"x{i}") - middle(i)) / wide(i)))
    alike = lambda i, j: _covariance(i, j) / F.sqrt((_covariance(i, i) + 1e-9) * (_covariance(j, j) + 1e-9))
    joined = squashed.join(middles, "g").withColumn("start", F.lit(1))
    related = _factor(joined, middle, lambda i, j: wide(i) ** 2 if i == j else alike(i, j) * wide(i) * wide(j), keep)
    some = x.where(F.pmod(F.xxhash64(*(f"x{i}" for i in p)), F.lit(4)) == 0)
    drawn = _from_moments(_moments(some, ["g"]).withColumn("start", F.lit(2)), 1.0, keep)
    return common.cut(plain.unionByName(related).unionByName(drawn))


def estimates(x: DataFrame) -> DataFrame:
    """Means m_i and Cholesky factor l_ij of each group of (g, x0, x1, ...), and `n`, the documents that the last estimate rests on."""
    columns = ["g", "start", *(f"x{i}" for i in range(len(VECTOR)))]
    whole = CORE / chi2_share(chi2_limit(CORE, len(VECTOR)), len(VECTOR) + 2)
    factors, before = _starts(x), None
    for _ in range(MOST_STEPS):
        factors = common.cut(_from_moments(_moments(_core(_distances(x, factors, columns)), ["g", "start"]), whole, ["g", "start"]))
        if before is not None and factors.join(before, ["g", "start"]).where(F.col("det") < F.col("old") - FALL).isEmpty():
            break
        before = factors.select("g", "start", F.col("det").alias("old"))
    of = F.struct(*(c for c in factors.columns if c != "g"))
    best = common.cut(factors.groupBy("g").agg(F.min_by(of, F.struct("det", "start")).alias("of")).select("g", "of.*"))
    near = chi2_limit(1 - REWEIGHT, len(VECTOR))
    scale = (1 - REWEIGHT) / chi2_share(near, len(VECTOR) + 2)
    moments = _moments(_distances(x, best, [c for c in columns if c != "start"]).where(F.col("d2") <= near), ["g"])
    return common.cut(_from_moments(moments, scale, ["g", "n"]).drop("det"))


def limit(n: Column, reject: float) -> Column:
    """The squared distance that a share `reject` of a normal group exceeds, if the estimate rests on n documents.

    It is p (n^2 - 1) / (n (n - p)) times a quantile of F with p and n - p degrees of freedom, by Wilson and Hilferty's cube root.
    """
    p, z = len(VECTOR), NormalDist().inv_cdf(1 - reject)
    n = F.greatest(n, F.lit(3 * p)).cast("double")
    a, b = 2 / (9 * p), 2 / (9 * (n - p))
    root = ((1 - a) * (1 - b) + z * F.sqrt((1 - b) ** 2 * a + (1 - a) ** 2 * b - z * z * a * b)) / ((1 - b) ** 2 - z * z * b)
    return p * (n * n - 1) / (n * (n - p)) * root**3


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, reject: float = REJECT) -> DataFrame:
    """One row for each row of `docs`: its statistics, base_failed, distance and kept.

    A document fails the base if it has under 50 words or if repeated three-word windows cover over half of them; a null text
    has no words.  The others of a language and source are measured by their own estimate; if they are fewer than `least`,
    together with those of all such groups of their language; if these are fewer too, with those of all such languages; and if
    even these are, nothing is rejected and the distance is null.  Null is a language or source like any other.  Repeated rows
    count each; texts are read whole, however long; an empty table gives no rows.
    """
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    vector = [share("word_chars", "n_words"), F.sqrt(share("n_symbols", "word_chars")), F.sqrt(share("n_dup_lines", "n_lines")), F.sqrt(share("n_repeat_words", "n_words")), F.sqrt(share("n_capitals", "word_chars"))]
    name = lambda *of: F.to_json(F.array(*(F.coalesce(F.col(c), F.lit("\0")) for c in of)))
    found = statistics(docs, id, text, lang, source).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    found = common.cut(found.select("*", name("lang", "source").alias("own"), name("lang").alias("wider"), *(v.alias(f"x{i}") for i, v in enumerate(vector))).drop("n_lines", "n_capitals", "lang", "source"))
    sizes = found.where("NOT base_failed").groupBy("own", "wider").count()
    small = F.when(F.col("count") < least, F.col("count"))
    pooled = lambda by: F.coalesce(F.sum("small").over(W.partitionBy(*by)), F.lit(0))
    sizes = sizes.withColumn("small", small).withColumn("of_language", pooled(["wider"]))
    sizes = sizes.withColumn("small", F.when(F.col("of_language") < least, F.col("small"))).withColumn("of_all", pooled([]))
    placed = F.when(F.col("count") >= least, F.col("own")).when(F.col("of_language") >= least, F.col("wider")).when(F.col("of_all") >= least, "")
    groups = common.cut(sizes.select("own", placed.alias("g")))
    size = groups.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("own")), F.lit(0))).first()
    few = size[0] <= BROADCAST_GROUPS and size[1] <= BROADCAST_BYTES
    grouped = found.drop("wider").join(F.broadcast(groups) if few else groups, "own", "left")
    judged = ~F.col("base_failed") & F.col("g").isNotNull()
    fitted = grouped.where(judged)
    factors = estimates(fitted.select("g", *(f"x{i}" for i in range(len(VECTOR)))))
    columns = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    measured = _distances(fitted, factors, [*columns, "n"]).withColumn("limit", limit(F.col("n"), reject)).drop("n")
    others = grouped.where(~judged).select(*columns, F.lit(None).cast("double").alias("d2"), F.lit(0.0).alias("limit"))
    return measured.unionByName(others).select(
        F.col("id").alias(id), *columns[1:], (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= F.col("limit"))).alias("kept"), F.sqrt("d2").alias("distance"),
    )
