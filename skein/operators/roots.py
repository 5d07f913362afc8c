"""Which registered folders hold a path.

A path asks for each of its own leading folders by an equality join with the table of roots, so neither the plan nor the work of a
path grows with the number of roots.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import keys


def table(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """(root, root_id) of registered roots."""
    found = spark.createDataFrame([(r.rstrip("/") or "/",) for r in sorted(roots)], "root string")
    return found.withColumn("root_id", keys.root_id(F.col("root")))


def holding(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, ...) for each path and each root that it lies under; a root does not hold itself."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = paths.select("path", F.explode(folders).alias("root")).where("root <> ''")
    whole = paths.where(F.startswith("path", F.lit("/"))).select("path", F.lit("/").alias("root"))
    return each.unionByName(whole).join(roots, "root")


def owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, ...): of the roots that hold a path the first one by path; no row for a path that none holds."""
    rest = [c for c in roots.columns if c != "root"]
    return holding(paths, roots).groupBy("path").agg(F.min("root").alias("root"), *(F.min_by(c, "root").alias(c) for c in rest))
