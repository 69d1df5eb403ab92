"""Comparison of several versions of one module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.plans.report import vector_names


def version_delta(overview_rows: DataFrame, order: DataFrame) -> DataFrame:
    """Counts of every vector per version, with the change from the version before.

    ``order`` has module, version, version_ord: the position of the version in the list compared.
    One window partition holds the listed versions of one module and vector.
    """
    by_version = W.partitionBy("module", "vector").orderBy("version_ord")
    long = overview_rows.join(order, ["module", "version"], "inner").select(
        "module", "version", "version_ord",
        F.inline(F.array(*[
            F.struct(F.lit(v).alias("vector"), F.col(f"n_{v}").alias("n")) for v in vector_names()])))
    return long.withColumn("delta", F.col("n") - F.lag("n").over(by_version))
