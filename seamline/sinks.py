"""Where results go. Every writer leaves the work spread over the tasks that hold the rows.

``write_by_module`` keeps a result as directories of module-versions, so that a later run of some modules replaces theirs and
leaves the files of all others as they are. The other writers replace everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seamline.plans import report


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overview and density tables."""
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


MODULE_KEY = ["module", "version"]
_MANIFEST = "_manifest"


def write_by_module(df: DataFrame, path: str, modules: DataFrame, order: list[str] | None = None, fmt: str = "parquet") -> None:
    """Writes the rows of the given module-versions, with ``module`` and ``version`` as directories.

    The rows are dealt by ranges of module, version and ``order`` (all columns, if none is given), so that a module with most of
    the rows is written by many tasks, into as many files, and each is sorted. Directories of other module-versions stay. Last comes a
    row per module-version in the manifest, with its number of rows. A run that is lost before leaves the old manifest,
    and a module that has no rows any more is one with 0 rows there, whatever files are left of it: ``read_by_module``
    goes by the manifest.
    """
    spark = df.sparkSession
    by = [*MODULE_KEY, *(order if order is not None else sorted(c for c in df.columns if c not in MODULE_KEY))]
    wanted = modules.select(MODULE_KEY).distinct()
    rows = df.join(wanted, MODULE_KEY, "left_semi").repartitionByRange(*by).sortWithinPartitions(*by)
    dynamic = lambda frame: frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MODULE_KEY)
    dynamic(rows).format(fmt).save(path)
    written = _typed(spark.read.format(fmt).schema(df.schema).load(path), df).join(wanted, MODULE_KEY, "left_semi").groupBy(*MODULE_KEY).agg(
        F.count("*").alias("n"))
    # What files say of a module without rows in this run is of an earlier one.
    found = df.join(wanted, MODULE_KEY, "left_semi").select(MODULE_KEY).distinct().withColumn("found", F.lit(True))
    counted = wanted.join(written, MODULE_KEY, "left").join(found, MODULE_KEY, "left").select(
        *MODULE_KEY, F.when(F.col("found"), F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("n_rows"))
    dynamic(counted.coalesce(1)).parquet(f"{path.rstrip('/')}{_MANIFEST}")


def _typed(read: DataFrame, like: DataFrame) -> DataFrame:
    return read.select(*[F.col(c).cast(like.schema[c].dataType) for c in like.columns])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(module, version, n_rows) of all module-versions written to the path."""
    return spark.read.schema("n_rows bigint, module string, version string").parquet(f"{path.rstrip('/')}{_MANIFEST}").select(*MODULE_KEY, "n_rows")


def read_by_module(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The rows of all module-versions that the manifest lists with any."""
    rows = spark.read.format(fmt).schema(schema).load(path).select(*schema.names)
    return rows.join(manifest(spark, path).filter("n_rows > 0"), MODULE_KEY, "left_semi")


def write_details(detail_rows: DataFrame, path: str) -> None:
    """The detail report in report order, range-partitioned so one huge module spans many files."""
    order = ["module", "version", "ord", "file_path", "line_number"]
    detail_rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_occurrence_json(occurrence_rows: DataFrame, path: str) -> None:
    """One JSON object per occurrence, blanks left out, keys in fixed order."""
    report.occurrence_json(occurrence_rows).select("json").write.mode("overwrite").text(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)


def write_bucketed_files(files: DataFrame, table: str, buckets: int) -> None:
    """Files as a table bucketed by path, so that analysing it needs no exchange.

    Partitioned by extension, so that looking up assembly functions reads no Go text.
    """
    (files.repartition(buckets, "path").write.mode("overwrite").partitionBy("ext")
     .bucketBy(buckets, "path").saveAsTable(table))


def show_summary(summary_rows: DataFrame, module: str, version: str) -> None:
    """Print the twelve lines of one module-version."""
    lines = summary_rows.filter((F.col("module") == module) & (F.col("version") == version)).orderBy("ord").select("label", "shown")
    lines.show(lines.count(), truncate=False)
