"""Helpers of several operators: settled tables, running totals, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none, as in tests."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seamline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder. On leaving, all but the kept ones are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, bool] = {}

    def settle(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """``df`` computed once and read back, so that its lineage ends here."""
        path = f"{shared_folder(self.spark)}/seamline-{uuid.uuid4().hex}"
        self.paths[path] = keep
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes one settled table early."""
        files = df.inputFiles()
        for path in [p for p in self.paths if files and p.rpartition("/")[2] in files[0]]:
            self._delete(path)
            del self.paths[path]

    def _delete(self, path: str) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path, keep in self.paths.items():
            if not keep:
                self._delete(path)


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else a table has; null texts are empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def held_out(doc_id, folds: int):
    """Whether crc32 of the id as text leaves no remainder; rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come before a row by ``order``.

    ``order`` is a column of evenly spread 64-bit values, which cut each group into ranges; a window never
    holds more than one range of a group, so a group may hold any share of the rows. Group columns are not
    null. Ties of ``order`` are broken by ``tie``, a column the caller provides.
    """
    ranges = max(256, 4 * shuffle_partitions(df.sparkSession))
    bits = (ranges - 1).bit_length()
    keyed = df.withColumn("_range", F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(2**63))), 64 - bits))
    keys = [*group, "_range"]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*keys).agg(F.sum(value).alias("_sum")).select(
        *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys).orderBy(order, "tie").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.join(starts, keys).withColumn(
        out, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_range", "_start")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its smallest node.

    Large-star and small-star steps in turn: each links neighbours to the smallest node seen, so that no row
    ever holds more than two nodes and the number of edges never grows. Each step is a settled table.
    """
    pairs = scratch.settle(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _fingerprint(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.settle(large.filter(F.col("a") != F.col("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        small = small.filter(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        settled = scratch.settle(small)
        scratch.drop(large)
        scratch.drop(pairs)
        pairs, last = settled, state
        state = _fingerprint(pairs)
        if state == last:
            break
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _fingerprint(pairs: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(h)).first())


def struct_of(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)
