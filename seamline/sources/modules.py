"""The module side: lists of addresses, catalogues of modules, and what is still to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline import schema
from seamline.functions import text
from seamline.operators.chunks import Running, scanned


def read_module_list(spark: SparkSession, path: str) -> DataFrame:
    """Modules from text files with one ``<address> <version>`` per line, in file order per task."""
    return module_list(spark.read.text(path).withColumnRenamed("value", "line"))


def module_list(lines: DataFrame) -> DataFrame:
    """Module rows from a ``line`` column: exactly two parts split on one space, address parsable."""
    parts = F.split("line", " ")
    return (
        lines.filter(F.size(parts) == 2)
        .select(*[c for c in lines.columns if c != "line"],
                parts[0].alias("repo_url"), parts[1].alias("version"))
        .withColumn("name", text.repo_name(F.col("repo_url")))
        .filter(F.col("name").isNotNull()))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue stored as JSON arrays, one array per file."""
    return with_import_path(
        spark.read.schema(schema.CATALOG_SCHEMA).option("multiLine", True).json(path))


def read_large_catalog(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_catalog`` gives, each array read by as many tasks as it has splits.

    The files are read as records that end at a closing brace, which Spark splits anywhere. Whether a brace lies in a text follows from the number
    of quotes before it, and how deep it lies from the brackets before it outside of texts: both are running sums in two
    levels, within a split and over the splits. A brace that leads back into the outer array ends an element; the records of an
    element are put together and parsed on their own. Files that are no array of objects give no rows.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("text"))
    # Escapes occur in texts only; without them every quote begins or ends a text.
    plain = raw.withColumn("plain", F.regexp_replace("text", r"(?s)\\.", ""))
    quotes = F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit("")))
    told = scanned(plain.withColumn("quotes", quotes.cast("bigint")), {"quoted": Running("sum", F.col("quotes"))}, ["file"])
    begins_in_text = (F.col("quoted") - F.col("quotes")) % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(begins_in_text, '"').otherwise(""), "plain"), '(?s)"[^"]*+(?:"|\\z)', "")
    in_text = F.col("quoted") % 2 == 1
    count = lambda chars: F.length(outside) - F.length(F.translate(outside, chars, ""))
    steps = (count("{[") - count("]") - F.when(in_text, 0).otherwise(1)).cast("bigint")
    placed = scanned(told.select("file", "chunk", "pos", "text", steps.alias("steps"), in_text.alias("in_text")),
                     {"depth": Running("sum", F.col("steps"))}, ["file"])
    ends = (F.col("depth") == 1) & ~F.col("in_text")
    numbered = scanned(placed.withColumn("ends", F.when(ends, 1).otherwise(0).cast("bigint")), {"ended": Running("sum", F.col("ends"))}, ["file"])
    elements = numbered.groupBy("file", (F.col("ended") - F.col("ends")).alias("element")).agg(
        F.array_sort(F.collect_list(F.struct("chunk", "pos", "text"))).alias("records"), F.max("ends").alias("whole"))
    joined = F.concat(F.array_join(F.transform("records", lambda r: r["text"]), "}"), F.lit("}"))
    element = F.regexp_replace(joined, r"^\ufeff?[\s,\[\]]*+", "")  # several arrays may follow each other
    return with_import_path(elements.filter("whole = 1").select(F.from_json(element, schema.CATALOG_SCHEMA).alias("m")).filter(
        "m is not null").select("m.*"))


def parse_catalog(lines: DataFrame) -> DataFrame:
    """Catalogue rows from a ``json`` column that holds one JSON array of modules per row."""
    rows = F.from_json("json", T.ArrayType(schema.CATALOG_SCHEMA))
    return with_import_path(lines.select(F.inline(rows)))


def with_import_path(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with import path; missing text is blank and a missing number 0."""
    return catalog.fillna("").fillna(0).withColumn(
        "import_path", text.import_path(F.col("package_manager_url")))


def top_modules(catalog: DataFrame, n: int = schema.CATALOG_RUN_SIZE) -> DataFrame:
    """The n modules with most dependents, ties by name. Each task sends at most n rows."""
    return catalog.orderBy(F.desc("dependents_count"), "name").limit(n)


def pending_modules(modules: DataFrame, done: DataFrame) -> DataFrame:
    """Modules whose (name, version) is not there yet."""
    return modules.join(done.select("name", "version").distinct(), ["name", "version"], "left_anti")


def with_dependents(modules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the dependents count from the catalogue; modules it does not list are dropped.

    An ordinary equi-join: the optimiser broadcasts the catalogue if its size allows.
    """
    listed = (
        catalog.select(text.dependents_key(F.col("repository_url")).alias("dependents_key"),
                       F.col("dependents_count").cast("long").alias("dependants"))
        .groupBy("dependents_key").agg(F.max("dependants").alias("dependants")))
    keyed = modules.withColumn("dependents_key", text.dependents_key(F.col("repo_url")))
    return keyed.join(listed, "dependents_key", "inner").select(*modules.columns, "dependents_key", "dependants")
