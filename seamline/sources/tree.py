"""Source files of module directories.

``read_tree`` reads directories every executor can see (a mounted file system) and finds all files,
hidden ones included. ``read_hadoop_tree`` reads any file system Spark can, but Spark leaves out
names that start with a dot or an underscore.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline import schema
from seamline.operators.bounds import settle
from seamline.operators.chunks import Running, scanned

EXTENSIONS = (".go", *schema.ASM_EXTENSIONS)
_BATCH_BYTES = 32 << 20
_CHUNK_ROWS = 10_000


def read_tree(modules: DataFrame, partitions: int | None = None) -> DataFrame:
    """Files below each module's ``root``; a module whose walk fails is left out.

    ``modules`` has module, version, root. The listing is spread by directory, the reading by volume: every task gets
    about as many bytes, so one huge module uses every task and a huge file is no more than one task's share or a task of its own.
    """
    n = partitions or int(modules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = by_volume(list_tree(modules, n), n)
    return _by_extension(lambda ext: listed.filter(F.endswith("name", F.lit(ext))).repartitionById(n, F.col("share")).select(
        "module", "version", "dir", "name").mapInArrow(
        _read_files, "module string, version string, dir string, name string, content binary"))


def by_volume(listed: DataFrame, shares: int) -> DataFrame:
    """Adds ``share``, from 0 to ``shares`` - 1, so that all shares of an extension have about the same number of bytes.

    Files are put in a random order, by a hash, and the running total of their sizes is cut at equal distances. The total
    is scanned in two levels, so that no task orders all files. A file lies where its middle lies; one that is larger than a
    share leaves the shares it covers to itself.
    """
    ext = F.when(F.endswith("name", F.lit(EXTENSIONS[0])), EXTENSIONS[0]).otherwise("other")
    # An empty file counts for its opening.
    weighed = listed.withColumn("ext_", ext).withColumn("weight", F.col("size") + 4096).withColumn("pos", F.xxhash64("module", "version", "dir", "name")).withColumn(
        "chunk", F.pmod("pos", F.lit(1024)))
    totals = weighed.groupBy("ext_").agg(F.sum("weight").alias("total"))
    placed = scanned(weighed, {"upto": Running("sum", F.col("weight"))}, ["ext_"]).join(totals, "ext_")
    share = F.floor((F.col("upto") - F.col("weight") / 2) * shares / F.col("total")).cast("int")
    return placed.select(*listed.columns, F.least(F.lit(shares - 1), share).alias("share"))


def _by_extension(read) -> DataFrame:
    """One branch for each extension, whose name is a constant there: a filter on ``ext`` drops whole
    branches before anything is read."""
    out = None
    for ext in EXTENSIONS:
        branch = read(ext).select(
            "module", "version", "dir", F.concat("dir", F.lit("/"), "name").alias("path"), "name",
            F.lit(ext).alias("ext"), F.col("content").cast("string").alias("content"))
        out = branch if out is None else out.unionByName(branch)
    return out


def list_tree(modules: DataFrame, partitions: int) -> DataFrame:
    """(module, version, dir, name, size) of the wanted files; modules with a directory that cannot be listed are left out."""
    found = _walk(modules, partitions)
    failed = found.filter(F.col("kind") == "error").select("module", "version").distinct()
    return found.filter(F.col("kind") == "file").drop("kind").join(
        failed, ["module", "version"], "left_anti")


def unlisted(modules: DataFrame, partitions: int | None = None) -> DataFrame:
    """(module, version, path, reason) of the directories for which ``read_tree`` leaves their module out."""
    n = partitions or int(modules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _walk(modules, n).filter(F.col("kind") == "error").select(
        "module", "version", F.col("dir").alias("path"), F.lit("directory cannot be listed").alias("reason"))


def _walk(modules: DataFrame, partitions: int) -> DataFrame:
    """Entries (module, version, dir, name, kind, size) of all directories, found one level at a time.

    Every level is a Spark job over all directories of that depth, whichever module they are in.
    """
    directories = modules.select("module", "version", F.regexp_replace("root", r"(?<=.)/+$", "").alias("dir"))
    levels = []
    while not levels or not directories.isEmpty():
        entries = settle(directories.repartition(partitions, "dir").mapInPandas(
            _list_directories, "module string, version string, dir string, name string, kind string, size bigint"))
        levels.append(entries)
        directories = entries.filter(F.col("kind") == "dir").select(
            "module", "version", F.concat("dir", F.lit("/"), "name").alias("dir"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def write_tree(files: DataFrame) -> None:
    """Writes each file's content to dir/name, in directories every executor sees; for copies of trees and for tests.

    Executors write the files; a file written again by a retried task is the same.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for directory, name, content in zip(*(batch.column(c).to_pylist() for c in ("dir", "name", "content"))):
                os.makedirs(directory, exist_ok=True)
                with open(os.path.join(directory, name), "wb") as f:
                    f.write(content or b"")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    files.select("dir", "name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n bigint").write.format("noop").mode(
        "overwrite").save()


def read_hadoop_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``, laid out as ``<root>/<module>@<version>/...``."""
    def raw(ext: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ext}").load(root)

    full = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    prefix = root.rstrip("/").split(":", 1)[-1].replace("//", "/")
    relative = F.expr(f"substring(full, length({_sql_text(prefix)}) + 2)")
    return _by_extension(
        lambda ext: raw(ext).withColumn("full", full).withColumn("relative", relative)
        .withColumn("module", F.regexp_extract("relative", r"^(.*?)@[^/]*(?:/|$)", 1))
        .withColumn("version", F.regexp_extract("relative", r"^.*?@([^/]*)", 1))
        .withColumn("dir", F.regexp_extract("full", r"^(.*)/[^/]*$", 1))
        .withColumn("name", F.regexp_extract("full", r"([^/]*)$", 1)))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of each directory in bounded chunks; directory links are not followed."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            chunk = []
            try:
                with os.scandir(row.dir) as entries:
                    for entry in entries:
                        if entry.is_dir(follow_symlinks=False):
                            chunk.append((entry.name, "dir", 0))
                        elif entry.name.endswith(EXTENSIONS):
                            chunk.append((entry.name, "file", _size_of(entry)))
                        if len(chunk) >= _CHUNK_ROWS:
                            yield _entries(row, chunk)
                            chunk = []
            except OSError:
                chunk.append(("", "error", 0))
            yield _entries(row, chunk)


def _size_of(entry: os.DirEntry) -> int:
    """Bytes of a file; 0 for one that cannot be looked at, such as a broken link."""
    try:
        return entry.stat().st_size
    except OSError:
        return 0


def _entries(row, chunk: list[tuple[str, str, int]]) -> pd.DataFrame:
    return pd.DataFrame({
        "module": row.module, "version": row.version, "dir": row.dir, "name": [e[0] for e in chunk],
        "kind": [e[1] for e in chunk], "size": [e[2] for e in chunk]}, dtype="object")


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each file's bytes, in batches of bounded size; NULL where a file cannot be read."""
    for batch in batches:
        start, contents, size = 0, [], 0
        dirs, names = batch.column("dir").to_pylist(), batch.column("name").to_pylist()
        for i, (directory, name) in enumerate(zip(dirs, names)):
            contents.append(_bytes_of(os.path.join(directory, name)))
            size += len(contents[-1] or b"")
            if size >= _BATCH_BYTES or i + 1 == len(dirs):
                part = batch.slice(start, len(contents))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(contents, pa.binary())], [*part.schema.names, "content"])
                start, contents, size = i + 1, [], 0


def _bytes_of(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None
