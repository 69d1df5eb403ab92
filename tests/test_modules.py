"""The module side, scalar helpers, and files on disk."""

import json
import os

import pytest
from pyspark.sql import functions as F

from seamline import schema, sinks
from seamline.functions import text
from seamline.sources import modules as m
from seamline.sources.tree import read_hadoop_tree, read_tree, unlisted


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize("url,name", [
    ("https://github.com/a/b", "b"), ("https://github.com/a/b/", "b"), ("http://x.org/a.git?q=/c#/d", "a.git"),
    ("https://x.org", "."), ("https://x.org/", "/"), ("https://x.org//", "/"), ("github.com/a/b", "b"),
    ("https://x.org/a%2Fb", "b"), ("https://x.org/a+b", "a+b"), ("mailto:x/y", "."), ("", "."),
    ("https://x.org/%zz", None), (":x", None), ("https://x.org:port/a", None), ("a b:c/d", None),
    ("https://x.org:80/a", "a"), ("https://x.org/{a|b}", "{a|b}")])
def test_repo_name(spark, url, name):
    assert column(spark, [url], text.repo_name) == [name]


def test_module_list(spark):
    lines = ["https://github.com/a/b v1", "https://github.com/a/b", "https://github.com/a/b v1 x", "",
             "https://github.com/a/b  v1", "https://x.org/%zz v1"]
    rows = m.module_list(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.repo_url, r.version, r.name) for r in rows] == [("https://github.com/a/b", "v1", "b")]


def test_keys_and_labels(spark):
    keys = column(spark, ["https://github.com/a/b", "https://github.com/kubernetes/kubernetes",
                          "http://github.com/a/kubernetes-x", "https://github.com/kubernetes-sigs/x"],
                  text.dependents_key)
    assert keys == ["github.com%2Fa%2Fb", "k8s.io%2Fkubernetes", "http:%2F%2Fgithub.com%2Fa%2Fkubernetes-x",
                    "k8s.io-sigs%2Fx"]
    assert column(spark, ["/a/b/c@v1", "c", "/c"], text.module_label) == ["b", "c", ""]
    assert column(spark, ["https://pkg.go.dev/a/b", "http://pkg.go.dev/a"], text.import_path) == [
        "a/b", "http://pkg.go.dev/a"]
    path = lambda v: text.module_path("/go", v, F.lit("v2"))
    assert column(spark, ["https://pkg.go.dev/a/b"], path) == ["/go/pkg/mod/a/b@v2"]


@pytest.mark.parametrize("content,index", [
    ("ab\ncd", 0), ("ab\ncd", 2), ("ab\ncd", 3), ("ab\ncd", 4), ("ab\ncd", 99), ("", 0), ("\n\n", 1), ("ü\nü", 3),
    ("üx", 1), ("ab", -1)])
def test_line_column(spark, content, index):
    data = content.encode()[:max(index, 0)]
    expected = (data.count(b"\n") + 1, len(data) - (data.rfind(b"\n") + 1) + 1)
    row = spark.createDataFrame([(content, index)], "c string, i int").select(
        text.line_of(F.col("c"), F.col("i")), text.column_of(F.col("c"), F.col("i"))).first()
    assert tuple(row) == expected


def test_catalog(spark, tmp_path):
    entry = {"name": "x", "dependents_count": 7, "package_manager_url": "https://pkg.go.dev/x/y", "other": 1}
    (tmp_path / "list.json").write_text(json.dumps([entry, {"name": "z", "dependents_count": 9}], indent=2))
    rows = m.read_catalog(spark, str(tmp_path / "list.json"))
    assert [(r.name, r.dependents_count, r.import_path, r.platform, r.contributions_count)
            for r in rows.orderBy("name").collect()] == [("x", 7, "x/y", "", 0), ("z", 9, "", "", 0)]
    assert [r.name for r in m.top_modules(rows, 1).collect()] == ["z"]
    assert "TakeOrderedAndProject" in m.top_modules(rows)._jdf.queryExecution().executedPlan().toString()
    sinks.write_catalog(rows.drop("import_path"), str(tmp_path / "cache"))
    assert spark.read.schema(schema.CATALOG_SCHEMA).json(str(tmp_path / "cache")).count() == 2


def test_dependents_and_pending(spark):
    wanted = spark.createDataFrame(
        [("a", "v1", "https://github.com/o/a"), ("b", "v1", "https://github.com/o/b")], "name string, version string, repo_url string")
    catalog = spark.createDataFrame([("https://github.com/o/a", 5)], "repository_url string, dependents_count int")
    assert [(r.name, r.dependants) for r in m.with_dependents(wanted, catalog).collect()] == [("a", 5)]
    done = wanted.filter("name = 'a'")
    assert [r.name for r in m.pending_modules(wanted, done).collect()] == ["b"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "mods"
    files = {
        "x@v1/a.go": "package x\n", "x@v1/.hidden/b.go": "package h\n", "x@v1/_c.go": "package x\n",
        "x@v1/vendor/v/d.go": "package v\n", "x@v1/asm.S": "TEXT ·f(SB)", "x@v1/e.GO": "no", "x@v1/readme.md": "no",
        "y@v2/deep/er/f.go": "package f\n"}
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (root / "x@v1" / "dir.go").mkdir()
    os.symlink(root / "y@v2", root / "x@v1" / "link")
    os.symlink(root / "y@v2" / "deep" / "er" / "f.go", root / "x@v1" / "linked.go")
    (root / "x@v1" / "bytes.go").write_bytes(b"package x\n// \xff\n")
    os.symlink(root / "nowhere", root / "x@v1" / "dangling.go")
    return root


def test_read_tree(spark, tree):
    modules = spark.createDataFrame(
        [("x", "v1", f"{tree}/x@v1/"), ("y", "v2", f"{tree}/y@v2"), ("gone", "v1", f"{tree}/gone")],
        "module string, version string, root string")
    files = read_tree(modules)
    assert files.schema == schema.FILES_SCHEMA or files.columns == schema.FILES_SCHEMA.names
    rows = {r.path[len(str(tree)) + 1:]: r for r in files.drop("content").collect()}
    assert set(rows) == {
        "x@v1/a.go", "x@v1/.hidden/b.go", "x@v1/_c.go", "x@v1/vendor/v/d.go", "x@v1/asm.S", "x@v1/linked.go",
        "x@v1/bytes.go", "x@v1/dangling.go", "y@v2/deep/er/f.go"}
    assert rows["x@v1/asm.S"].ext == ".S" and rows["y@v2/deep/er/f.go"].module == "y"
    contents = {r.path.rsplit("/", 1)[1]: r.h for r in files.select("path", F.hex("content").alias("h")).collect()}
    assert [(r.module, r.path) for r in unlisted(modules).collect()] == [("gone", f"{tree}/gone")]
    assembly = files.filter(F.col("ext").isin(schema.ASM_EXTENSIONS))._jdf.queryExecution().optimizedPlan().toString()
    assert assembly.count("MapInArrow") == len(schema.ASM_EXTENSIONS)  # nothing reads the Go files
    assert contents["bytes.go"] == b"package x\n// \xff\n".hex().upper() and contents["dangling.go"] is None


def test_read_hadoop_tree(spark, tree):
    rows = {(r.module, r.version, r.name): r for r in read_hadoop_tree(spark, str(tree)).collect()}
    assert ("x", "v1", "a.go") in rows and ("y", "v2", "f.go") in rows and ("x", "v1", "asm.S") in rows
    assert rows["x", "v1", "a.go"].dir == f"{tree}/x@v1" and rows["x", "v1", "a.go"].content == "package x\n"


def test_shares_by_volume(spark):
    """A tree with a few large files and many small ones: no share has more than twice the mean, but for a file that has."""
    from seamline.sources.tree import by_volume

    size = F.when(F.col("id") % 100 == 0, 400_000).when(F.col("id") == 7, 9_000_000).otherwise(1000)
    listed = spark.range(4000).select(F.lit("m").alias("module"), F.lit("v").alias("version"), (F.col("id") % 3).cast("string").alias("dir"),
                                      F.concat(F.col("id").cast("string"), F.lit(".go")).alias("name"), size.cast("bigint").alias("size"))
    shares = by_volume(listed, 8).groupBy("share").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest")).collect()
    mean = sum(r.bytes for r in shares) / 8
    assert len(shares) >= 6 and {r.share for r in shares} <= set(range(8))
    assert all(r.bytes <= 2 * mean or r.bytes - r.largest <= mean for r in shares)
    placed = by_volume(listed, 8).repartitionById(8, F.col("share")).groupBy(F.spark_partition_id().alias("at")).agg(F.count_distinct("share").alias("n"))
    assert {r.n for r in placed.collect()} <= set(range(9)) and by_volume(listed.limit(0), 8).count() == 0
