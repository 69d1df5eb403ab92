"""A catalogue of one array, read by several tasks."""

import json
import os

import pytest

from seamline.sources.modules import read_catalog, read_large_catalog


def rows(df):
    return sorted(map(repr, df.collect()))


def module(i):
    odd = ["plain", 'a "quoted" }{][ text', "back\\slash\\", "\\\"}", "new\nline é  ", "", "}}}]", "\\\\\"", "{", None][i % 10]
    return {"name": f"n{i}", "description": odd, "dependents_count": i, "platform": "Go", "extra": {"deep": [{"x": "}"}, [1, {"y": {}}]]},
            "package_manager_url": f"https://pkg.go.dev/m{i}", "repository_url": odd and odd * 3}


@pytest.mark.parametrize("indent", [None, 2])
def test_several_tasks_read_one_array(spark, tmp_path, indent):
    os.makedirs(tmp_path / "in")
    for k, n in enumerate((900, 1, 0)):
        (tmp_path / "in" / f"c{k}.json").write_text(json.dumps([module(i) for i in range(n)], indent=indent, ensure_ascii=k == 0))
    path = str(tmp_path / "in")
    want = rows(read_catalog(spark, path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("7k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            assert rows(read_large_catalog(spark, path)) == want and len(want) == 901
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
