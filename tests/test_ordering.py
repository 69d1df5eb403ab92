"""Walk order, numbering over ranges, pages, and analysis of distinct texts."""

from pyspark.sql import functions as F

from seamline.operators import registry
from seamline.plans.occurrences import occurrences
from seamline.plans.ordering import detail_pages, in_walk_order, numbered
from seamline.plans.shared_texts import distinct_texts, shared_occurrences
from tests.test_detectors import CASES


def test_walk_order(files_of):
    text = "package p\nfunc init() {}\nfunc init() {}\n"
    paths = ["m/a.go", "m/a/z.go", "m/a/b/c.go", "m/a-b/a.go", "m/a/b.go", "m/Z/a.go", "m/a.b/a.go", "m/a/b/b.go"]
    rows = in_walk_order(occurrences(files_of({p: text for p in paths}), places=True)).orderBy("ordinal").collect()
    want = ["m/a.go", "m/Z/a.go", "m/a/b.go", "m/a/z.go", "m/a/b/b.go", "m/a/b/c.go", "m/a-b/a.go", "m/a.b/a.go"]
    assert [(r.file_path, r.line_number) for r in rows] == [(p, line) for p in want for line in (2, 3)]
    assert [r.ordinal for r in rows] == list(range(1, 17))


def test_one_list_with_all_rows_spreads(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 5000).alias("v"))
    out = numbered(rows, ["g"], ["v"], partitions=8)
    assert [tuple(r) for r in out.orderBy("v").select("v", "ordinal").collect()] == [(i, i + 1) for i in range(5000)]
    assert numbered(rows.limit(0), ["g"], ["v"]).count() == 0
    ties = numbered(rows.withColumn("v", F.lit(1)), ["g"], ["v"], partitions=4)
    assert sorted(r.ordinal for r in ties.collect()) == list(range(1, 5001))


def test_pages(files_of):
    texts = {f"m/d{i}/a.go": "package p\n" + "func init() {}\n" * (i + 1) for i in range(5)} | {"n/a/a.go": "package p\nfunc init() {}\n"}
    ordered = in_walk_order(occurrences(files_of(texts), places=True))
    pages = {(r.module, r.page): r for r in detail_pages(ordered, 4).collect()}
    assert sorted(pages) == [("m", 0), ("m", 1), ("m", 2), ("m", 3), ("n", 0)]
    assert [len(pages["m", p].entries) for p in range(4)] == [4, 4, 4, 3] and pages["m", 2].first_ordinal == 9
    entries = [e for p in range(4) for e in pages["m", p].entries]
    assert [e.ordinal for e in entries] == list(range(1, 16)) and entries[1].file_path == "m/d1/a.go" and entries[1].line == "m/d1/a.go:2"


def test_distinct_texts_give_the_same(files_of):
    texts = {f"{m}/{n}/{n}.go": t for m in ("m", "n") for n, (t, _) in CASES.items()}
    texts |= {f"{m}/asm/{f}": t for m in ("m", "n", "o") for f, t in (
        ("a.go", "package p\nfunc f() {\n\tasmFn(1)\n\tother(1)\n}\n"), ("b_test.go", "package q\nfunc TestA() {}\n"), ("b.go", "package q\nfunc TestA() {}\n"))}
    texts |= {"m/asm/x.s": "TEXT ·asmFn(SB)\n", "n/asm/x.s": "TEXT ·other(SB)\n"}
    files = files_of(texts)
    registry.register_detector("panics", F.col("call_name") == "panic", ["file_path", "line_number"], "X", "Panics")
    registry.register_detector("others", lambda rows: rows.filter(F.col("call_name") == "other"), ["file_path", "line_number"], "Y", "Others")
    try:
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(shared_occurrences(files)) == rows(occurrences(files))
        assert rows(shared_occurrences(files, places=True)) == rows(occurrences(files, places=True))
    finally:
        for name in ("panics", "others"):
            registry.unregister_detector(name)
    assert distinct_texts(files).count() < files.filter("ext = '.go'").count() * 0.6


def test_a_rerun_of_one_module_leaves_the_others(spark, tmp_path):
    import os

    from seamline import sinks

    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "small/x").when(F.col("id") % 10 == 1, "gone").otherwise("large").alias("module"),
                                    F.lit("v1").alias("version"), F.col("id").alias("n"))
    modules, path = rows.select("module", "version").distinct(), str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_by_module(rows, path, modules, ["n"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = lambda module: sorted(os.listdir(f"{path}/module={module}/version=v1"))
    before = files("large")
    assert len([f for f in before if f.endswith(".parquet")]) > 1  # a large module is spread over tasks
    changed = rows.filter("module <> 'gone'").withColumn("n", -F.col("n"))
    sinks.write_by_module(changed, path, modules.filter("module <> 'large'"), ["n"])
    assert files("large") == before
    back = sinks.read_by_module(spark, path, rows.schema)
    assert back.dtypes == rows.dtypes
    want = {("large", i) for i in range(3000) if i % 10 > 1} | {("small/x", -i) for i in range(0, 3000, 10)}
    assert {(r.module, r.n) for r in back.collect()} == want and back.count() == len(want)
    listed = {r.module: r.n_rows for r in sinks.manifest(spark, path).collect()}
    assert listed == {"large": 2400, "small/x": 300, "gone": 0}
