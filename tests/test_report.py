"""Counts, reports, sinks, registered detectors, and the shape of the plans."""

import json
import re

import pytest
from pyspark.sql import functions as F

from seamline import schema, sinks
from seamline.operators import registry
from seamline.operators.packages import loc
from seamline.operators.segments import lexed, segments
from seamline.operators.tokens import TOKEN, tokens
from seamline.plans import report
from seamline.plans.occurrences import occurrences, unique_counts
from seamline.plans.versions import version_delta


def occurrence(spark, rows):
    names = ["vector", "file_path", "line_number", "variable_name", "command", "method_invoked", "type_passed", "pattern"]
    full = [("m", "v1", "p", *r, *[""] * (len(names) - len(r))) for r in rows]
    return spark.createDataFrame(full, "module string, version string, package_name string, vector string, "
                                 "file_path string, line_number int, variable_name string, command string, "
                                 "method_invoked string, type_passed string, pattern string")


def test_distinct_keys(spark):
    rows = []
    for vector, key in schema.DISTINCT_KEYS.items():
        base = {"file_path": "f", "line_number": 1, "variable_name": "a", "command": "b", "method_invoked": "c",
                "type_passed": "d", "pattern": "e"}
        for changed in [None, *base]:
            row = dict(base)
            if changed:
                row[changed] = 2 if changed == "line_number" else "other"
            rows.append((vector, *row.values()))
    rows.append(("unknown", "f", 1))
    counts = {r.vector: r.n for r in unique_counts(occurrence(spark, rows)).collect()}
    assert counts == {v: 1 + len(k) for v, k in schema.DISTINCT_KEYS.items()}


def test_reports(spark):
    found = occurrence(spark, [("init", "f", 1), ("init", "f", 1), ("exec", "f", 2, "", "", "exec.Command")])
    counts = unique_counts(found)
    modules = spark.createDataFrame([("m", "v1", 3), ("empty", "v1", 4), ("noloc", "v1", 5), ("zero", "v1", 6)],
                                    "module string, version string, dependants long")
    lines = spark.createDataFrame([("m", "v1", 8), ("empty", "v1", 2), ("zero", "v1", 0)],
                                  "module string, version string, loc long")
    wide = {r.module: r for r in report.overview(modules, lines, counts).collect()}
    assert set(wide) == {"m", "empty", "zero"}
    assert wide["m"].n_init == 1 and wide["m"].n_exec == 1 and wide["m"].n_cgo == 0 and wide["empty"].n_init == 0
    dense = {r.module: r for r in report.density(report.overview(modules, lines, counts)).collect()}
    assert dense["m"].d_init == 0.125 and dense["empty"].d_init == 0.0 and dense["zero"].d_init is None
    shown = report.summary(counts, modules).filter("module = 'm'").orderBy("ord").collect()
    assert report.summary(counts, modules).count() == 4 * len(schema.VECTOR_NAMES)
    assert [r.vector for r in shown] == schema.VECTOR_NAMES
    assert (shown[3].label, shown[3].shown) == ("[I2] init() Functions:", "         1")
    details = report.module_details(modules, lines, counts, found).filter("module = 'm'").orderBy("ord").collect()
    assert [(r.heading, r.n, r.line) for r in details if r.n] == [
        ("[I2] Initialization Hooks", 1, "f:1"), ("[I2] Initialization Hooks", 1, "f:1"),
        ("[E8] External Execution", 1, "f:2 - Method Invoked: exec.Command")]
    assert sum(r.line == "No occurrences found." for r in details) == 10


def test_lines_and_json(spark, tmp_path):
    found = occurrence(spark, [("global", "f", 1, "v", "c", "m", "t", "p"), ("init", "g", 0)])
    lines = {r.vector: r for r in report.detail_lines(found).collect()}
    assert lines["global"].line == ("f:1 - Variable Name: v - Command: c - Method Invoked: m - Type Passed: t"
                                    " - Pattern: p")
    assert lines["global"].link == "f#L1" and lines["init"].line == "g:0"
    sinks.write_occurrence_json(found, str(tmp_path / "j"))
    rows = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()), key=len)
    assert rows[0] == {"PackageName": "p", "Type": "init", "FilePath": "g"}
    assert list(rows[1]) == ["PackageName", "Type", "FilePath", "LineNumber", "MethodInvoked", "TypePassed",
                             "VariableName", "Command", "Pattern"]


def test_sinks(spark, tmp_path, capsys):
    found = occurrence(spark, [("init", "f", 2), ("init", "f", 1)])
    details = report.detail_lines(found)
    sinks.write_details(details, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    sinks.write_table(unique_counts(found), str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().n == "2"
    sinks.show_summary(report.summary(unique_counts(found), found), "m", "v1")
    assert "[I2] init() Functions:" in capsys.readouterr().out


def test_version_delta(spark):
    zero = {f"n_{v}": 0 for v in schema.VECTOR_NAMES}
    rows = [{"module": "m", "version": v, "dependants": 1, "loc": 1, **zero, "n_init": n}
            for v, n in (("r-9", 5), ("r-10", 7), ("other", 1))]
    kind = "module string, version string, dependants long, loc long, " + ", ".join(f"{c} long" for c in zero)
    wide = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    order = spark.createDataFrame([("m", "r-9", 1), ("m", "r-10", 2)], "module string, version string, version_ord int")
    got = version_delta(wide, order).filter("vector = 'init'").orderBy("version_ord").collect()
    assert [(r.version, r.n, r.delta) for r in got] == [("r-9", 5, None), ("r-10", 7, 2)]


def test_loc(files_of):
    text = ("package p\n\n// c\n/* a\nb */ var x = 1 /* c\n\n*/\nvar s = `a\n// b\n\n`\nvar t = \"/*\" // d\n\t\n"
            "var u = '\"' /* e */\n/*f*/ /*g*/\n")
    rows = loc(files_of({"m/a.go": text, "m/b/c.go": "not go at all {\n", "m/x.s": "TEXT\n"})).collect()
    assert [(r.module, r.loc) for r in rows] == [("m", 8)]


TRICKY = ("package p /* c */\n// d\nvar x = 'a' + `b\nc` + \"d\\\"\" + 0x1p-2 + 1e+5 + .5i\nfunc f() { a <<= b &^ c... }\n"
          "x\t:=<-ch//e")


def test_tokens(spark, files_of):
    files = files_of({"m/a.go": TRICKY})
    pieces = files.select(F.array_join(F.regexp_extract_all("content", F.lit(TOKEN), 0), "")).first()[0]
    assert pieces == TRICKY
    rows = [(r.tok, r.line) for r in tokens(files).orderBy("pos").collect()]
    assert rows == [(t, 1) for t in ("package", "p")] + [(t, 3) for t in ("var", "x", "=", "'a'", "+", "`b\nc`")] + [
        (t, 4) for t in ("+", '"d\\""', "+", "0x1p-2", "+", "1e+5", "+", ".5i")] + [
        (t, 5) for t in ("func", "f", "(", ")", "{", "a", "<<=", "b", "&^", "c", "...", "}")] + [
        (t, 6) for t in ("x", ":=", "<-", "ch")]


def test_segments_keep_every_newline(spark, files_of):
    files = files_of({"m/a.go": TRICKY})
    assert lexed(files).agg(F.sum("nl")).first()[0] == TRICKY.count("\n") + 1


def test_registered_detector(spark, files_of):
    files = files_of({"m/a.go": "package p\nfunc f() {\n\tpanic(1)\n\tx.panic(2)\n\tpanic(3); panic(4)\n}\n"})
    registry.register_detector(
        "panic", lambda rows: rows.filter((F.col("call_name") == "panic") & ~F.col("selector")),
        ["file_path", "line_number"], "X1", "Panics")
    try:
        found = occurrences(files)
        assert sorted((r.vector, r.line_number) for r in found.collect()) == [("panic", 3), ("panic", 5), ("panic", 5)]
        counts = unique_counts(found)
        assert {r.vector: r.n for r in counts.collect()} == {"panic": 2}
        assert report.summary(counts, counts).filter("vector = 'panic'").first().label == "[X1] Panics:"
        modules = spark.createDataFrame([("m", "v1", 1)], "module string, version string, dependants long")
        assert report.overview(modules, loc(files), counts).first().n_panic == 2
        with pytest.raises(ValueError):
            registry.register_detector("init", lambda rows: rows, [], "", "")
    finally:
        registry.unregister_detector("panic")


def test_exec_rules(spark, files_of):
    files = files_of({"m/a.go": "package p\nfunc f() {\n\tos.Remove(1)\n\texec.Command(2)\n\ta.os.Remove()\n}\n"})
    rules = spark.createDataFrame([("os", "Remove"), ("os", "Remove")], "pkg string, func string")
    for threshold in (-1, 10_000_000):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = occurrences(files, ["exec"], exec_rules=rules).collect()
        assert [(r.line_number, r.method_invoked) for r in got] == [(3, "os.Remove")]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_one_exchange_by_path(spark, files_of):
    files = files_of({"m/a.go": "package p\n"})
    text = plan(segments(files))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"\bSort \[", text)) == 1
    whole = plan(occurrences(files, ["constructor", "interface", "global", "init", "exec"]))
    assert len(re.findall(r"Exchange hashpartitioning\(module#\w+, version#\w+, path", whole)) == 1
    for i, word in enumerate(("a", "b", "c")):
        registry.register_detector(word, F.col("call_name") == word, ["file_path"], f"X{i}", word)
    try:
        rules = spark.createDataFrame([("os", "Remove")], "pkg string, func string")
        every = plan(occurrences(files, exec_rules=rules))
        assert len(re.findall(r"Exchange hashpartitioning\(module#\w+, version#\w+, path", every)) == 1
    finally:
        for word in ("a", "b", "c"):
            registry.unregister_detector(word)
    assert "CartesianProduct" not in whole and "BroadcastNestedLoopJoin" not in whole


def test_bucketed_files_need_no_exchange(spark, files_of, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.sql(f"create database if not exists b location '{tmp_path}/b'")
    try:
        sinks.write_bucketed_files(files_of({"m/a.go": "package p\nfunc init() {}\n"}), "b.files", 4)
        rows = segments(spark.table("b.files"), partitions=0)
        assert "Exchange" not in plan(rows)
        assert rows.filter("func_name = 'init'").count() == 1
    finally:
        spark.sql("drop database b cascade")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitions_follow_the_text(spark, files_of, monkeypatch):
    from seamline.operators import bounds
    from seamline.plans.analysis import Analysis
    assert bounds.partitions_for(0, 8) == 8 and bounds.partitions_for(100 << 40, 8) == (100 << 40) // (24 << 20) + 1
    monkeypatch.setattr(bounds, "PARTITION_BYTES", 10)
    files = files_of({"m/a.go": "package p\nfunc init() {}\n", "m/b.go": "package p\n" + "// x\n" * 20})
    a = Analysis(files)
    assert a._text_partitions() == 14
    assert a.counts.first().n == 1 and a.summary().count() == 12
    assert Analysis(files, partitions=3)._text_partitions() == 3
