"""Every stage of an analysis is small enough for the JIT compiler; one that is not runs many times slower, without a failure."""

import pytest
from pyspark.sql import functions as F

from seamline.functions import golang
from seamline.operators.detectors import _candidates, _resolve_by_key, detect
from seamline.operators.segments import _may_end_statement, segments
from seamline.plans.occurrences import occurrences

LARGEST_METHOD = 8000  # HotSpot's limit, in bytes
TEXT = 'package p\nfunc init() {\n\tt.New()\n\tasm(1)\n\texec.Command("x")\n}\n'


def method_sizes(df):
    jvm = df.sparkSession._jvm
    name = "org.apache.spark.sql.catalyst.expressions.codegen.CodeGenerator$"
    compiler = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(name).getField("MODULE$").get(None)
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "WholeStageCodegenExec":
            out.append(compiler.compile(plan.doCodeGen()._2())._2().maxMethodCodeSize())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


@pytest.mark.parametrize("vectors", [None, ["exec", "global"]])
def test_generated_methods_are_compiled(spark, files_of, vectors):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = method_sizes(occurrences(files_of({"m/a/a.go": TEXT}), vectors))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 5 and max(sizes) < LARGEST_METHOD


def test_rows_without_key_share_groups(files_of):
    """Sixty calls of a file that need no others for their decision are a group or two, not sixty."""
    calls = "\n".join(f"\tt.New{i}()" for i in range(60))
    found = detect(files_of({"m/a/a.go": f"package p\nfunc f() {{\n{calls}\n}}\n"}), ["constructor"])
    events = found.withColumns({c: F.lit(None).cast("string") for c in ("key", "piece")}).withColumn("stop", F.lit(None).cast("int"))
    resolved = _resolve_by_key(events)
    assert sorted(r.line_number for r in resolved.collect()) == list(range(3, 63))
    assert "shiftright" in resolved._jdf.queryExecution().optimizedPlan().toString()


def test_every_text_is_cut_once(files_of):
    """No filter on the number of pieces is inferred and taken to the scan, where it would cut every text a second time."""
    plan = occurrences(files_of({"m/a/a.go": TEXT}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_calls_of_names_no_method_has_are_left_out_before_grouping(spark, files_of):
    """Of calls in a file with methods only those of their names, or of names with the same bit, are candidates for ``interface``."""
    calls = "\n".join(f"\tx.Other{i}()" for i in range(200))
    files = files_of({"m/a/a.go": f"package p\nfunc (t T) Run() {{}}\nfunc f() {{\n\tt.Run()\n\tt.Run().Run()\n{calls}\n}}\n"})
    candidates = _candidates(segments(files), ["interface"], {}, False).filter("vector = 'interface'")
    names = [r.call_name for r in candidates.collect()]
    assert names.count("Run") == 3 and len(names) < 30
    assert [(r.method_invoked, r.line_number) for r in detect(files, ["interface"]).orderBy("pos").collect()] == [("Run", 4), ("Run", 5), ("Run", 5)]


def test_tokens_that_cannot_be_neighbours_are_found_by_their_first_character(spark):
    """No text that a rule takes for ill-formed is passed by the looks at first characters."""
    rules = [*golang._AFTER_SIGNS, rf"(?<![\p{{L}}\p{{Nd}}_])(?:{'|'.join(golang._AFTER_WORDS)})"]
    tokens = [*"()[]{}=*/%&|^<>!~+-.,;:\"'`7xé_\n", " ", "\t", "5 x", "<-", ":=", "&^", *golang.KEYWORDS]
    texts = [a + blank + b + blank + c for a in tokens for b in tokens for c in ("", "x", ")", "}", "if") for blank in ("", " ")]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.col("text").rlike("|".join(rules)).alias("by_rules"), F.col("text").rlike(golang.MALFORMED).alias("found")).collect()
    assert any(r.found for r in found) and all(r.by_rules == r.found for r in found)


def test_windows_over_a_file_pass_the_row_as_one_column(files_of):
    """What a window only passes on is one struct, which the optimiser leaves whole."""
    todo, widths = [occurrences(files_of({"m/a/a.go": TEXT}))._jdf.queryExecution().optimizedPlan()], []
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "Window" and "_passed" in plan.output().toString():
            widths.append(plan.child().output().size())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    assert len(widths) == 2 and max(widths) < 20


def test_a_specification_is_decided_once(files_of):
    """Its value is not told anew for each rule by a filter behind the rows."""
    plan = occurrences(files_of({"m/a/a.go": TEXT}), ["global"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\b(?:interface|struct)\s*+\{\}") == 1


def test_looks_that_save_a_rule_pass_nothing_it_would_find(spark):
    """No statement ends without what is looked for first, and no two brackets of which the second closes are ill-formed."""
    tokens = ["", *"()[]{}=.,;:\"'`7x_\n", " ", "\t", "5.", "\r\n", "var", "return"]
    texts = [a + b + c for a in tokens for b in tokens for c in tokens]
    ends = spark.createDataFrame([(t,) for t in texts], "text string").filter(F.col("text").rlike(golang.STATEMENT_END))
    assert ends.count() > 100 and ends.filter(~_may_end_statement(F.col("text"))).count() == 0
    pairs = spark.createDataFrame([(a + b,) for a in "()[]{}" for b in ")]}"], "text string")
    assert pairs.filter(F.col("text").rlike(golang.MALFORMED)).count() == 0
