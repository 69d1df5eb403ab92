"""Files read in pieces give what whole files give, and detectors share one table of segments."""

import pytest
from pyspark.sql import functions as F

from seamline.functions import golang as go
from seamline.operators import registry, segments
from seamline.operators.chunks import chunks
from seamline.operators.segments import lexed, lexed_in_chunks, structured
from seamline.plans.occurrences import occurrences
from tests.test_detectors import CASES, ILL_FORMED, WELL_FORMED
from tests.test_generated_code import LARGEST_METHOD, method_sizes

DECLARATIONS = [
    'func a() {\n\texec.Command("x")\n\tt.Run()\n}', "var s = `\n}\nfunc init() {}\n}\n`", "/*\n}\nvar hidden = f()\n}\n*/", "func init() {\n\tNew()\n}",
    "type T struct {\n}\nfunc (t T) Run() {\n}", "var (\n\tx = f()\n\ty = g.H()\n)", "//line gen.go:500\nfunc b() {\n\tunsafe.Pointer(p)\n}",
    "type I interface {\n\tNew()\n}", "var c = []int{\n1,\n}\nvar d = f(\n1)", 'func e() {\n\tf(`}\n}`, "/*", \'"\').\n\t\tNewX()\n}', "// `\n}",
    "func g() {\n\tif x {\n}\n\tC.call(`a\n}`)\n}",
]


def texts():
    out = {f"c/{n}/{n}.go": t for n, (t, _) in CASES.items()}
    out |= {f"g{i}/a/a.go": f"package p\n{t}\n" for i, t in enumerate([*WELL_FORMED, *ILL_FORMED])}
    for k in range(len(DECLARATIONS)):
        turned = [d for d in DECLARATIONS[k:] + DECLARATIONS[:k] if d != "// `\n}" or k == 3]
        out[f"t{k}/a/a.go"] = "package p\n" + "\n".join(turned * 3) + "\n"
    return out


@pytest.mark.parametrize("chunk_chars", [1, 40, 300])
def test_pieces_give_what_whole_files_give(files_of, chunk_chars):
    files = files_of(texts())
    whole, pieces = structured(lexed(files, 4)), structured(lexed_in_chunks(files, chunk_chars, 4))
    columns = [c for c in whole.columns if c not in ("pos", "stmt_pos")]
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert rows(pieces) == rows(whole)
    found = lambda **more: sorted(map(tuple, occurrences(files, **more).collect()))
    assert found(large_bytes=0, chunk_chars=chunk_chars) == found(large_bytes=150, chunk_chars=chunk_chars) == found()


def test_a_large_file_is_many_pieces(files_of):
    text = "package p\n" + "\n".join(DECLARATIONS[:4] * 200) + "\n"
    files = files_of({"m/a/a.go": text})
    rows = chunks(files, F.col("content"), 500).orderBy("chunk").collect()
    assert "".join(r.text for r in rows) == text and [r.chunk for r in rows] == list(range(len(rows)))
    assert len(rows) > 20 and max(len(r.text) for r in rows) < 2000
    assert all(r.text.endswith("\n}") for r in rows[:-1])
    framed = structured(lexed_in_chunks(files, 500, 8))
    assert framed.count() == structured(lexed(files, 8)).count() > 2000
    assert len(lexed_in_chunks(files, 500, 8).select(F.spark_partition_id().alias("at")).distinct().collect()) > 4
    inside = "package p\nvar s = `" + "\n}\n" * 500 + "`\nfunc init() {\n}\n"
    assert len(chunks(files_of({"m/a/a.go": inside}), F.col("content"), 50).collect()) <= 2


def test_open_brackets_of_parts(spark):
    def left(text):
        pieces = F.regexp_extract_all(F.lit(text), F.lit(go.SEGMENT), 0)
        return spark.range(1).select(segments.open_brackets(pieces)).first()[0]
    assert [left(t) for t in ("(a[b]{c})\n", "a)b]\n", "(a[b\n", ")a(\n", "(]\n", "x)}{[\n")] == ["", "])", "[(", "()", "!", "[{})"]


def test_function_detectors_share_segments(files_of, monkeypatch):
    calls = []
    original = segments.lexed
    monkeypatch.setattr(segments, "lexed", lambda *a: calls.append(1) or original(*a))
    files = files_of({"m/a/a.go": "package p\nfunc init() {\n\tone(1)\n\ttwo(2)\n\tthree(3)\n\tt.New()\n}\n"})
    names = ["one", "two", "three"]
    for name in names:
        registry.register_detector(name, lambda rows, n=name: rows.filter(F.col("call_name") == n).withColumn("method_invoked", F.col("call_name")),
                                   ["method_invoked", "file_path", "line_number"], "X", name)
    try:
        df = occurrences(files)
        rows = sorted((r.vector, r.line_number) for r in df.collect())
    finally:
        for name in names:
            registry.unregister_detector(name)
    assert rows == [("constructor", 6), ("init", 2), ("one", 3), ("three", 5), ("two", 4)]
    assert len(calls) == 1


def test_open_brackets_of_deep_texts(spark, monkeypatch):
    """Pairs taken out at once leave what the fold over all brackets leaves, and too deep a nest stays one."""
    def left(pieces):
        return spark.range(1).select(segments.open_brackets(F.array(*[F.lit(p) for p in pieces]))).first()[0]
    texts = ["(" * 9 + ")" * 9, "([{" * 4 + "}])" * 4, "([{" * 4 + "}])" * 3, "(" * 8 + "]" + ")" * 7, ")" * 3 + "(" * 3, "[()" * 7]
    looked_at = [left([f"x{b}" for b in t]) for t in texts]
    monkeypatch.setattr(segments, "PAIR_ROUNDS", 0)
    assert looked_at == [left([f"x{b}" for b in t]) for t in texts] == ["", "", "{[(", "!", "((()))", "[" * 7]
    monkeypatch.setattr(segments, "PAIR_ROUNDS", 5)
    monkeypatch.setattr(segments, "MAX_NESTING", 3)
    assert left(["("] * 4 + [")"] * 4) == "!" and left(["(", "(", ")", ")"]) == ""
    assert left(["(", "//line a:1)", "x", ")"]) == ""


def test_pieces_are_stored_three_times(files_of, monkeypatch):
    """As cut, and in each of the two scans; the segments of a piece are not stored once more before they are told apart, and no
    stage that fills a stored table is too large for the JIT compiler."""
    from seamline.operators import chunks as module
    stored, original = [], module.settle
    counted = lambda df: stored.append(max(method_sizes(df))) or original(df)
    monkeypatch.setattr(module, "settle", counted)
    if hasattr(segments, "settle"):
        monkeypatch.setattr(segments, "settle", counted)
    files = files_of({"m/a/a.go": "package p\n" + "\n".join(DECLARATIONS[:4]) + "\n"})
    files.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert structured(lexed_in_chunks(files, 40, 2)).count() == structured(lexed(files, 2)).count() > 0
    finally:
        files.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(stored) == 3 and max(stored) < LARGEST_METHOD


def test_texts_are_shuffled_once(spark, files_of, monkeypatch):
    """When the pieces are dealt out. What is stored of them knows how it lies, so that no segments are shuffled for what is carried to them,
    and but for one table only a row for each piece is stored."""
    from seamline.operators import chunks as module
    stored, original = [], module.settle
    monkeypatch.setattr(module, "settle", lambda df: stored.append(original(df)) or stored[-1])
    files = files_of({f"m/a{k}/a.go": "package p\n" + "\n".join(DECLARATIONS[:4]) + "\n" for k in range(3)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = lexed_in_chunks(files, 40, 4)
        n = rows.count()
        found = structured(rows)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = [df.count() for df in stored]
    pieces = rows.select("path", "chunk").distinct().count()
    assert 3 < pieces < n and sizes == [n, pieces, pieces]
    assert "SortMergeJoin" in plan
    shuffled, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                shuffled.append(node.output().toString())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    assert shuffled and all("_passed" not in columns for columns in shuffled)


def test_rows_that_share_a_path_are_one_text(spark, files_of):
    """In pieces as they were put together before they were dealt out by piece: two package clauses make a file ill-formed."""
    files = files_of({"m/a/a.go": "package p\nimport (\n\"os/exec\"\n)\nfunc init() {\n\texec.Command(`a`)\n}\nvar x = f()\n"})
    assert structured(lexed_in_chunks(files, 10, 2)).count() > 0
    assert structured(lexed_in_chunks(files.unionByName(files), 10, 2)).count() == 0


def test_last_rows_sum_up_pieces(files_of):
    """Each piece is summed up by its last row: no rows are sorted once more to be grouped by piece."""
    files = files_of({"m/a/a.go": "package p\n" + "\n".join(DECLARATIONS[:4]) + "\n"})
    plan = structured(lexed_in_chunks(files, 40, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "Aggregate" not in plan
