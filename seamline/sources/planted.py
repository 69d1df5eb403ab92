"""A Go corpus derived row by row from the ``documents`` table.

Every document becomes one Go file whose constructs depend on ``doc_id`` alone, so the expected
occurrences can be stated as plain arithmetic, and the corpus grows with the table. The document
text is kept whole, as a trailing block comment. One assembly file is added per English or German
directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_PREFIX = "https://github.com/planted/"


def _pick(condition: Column, planted: str | Column, otherwise: str | Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(condition, as_col(planted)).otherwise(as_col(otherwise))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", "lang", "source")


def go_files(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    sid = i.cast("string")
    lines = [
        F.concat(F.lit("package p_"), F.col("lang")),
        F.lit("import ("),
        F.lit('"os/exec"'),
        _pick(i % 5 == 0, '"reflect"', '// "reflect"'),
        F.lit(")"),
        F.concat(
            F.lit("var g"), sid,
            F.when(i % 3 == 0, " = build()").when(i % 3 == 1, " = pkg.Build().Done()")
            .otherwise(" = build() + 1")),
        F.concat(F.lit("var h"), sid, F.lit(" = func() int { return 1 }"), _pick(i % 11 == 0, "()", "")),
        _pick(i % 2 == 0, "func init() {}", "func initX() {}"),
        _pick(i % 13 == 0, F.concat(F.lit("//go:generate go run gen"), sid, F.lit(".go")),
              "// go:generate none"),
        F.lit("type T struct{}"),
        F.lit("func (t T) Run() {}"),
        F.lit("func helper(t T) {"),
        _pick(i % 4 == 0, '\texec.Command("a", "exec.Command(")',
              '\t_ = "exec.Command(x)" // exec.Command('),
        _pick(i % 6 == 0, "\tt.Run()", "\t// t.Run()"),
        _pick(i % 10 == 0, '\tplugin.Open("p.so")', '\tx.plugin.Open("p.so")'),
        _pick(i % 8 == 0, "\t_ = unsafe.Pointer(uintptr(unsafe.Pointer(&t)))", "\t_ = unsafe.Sizeof(t)"),
        _pick(i % 9 == 0, "\tC.call(1)", "\t(*C.char)(nil)"),
        F.when(i % 7 == 0, "\tlib.NewThing().NewOther()").when(i % 7 == 1, "\tNew()")
        .otherwise("\tNewLocal()"),
        _pick(i % 12 == 0, "\tasmFn(1)", "\tother(1)"),
        F.lit("}"),
        F.concat(F.lit("func TestX"), sid, F.lit("() {}")),
        F.concat(F.lit("/*"), F.replace("text", F.lit("*/"), F.lit(" ")), F.lit("*/")),
    ]
    suffix = _pick(i % 5 == 1, "_test.go", ".go")
    return _files(docs, F.concat(F.lit("f"), sid, suffix), ".go", F.concat_ws("\n", *lines))


def text_files(docs: DataFrame) -> DataFrame:
    """Go files whose names, lines and constructs follow from the words and lines of each document's text.

    The text is a raw string, so every line behind it moves with it; its first word names things, and its numbers of lines
    and characters are named by line directives. Chains and literals go over several lines.
    """
    raw = F.replace(F.coalesce("text", F.lit("")), F.lit("`"), F.lit(""))
    word = F.concat(F.lower(F.regexp_extract(raw, "[A-Za-z]+", 0)), F.lit("s"))
    breaks = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))
    lines = [
        F.concat(F.lit("package w_"), "lang"),
        F.concat(F.lit("var doc = `"), raw, F.lit("`")),
        F.lit("var found = load.From("),
        F.concat(F.lit('\t"'), word, F.lit('",')),
        F.lit(")"),
        F.lit("func use(c T) {"),
        F.lit("\tlib."),
        F.lit('\t\tOpen("a").'),
        F.concat(F.lit("\t\tNew"), F.initcap(word), F.lit("(c)")),
        F.concat(F.lit("\tfor i := range "), word, F.lit(" {")),
        F.lit("\t\texec.Command(`a"),
        F.lit("b`)"),
        F.lit("\t}"),
        F.concat(F.lit("/*line gen.go:"), breaks + 1000, F.lit('*/\texec.Command("b")')),
        F.concat(F.lit("//line other.go:"), F.length(raw) + 1),
        F.lit("\tunsafe.Pointer(c)"),
        F.lit("}"),
        F.lit("func init() {}"),
        F.lit(""),
    ]
    return _files(docs, F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit(".go")), ".go", F.concat_ws("\n", *lines))


def asm_files(docs: DataFrame) -> DataFrame:
    dirs = (docs.filter(F.col("lang").isin("en", "de"))
            .select("source", "lang", (F.col("doc_id") % 3).alias("doc_id")).distinct())
    return _files(dirs, F.lit("asm.s"), ".s",
                  F.lit("// planted\nTEXT ·asmFn(SB), $0\n\tRET\nTEXT ·second(SB), $0\n\tRET\n"))


def _files(df: DataFrame, name: Column, ext: str, content: Column) -> DataFrame:
    return (
        df.withColumn("version", F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")))
        .withColumn("dir", F.concat("source", F.lit("@"), "version", F.lit("/"), "lang"))
        .withColumn("name", name)
        .select(
            F.col("source").alias("module"), "version", "dir",
            F.concat("dir", F.lit("/"), "name").alias("path"),
            "name", F.lit(ext).alias("ext"),
            # Exploding one element keeps filters on the text from repeating the expression.
            F.explode(F.array(content)).alias("content")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return go_files(docs).unionByName(asm_files(docs))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module-versions of the corpus with the address their dependents are looked up by."""
    return (
        documents(spark, sf_dir)
        .select(F.col("source").alias("module"),
                F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version"))
        .distinct()
        .withColumn("repo_url", F.concat(F.lit(REPO_PREFIX), "module")))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows made from ``part``: the part number is the dependents count.

    Part 0 becomes ``src0`` and so on, so modules beyond the part table would find no dependents.
    """
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey").cast("string")
    return p.select(
        F.col("p_size").cast("int").alias("contributions_count"),
        (F.col("p_partkey") % 97).cast("int").alias("dependent_repos_count"),
        F.col("p_partkey").cast("int").alias("dependents_count"),
        F.col("p_type").alias("description"),
        F.lit("Go").alias("language"),
        F.concat(F.lit("v1."), key, F.lit(".0")).alias("latest_release_number"),
        F.concat(F.lit("v1."), key, F.lit(".0")).alias("latest_stable_release_number"),
        F.concat(F.col("p_name"), F.lit(" "), key).alias("name"),
        F.concat(F.lit("https://pkg.go.dev/github.com/planted/src"), key).alias("package_manager_url"),
        F.lit("Go").alias("platform"),
        F.concat(F.lit(REPO_PREFIX), F.lit("src"), key).alias("repository_url"))
