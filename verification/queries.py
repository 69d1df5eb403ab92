"""One query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline import schema, sinks
from seamline.functions import text
from seamline.operators import registry
from seamline.operators.assembly import asm_functions
from seamline.operators.bounds import work_folder
from seamline.operators.brackets import bracket_counts, bracket_pairs
from seamline.operators.packages import loc, packages
from seamline.operators.segments import failures
from seamline.operators.tokens import tokens
from seamline.plans.analysis import Analysis
from seamline.plans.occurrences import occurrences, unique_counts
from seamline.plans.ordering import in_walk_order
from seamline.plans.shared_texts import shared_occurrences
from seamline.sources import modules as module_side
from seamline.sources import planted
from seamline.sources.tree import read_tree, write_tree

Query = Callable[[SparkSession, str], DataFrame]


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return planted.files(spark, sf)


def _modules(spark: SparkSession, sf: str) -> DataFrame:
    return module_side.with_dependents(planted.modules(spark, sf), planted.catalog(spark, sf))


def source_files(spark, sf):
    return _files(spark, sf).select(
        "module", "version", "dir", "path", "name", "ext", F.md5("content").alias("content_md5"))


def token_counts(spark, sf):
    return tokens(_files(spark, sf)).groupBy("path").agg(
        F.count("*").alias("n_tokens"), F.max("line").alias("last_line"))


def _vector(vector: str) -> Query:
    return lambda spark, sf: occurrences(_files(spark, sf), [vector])


def _analysis(spark, sf) -> Analysis:
    return Analysis(_files(spark, sf), _modules(spark, sf))


def deltas(spark, sf):
    order = planted.modules(spark, sf).select(
        "module", "version", F.substring("version", 2, 10).cast("int").alias("version_ord"))
    # As a double, which has the same form on both sides of the comparison where it is NULL.
    return _analysis(spark, sf).version_delta(order).withColumn("delta", F.col("delta").cast("double"))


KEY = ["method_invoked", "file_path", "line_number"]


def custom_detector(spark, sf):
    def helper_calls(rows: DataFrame) -> DataFrame:
        return rows.filter((F.col("call_name") == "other") & ~F.col("selector")).withColumn(
            "method_invoked", F.col("call_name"))

    registry.register_detector("helper_call", helper_calls, KEY, "X1", "Helper Calls")
    try:
        return occurrences(_files(spark, sf), ["helper_call"])
    finally:
        registry.unregister_detector("helper_call")


def custom_detectors_and_rules(spark, sf):
    """Three detectors that are conditions and a table of rules, all in one pass."""
    rules = spark.createDataFrame([("unsafe", "Sizeof"), ("lib", "NewThing")], "pkg string, func string")
    bare = ~F.col("selector")
    call = {"method_invoked": F.col("call_name")}
    found = {
        "helper_call": (bare & (F.col("call_name") == "other"), call),
        "local_new": (bare & (F.col("call_name") == "NewLocal"), call),
        "methods": (F.col("is_method"), {"method_invoked": F.col("func_name"), "line_number": F.col("decl_line")}),
    }
    for i, (name, (where, fields)) in enumerate(found.items()):
        registry.register_detector(name, where, KEY, f"X{i}", name, fields)
    try:
        return occurrences(_files(spark, sf), ["exec", "assembly", *found], exec_rules=rules)
    finally:
        for name in found:
            registry.unregister_detector(name)


def equal_paths(spark, sf):
    """The corpus twice, as two sets of modules whose files have the same paths."""
    files = _files(spark, sf)
    return occurrences(files.unionByName(files.withColumn("module", F.concat("module", F.lit("-copy")))), ["exec", "global"])


def ill_formed_files(spark, sf):
    """Files that lack a bracket, cross brackets, assign twice, import too late, swap brackets, or put tokens where none
    can stand, by turns of the path's number."""
    number = F.regexp_extract("name", "([0-9]+)", 1).try_cast("bigint") % 17
    bad = F.when(number == 0, "}\n").when(number == 1, "func bad() { x[(]) }\n").when(
        number == 2, "func bad() { x := := 3 }\n").when(number == 3, 'import "late"\n').when(number == 4, "var alone\n").when(
        number == 5, "func bad() { a = (b] ; c = [d) }\n").when(number == 6, "func bad( { }\n)\n").when(
        number == 7, "func bad() { x = }\n").when(number == 8, "func bad() { if a {} else else {} }\n")
    files = _files(spark, sf).filter("ext = '.go'")
    return failures(files.withColumn("content", F.concat("content", F.lit("\n"), F.coalesce(bad, F.lit("")))))


def text_corpus(spark, sf):
    """All vectors in files that follow from the words and lines of the texts, with line directives and chains over lines."""
    return occurrences(planted.text_files(planted.documents(spark, sf)))


def _tree(spark, sf) -> DataFrame:
    """The corpus in directories whose order is not that of their paths: d, d/b and d-b."""
    turn = F.regexp_extract("name", "([0-9]+)", 1).try_cast("bigint") % 3
    moved = F.concat("dir", F.when(turn == 0, "").when(turn == 1, "/b").otherwise("-b"))
    return _files(spark, sf).filter("ext = '.go'").withColumn("dir", F.concat(F.lit("top/"), F.substring_index("dir", "/", -1))).withColumn(
        "dir", moved).withColumn("path", F.concat("dir", F.lit("/"), "name"))


def shared_texts(spark, sf):
    """The corpus in two versions each, with equal texts, of which every text is analysed once."""
    files = _files(spark, sf)
    return shared_occurrences(files.unionByName(files.withColumn("version", F.concat("version", F.lit("-next")))))


def shared_deltas(spark, sf):
    order = planted.modules(spark, sf).select("module", "version", F.substring("version", 2, 10).cast("int").alias("version_ord"))
    return Analysis(_files(spark, sf), _modules(spark, sf), share_texts=True).version_delta(order).withColumn(
        "delta", F.col("delta").cast("double"))


def walk_order(spark, sf):
    return in_walk_order(occurrences(_tree(spark, sf), places=True)).select(
        "module", "version", "vector", "ordinal", "file_path", "line_number", "method_invoked")


def pages(spark, sf):
    """Pages of seven rows; each is told by its size and the text of its lines."""
    found = Analysis(_tree(spark, sf)).detail_pages(7)
    return found.select("module", "version", "vector", "page", "first_ordinal", F.size("entries").cast("bigint").alias("n"), F.md5(
        F.array_join(F.transform("entries", lambda e: e["line"]), "\n")).alias("lines_md5"))


def summaries(spark, sf):
    """Modules of the corpus, and as many in which nothing is found."""
    modules = planted.modules(spark, sf)
    nothing = modules.withColumn("module", F.concat("module", F.lit("/none")))
    return Analysis(_files(spark, sf), modules.unionByName(nothing)).summary()


def custom_exec_rules(spark, sf):
    rules = spark.createDataFrame([("unsafe", "Sizeof"), ("lib", "NewThing")], "pkg string, func string")
    return occurrences(_files(spark, sf), ["exec"], exec_rules=rules)


def _rerun(spark, df: DataFrame, modules: DataFrame, order=None, fmt="parquet") -> DataFrame:
    """Written by module, then the first version of each module again, and read back."""
    path = work_folder(spark, "sink")
    sinks.write_by_module(df, path, modules, order, fmt)
    sinks.write_by_module(df, path, modules.filter("version = 'v1'"), order, fmt)
    return sinks.read_by_module(spark, path, df.schema, fmt)


def overview_sink(spark, sf):
    return _rerun(spark, _analysis(spark, sf).overview(), planted.modules(spark, sf))


def details_sink(spark, sf):
    return _rerun(spark, _analysis(spark, sf).details(), planted.modules(spark, sf), ["ord", "file_path", "line_number"])


def json_sink(spark, sf):
    return _rerun(spark, _analysis(spark, sf).json(), planted.modules(spark, sf), ["json"], "json")


def catalog_sink(spark, sf):
    """Catalogue rows as arrays of up to a thousand in text files, read by splits."""
    path = work_folder(spark, "catalog")
    rows = planted.catalog(spark, sf)
    rows.groupBy(F.floor(F.col("dependents_count") / 1000)).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).select("value").write.text(path)
    return module_side.read_large_catalog(spark, path)


def tree_files(spark, sf):
    """The corpus as files in directories, read back by the loader."""
    root = work_folder(spark, "tree").removeprefix("file:")
    files = _files(spark, sf).withColumn("dir", F.concat(F.lit(root + "/"), "dir"))
    write_tree(files)
    roots = files.select("module", "version", F.concat(F.lit(root + "/"), "module", F.lit("@"), "version").alias("root")).distinct()
    at = len(root) + 2
    return read_tree(roots).select(
        "module", "version", F.expr(f"substring(dir, {at})").alias("dir"), F.expr(f"substring(path, {at})").alias("path"), "name", "ext",
        F.md5("content").alias("content_md5"))


def line_column(spark, sf):
    docs = planted.documents(spark, sf)
    half = F.expr("substring(text, 1, cast(length(text) div 2 as int))")
    content, index = F.col("text").cast("binary"), F.octet_length(half)
    return docs.select("doc_id", text.line_of(content, index).alias("line"),
                       text.column_of(content, index).alias("col"))


def module_list(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    versioned = F.concat("url", F.lit(" v"), (F.col("page_id") % 5).cast("string"))
    return module_side.module_list(pages.select("page_id", F.explode(F.array(
        versioned, F.col("url"), F.concat("url", F.lit(" v1 extra")))).alias("line")))


def module_catalog(spark, sf):
    as_json = planted.catalog(spark, sf).select(
        F.to_json(F.array(F.struct("*"))).alias("json"))
    return module_side.parse_catalog(as_json).withColumn(
        "module_path", text.module_path("/go", F.col("package_manager_url"), F.col("latest_release_number")))


def top_modules(spark, sf):
    return module_side.top_modules(module_side.with_import_path(planted.catalog(spark, sf))).select(
        "name", "import_path", "dependents_count")


def pending_modules(spark, sf):
    listed = module_list(spark, sf)
    done = listed.filter(F.startswith("repo_url", F.lit("http://")))
    return module_side.pending_modules(listed, done).select("page_id", "repo_url", "version", "name")


def queries() -> dict[str, Query]:
    return {
        "overview": lambda spark, sf: _analysis(spark, sf).overview(),
        "source_files": source_files,
        "packages": lambda spark, sf: packages(_files(spark, sf)),
        "asm_functions": lambda spark, sf: asm_functions(_files(spark, sf)),
        "loc_per_module": lambda spark, sf: loc(_files(spark, sf)),
        "tokens": token_counts,
        **{f"vec_{v}": _vector(v) for v in schema.VECTOR_NAMES},
        "occurrences": lambda spark, sf: occurrences(_files(spark, sf)),
        "unique_counts": lambda spark, sf: unique_counts(occurrences(_files(spark, sf))),
        "density": lambda spark, sf: _analysis(spark, sf).density(),
        "summary": summaries,
        "detail_lines": lambda spark, sf: _analysis(spark, sf).detail_lines(),
        "module_details": lambda spark, sf: _analysis(spark, sf).details(),
        "occurrence_json": lambda spark, sf: _analysis(spark, sf).json(),
        "version_delta": deltas,
        "custom_detector": custom_detector,
        "custom_detectors_and_rules": custom_detectors_and_rules,
        "equal_paths": equal_paths,
        "failures": ill_formed_files,
        "overview_sink": overview_sink,
        "details_sink": details_sink,
        "json_sink": json_sink,
        "catalog_sink": catalog_sink,
        "source_tree": tree_files,
        "walk_order": walk_order,
        "shared_texts": shared_texts,
        "version_delta_shared": shared_deltas,
        "detail_pages": pages,
        "text_corpus": text_corpus,
        "large_files": lambda spark, sf: occurrences(_files(spark, sf), large_bytes=600, chunk_chars=200),
        "bracket_pairs": lambda spark, sf: bracket_counts(bracket_pairs(_files(spark, sf))),
        "exec_rules_custom": custom_exec_rules,
        "line_column": line_column,
        "module_list": module_list,
        "module_catalog": module_catalog,
        "top_modules": top_modules,
        "dependents_lookup": lambda spark, sf: _modules(spark, sf),
        "pending_modules": pending_modules,
    }
