"""Scalar helpers of the module side and the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline import schema


def import_path(package_manager_url: Column) -> Column:
    """Import path of a module: its documentation address without the site's prefix."""
    return F.regexp_replace(package_manager_url, r"^https://pkg\.go\.dev/", "")


def module_path(root: str | Column, package_manager_url: Column, release: Column) -> Column:
    """Directory of a downloaded module-version under a module cache root."""
    base = F.lit(root) if isinstance(root, str) else root
    return F.concat(base, F.lit("/pkg/mod/"), import_path(package_manager_url), F.lit("@"), release)


def repo_name(url: Column) -> Column:
    """Last element of the address's path; NULL for an address that cannot be parsed.

    Trailing slashes, the query and the fragment do not count; an empty path gives ``.``, a path of
    slashes only gives ``/``. Escapes are decoded first.
    """
    before_fragment = F.regexp_extract(url, r"^([^#]*)", 1)
    scheme = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)"
    after_scheme = F.regexp_extract(before_fragment, scheme + r"?([^?]*)", 1)
    opaque = before_fragment.rlike(scheme) & ~F.startswith(after_scheme, F.lit("/"))
    raw = F.when(opaque, "").otherwise(F.regexp_replace(after_scheme, r"^//[^/]*", ""))
    path = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    bad = (
        url.rlike(r"[\x00-\x1f\x7f]")
        | F.concat(after_scheme, F.coalesce(F.regexp_extract(url, r"#(.*)$", 1), F.lit("")))
        .rlike(r"%(?![0-9A-Fa-f]{2})")
        | url.rlike(r"^:")
        | (~before_fragment.rlike(scheme) & before_fragment.rlike(r"^[^/?]*:"))
        | after_scheme.rlike(r"^//(?:[^/@]*@)?(?:\[[^\]/]*\]|[^/:]*):[0-9]*[^0-9/]")
        | after_scheme.rlike(r"^//[^/]*[ <>\"]"))
    trimmed = F.regexp_replace(path, r"/+$", "")
    return (
        F.when(bad | path.isNull(), None)
        .when(path == "", ".")
        .when(trimmed == "", "/")
        .otherwise(F.regexp_extract(trimmed, r"([^/]*)$", 1)))


def dependents_key(url: Column) -> Column:
    """Key under which a catalogue lists a repository's dependents."""
    bare = F.regexp_replace(url, r"^https://", "")
    key = F.replace(bare, F.lit("/"), F.lit("%2F"))
    renamed = F.replace(key, F.lit("github.com%2Fkubernetes"), F.lit("k8s.io"))
    return F.when(F.contains(key, F.lit("kubernetes")), renamed).otherwise(key)


def module_label(path: Column) -> Column:
    """Name of the directory above the module; the path itself if it has no slash."""
    parts = F.split(path, "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), path)


def line_of(content: Column, index: Column) -> Column:
    """1-based line of a 0-based byte offset; an offset past the end stops at the end."""
    head = _head(content, index)
    text = head.cast("string")
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(content: Column, index: Column) -> Column:
    """1-based column in bytes of a 0-based byte offset; it restarts after each newline."""
    head = _head(content, index)
    last_line = F.substring_index(head.cast("string"), "\n", -1)
    return (F.octet_length(last_line) + 1).cast("int")


def _head(content: Column, index: Column) -> Column:
    return F.substring(content.cast("binary"), F.lit(1), F.greatest(index.cast("int"), F.lit(0)))


def occurrence_json() -> Column:
    """An occurrence as JSON in fixed key order, blank text and zero left out."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    # The keys and their order.
    return F.to_json(F.struct(
        blank("package_name").alias("PackageName"),
        blank("vector").alias("Type"),
        blank("file_path").alias("FilePath"),
        F.nullif(F.col("line_number"), F.lit(0)).alias("LineNumber"),
        blank("method_invoked").alias("MethodInvoked"),
        blank("type_passed").alias("TypePassed"),
        blank("variable_name").alias("VariableName"),
        blank("command").alias("Command"),
        blank("pattern").alias("Pattern")))


def detail_text() -> Column:
    """An occurrence as a report line: place, then each field that is not blank."""
    place = F.concat("file_path", F.lit(":"), F.col("line_number").cast("string"))
    # The field labels and their order.
    labels = [("variable_name", "Variable Name"), ("command", "Command"),
              ("method_invoked", "Method Invoked"), ("type_passed", "Type Passed"),
              ("pattern", "Pattern")]
    fields = [F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), c)) for c, label in labels]
    return F.concat_ws(" - ", place, *fields)


def detail_link() -> Column:
    return F.concat("file_path", F.lit("#L"), F.col("line_number").cast("string"))


def vector_rows(extra: list[tuple] = ()) -> Column:
    """The dimension of vectors as an array of structs, to be inlined next to each row."""
    return F.array(*[
        F.struct(F.lit(vector).alias("vector"), F.lit(code).alias("code"), F.lit(label).alias("label"),
                 F.lit(report_label).alias("report_label"), F.lit(ord_).alias("ord"))
        for vector, code, label, report_label, ord_, _ in [*schema.VECTORS, *extra]])


def vector_order(extra: list[tuple] = ()) -> Column:
    """Place of the row's vector in the reports."""
    out = F.lit(None).cast("int")
    for vector, _, _, _, ord_, _ in [*schema.VECTORS, *extra]:
        out = F.when(F.col("vector") == vector, ord_).otherwise(out)
    return out
