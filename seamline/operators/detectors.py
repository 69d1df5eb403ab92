"""The twelve detectors, run together over one pass of the segment table.

Most detectors need nothing but one segment row: they are conditions on it, and the row is exploded
into the vectors whose condition it meets. The others need neighbours:

* a call on a chain such as ``f(x).New()`` reports the line its whole chain starts at, and
  ``New()`` inside an interface body is a declaration: both are found with a window by
  (path, level) over the few files and rows where the question arises;
* ``interface`` asks whether the called name is a method declared in the same file, and ``global``
  needs all pieces of a specification: both with one window by (path, key) over the candidate rows;
* ``assembly`` matches called names with those defined in the directory's assembly files, and
  ``exec`` with rules from a table if there is one: both are one ordinary join of the few rows found
  with the listed names, which the optimiser sizes.

Registered detectors that are conditions on a segment are found in the same pass. All windows start
with the file, so they reuse the one exchange of ``segments``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline import schema
from seamline.functions import golang as go
from seamline.operators.assembly import asm_functions
from seamline.operators.chunks import CHUNK_CHARS
from seamline.operators.segments import (
    ANY_CHAIN, FILE_KEY, INTERFACE, INTERFACES, METHODS, NEW_CHAIN, OWN_CALL, OWN_NEW, continues_brackets,
    first_in_group, in_file, may_be_method, own_statement, segments, statement_text)

DIR_KEY = ["module", "version", "dir"]
PLACE = ["path", "pos"]
TEXT_FIELDS = ["variable_name", "command", "method_invoked", "type_passed", "pattern"]

# A word that must occur in the file text for the vector to occur; checked before the exchange.
_REQUIRED_TEXT = {
    "generate": ["//go:generate"], "init": ["init"], "constructor": ["New"],
    "reflect": ['"reflect"'], "unsafe": ["unsafe", "Pointer"], "cgo": ["C"],
    "plugin": ["plugin", "Open"], "interface": ["func"], "test": ["func"],
}


@dataclass(frozen=True)
class Found:
    """A registered detector that is a condition on one segment, and the occurrence fields it sets."""

    where: Column
    fields: dict[str, Column]


def detect(files: DataFrame, vectors: list[str] | None = None, *, exec_rules: DataFrame | None = None,
           custom: dict[str, Found] | None = None, partitions: int | None = None,
           large_bytes: int | None = None, chunk_chars: int = CHUNK_CHARS, rows: DataFrame | None = None,
           listed_assembly: bool = True) -> DataFrame:
    """Occurrences of the wanted vectors (all by default), duplicates kept, without package names.

    ``exec_rules(pkg, func)`` replaces the built-in process-starting functions. Files of ``large_bytes`` and more are read in
    pieces. ``rows`` are the segments of all files, where they are at hand. Without ``listed_assembly`` every bare call is one
    of ``assembly``, for the caller to decide.
    """
    custom = custom or {}
    wanted = [*(schema.VECTOR_NAMES if vectors is None else vectors), *custom]
    by_table = exec_rules is not None and "exec" in wanted
    if rows is None:
        rows = segments(_prefilter(files, wanted, by_table), partitions, large_bytes, chunk_chars)
    events = _events(_candidates(rows, wanted, custom, by_table), wanted, custom)
    if {"interface", "global", "reflect"} & set(wanted):
        events = _resolve_by_key(events)
    listed = []
    by_assembly = "assembly" in wanted and listed_assembly
    if by_assembly:
        listed.append(asm_functions(files).select(_listed_name("assembly", *DIR_KEY, "name").alias("listed_name")))
    if by_table:
        listed.append(exec_rules.select(_listed_name("exec", F.concat("pkg", F.lit("."), "func")).alias("listed_name")))
    if listed:
        events = _keep_listed(events, listed, ["assembly"] * by_assembly + ["exec"] * by_table)
    return events.select(*DIR_KEY, *PLACE, "vector", "file_path", "line_number", *TEXT_FIELDS)


def _listed_name(vector: str, *parts) -> Column:
    return F.concat_ws("\1", F.lit(vector), *parts)


def _keep_listed(events: DataFrame, listed: list[DataFrame], vectors: list[str]) -> DataFrame:
    """Drops rows of ``vectors`` whose name is in no list. Rows of other vectors get a name of their own,
    which no list has, so that they spread over the join."""
    names = listed[0]
    for more in listed[1:]:
        names = names.unionByName(more)
    own = F.concat_ws("\1", F.lit(""), *FILE_KEY, F.col("pos").cast("string"), "vector")
    name = own
    if "assembly" in vectors:
        name = F.when(F.col("vector") == "assembly", _listed_name("assembly", *DIR_KEY, "method_invoked")).otherwise(name)
    if "exec" in vectors:
        name = F.when(F.col("vector") == "exec", _listed_name("exec", "method_invoked")).otherwise(name)
    names = names.distinct().withColumn("is_listed", F.lit(True))
    return events.withColumn("listed_name", name).join(names, "listed_name", "left").filter(
        ~F.col("vector").isin(vectors) | F.col("is_listed"))


def _prefilter(files: DataFrame, wanted: list[str], by_table: bool) -> DataFrame:
    """Keep only files that can hold a wanted construct, before their text is shuffled."""
    if wanted == ["test"]:
        files = files.filter(F.endswith("path", F.lit("_test.go")))
    if wanted == ["exec"] and not by_table:
        pairs = [F.contains("content", F.lit(p)) & F.contains("content", F.lit(f))
                 for p, f in schema.EXEC_RULES]
        return files.filter(_any(pairs))
    if all(v in _REQUIRED_TEXT for v in wanted):
        return files.filter(_any([
            _all([F.contains("content", F.lit(word)) for word in _REQUIRED_TEXT[v]]) for v in wanted]))
    return files


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# --- candidate rows -------------------------------------------------------------------------


def _conditions(wanted: list[str], custom: dict[str, Found], by_table: bool) -> dict[str, Column]:
    """Which rows each wanted vector is found on.

    Two vectors need rows of other kinds for the decision: ``interface`` the declared methods
    (``method``), and ``global`` the text before a statement end, which closes the specification
    before (``closing``), next to the text that opens or continues the current one (``global``).
    """
    call, chain, selector = F.col("call_name"), F.col("chain"), F.col("selector")
    alias = rf'(?:{go.IDENT}|\.)?\s*+"\s*+\z'
    imported = (F.col("core") == "reflect") & F.startswith("stmt", F.lit("import")) & (
        ((F.col("level") == 0) & F.col("rest").rlike(rf"^import\s*+{alias}"))
        | ((F.col("level") == 1) & (F.col("stmt") == "import(")
           & F.coalesce("rest", F.lit("")).rlike(f"^{alias}")))
    every = {
        "generate": lambda: F.startswith("note", F.lit("//go:generate")),
        "test": lambda: (F.endswith("path", F.lit("_test.go"))
                         & F.col("func_name").rlike("^(?:Test|Benchmark|Example|Fuzz)")),
        "init": lambda: F.col("func_name") == "init",
        "constructor": lambda: F.startswith(call, F.lit("New")) & (selector | (call == "New")),
        "reflect": lambda: imported,
        "unsafe": lambda: chain == "unsafe.Pointer",
        "cgo": lambda: chain.rlike(r"^C\.[^.]++\z"),
        "plugin": lambda: chain == "plugin.Open",
        "exec": lambda: (chain.rlike(r"^[^.]++\.[^.]++\z") if by_table
                         else chain.isin([f"{p}.{f}" for p, f in schema.EXEC_RULES])),
        "interface": lambda: selector & may_be_method(),
        "method": lambda: F.col("is_method"),
        "assembly": lambda: call.isNotNull() & ~selector,
        "global": lambda: _spec_part(),
        "closing": lambda: F.col("starts") & (F.col("level") == spec_level("prev_stmt")),
    }
    helpers = ["method"] * ("interface" in wanted) + ["closing"] * ("global" in wanted)
    return {v: custom[v].where if v in custom else every[v]() for v in [*wanted, *helpers]}


def spec_level(stmt: str) -> Column:
    """Level of the values of a ``var`` or ``const`` statement, one more in a group; else NULL."""
    statement = F.col(stmt)
    return F.when(statement.isin("var", "const"), 0).when(statement.isin("var(", "const("), 1)


def _spec_part() -> Column:
    """Whether the row's text, or the bracket it closes, lies at the level of the values."""
    above = F.col("level") - spec_level("stmt")
    return (above == 0) | ((above == 1) & go.is_closer(F.col("core")))


def _candidates(rows: DataFrame, wanted: list[str], custom: dict[str, Found], by_table: bool) -> DataFrame:
    """One row per segment and ``vector`` it may be found as; the bulk of the segments goes.

    In files in which chains or interface bodies have to be told apart, the rows that show them stay
    as context, with a blank vector, until that is done.
    """
    levels = (
        [in_file(NEW_CHAIN) | (in_file(INTERFACES) & in_file(OWN_NEW))] * ("constructor" in wanted)
        + [in_file(ANY_CHAIN) & in_file(METHODS)] * ("interface" in wanted)
        + [in_file(INTERFACES) & in_file(OWN_CALL)] * ("assembly" in wanted))
    found = F.concat_ws(",", *[F.when(c, v) for v, c in _conditions(wanted, custom, by_table).items()])
    context = F.col("needs_levels") & (go.is_opener(F.col("core")) | first_in_group())
    rows = (
        rows.withColumn("needs_levels", _any(levels))
        .withColumn("vector", F.explode(F.split(found, ",")))
        .filter((F.col("vector") != "") | context))
    if levels:
        rows = _resolve_chains(rows)
        signature = F.col("vector").isin("constructor", "assembly") & F.col("signature")
        rows = rows.filter((F.col("vector") != "") & ~signature)
    return rows


def _resolve_chains(rows: DataFrame) -> DataFrame:
    """Line of the start of every bracketed chain; mark method signatures of interface bodies."""
    code, prev, core, needed = F.col("code"), F.col("prev"), F.col("core"), F.col("needs_levels")
    type_text = rf"^[ \t]*+(?:\*[ \t]*+)*+{go.IDENT}(?:\.{go.IDENT})*+[ \t]*+\z"
    dotted = rf"^[ \t]*+\.\s*+(?:{go.IDENT}(?:[ \t]*+\.\s*+{go.IDENT})*+)?[ \t]*+\z"
    continues = go.is_closer(prev) & (
        code.rlike(r"^[ \t]*+\z") | code.rlike(dotted)
        | (((prev == "]") | ((prev == ")") & (core == "{"))) & code.rlike(type_text)))
    own_line = F.col("line") - go.newlines(F.regexp_extract(code, go.CHAIN_AT_END, 0))
    starts_at = F.when(needed & go.is_opener(core) & ~F.coalesce(continues, F.lit(False)), own_line)
    group = F.when(needed & first_in_group(), prev)
    running = W.partitionBy(*FILE_KEY, "level").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(
        "*",
        F.last(starts_at, ignorenulls=True).over(running).alias("chain_start"),
        F.last(group, ignorenulls=True).over(running).alias("group"))
    return (
        rows.withColumn("start_line", F.when(
            needed & continues_brackets(), F.coalesce("chain_start", "start_line"))
            .otherwise(F.col("start_line")))
        .withColumn("signature", F.coalesce(
            needed & (F.col("group") == INTERFACE) & own_statement(), F.lit(False))))


# --- events ---------------------------------------------------------------------------------


def _events(rows: DataFrame, wanted: list[str], custom: dict[str, Found]) -> DataFrame:
    """One row per candidate and vector, with the occurrence fields the row itself knows.

    ``key`` and ``piece`` belong to ``interface``, ``reflect`` and ``global``, which are decided per key later.
    """
    vector, call, name = F.col("vector"), F.col("call_name"), F.col("func_name")
    blank = F.lit("")
    of = lambda *vectors: vector.isin(*vectors)
    alias_lines = go.newlines(F.coalesce(
        F.regexp_extract("rest", r"(?s)^(?:import\s++)?(.*)\z", 1), blank))
    line = (
        F.when(of("test", "init"), F.col("decl_line"))
        .when(vector == "reflect", F.col("line") - alias_lines)
        .when(of("generate", "global", "closing"), F.col("line"))
        .otherwise(F.col("start_line")))
    command = F.regexp_replace(F.replace("note", F.lit("\r"), blank), "^//go:generate ", "")
    method = (
        F.when(vector == "test", name)
        .when(of("unsafe", "cgo", "exec"), F.col("chain"))
        .when(of("constructor", "plugin", "assembly", "interface"), call)
        .otherwise(blank))
    pattern = F.when(vector == "constructor",
                     F.when(F.col("selector"), "factory function").otherwise("New() function")).otherwise(blank)
    none = F.lit(None).cast("string")
    key, piece, stop = none, none, F.lit(None).cast("int")
    if "interface" in wanted:
        key = F.when(vector == "interface", call).when(vector == "method", name)
    if "reflect" in wanted:
        key = F.when(vector == "reflect", F.concat(F.lit("import "), F.col("stmt_pos").cast("string"))).otherwise(key)
    if "global" in wanted:
        key = F.when(of("global", "closing"), _spec_key(vector == "closing")).otherwise(key)
        piece = F.when(vector == "closing", _closing_piece()).when(vector == "global", _open_piece())
        stop = F.when((vector == "global") & ~F.col("starts") & _ends_first_value(), F.col("pos"))
    fields = {
        "file_path": F.when(vector == "test", F.concat("path", F.lit("/"), "own_package")).otherwise(F.col("path")),
        "line_number": line,
        "variable_name": blank,
        "command": F.when(vector == "generate", command).otherwise(blank),
        "method_invoked": method,
        "type_passed": F.when((vector == "interface") & F.col("chain").rlike(r"^[^.]++\.[^.]++\z"),
                              F.substring_index("chain", ".", 1)).otherwise(blank),
        "pattern": pattern,
    }
    for name_, found in custom.items():
        fields |= {c: F.when(vector == name_, own).otherwise(fields[c]) for c, own in found.fields.items()}
    fields["line_number"] = fields["line_number"].cast("int")
    return rows.select(
        *DIR_KEY, "path", "pos", "vector", *[c.alias(k) for k, c in fields.items()],
        key.alias("key"), piece.alias("piece"), stop.alias("stop"))


# --- global initialisers --------------------------------------------------------------------


def _spec_key(closing: Column) -> Column:
    """Number of the specification, or of the one before it if this row closes that one.

    A specification is numbered by the statement ends before it, at its own level; one in a group
    by those at level 0 too.
    """
    back = F.when(closing, 1).otherwise(0)
    grouped = spec_level("stmt") == 1
    grouped = F.when(closing, F.col("level") == 1).otherwise(grouped)
    return F.when(grouped, F.concat_ws(" ", F.lit("spec"), "ends0", F.col("ends1") - back)).otherwise(
        F.concat_ws(" ", F.lit("spec"), F.col("ends0") - back))


def _open_piece() -> Column:
    """This row's part of the specification at its end.

    Text at the level of the values is kept, nested text is dropped and its brackets stay, so
    ``f(x).g(y)`` becomes ``f().g()``.
    """
    core = F.col("core")
    at_level = F.col("level") == spec_level("stmt")
    ends_group = go.is_closer(core) & at_level
    bracket = (F.when(ends_group, "").when(go.is_bracket(core), core).otherwise(""))
    own_text = F.coalesce("rest", "code")
    return F.concat(F.when(at_level, own_text).otherwise(""), bracket)


def _ends_first_value() -> Column:
    """Text after which a specification holds nothing that matters: a comma ends the first value, an
    operator makes it no call. Keeps the pieces of long lists and sums out of the final decision."""
    at_level = F.col("level") == spec_level("stmt")
    return at_level & F.col("code").rlike(r"[,+/%|^&!>]") & ~F.contains("code", F.lit("="))


def _closing_piece() -> Column:
    """The text before the first statement end, which belongs to the specification before it."""
    return F.regexp_extract(statement_text(), rf"(?s)^.(.*?){go.STATEMENT_END}", 1)


# Shapes of a first value, nested text removed and `interface{}` and `struct{}` written as a keyword,
# which is no callee of its own but may lead a chain.
# Fixed by the three kinds of callee that count; loops are possessive, however long the chain.
_NAME = go.IDENT
_LITERAL = r"func\s*+\(\)[^{}=]*+\{\}"
_PLAIN_CALL = rf"^(?!(?:{'|'.join(go.KEYWORDS)})\b){_NAME}\s*+\(\)\s*+\z"
_LITERAL_CALL = rf"^{_LITERAL}\s*+\(\)\s*+\z"
_OPERAND_CHAIN = (
    rf"^(?!\*)(?:{_LITERAL}|(?:\[\]|map\s*+\[\]|\*|\s)*+{_NAME}|\(\)|[\"'`]|{go.NUMBER})"
    rf"(?:\s*+\.\s*+(?:{_NAME}|\(\))|\s*+\(\)|\s*+\[\]|\s*+\{{\}})*+\s*+\z")
_SELECTOR_AT_END = rf"\.\s*+{_NAME}\s*+\(\)\s*+\z"


def _resolve_by_key(events: DataFrame) -> DataFrame:
    """Decide ``interface`` and ``global`` from all candidate rows of one (path, key).

    Of several imports in one declaration only the first counts for ``reflect``. A call counts for ``interface`` if its name is a method declared in the file. A specification
    counts for ``global`` if its first value is a call of a name, a selector or a function literal;
    it is reported at the line of that value.
    """
    vector = F.col("vector")
    fields = [c for c in events.columns if c not in (*FILE_KEY, "key")]
    # Rows without a key are decided by themselves and go in groups of near places. A group is gathered once, not once for each of its rows.
    near = F.shiftright(F.col("pos").cast("bigint"), 6).cast("string")
    group = F.coalesce("key", F.concat_ws(" ", F.lit("row"), near))
    groups = events.groupBy(*FILE_KEY, group.alias("group")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "vector", *[c for c in fields if c not in ("pos", "vector")]))).alias("rows"),
        F.max(vector == "method").alias("declared"), F.min("stop").alias("stop_at"))
    within = F.filter("rows", lambda r: F.coalesce(r["pos"] <= F.col("stop_at"), F.lit(True)))
    parts = F.transform(F.filter("rows", lambda r: r["piece"].isNotNull()), lambda r: F.struct(
        r["piece"].alias("piece"), r["line_number"].alias("line_number")))
    pieces, value, called = F.col("pieces"), F.col("value"), F.col("called")
    spec = rf"(?s)^\s*+(?:(?:var|const)\s++)?({go.IDENT})[^=]*+="
    # The value starts in the piece with the first `=`; its line is that of the piece's core.
    value_piece = F.try_element_at(F.filter(pieces, lambda p: F.contains(p.piece, F.lit("="))), F.lit(1))
    value_text = F.regexp_extract(value_piece.piece, r"(?s)^[^=]*+=\s*+(.*)\z", 1)
    is_call = value.rlike(_PLAIN_CALL) | (value.rlike(_SELECTOR_AT_END) & value.rlike(_OPERAND_CHAIN))
    # A specification is decided once, before its group comes apart into rows, of which a filter would decide it again for each rule.
    groups = (
        groups.withColumn("rows", within).withColumn("first_pos", F.col("rows")[0]["pos"])
        .withColumn("pieces", F.when(F.exists("rows", lambda r: r["vector"] == "global"), parts))
        .withColumn("shape", F.array_join(F.transform(pieces, lambda p: p.piece), ""))
        .withColumn("value", F.regexp_replace(
            F.regexp_extract("shape", rf"{spec}\s*+([^,]*+)", 2), r"\b(?:interface|struct)\s*+\{\}", "struct"))
        .withColumn("called", F.when(value.rlike(_LITERAL_CALL), "anonym func").when(
            is_call, F.concat(F.regexp_extract(value, rf"({go.IDENT})\s*+\(\)\s*\z", 1), F.lit("()"))))
        .withColumn("variable", F.when(called.isNotNull(), F.regexp_extract("shape", spec, 1)))
        .withColumn("value_line", F.when(called.isNotNull(), value_piece.line_number - go.newlines(value_text))))
    # Of a specification and an import declaration only the first row goes on, and of a method none.
    rows = F.filter("rows", lambda r: (
        F.when(r["vector"].isin("method", "closing"), False)
        .when(r["vector"] == "interface", F.col("declared"))
        .when(r["vector"] == "global", called.isNotNull() & (r["pos"] == F.col("first_pos")))
        .when(r["vector"] == "reflect", r["pos"] == F.col("first_pos"))
        .otherwise(True)))
    of_global = lambda own, name: F.when(vector == "global", F.col(own)).otherwise(F.col(name))
    return (
        groups.select(*FILE_KEY, "called", "variable", "value_line", F.inline(rows))
        .withColumn("method_invoked", of_global("called", "method_invoked"))
        .withColumn("variable_name", of_global("variable", "variable_name"))
        .withColumn("line_number", of_global("value_line", "line_number").cast("int")))
