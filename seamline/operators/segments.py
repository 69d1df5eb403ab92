"""Go files as a table of segments: one row per bracket, with nesting level, line and statement.

A segment is the text from one bracket to the next, so everything in it lies at one nesting level
and inside one bracket pair. That makes call heads, declarations and statement ends plain regular
expressions on a short text, and nesting a running sum. There are about four times fewer segments
than tokens, and blanks, comments and literals never become rows.

Plan: one exchange of the files by path (none if they are bucketed by path), one sort by
(path, pos), and two window passes over that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from seamline.functions import golang as go
from seamline.operators.chunks import CHUNK_CHARS, FILE_KEY, Running, chunks, scanned

#: As many brackets open at once as the language's own parser takes.
MAX_NESTING = 100_000
INTERFACE = "{{"  # `prev` of the first row inside an interface body
KEYWORD_LIST = f" {' '.join(go.KEYWORDS)} "
DECL_WORDS = "package|import|var|const|type|func"


def so_far() -> WindowSpec:
    """Frame over a file's rows up to each, in text order."""
    return W.partitionBy(*FILE_KEY).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)


def segments(files: DataFrame, partitions: int | None = None, large_bytes: int | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Structured segments of all well-formed Go files.

    Files of ``large_bytes`` and more, where that is given, are cut into pieces of ``chunk_chars`` that lie in as many tasks. The
    text is then read twice, as each branch takes its files, so it is given only where such files are known to be.

    ``files`` has the columns of ``schema.FILES_SCHEMA``. ``partitions`` is the number of hash
    partitions by path; the session's ``spark.sql.shuffle.partitions`` if not given. 16 to 32 MB of
    source per partition keeps the sort in memory. 0 is for a table already bucketed by path, which
    needs no exchange.

    Columns of a row, next to the file's module, version, dir and path:

    * ``pos``, its number; ``core``, the bracket it ends with, or ``reflect``, ``note``, ``eof``;
      ``code``, the text without that bracket and comments, literals cut down to a quote; ``note``, a directive comment;
    * ``prev``, the last character before the text; ``level`` of the text; ``line`` of the core;
    * ``starts``, whether a statement ends in the text, and ``rest``, what follows it (both only
      down to level 1); ``stmt`` and ``prev_stmt``, the word that begins the top-level statement
      after and before it, with ``(`` if only that follows, and ``stmt_pos``, its row;
    * ``chain``, the selector chain called here, and ``start_line``; its last name ``call_name``;
      ``selector``, whether it has a dot;
    * ``func_name``, a top-level function or method declared here, ``is_method`` and ``decl_line``;
    * ``ends0`` and ``ends1``, the number of texts so far in which a statement of level 0 or 1 ends;
    * ``file_flags``, what occurs anywhere in the file.
    """
    if large_bytes is None:
        return structured(lexed(files, partitions))
    is_large = F.coalesce(F.octet_length("content") >= large_bytes, F.lit(False))
    in_chunks = structured(lexed_in_chunks(files.filter(is_large), chunk_chars, partitions))
    return structured(lexed(files.filter(~is_large), partitions)).unionByName(in_chunks)


def lexed(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Segments with the properties that depend on their own text only."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")) if partitions is None else partitions
    sources, content = _sources(files)
    pieces = (
        (sources.repartition(n, *FILE_KEY) if n else sources)
        .select("module", "version", "dir", "path", F.regexp_extract_all(content, F.lit(go.SEGMENT), 0).alias("pieces"))
        .withColumn("paired", open_brackets(F.col("pieces")) == "")  # once a file, before its pieces become rows
        .select("module", "version", "dir", "path", "paired", _each_piece().alias("pos", "raw")))
    return _lexed_pieces(pieces)


def lexed_in_chunks(large: DataFrame, chunk_chars: int = CHUNK_CHARS, partitions: int | None = None) -> DataFrame:
    """The rows of ``lexed`` with a column ``chunk`` more, for files too large for one task; ``structured`` takes either.

    ``open`` is what is left of the brackets of a piece, a few letters, to be paired across pieces.
    """
    n = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")) if partitions is None else partitions
    sources, content = _sources(large)
    # Rows that share a path are one text, piece by piece; they lie together already.
    text = F.array_join(F.array_sort(F.collect_list("text")), "").alias("text")
    dealt = chunks(sources, content, chunk_chars).repartition(n, *FILE_KEY, "chunk")
    pieces = (
        dealt.groupBy("module", "version", "dir", "path", "chunk").agg(text)
        .select("module", "version", "dir", "path", "chunk", F.regexp_extract_all("text", F.lit(go.SEGMENT), 0).alias("pieces"))
        .withColumn("open", open_brackets(F.col("pieces")))
        .select("module", "version", "dir", "path", "chunk", "open", _each_piece().alias("at", "raw")))
    return _lexed_pieces(pieces.withColumn("pos", F.shiftleft(F.col("chunk").cast("bigint"), 32) + F.col("at")).drop("at"))


def _all_pair(open_of_pieces: Column) -> Column:
    """Whether what is left open of the pieces of a file pairs across them."""
    return _left_open(F.flatten(F.transform(open_of_pieces, lambda left: F.split(F.reverse(left), "")))) == ""


def _each_piece() -> Column:
    """Position and text of each piece, of which no text has none. From the plain ``posexplode`` the optimiser infers a filter on the
    number of pieces and takes it below the exchange, so that every text would be cut twice."""
    return F.posexplode_outer("pieces")


def _sources(files: DataFrame) -> tuple[DataFrame, Column]:
    """Go files that are text, and their content as it is lexed."""
    sources = files.filter((F.col("ext") == ".go") & go.well_encoded(F.col("content")))
    content = F.col("content")
    return sources, F.concat(F.when(F.startswith(content, F.lit("\ufeff")), F.substring(content, 2, 2147483647)).otherwise(content), F.lit("\n"))


def _lexed_pieces(pieces: DataFrame) -> DataFrame:
    raw, core = F.col("raw"), F.col("core")
    bracket = _bracket_at_end(raw)
    keys = [c for c in ("module", "version", "dir", "path", "chunk", "open", "paired", "pos") if c in pieces.columns]
    return (
        pieces
        .withColumn("note", F.when(
            _may_be_note(raw), F.nullif(F.regexp_extract(raw, go.SEGMENT_NOTE, 1), F.lit(""))))
        .withColumn("core", F.when(F.col("note").isNotNull(), "note")
                    .otherwise(F.coalesce(bracket, F.when(F.endswith(raw, F.lit('"reflect"')), "reflect")
                                          .when(F.endswith(raw, F.lit("\n")), "eof").otherwise("error"))))
        .withColumn("code", go.blank_literals(raw))
        .withColumn("code", F.when(go.is_bracket(core), F.left("code", F.length("code") - 1))
                    .otherwise(F.col("code")))
        .withColumn("head", F.when(core == "(", F.regexp_extract("code", go.CHAIN_AT_END, 0)).otherwise(""))
        .withColumn("chain", F.when(F.col("head") == "", "").otherwise(F.regexp_replace("head", r"\s+", "")))
        # What the text alone tells is decided here, as the stage between the windows is near the size that is compiled.
        .select(*keys, "note", "core", "code", go.newlines(F.col("head")).alias("head_lines"), "chain", _is_bare().alias("bare"),
                _is_error().alias("error"), _package_clause().alias("clause"), F.when(F.col("note").isNotNull(), _note_line()).alias("note_line"),
                _name_bit().alias("name_bit"),
                go.newlines(raw).alias("nl"),
                F.when(go.is_bracket(core), F.when(go.is_opener(core), 1).otherwise(-1)).otherwise(0).alias("step")))


def _is_bare() -> Column:
    """Whether the called chain is neither blank nor a keyword nor the name of a function declared here."""
    chain, code = F.col("chain"), F.col("code")
    declared = F.contains(code, F.lit("func")) & code.rlike(rf"{go.NOT_IN_IDENT}func\s++{go.IDENT}\s*+\z")
    keyword = F.contains(F.lit(KEYWORD_LIST), F.concat(F.lit(" "), chain, F.lit(" ")))
    return (chain != "") & ~declared & ~keyword


def _name_bit() -> Column:
    """One of the bits of ``file_flags`` behind those that have names, by the last name of the called chain; NULL if there is none."""
    name = F.substring_index("chain", ".", -1)
    place = F.pmod(F.xxhash64(name), F.lit(NAME_BITS)).cast("int") + FIRST_NAME_BIT
    return F.when(F.col("chain") != "", F.call_function("shiftleft", F.lit(1).cast("bigint"), place))


def _package_clause() -> Column:
    """The name in a package clause that begins the text, if one does."""
    code = F.col("code")
    return F.when(F.contains(code, F.lit("package")), F.regexp_extract(code, rf"^\s*+package\s++({go.IDENT})[ \t\r]*+(?:[;\n]|\z)", 1))


def _is_error() -> Column:
    """Whether the text is ill-formed by itself, whatever stands before it."""
    code = F.col("code")
    twice = F.contains(code, F.lit("=")) & code.rlike(go.DOUBLE_ASSIGNMENT)
    return (F.col("core") == "error") | ((code != "") & code.rlike(go.STRAY_CHARACTER)) | twice


def _may_be_note(raw: Column) -> Column:
    return (F.contains(raw, F.lit("//go:generate")) | F.contains(raw, F.lit("//line "))
            | F.contains(raw, F.lit("/*line ")))


def _bracket_at_end(raw: Column, otherwise: Column | None = None) -> Column:
    """The bracket a piece ends with. Asked for one by one, as the last character of a long piece is only found by counting all."""
    first, *more = "()[]{}"
    out = F.when(F.endswith(raw, F.lit(first)), first)
    for b in more:
        out = out.when(F.endswith(raw, F.lit(b)), b)
    return out if otherwise is None else out.otherwise(otherwise)


#: How often pairs of neighbours are taken out at once before the brackets that are left are looked at one by one.
PAIR_ROUNDS = 5


def open_brackets(pieces: Column) -> Column:
    """The brackets that do not pair within a text of these pieces, last first; blank if all do.

    A fold over the brackets: a closing bracket takes away the open one of its kind that came last, stays where none is open, and
    gives ``!`` for good where the last is of another kind or more than ``MAX_NESTING`` are open. What is left of two
    texts, put together, leaves what is left of both. Pairs of neighbours change nothing, as long as there are too few brackets to nest
    too deep, and are taken out before.
    """
    def bracket(raw: Column) -> Column:
        is_note = _may_be_note(raw) & (F.regexp_extract(raw, go.SEGMENT_NOTE, 1) != "")
        own = _bracket_at_end(raw, F.when(raw == "!", "!").otherwise(""))
        return F.when((own != "") & is_note, "").otherwise(own)

    each = F.array_join(F.transform(pieces, bracket), "")
    left = each
    for _ in range(PAIR_ROUNDS):
        left = F.regexp_replace(left, r"\(\)|\[\]|\{\}", "")
    return _left_open(F.split(F.when(F.size(pieces) < MAX_NESTING, left).otherwise(each), ""))


def _left_open(brackets: Column) -> Column:
    def step(opened: Column, bracket: Column) -> Column:
        top = F.left(opened, F.lit(1))
        return (
            F.when((top == "!") | (bracket == ""), opened).when(bracket == "!", "!")
            .when(top == F.when(go.is_closer(bracket), F.translate(bracket, ")]}", "([{")).otherwise("none"), F.substring(opened, 2, MAX_NESTING))
            .when((go.is_opener(bracket) | (opened == "") | go.is_closer(top)) & (F.length(opened) < MAX_NESTING), F.concat(bracket, opened))
            .otherwise("!"))

    return F.aggregate(brackets, F.lit(""), step)


def structured(lexed_rows: DataFrame) -> DataFrame:
    """Add nesting, lines, statements, calls and declarations; drop ill-formed files."""
    return _of_well_formed(_framed(lexed_rows))


def failures(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """(module, version, path, reason) of Go files that give no occurrences because they cannot be analysed."""
    unread = files.filter((F.col("ext") == ".go") & ~F.coalesce(go.well_encoded(F.col("content")), F.lit(False))).select(
        *FILE_KEY, F.when(F.col("content").isNull(), "unreadable").otherwise("not text").alias("reason"))
    rows = _framed(lexed(files, partitions)).groupBy(*FILE_KEY).agg(F.bool_and(_well_formed()).alias("good"))
    return rows.filter(~F.col("good")).select(*FILE_KEY, F.lit("ill-formed").alias("reason")).unionByName(unread)


def _framed(lexed_rows: DataFrame) -> DataFrame:
    return _with_file_context(_with_calls(_with_statement_ends(_with_nesting(lexed_rows))))


def _well_formed() -> Column:
    return ((F.col("file_flags").bitwiseAND(ERROR) == 0) & (F.coalesce("own_package", F.lit("")) != "")
            & F.col("paired") & F.coalesce(F.col("last_import") <= F.col("first_decl"), F.lit(True)))


def _with_nesting(rows: DataFrame) -> DataFrame:
    core, code = F.col("core"), F.col("code")
    opens_interface = (core == "{") & code.rlike(rf"{go.NOT_IN_IDENT}interface[ \t]*+\z")
    tail = (
        F.when(opens_interface, INTERFACE)
        .when(go.is_bracket(core), core)
        .otherwise(F.nullif(F.regexp_extract(code, r"(\S)\s*+\z", 1), F.lit(""))))
    # Whether a line ended between the last character and a directive comment behind it.
    line_ended = F.when((core == "note") & code.rlike(r"\n\s*+\z"), True).when(F.col("tail").isNotNull(), False)
    prev = F.col("prev")
    across = {"paired": Running("each", F.col("open"), _all_pair)} if "open" in rows.columns else {}
    scan = scanned(rows.withColumn("tail", tail), {
        **across,
        "lines": Running("sum", F.col("nl")), "nested": Running("sum", F.col("step")),
        "prev": Running("last_before", F.col("tail")), "line_ended": Running("last_before", line_ended)}, spent=("nl", "open"))
    return (
        scan.withColumn("line", (F.col("lines") + 1).cast("int"))
        .withColumn("level", (F.col("nested") - F.col("step")).cast("int"))
        .withColumn("prev", F.when(F.col("line_ended") & ~go.is_opener(prev), F.concat(prev, F.lit("\n"))).otherwise(prev))
        .drop("line_ended", "lines", "nested"))


# Bits of ``file_flags``: what occurs anywhere in the file.
ERROR, METHODS, NEW_CHAIN, ANY_CHAIN, INTERFACES, OWN_NEW, OWN_CALL = (1 << i for i in range(7))
# The bits behind them tell the names of the methods declared in the file, several names to a bit.
FIRST_NAME_BIT, NAME_BITS = 7, 55


def in_file(flag: int) -> Column:
    return F.col("file_flags").bitwiseAND(flag) != 0


def may_be_method() -> Column:
    """Whether the called name may be that of a method declared in the file. If not, it is none; if so, another name may have its bit."""
    return F.coalesce(F.col("file_flags").bitwiseAND(F.col("name_bit")) != 0, F.lit(False))


def first_in_group() -> Column:
    """Whether the text follows an opening bracket or starts the file."""
    return F.coalesce(go.is_opener(F.col("prev")), F.lit(True))


def statement_text() -> Column:
    """The text behind the character at which the statement before it may have ended."""
    return F.concat(F.when(first_in_group(), ";").otherwise(F.col("prev")), "code")


def _may_end_statement(text: Column) -> Column:
    """Whether there is what every match of ``STATEMENT_END`` ends with."""
    return F.contains(text, F.lit(";")) | F.contains(text, F.lit("\n"))


def _with_statement_ends(rows: DataFrame) -> DataFrame:
    text, rest = F.col("text"), F.col("rest")
    word = F.regexp_extract(rest, rf"^({DECL_WORDS})(?![\p{{L}}\p{{Nd}}_])", 1)
    return (
        rows.withColumn("text", F.when(F.col("level") <= 1, statement_text()))
        .withColumn("starts", F.coalesce(_may_end_statement(text) & text.rlike(go.STATEMENT_END), F.lit(False)))
        .withColumn("rest", F.when(
            F.col("starts"), F.regexp_extract(text, rf"(?s)^.*{go.STATEMENT_END}\s*+(.*)\z", 1)))
        .withColumn("word", F.when((F.col("level") == 0) & (rest != ""), word)))


def _with_calls(rows: DataFrame) -> DataFrame:
    core, code, level = F.col("core"), F.col("code"), F.col("level")
    chain = F.col("chain")
    after_receiver = (F.col("prev") == ")") & code.rlike(rf"^[ \t]*+{go.IDENT}[ \t]*+\z")
    function = F.when(F.contains(F.lit("(["), core) & (F.col("word") == "func"),
                      F.nullif(F.regexp_extract("rest", rf"^func\s++({go.IDENT})\s*+\z", 1), F.lit("")))
    # At the top level, `) Name (` without a statement end in between occurs in methods only.
    method = F.when(F.col("is_method"), chain)
    return (
        rows
        .withColumn("selector", F.contains(chain, F.lit(".")))
        .withColumn("after_receiver", F.coalesce(after_receiver, F.lit(False)))
        .withColumn("is_method", (core == "(") & (level == 0) & F.col("after_receiver") & F.col("bare"))
        .withColumn("call_name", F.when(F.col("selector") | (F.col("bare") & ~F.col("after_receiver")), F.substring_index(chain, ".", -1)))
        .withColumn("func_name", F.coalesce(method, function)))


def continues_brackets() -> Column:
    """A called chain that goes on after a closing bracket, as in ``f(x).name(``."""
    return F.startswith("chain", F.lit(".")) & go.is_closer(F.col("prev"))


def own_statement() -> Column:
    """A bare call that is a statement below the top level; a method signature looks the same."""
    named = rf"\s*+{go.IDENT}[ \t]*+\z"
    alone = F.when(first_in_group(), F.col("code").rlike("^" + named)).otherwise(
        F.concat("prev", "code").rlike(go.STATEMENT_END + named))
    return ~F.col("selector") & F.col("call_name").isNotNull() & (F.col("level") > 0) & alone


def _with_file_context(rows: DataFrame) -> DataFrame:
    core, code, level, rest = F.col("core"), F.col("code"), F.col("level"), F.col("rest")
    # The word that begins a statement, with a bracket if nothing else stands before the core.
    head = F.when(F.rtrim(rest) == F.col("word"), F.concat("word", core)).otherwise(F.col("word"))
    stmt = {"stmt": head, "stmt_line": F.col("line") - go.newlines(rest), "stmt_pos": F.col("pos")}
    stmt = {k: F.when((level == 0) & (rest != ""), c) for k, c in stmt.items()}
    stray = (level == 0) & (
        (F.col("starts") & F.col("text").rlike(rf"{go.STATEMENT_END}\s*+(?!(?:{DECL_WORDS})(?![\p{{L}}\p{{Nd}}_])|;|\z)"))
        | (go.is_opener(core) & (rest == "")))
    between = F.concat(F.replace(F.coalesce("prev", F.lit("")), F.lit(INTERFACE), F.lit("{")), code, F.when(go.is_bracket(core), core).otherwise(""))
    # Of two brackets side by side only an opening one can be out of place.
    alone = (code == "") & go.is_closer(core) & (go.is_closer(F.col("prev")) | go.is_opener(F.col("prev")))
    specified = F.contains("text", F.lit("var")) | F.contains("text", F.lit("const"))
    error = (F.col("error") | (~F.coalesce(alone, F.lit(False)) & between.rlike(go.MALFORMED))
             | ((level == 0) & specified & F.col("text").rlike(go.INCOMPLETE_SPEC))
             | ((level == 0) & F.contains("text", F.lit("import")) & F.col("text").rlike(go.LATE_IMPORT)) | (level + F.col("step") < 0) | stray
             | F.coalesce(F.col("note_line") == 0, F.lit(False)))
    first_code = F.when((level == 0) & code.rlike(r"\S"), F.coalesce("clause", F.lit("")))
    is_new = F.startswith("call_name", F.lit("New"))
    flags = {
        ERROR: error,
        METHODS: F.col("is_method"),
        NEW_CHAIN: is_new & continues_brackets(),
        ANY_CHAIN: continues_brackets(),
        INTERFACES: F.col("tail") == INTERFACE,
        OWN_NEW: (F.col("call_name") == "New") & own_statement(),
        OWN_CALL: own_statement(),
    }
    bits = sum((F.when(c, bit).otherwise(0) for bit, c in flags.items()), F.when(F.col("is_method"), F.col("name_bit")).otherwise(0))
    declares = F.col("word").isin("var", "const", "type", "func")
    imports = (level == 0) & F.contains("text", F.lit("import")) & F.col("text").rlike(go.IMPORT)
    return scanned(rows, {
        **{k: Running("last", c) for k, c in stmt.items()},
        "prev_stmt": Running("last_before", stmt["stmt"]), "shift": Running("last_before", _line_shift()),
        "own_package": Running("first", first_code),
        **{f"ends{i}": Running("sum", F.when(F.col("starts") & (level == i), 1).otherwise(0)) for i in (0, 1)},
        "first_decl": Running("min", F.when(declares, F.col("pos"))), "last_import": Running("max", F.when(imports, F.col("pos"))),
        "file_flags": Running("bit_or", bits)}, spent=("after_receiver", "text", "word", "note_line", "tail", "step", "bare", "error", "clause"), store=False)


def _of_well_formed(framed: DataFrame) -> DataFrame:
    shifted = lambda c: (c + F.coalesce("shift", F.lit(0))).cast("int")
    return (
        framed.filter(_well_formed())
        .withColumn("start_line", shifted(F.col("line") - F.col("head_lines")))
        .withColumn("decl_line", shifted(F.col("stmt_line")))
        .withColumn("line", shifted(F.col("line")))
        .drop("paired", "first_decl", "last_import", "head_lines", "shift", "stmt_line", "chunk"))


def _note_line() -> Column:
    """The line a ``//line name:N`` or ``/*line name:N*/`` comment gives, NULL if it gives none.

    Either may have a column after the line. A last field that is no number from 1 to 2^30 makes the
    file ill-formed, which is told by a 0.
    """
    note = F.col("note")
    at_line_start = F.col("code").rlike(r"\n \z") | ((F.col("pos") == 0) & (F.col("code") == " "))
    directive = F.startswith(note, F.lit("/*line ")) | (F.startswith(note, F.lit("//line ")) & at_line_start)
    number = F.regexp_extract(note, r":0*(\d{1,10})(?::0*[1-9]\d{0,9})?\r?(?:\*/)?\z", 1).try_cast("int")
    return F.when(directive & F.contains(note, F.lit(":")),
                  F.coalesce(F.when(number <= 1 << 30, number), F.lit(0)))


def _line_shift() -> Column:
    """Difference between reported and physical line from a line directive on.

    ``//line`` names the line after it, ``/*line */`` the line it ends on.
    """
    below = F.when(F.startswith("note", F.lit("//")), 1).otherwise(0)
    return F.col("note_line") - F.col("line") - below
