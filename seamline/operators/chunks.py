"""Large files in pieces: a file of any size is spread over tasks.

A file is cut behind lines that are a closing brace alone. Whether such a place lies in code or inside a raw string or comment is told
without reading the file in order: each piece is a function from the state before it to the state behind it, and the
functions of a file, three letters each, are composed. Pieces that begin in code begin right behind a bracket, where a
segment begins in the whole file, too; a piece that begins inside a literal is joined to the one before it. So the pieces give the
very segments of the whole file.

Running values over a file (lines, nesting, statements) are two-level scans: every piece is summed up in one row, the
few rows of a file are scanned, and what comes before a piece is added to the running values within it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import golang as go
from seamline.operators.bounds import settle

FILE_KEY = ["module", "version", "path"]
#: Files of this many bytes are cut, into pieces of about so many characters.
LARGE_BYTES, CHUNK_CHARS = 64 << 20, 4 << 20

# States between pieces: in code, in a raw string, in a comment.
_CODE, _RAW, _COMMENT = "c", "r", "m"
_WHOLE = "|".join([go.STRING, go.RAW_STRING, go.RUNE, go.LINE_COMMENT, go.BLOCK_COMMENT])


def _cut(content: Column, chunk_chars: int) -> Column:
    """Pieces of at least so many characters, but for the last, that end behind a closing brace that begins a line."""
    behind = r"[^\n]*+(?:\n(?!\})[^\n]*+)*+(?:\n\}|\z)"
    return F.regexp_extract_all(content, F.lit(rf"(?s).{{{chunk_chars}}}{behind}|.++"), 0)


def _state_after(text: Column) -> Column:
    """State behind a text that begins in code: literals and comments that end are taken out; what opens first stays open."""
    opened = F.regexp_extract(F.regexp_replace(text, _WHOLE, " "), r"`|/\*", 0)
    return F.when(opened == "`", _RAW).when(opened == "/*", _COMMENT).otherwise(_CODE)


def _function(text: Column) -> Column:
    """States behind the text if it begins in code, in a raw string, in a comment, as three letters."""
    def behind(end: str, else_: str) -> Column:
        at = F.instr(text, end)
        return F.when(at == 0, else_).otherwise(_state_after(F.substr(text, at + len(end))))
    return F.concat(_state_after(text), behind("`", _RAW), behind("*/", _COMMENT))


def _then(states: Column, function: Column) -> Column:
    """The states so far, last first, with the one behind the next piece."""
    last = F.left(states, F.lit(1))
    place = F.when(last == _CODE, 1).when(last == _RAW, 2).otherwise(3)
    return F.concat(F.substr(function, place, F.lit(1)), states)


def chunks(large: DataFrame, content: Column, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """module, version, dir, path, chunk, text: pieces of each file that begin in code, numbered from 0.

    All in the row of the file, so that its text is neither stored nor shuffled before the pieces are dealt out.
    """
    pieces, starts = F.col("pieces"), F.col("starts")
    cut = large.select("module", "version", "dir", "path", _cut(content, chunk_chars).alias("pieces"))
    states = F.reverse(F.aggregate(F.transform(pieces, _function), F.lit(_CODE), _then))
    begins = F.transform(F.split(F.left(states, F.size(pieces)), ""), lambda state, n: F.when(state == _CODE, n))
    found = cut.withColumn("starts", F.filter(begins, lambda n: n.isNotNull()))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(pieces)))
    joined = F.zip_with(starts, ends, lambda start, end: F.array_join(F.slice(pieces, start + 1, end - start), ""))
    texts = F.when(F.size(starts) == F.size(pieces), pieces).otherwise(joined)
    return found.select("module", "version", "dir", "path", F.posexplode_outer(texts).alias("chunk", "text"))


@dataclass(frozen=True)
class Running:
    """A running value over a file: ``how`` is sum or last (up to a row), last_before (it), or first, min, max or bit_or of all rows.

    ``last`` and ``first`` leave out nulls. For pieces there is also ``each``: ``combine`` of the list of values of all pieces, in order; a value
    is the same for all rows of a piece.
    """

    how: str
    value: Column
    combine: Callable[[Column], Column] | None = None


def scanned(rows: DataFrame, columns: dict[str, Running], key: list[str] = FILE_KEY, spent: tuple[str, ...] = (), store: bool = True) -> DataFrame:
    """The rows with running values by ``pos`` over their file, which ``key`` tells, without the ``spent`` columns.

    Rows with a column ``chunk`` are scanned in two levels, within a piece and over the pieces; others by a window over their file. A window
    takes a row apart and puts it together again column by column, so what it only passes on goes through it as one struct. The rows are
    read twice for two levels, so they are settled first. Without ``store`` they are made again instead, for a second scan of rows that the
    first has settled, as another table of them would take more disk than their text.
    """
    pieces = "chunk" in rows.columns
    place = [*key, "chunk", "pos"] if pieces else [*key, "pos"]
    passed = [c for c in rows.columns if c not in (*place, *spent)]
    values = {name: replace(r, value=F.col(f"_of_{name}")) for name, r in columns.items()}
    packed = rows.select(*place, F.struct(*passed).alias("_passed"), *[r.value.alias(f"_of_{name}") for name, r in columns.items()])
    if not pieces:
        return packed.select(*place, "_passed", *[_within(r, key).alias(name) for name, r in values.items()]).select(
            *place, "_passed.*", *columns)
    piece = [*key, "chunk"]
    ends = F.lead(F.lit(True), 1, False).over(W.partitionBy(*piece).orderBy("pos"))
    late = [f"_of_{name}" for name, r in values.items() if r.how in ("each", "last_before")]
    own = packed.select(*place, "_passed", *late, *[_in_piece(r, piece).alias(name) for name, r in values.items() if r.how != "each"], (~ends).alias("_ends"))
    if store:
        own = _settled_as_dealt(own)
    # The last row of a piece sums it up.
    summaries = own.filter("_ends").select(*piece, *[_at_end(name, r).alias(name) for name, r in values.items()])
    carried = settle(summaries.select(*piece, *[_carried(name, r, key).alias(f"_{name}") for name, r in values.items()]))
    before = {name: F.col(f"_{name}") for name in values}
    both = {
        name: F.col(name) + F.coalesce(before[name], F.lit(0)) if r.how == "sum"
        else F.coalesce(F.col(name), before[name]) if r.how in ("last", "last_before") else before[name]
        for name, r in values.items()}
    return own.join(carried, piece).select(*place, "_passed.*", *[c.alias(name) for name, c in both.items()])


def _settled_as_dealt(rows: DataFrame) -> DataFrame:
    """The rows computed once, and known to lie by piece and in order; adaptive execution would leave that unknown, and all rows would be
    shuffled anew for every join with what their pieces carry."""
    conf, adaptive = rows.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(adaptive)
    conf.set(adaptive, "false")
    try:
        return settle(rows)
    finally:
        conf.set(adaptive, before)


def _within(r: Running, keys: list[str]) -> Column:
    frame = lambda start, end: W.partitionBy(*keys).orderBy("pos").rowsBetween(start, end)
    so_far, before, whole = (frame(W.unboundedPreceding, end) for end in (0, -1, W.unboundedFollowing))
    return {
        "sum": lambda: F.sum(r.value).over(so_far), "last": lambda: F.last(r.value, ignorenulls=True).over(so_far),
        "last_before": lambda: F.last(r.value, ignorenulls=True).over(before), "first": lambda: F.first(r.value, ignorenulls=True).over(whole),
        "min": lambda: F.min(r.value).over(whole), "max": lambda: F.max(r.value).over(whole), "bit_or": lambda: F.bit_or(r.value).over(whole),
    }[r.how]()


def _in_piece(r: Running, piece: list[str]) -> Column:
    """The running value within a piece, also of those that are of all rows of a file: the last row has that of the piece."""
    frame = W.partitionBy(*piece).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return {
        "first": lambda: F.first(r.value, ignorenulls=True).over(frame), "min": lambda: F.min(r.value).over(frame),
        "max": lambda: F.max(r.value).over(frame), "bit_or": lambda: F.bit_or(r.value).over(frame),
    }.get(r.how, lambda: _within(r, piece))()


def _at_end(name: str, r: Running) -> Column:
    return r.value if r.how == "each" else F.coalesce(r.value, F.col(name)) if r.how == "last_before" else F.col(name)


def _carried(name: str, r: Running, key: list[str]) -> Column:
    """What the pieces before give, or all pieces, over the one row of each piece."""
    order = W.partitionBy(*key).orderBy("chunk")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = F.col(name)
    return {
        "sum": lambda: F.sum(c).over(before), "last": lambda: F.last(c, ignorenulls=True).over(before),
        "last_before": lambda: F.last(c, ignorenulls=True).over(before), "first": lambda: F.first(c, ignorenulls=True).over(whole),
        "min": lambda: F.min(c).over(whole), "max": lambda: F.max(c).over(whole), "bit_or": lambda: F.bit_or(c).over(whole),
        "each": lambda: r.combine(F.collect_list(c).over(whole)),
    }[r.how]()
