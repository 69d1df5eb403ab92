"""Operator 11: chat formatting. Records of any known layout become canonical turns, and turns become template text.

*Fingerprints.* A record is a JSON text. Its layout is the set of nested field paths with their kinds (``messages[].role:s``);
the fingerprint is a hash of the sorted paths. The first record with a fingerprint in a task is held against the declarative
``Mapping`` rows of ``MAPPINGS``, in order: the first whose required paths all occur applies; after that the fingerprint
alone selects it. A mapping says where a record keeps its turns: in a list of messages, in columns such as prompt and
response, or, as one turn, in the record itself. Nothing else in this module knows a layout.

*Template.* A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts ``<``, k backslashes and ``|`` get one backslash
more, which leaves no control string and is undone by taking one away. Roles escape backslashes and line ends besides. The
loss mask covers the texts of assistants, without marks.

*Output.* Turns are range-sorted by (conv_id, turn), so a conversation of any length is spread over tasks, and written as
pieces of whole turns of about ``PIECE_CHARS``; the pieces of a conversation in order are its text. ``read_turns`` reads pieces
back by the template alone. Only ``digests`` needs a conversation in one task, as a hash has no other way; it streams.

Defined results: a null text is empty, a null role too, a null record has no turns. A text that is no JSON object, or whose
fingerprint no mapping takes, has none either and is counted by ``layouts``. Turns of rows are ordered by turn (null first), ties by a
hash of role and text; repeated rows are repeated turns. Rows without conv_id form a conversation of their own. Of values
that are no text, content lists give the texts of their parts, one after the other; others are written as JSON. Very long texts
are one row in one task. Empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import shuffle_partitions

START, END = "<|im_start|>", "<|im_end|>"
PIECE_CHARS = 1 << 20
ASSISTANT = "assistant"
#: Fingerprints whose mapping a task remembers
REMEMBERED = 10_000

# Names of roles in public chat layouts, and the canonical ones.
ROLES = {
    "human": "user",
    "prompter": "user",
    "gpt": "assistant",
    "bot": "assistant",
    "model": "assistant",
    "chatgpt": "assistant",
}


@dataclass(frozen=True)
class Mapping:
    """Where records of a layout keep their turns.

    ``requires`` are field paths, with or without kind. With ``each`` the turns are the elements of that list, and
    ``role`` and ``text`` are fields of an element; with ``columns`` each (path, role) is a turn if the path
    has a text; otherwise the record is one turn, whose number is at ``turn``. Several paths joined by ``+`` are
    joined by a blank line. ``exact`` keeps roles as they are.
    """

    name: str
    requires: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    columns: tuple[tuple[str, str], ...] = ()
    exact: bool = False


# The layouts known; a caller may pass others.
MAPPINGS = (
    Mapping("rows", ("turn:n", "role"), role="role", text="text", turn="turn", exact=True),
    Mapping("row_text", ("turn:n", "text"), role="role", text="text", turn="turn", exact=True),
    Mapping("messages", ("messages[].role", "messages[].content"), each="messages", role="role", text="content"),
    Mapping("shared", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value"),
    Mapping("dialogue", ("turns[].speaker", "turns[].text"), each="turns", role="speaker", text="text"),
    Mapping("nested", ("data.messages[].role", "data.messages[].content"), each="data.messages", role="role", text="content"),
    Mapping("instruction", ("instruction", "output"), columns=(
        ("system", "system"), ("instruction+input", "user"), ("output", "assistant"))),
    Mapping("prompt_response", ("prompt", "response"), columns=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt_completion", ("prompt", "completion"), columns=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question_answer", ("question", "answer"), columns=(
        ("system_prompt", "system"), ("context+question", "user"), ("answer", "assistant"))),
)

TURNS = "conv_id bigint, turn bigint, role string, text string"


def field_paths(record) -> set[str]:
    """Nested field paths of a JSON value, each with its kind: n number, s text, b truth value, 0 null."""
    paths: set[str] = set()
    stack = [("", record)]
    while stack:
        at, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{at}.{k}" if at else k, v) for k, v in value.items())
        elif isinstance(value, list):
            stack.extend((f"{at}[]", v) for v in value)
        else:
            kind = "s" if isinstance(value, str) else "b" if isinstance(value, bool) else "0" if value is None else "n"
            paths.add(f"{at}:{kind}")
    return paths


def fingerprint(paths: set[str]) -> int:
    """A hash of 63 bits of the sorted field paths."""
    digest = hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little") >> 1


def choose(paths: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The first mapping all of whose required paths occur."""
    bare = {p.rpartition(":")[0] for p in paths}
    lists = {p[: i] for p in bare for i in range(len(p)) if p[i: i + 2] == "[]" or p[i] == "."}  # content lists count, too
    return next((m for m in mappings if all(r in paths or r in bare or r in lists for r in m.requires)), None)


def _at(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, list):
        return "".join(_text(p.get("text") if isinstance(p, dict) else p) for p in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _clean(text: str) -> str:
    """JSON can name halves of surrogate pairs, which are no text."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def turns_of(record, mapping: Mapping) -> Iterator[tuple[int | None, str, str]]:
    """(turn, role, text) of the record by the mapping."""
    if mapping.columns:
        n = 0
        for path, role in mapping.columns:
            parts = [_text(_at(record, p)) for p in path.split("+")]
            if any(_at(record, p) is not None for p in path.split("+")):
                yield n, role, _clean("\n\n".join(p for p in parts if p))
                n += 1
        return
    elements = _at(record, mapping.each) if mapping.each else [record]
    for n, element in enumerate(elements if isinstance(elements, list) else []):
        role = _text(_at(element, mapping.role))
        number = _at(element, mapping.turn) if mapping.turn else n
        yield (number if isinstance(number, int) and abs(number) < 1 << 63 else None,
               _clean(role if mapping.exact else ROLES.get(role.lower(), role.lower())), _clean(_text(_at(element, mapping.text))))


def _parsed(batches: Iterator[pa.RecordBatch], mappings: tuple[Mapping, ...]):
    """(conv_id, record, fingerprint, mapping) of each row; the fingerprint of what is no JSON object is -1."""
    known: dict[int, Mapping | None] = {}
    for batch in batches:
        for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("record")):
            try:
                record = json.loads(line.as_py() or "")
            except (ValueError, RecursionError):
                record = None
            if not isinstance(record, dict):
                yield conv_id, None, -1, None
                continue
            paths = field_paths(record)
            mark = fingerprint(paths)
            if mark not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[mark] = choose(paths, mappings)
            yield conv_id, record, mark, known[mark]


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns (conv_id, turn, role, text) of records (conv_id, record); a record is a JSON text of any layout mapped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for conv_id, record, _, mapping in _parsed(batches, mappings):
            for turn, role, text in turns_of(record, mapping) if mapping else ():
                rows.append((conv_id, turn, role, text))
                size += len(text) + 100
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows)

    return _records(records).mapInArrow(run, TURNS)


def layouts(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(fingerprint, mapping, n_records, first_record): which layouts occur; the mapping of unknown ones is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(mark, *row) for mark, row in seen.items()]
            seen.clear()
            columns = list(zip(*rows)) if rows else [[]] * 4
            return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                                    pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                                   names=["fingerprint", "mapping", "n", "first"])
        for conv_id, _, mark, mapping in _parsed(batches, mappings):
            row = seen.setdefault(mark, [mapping.name if mapping else None, 0, None])
            row[1] += 1
            row[2] = conv_id if row[2] is None else row[2] if conv_id is None else min(row[2], conv_id)
            if len(seen) >= REMEMBERED:
                yield flush()
        yield flush()

    return _records(records).mapInArrow(run, "fingerprint bigint, mapping string, n bigint, first bigint").groupBy(
        "fingerprint", "mapping").agg(F.sum("n").alias("n_records"), F.min("first").alias("first_record"))


def _records(records: DataFrame) -> DataFrame:
    return records.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("record").cast("string").alias("record"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "turn", "role", "text"])


# --- template ------------------------------------------------------------------------------------

def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    """Takes away the backslash that ``escaped`` put in."""
    out, at = [], 0
    found = text.find("<\\")
    while found >= 0:
        end = found + 1
        while end < len(text) and text[end] == "\\":
            end += 1
        if end < len(text) and text[end] == "|":
            out.append(text[at: found + 1])
            at = found + 2
        found = text.find("<\\", end)
    return "".join([*out, text[at:]]) if out else text


def unescape_role(role: str) -> str:
    out, at = [], 0
    role = unescape(role)
    while at < len(role):
        if role[at] == "\\" and at + 1 < len(role):
            out.append("\n" if role[at + 1] == "n" else role[at + 1])
            at += 2
        else:
            out.append(role[at])
            at += 1
    return "".join(out)


def formatted_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, tie, formatted text of each turn, and its loss mask: start and length in code points, null outside."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    body = escaped(text)
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.xxhash64(role, text).alias("tie"),
        F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
        F.when(role == ASSISTANT, F.length(head)).alias("loss_start"), F.when(role == ASSISTANT, F.length(body)).alias("loss_length"))


PIECES = "conv_id bigint, piece bigint, formatted string, loss_mask array<struct<start: bigint, length: bigint>>"


def pieces(turns: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces of the formatted conversations: conv_id, piece (ascending in a conversation), formatted, loss_mask."""
    order = ["conv_id", "turn", "tie"]
    n = shuffle_partitions(turns.sparkSession)
    dealt = formatted_turns(turns).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv, parts, size, mask, out, held = 0, None, [], 0, [], [], 0

        def cut() -> None:
            nonlocal parts, size, mask, held, number
            if parts:
                out.append((conv, part << 32 | number, "".join(parts), mask))
                held += size
                number += 1
            parts, size, mask = [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            columns = list(zip(*out)) if out else [[]] * 4
            out, held = [], 0
            mask_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                                    pa.array(columns[3], mask_type)], names=["conv_id", "piece", "formatted", "loss_mask"])
        part = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row_conv, _, _, text, start, length, part = (c[i].as_py() for c in batch.columns)
                if parts and (row_conv != conv or size + len(text) > piece_chars):
                    cut()
                    if held > 4 * piece_chars:
                        yield flush()
                conv = row_conv
                if start is not None:
                    mask.append({"start": size + start, "length": length})
                parts.append(text)
                size += len(text)
        cut()
        yield flush()

    return dealt.mapInArrow(run, PIECES)


def write(turns: DataFrame, directory: str) -> None:
    """Writes the formatted conversations as Parquet, range-sorted by conversation."""
    pieces(turns).write.parquet(directory)


def read_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(PIECES).parquet(directory)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a piece, by the template alone."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END + "\n", line)
        if not text.startswith(START, at):
            raise ValueError("a turn does not begin with its mark")
        yield unescape_role(text[at + len(START): line]), unescape(text[line + 1: end])
        at = end + len(END) + 1


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, piece, turn in the piece, role, text, read back from pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv_id, piece, text in zip(*(batch.column(c) for c in ("conv_id", "piece", "formatted"))):
                rows = [(conv_id.as_py(), piece.as_py(), n, role, body) for n, (role, body) in enumerate(parse(text.as_py()))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "piece", "turn", "role", "text"])

    return formatted.select("conv_id", "piece", "formatted").mapInArrow(run, "conv_id bigint, piece bigint, turn bigint, role string, text string")


DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: number and hash of its turns, length and hash of its text under the mask, length of its formatted text.

    One conversation is read by one task, piece by piece; two hash states are all that is held of it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 6
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                   names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> None:
            if state is not None:
                turns, chars, loss, total, turns_hash, loss_hash = state
                out.append((conv, turns, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), total))
        for batch in batches:
            for conv_id, text, mask in zip(*(batch.column(c) for c in ("conv_id", "formatted", "loss_mask"))):
                conv_id, text = conv_id.as_py(), text.as_py()
                if state is None or conv_id != conv:
                    close()
                    if len(out) >= 10_000:
                        yield flush()
                    conv, state = conv_id, [0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                for role, body in parse(text):
                    state[0] += 1
                    state[4].update(f"{role}\n{body}\n".encode())
                for span in mask.as_py():
                    loss = unescape(text[span["start"]: span["start"] + span["length"]])
                    state[1] += len(loss)
                    state[5].update(loss.encode())
                state[3] += len(text)
        close()
        yield flush()

    n = shuffle_partitions(formatted.sparkSession)
    return formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, DIGESTS)
