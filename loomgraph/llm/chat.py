"""Chat formatting by schema fingerprints.

The nested field paths of a record (or of a table's schema) that any known layout uses are hashed; the
hash selects a declarative mapping, and the mapping turns the record into canonical turns (conversation,
position, role, text). Turns become segments of one template, one row each, so a conversation of any
length is formatted without gathering it; its formatted text is its segments in order.

Template: `### role: text</turn>` and a line feed. In texts and roles a backslash stands before each
backslash, `#` and `<` (in roles before `:` too), so no text can hold a control string, and reading back
is exact. The loss mask covers the text of each assistant turn.

Defined results: null texts and roles are empty; rows of equal turn number are ordered by role and text;
repeated rows are turns of their own; a null conversation id is a conversation; records of a layout that
no mapping knows give one row with a null role and the fingerprint, never an error, and so do texts that are no JSON
or are nested too deep to be read; halves of surrogate pairs become U+FFFD; texts of any length are kept whole;
an empty table gives an empty one; fields that no layout uses are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSISTANT = "assistant"
TURN_END = "</turn>\n"
#: Names that other layouts give to the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A mapping: `turns` lists, in order, what makes turns.

    A part is (role, field) for one text, or (list, role field, text field) for a list of messages.
    Several fields joined by "+" are put together with an empty line between, empty ones left out.
    A layout with `rows` keeps one turn in each row: (conversation, position, role, text).
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, ...], ...] = ()
    rows: tuple[str, str, str, str] | None = None


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), (("messages", "role", "content"),)),
    Layout("share", ("conversations[].from", "conversations[].value"), (("conversations", "from", "value"),)),
    Layout("share with system", ("system", "conversations[].from", "conversations[].value"), (("system", "system"), ("conversations", "from", "value"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("instruction", "input", "output"), (("user", "instruction+input"), ("assistant", "output"))),
    Layout("instruction with response", ("instruction", "context", "response"), (("user", "context+instruction"), ("assistant", "response"))),
    Layout("prompt", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt with response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Layout("question with system", ("system_prompt", "question", "response"), (("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
)


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


VOCABULARY = frozenset(p for x in LAYOUTS for p in x.paths)
BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def layout_of(paths) -> tuple[str, Layout | None]:
    """The fingerprint of the paths that layouts use, and its layout; else the largest layout within them, if it is the only one."""
    known = VOCABULARY.intersection(paths)
    mark = fingerprint(known)
    if mark in BY_FINGERPRINT:
        return mark, BY_FINGERPRINT[mark]
    inside = [x for x in LAYOUTS if known.issuperset(x.paths)]
    most = max((len(x.paths) for x in inside), default=0)
    largest = [x for x in inside if len(x.paths) == most]
    return mark, largest[0] if len(largest) == 1 else None


def record_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a parsed JSON value; list elements are written []."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{prefix}.{k}" if prefix else k)} or ({prefix} if prefix else set())
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix} if prefix else set()


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema, written as those of records."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix} if prefix else set()


def _string(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _joined(fields: str) -> Column:
    parts = F.array(*(_string(F.col(x)) for x in fields.split("+")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def _role(c: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.lower(c.cast("string"))), _string(c))


def _message_turns(messages: Column, role: str, text: str) -> Column:
    return F.transform(messages, lambda m: F.struct(_role(m[role]).alias("role"), _string(m[text]).alias("text")))


def canonical_turns(df: DataFrame, key: str | None = None) -> DataFrame:
    """Turns (conv_id, position, role, text) of a table, by the layout that its schema's fingerprint selects.

    `key` names the conversation where the layout keeps a whole conversation in a row. An unknown
    schema is an error here, as it holds for every row.
    """
    mark, layout = layout_of(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no mapping for the schema with fingerprint {mark}")
    if layout.rows:
        conv, at, role, text = layout.rows
        return df.select(F.col(conv).alias("conv_id"), F.col(at).cast("long").alias("position"), _string(F.col(role)).alias("role"), _string(F.col(text)).alias("text"))
    if key is None:
        raise ValueError("name the column that identifies a conversation")
    parts = []
    for part in layout.turns:
        if len(part) == 3:
            messages = F.coalesce(F.col(part[0]), F.array().cast(df.schema[part[0]].dataType))
            parts.append(_message_turns(messages, part[1], part[2]))
        else:
            parts.append(F.array(F.struct(F.lit(part[0]).alias("role"), _joined(part[1]).alias("text"))))
    turns = F.concat(*parts) if len(parts) > 1 else parts[0]
    return df.select(F.col(key).alias("conv_id"), F.posexplode(turns).alias("position", "_turn")).select("conv_id", F.col("position").cast("long").alias("position"), "_turn.role", "_turn.text")


_LONE = regex.compile(r"[\ud800-\udfff]")


def _text(value) -> str:
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _LONE.sub("\ufffd", text)  # half a surrogate pair is no character


def record_turns(record: dict, layout: Layout) -> Iterator[tuple[str, str]]:
    """(role, text) of a parsed record."""
    if layout.rows:
        yield _text(record.get(layout.rows[2])), _text(record.get(layout.rows[3]))
    for part in layout.turns:
        if len(part) == 3:
            for m in record[part[0]]:
                role = _text(m.get(part[1]))
                yield ROLES.get(role.lower(), role), _text(m.get(part[2]))
        else:
            yield part[0], "\n\n".join(x for f in part[1].split("+") if (x := _text(record.get(f))))


def canonical_records(df: DataFrame, record: str, key: str) -> DataFrame:
    """Turns of JSON records that may each have another layout: conv_id, position, role, text, fingerprint, layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x in enumerate(b.column(1).to_pylist()):
                try:
                    value = json.loads(x or "")
                    mark, layout = layout_of(record_paths(value)) if isinstance(value, dict) else ("", None)
                except (ValueError, RecursionError):  # no JSON, or nested deeper than any layout
                    mark, layout = "", None
                try:
                    turns = list(record_turns(value, layout)) if layout else [(None, None)]
                except (AttributeError, TypeError, RecursionError):  # a list that mixes messages with other values
                    turns, layout = [(None, None)], None
                rows += [(i, k, r, t, mark, layout.name if layout else None) for k, (r, t) in enumerate(turns)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(arrays[0]), *arrays[1:]], names=["conv_id", "position", "role", "text", "fingerprint", "layout"])

    kind = dict(df.dtypes)[key]
    return df.select(key, record).mapInArrow(run, f"conv_id {kind}, position long, role string, text string, fingerprint string, layout string")


def segments(turns: DataFrame) -> DataFrame:
    """turns and their formatted segments: segment, and the loss mask's loss_start and loss_length in it (code points)."""
    head = F.concat(F.lit("### "), F.regexp_replace("role", r"([\\#<:])", r"\\$1"), F.lit(": "))
    text = F.regexp_replace("text", r"([\\#<])", r"\\$1")
    return turns.withColumns(
        {
            "segment": F.concat(head, text, F.lit(TURN_END)),
            "loss_start": F.length(head).cast("long"),
            "loss_length": F.when(F.col("role") == ASSISTANT, F.length(text)).otherwise(0).cast("long"),
        }
    )


_SEGMENT = regex.compile(r"### ((?:[^\\#<:]|\\.)*+): ((?:[^\\#<]|\\.)*+)</turn>\n", regex.S)
_ESCAPED = regex.compile(r"\\(.)", regex.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; anything else in it is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def conversation_digests(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from its segments: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments of a conversation come in order to one task, which reads them as a stream and keeps only
    running hashes, so a conversation may be longer than memory. A digest of a whole conversation can't be
    put together from parts, so one conversation is the work of one task, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, started = None, None, False

        def batch(rows):
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            cols = list(zip(*rows, strict=True))
            kinds = (None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k or id_type) for c, k in zip(cols, kinds, strict=True)], names=names)

        def row():
            n, turns, chars, loss, size = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), size

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            done = []
            for k, part, at, length in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if not started or k != key:
                    if started:
                        done.append(row())
                    key, state, started = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, text in read_back(part):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(part[at : at + length])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(part)
            if done:
                yield batch(done)
        if started:
            yield batch([row()])

    kind = dict(parts.dtypes)["conv_id"]
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "position", "role", "text").select("conv_id", "segment", "loss_start", "loss_length")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
