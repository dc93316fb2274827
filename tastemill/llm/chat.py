"""Chat formatting of records whose layout is recognised by their schema.

A record is a JSON object of unknown layout. The paths of its nested fields are
hashed to a fingerprint, which selects a declarative mapping; the mapping says
where the turns are and what their roles are. Turns are then written in one
template, with control strings inside texts escaped, and read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import stored

# Fixed by the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
# A conversation longer than this is written in several rows.
PART_CHARS = 1_000_000


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``fixed`` lists (role, path) pairs, one turn each, of which those in
    ``optional`` are left out where empty; ``turns`` names an array and, in it,
    the paths of role and text. ``order`` is the path of the turn's number in
    records that hold one turn each. ``paths`` are the sets of field paths by
    which the layout is known.
    """

    name: str
    paths: tuple[tuple[str, ...], ...]
    fixed: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    turns: tuple[str, str, str] | None = None
    single: tuple[str, str] | None = None
    order: str | None = None


LAYOUTS = (
    Layout("turn", (("role", "text", "turn"),), single=("role", "text"), order="turn"),
    Layout("prompt_response", (("prompt", "response"),), (("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", (("completion", "prompt"),), (("user", "prompt"), ("assistant", "completion"))),
    Layout(
        "system_prompt_response",
        (("prompt", "response", "system"),),
        (("system", "system"), ("user", "prompt"), ("assistant", "response")),
        ("system",),
    ),
    Layout(
        "instruction",
        (("input", "instruction", "output"), ("instruction", "output")),
        (("user", "instruction"), ("user", "input"), ("assistant", "output")),
        ("input",),
    ),
    Layout("messages", (("messages[].content", "messages[].role"), ("messages",)), turns=("messages", "role", "content")),
    Layout("from_value", (("conversations[].from", "conversations[].value"), ("conversations",)), turns=("conversations", "from", "value")),
    Layout(
        "author_parts",
        (("mapping.turns[].author.role", "mapping.turns[].content.text"),),
        turns=("mapping.turns", "author.role", "content.text"),
    ),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all leaves; the elements of an array share one path, ``name[]``."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value))
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    return {fingerprint(paths): layout for layout in layouts for paths in layout.paths}


def at_path(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def as_text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of a record, in order."""
    if layout.single:
        found = [tuple(at_path(record, p) for p in layout.single)]
    elif layout.turns:
        array, role, text = layout.turns
        found = [(at_path(t, role), at_path(t, text)) for t in at_path(record, array) or []]
    else:
        found = [
            (role, at_path(record, path))
            for role, path in layout.fixed
            if path not in layout.optional or at_path(record, path)
        ]
    return [(ROLES.get(as_text(r), as_text(r)), as_text(t)) for r, t in found]


TURNS = "conv_id long, seq long, sub long, role string, text string, layout string, fingerprint string"


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Turns of records ``(conv_id, record)``, ordered by ``seq`` and ``sub``.

    ``seq`` is the turn's number where records hold one turn each, else 0. A
    record that is null, no JSON or of unknown layout gives one row with a null
    role and layout and the whole record as text, so nothing is lost.
    """
    known = registry(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, raw in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mark = fingerprint(field_paths(record))
                layout = known.get(mark)
                if layout is None:
                    rows.append((conv, 0, 0, None, raw, None, mark))
                    continue
                seq = at_path(record, layout.order) if layout.order else 0
                seq = seq if isinstance(seq, int) else 0
                for sub, (role, text) in enumerate(turns_of(record, layout)):
                    rows.append((conv, seq, sub, role, text, layout.name, mark))
            kinds = [pa.int64()] * 3 + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                names=[c.split()[0] for c in TURNS.split(", ")],
            )

    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(run, TURNS)


def escape(text: str) -> str:
    """Text without control strings: backslashes are doubled, ``<|`` is taken apart."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def escape_role(role: str) -> str:
    """A role also ends at the line end."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], role)


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation together and in order; texts break ties, so reruns agree."""
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *order)


FORMATTED = "conv_id long, part long, formatted string, loss array<struct<start:long,stop:long>>"


def formatted(turns: DataFrame) -> DataFrame:
    """Conversations in the template, with the spans (code points) that count for the loss.

    ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn; the assistants' texts are
    the loss spans. A conversation is one row, unless it is longer than
    ``PART_CHARS``; then it goes on in further rows, cut between turns. Turns
    stream through a task in order, so a conversation of any length is never
    held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, part, pieces, spans, size = None, 0, [], [], 0
        done: list[tuple] = []

        def close() -> None:
            if pieces:
                done.append((current[0], part, "".join(pieces), [dict(start=a, stop=b) for a, b in spans]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(span)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                names=["conv_id", "part", "formatted", "loss"],
            )

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if current != (conv,):
                    close()
                    current, part, pieces, spans, size = (conv,), 0, [], [], 0
                elif size >= PART_CHARS:
                    close()
                    part, pieces, spans, size = part + 1, [], [], 0
                head, body = f"{OPEN}{escape_role(role or '')}\n", escape(text or "")
                if role == "assistant":
                    spans.append((size + len(head), size + len(head) + len(body)))
                pieces.append(f"{head}{body}{CLOSE}\n")
                size += len(pieces[-1])
            if done:
                yield batch_of(done)
                done.clear()
        close()
        if done:
            yield batch_of(done)

    ordered = _ordered(turns.select("conv_id", "seq", "sub", "role", "text"), "seq", "sub", "role", "text")
    return ordered.mapInArrow(run, FORMATTED)


_TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long"
)


def digests(output: DataFrame) -> DataFrame:
    """What the formatted rows of each conversation hold, read back from them alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, loss, counts = None, None, None, [0, 0, 0]
        done: list[tuple] = []

        def close() -> None:
            if current is not None:
                n, masked, size = counts
                done.append((current[0], n, turns.hexdigest(), masked, loss.hexdigest(), size))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                names=[c.split()[0] for c in DIGESTS.split(", ")],
            )

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if current != (conv,):
                    close()
                    current, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, body in parsed(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    counts[0] += 1
                for span in spans:
                    body = unescape(text[span["start"] : span["stop"]])
                    loss.update(body.encode())
                    counts[1] += len(body)
                counts[2] += len(text)
            if done:
                yield batch_of(done)
                done.clear()
        close()
        if done:
            yield batch_of(done)

    return _ordered(output, "part").mapInArrow(run, DIGESTS)


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as records of the ``turn`` layout."""
    options = {"ignoreNullFields": "false"}
    return conversations.select("conv_id", F.to_json(F.struct("turn", "role", "text"), options).alias("record"))


def round_trip(records: DataFrame) -> DataFrame:
    """Recognise, format, write, read back and digest all records.

    Null texts are empty, a null role is an empty role, rows without a
    conversation id form one conversation, repeated rows are turns of their own
    and turns with one number are ordered by role and text. Records of unknown
    layout are turns without a role. An empty table gives no rows.
    """
    return digests(stored(formatted(canonical(records)), "formatted"))
