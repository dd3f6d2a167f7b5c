"""Chat formatting: a fingerprint of nested field paths selects the mapping to canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """How records with just these field paths become turns.

    ``turns`` lists (role, path) for records of single fields, where a role that starts with "=" is a constant;
    for a list of turns it holds one (role path, text path) below ``each``.  Rows of turns have a ``turn`` path.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str | None = None
    turn: str | None = None

    @property
    def key(self) -> str:
        return fingerprint(self.paths)


LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn"), (("role", "text"),), turn="turn"),
    Layout("messages", ("messages[].content", "messages[].role"), (("role", "content"),), each="messages"),
    Layout("from and value", ("conversations[].from", "conversations[].value"), (("from", "value"),), each="conversations"),
    Layout("system and messages", ("messages[].content", "messages[].role", "system"), (("=system", "system"), ("role", "content")), each="messages"),
    Layout("instruction", ("instruction", "output"), (("=user", "instruction"), ("=assistant", "output"))),
    Layout("instruction with input", ("input", "instruction", "output"), (("=user", "instruction+input"), ("=assistant", "output"))),
    Layout("prompt", ("prompt", "response"), (("=user", "prompt"), ("=assistant", "response"))),
    Layout("prompt and completion", ("completion", "prompt"), (("=user", "prompt"), ("=assistant", "completion"))),
    Layout("question", ("answer", "question"), (("=user", "question"), ("=assistant", "answer"))),
)
BY_KEY = {x.key: x for x in LAYOUTS}
#: The only paths that count for a fingerprint; other fields are extra columns.
KNOWN_PATHS = frozenset(p for x in LAYOUTS for p in x.paths)
#: Names of roles in other layouts (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Leaf paths of a Spark type; [] stands for the items of an array."""
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            yield from schema_paths(field.dataType, f"{at}.{field.name}" if at else field.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def value_paths(value, at: str = "") -> Iterator[str]:
    """Leaf paths of a JSON value."""
    if isinstance(value, dict):
        for name, x in value.items():
            yield from value_paths(x, f"{at}.{name}" if at else name)
    elif isinstance(value, list):
        for x in value:
            yield from value_paths(x, f"{at}[]")
    else:
        yield at


def layout_of(paths) -> Layout | None:
    return BY_KEY.get(fingerprint(set(paths) & KNOWN_PATHS))


def canonical_role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    for name, meant in ROLES.items():
        role = F.when(role == name, meant).otherwise(role)
    return role


def joined_fields(path: str) -> Column:
    """Fields of one turn, those that are not empty on lines of their own."""
    return F.concat_ws("\n", *[F.when(F.col(p) != "", F.col(p)) for p in path.split("+")])


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table whose schema's fingerprint is known; other tables raise ValueError."""
    found = layout_of(schema_paths(df.schema))
    if found is None:
        raise ValueError(f"no layout for the paths {sorted(set(schema_paths(df.schema)))}")
    conv = F.col(id_col).cast("long").alias("conv_id")
    if found.turn:
        role, text = found.turns[0]
        return df.select(conv, F.col(found.turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = [F.array(F.struct(F.lit(role[1:]).alias("role"), joined_fields(path).alias("text"))) for role, path in found.turns if role[0] == "="]
    if found.each:
        role, text = found.turns[-1]
        items.append(F.transform(F.coalesce(F.col(found.each), F.array()), lambda x: F.struct(canonical_role(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))))
    return df.select(conv, F.posexplode(F.concat(*items)).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def record_turns(record) -> list[tuple[str, str]] | None:
    """Turns (role, text) of one JSON record, or None if no layout has its fingerprint."""
    found = layout_of(value_paths(record)) if isinstance(record, dict) else None
    if found is None or found.turn:
        return None
    say = lambda x: "" if x is None else str(x)
    out = [(role[1:], "\n".join(x for p in path.split("+") if (x := say(record.get(p))))) for role, path in found.turns if role[0] == "="]
    if found.each:
        role, text = found.turns[-1]
        out += [(ROLES.get(say(x.get(role)), say(x.get(role))), say(x.get(text))) for x in record[found.each] if isinstance(x, dict)]
    return out


def canonical_json_turns(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of JSON records whose layouts differ row by row.

    A record that is null, not JSON or of an unknown layout gives one row with a null turn and its raw text, so
    that nothing is lost silently.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    turns = record_turns(json.loads(raw or ""))
                except ValueError:
                    turns = None
                out += [(conv, None, None, raw)] if turns is None else [(conv, i, r, t) for i, (r, t) in enumerate(turns)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "role", "text"])

    return df.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, "conv_id long, turn long, role string, text string")


#: Marks of the template, in the order of their numbers in escapes (fixed values).
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
MARK = re.compile("|".join(map(re.escape, MARKS)))
ESCAPED = re.compile(r"\\(?:\\|m(\d+);)")
#: Opening and closing marks of the roles that have their own.
FRAMES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}


def escaped(text: str) -> str:
    """``text`` without marks: a backslash is doubled, a mark becomes backslash, m, its number and a semicolon."""
    return MARK.sub(lambda m: f"\\m{MARKS.index(m.group())};", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" if m.group(1) is None else MARKS[int(m.group(1))], text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """One turn in the template, and where its loss mask starts and ends (equal: no loss)."""
    body = escaped(text)
    if role in FRAMES:
        left, right = FRAMES[role]
    else:
        left, right = f"<<ROLE>>{escaped(role)}<</ROLE>>[INST]", "[/INST]"
    start = len(left)
    return left + body + right, start, start + len(body) if role == "assistant" else start


def parsed(segment: str) -> tuple[str, str]:
    """(role, text) of one formatted turn; formatted() undone."""
    for role, (left, right) in FRAMES.items():
        if segment.startswith(left):
            return role, unescaped(segment[len(left) : -len(right)])
    head, _, body = segment.removeprefix("<<ROLE>>").partition("<</ROLE>>")
    return unescaped(head), unescaped(body.removeprefix("[INST]").removesuffix("[/INST]"))


def format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [formatted(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True))],
            names=["conv_id", "turn", "formatted", "loss_start", "loss_end"],
        )


def write_chats(turns: DataFrame, out: str) -> None:
    """Format (conv_id, turn, role, text) into the folder ``out``: a row for each turn, (conv_id, turn,
    formatted, loss_start, loss_end); a conversation is its rows by turn, joined by nothing.  No shuffle."""
    rows = turns.select("conv_id", "turn", "role", "text").mapInArrow(format_rows, "conv_id long, turn long, formatted string, loss_start long, loss_end long")
    rows.write.option("compression", "zstd").parquet(out)


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; one conversation is hashed as it streams by, whatever its length."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, state, out = None, None, []

    def close() -> None:
        if state:
            out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (conv,):
                close()
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parsed(segment)
            loss = unescaped(segment[start:end])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(segment)
        if len(out) >= 1000:
            yield flush()
    close()
    yield flush()


def read_chats(spark, out: str) -> DataFrame:
    """Digests of the conversations in ``out``, from the formatted text alone."""
    rows = spark.read.schema("conv_id long, turn long, formatted string, loss_start long, loss_end long").parquet(out)
    dealt = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss_start", "loss_end")
    return dealt.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(df: DataFrame) -> DataFrame:
    """Bring ``df`` to canonical turns by its fingerprint, write the formatted chats and read them back.

    Every row is a turn: null texts and roles are empty, null turns come first, equal turn numbers are ordered
    by their formatted text, rows without a conv_id form one conversation.  Extra columns are ignored.  An empty
    table gives an empty result.
    """
    out = new_path(df.sparkSession, "chats")
    write_chats(canonical_turns(df), out)
    return read_chats(df.sparkSession, out)
