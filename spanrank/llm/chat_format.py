"""Chat formatting by event-sourced reconstruction.

A log is a table of events (conv_id, turn, seq, kind, role, text).  Events are
partitioned by conversation, sorted by (turn, seq) and folded one after the
other: a task holds the message at hand, never a whole conversation, so one
conversation may be of any length.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, parts

#: Control strings of the template and of well-known others; none of them survives inside a text.
CONTROL = ("<|turn|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?=(?:{_TAILS}))")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?=(?:{_TAILS}))")
_MARKED = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Text with a backslash after the first character of every control string (one more where some stand)."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role_out(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render_message(role: str, text: str) -> str:
    return f"<|turn|>{_role_out(role)}\n{escape(text)}<|end|>\n"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each message; start and end bound the escaped text in ``rendered``."""
    return [(_role_in(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _MARKED.finditer(rendered)]


def fold(events):
    """Final messages (conv, turn, role, text) of events in order (conv, turn, seq).

    message: a whole message; delta: text added to the open message, which it
    opens if need be; edit: new text for it; regenerate: the open message is
    emptied, and what later turns had said before its seq is void; delete:
    it goes.  Other kinds and null kinds count as message.  edit, regenerate
    and delete without an open message open an empty one (delete: none).
    """
    conv = turn = None
    role, text, open_, started = "", [], False, False
    void = None  # seq up to which events of later turns are void
    pending = None
    for c, t, seq, kind, r, x in events:
        if not started or c != conv or t != turn:
            if open_:
                yield conv, turn, role, "".join(text)
            void = (void if pending is None else pending if void is None else max(void, pending)) if started and c == conv else None
            pending = None
            conv, turn, role, text, open_, started = c, t, "", [], False, True
        if void is not None and seq is not None and seq <= void:
            continue
        x = x or ""
        if kind == "delta":
            role, open_ = role if open_ and not r else (r or ""), True
            text.append(x)
        elif kind == "edit":
            role, text, open_ = role if open_ and not r else (r or ""), [x], True
        elif kind == "regenerate":
            role, text, open_ = role if open_ and not r else (r or ""), [x], True
            pending = seq if pending is None or (seq is not None and seq > pending) else pending
        elif kind == "delete":
            text, open_ = [], False
        else:
            if open_:
                yield conv, turn, role, "".join(text)
            role, text, open_ = r or "", [x], True
    if open_:
        yield conv, turn, role, "".join(text)


def _ordered(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "seq", "kind", "role", "text")))


def _sorted_events(events: DataFrame) -> DataFrame:
    cols = [F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("seq", "long"), ("kind", "string"), ("role", "string"), ("text", "string"))]
    return events.select(*cols).repartition(parts(events.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text")


def render(events: DataFrame, flush: int = 1 << 20) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss): the rendered conversations.

    A conversation is one row; where it is longer than ``flush`` characters it
    goes on in further parts, each of whole messages, so that no row outgrows
    memory.  loss has the (start, end) of assistant texts in ``formatted``, in
    code points.  Null roles and texts are empty; null turns come first; rows
    equal in every column are separate messages.  No events: no rows.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", span)])

    def run(batches):
        rows, held = [], 0
        conv, part, n, text, size, loss = None, 0, 0, [], 0, []

        for c, _, role, x in fold(_ordered(batches)):
            if n and (c != conv or size > flush):
                rows.append((conv, part, n, "".join(text), loss))
                held += size
                part = part + 1 if c == conv else 0
                n, text, size, loss = 0, [], 0, []
                if held > flush:
                    yield arrow_batch(schema, [list(k) for k in zip(*rows)])
                    rows, held = [], 0
            conv = c
            piece = render_message(role, x)
            if role == "assistant":
                loss.append({"start": size + piece.index("\n") + 1, "end": size + len(piece) - len("<|end|>\n")})
            text.append(piece)
            size += len(piece)
            n += 1
        if n:
            rows.append((conv, part, n, "".join(text), loss))
        if rows:
            yield arrow_batch(schema, [list(k) for k in zip(*rows)])

    return _sorted_events(events).mapInArrow(run, "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def digest(rendered: DataFrame) -> DataFrame:
    """One row for each conversation with what is read back from its rendered parts."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        now, started, state, rows = None, False, None, []

        def close():
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, formatted, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                if not started or conv != now:
                    if started:
                        close()
                    now, started, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in loss:
                    text = unescape(formatted[s["start"] : s["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            if len(rows) > 2000:
                yield arrow_batch(schema, [list(k) for k in zip(*rows)])
                rows.clear()
        if started:
            close()
        if rows:
            yield arrow_batch(schema, [list(k) for k in zip(*rows)])

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(conversations: DataFrame) -> DataFrame:
    """A plain table of turns as a log: every row is one whole message."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")
