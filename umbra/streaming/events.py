"""Server-sent events of model responses: framing, and restoring placeholders in their deltas.

Each interface says which fields of an event are pieces of which text streams, and when a stream
ends.  Fields that belong to no stream are restored in place; signed reasoning stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.walk import DIALECTS, Dialect, Number, Walk, decode, encode, restore_text
from ..sources.tables import extended
from . import chunks



@dataclass
class Event:
    lines: list[str] = field(default_factory=list)
    value: dict | None = None
    changed: bool = False

    @property
    def data(self) -> str:
        return "\n".join(x[5:].removeprefix(" ") for x in self.lines if x.startswith("data:"))

    def text(self) -> str:
        if not self.changed:
            return "\n".join(self.lines) + "\n\n"
        others = [x for x in self.lines if not x.startswith("data:")]
        return "\n".join([*others, f"data: {encode(self.value)}"]) + "\n\n"


def parse(body: str) -> Iterator[Event]:
    """Events of a stream; one that its end cuts short counts."""
    lines: list[str] = []
    for line in [*(x.rstrip("\r") for x in body.split("\n")), ""]:
        if line:
            lines.append(line)
        elif lines:
            event = Event(lines)
            if any(x.startswith("data:") for x in lines):
                try:
                    value = decode(event.data)
                    event.value = value if isinstance(value, dict) else None
                except ValueError:
                    pass
            yield event
            lines = []


@dataclass
class Stream:
    escaped: bool
    made: Callable[[str], Event]
    pending: str = ""


class Session:
    """The state of one response: its open streams in the order of opening, and its id."""

    def __init__(self, dialect: Dialect, values: dict[str, str]):
        self.dialect, self.values = dialect, values
        self.open: dict[str, Stream] = {}
        self.response_id: str | None = None

    def feed(self, name: str, text: str, escaped: bool, made: Callable[[str], Event]) -> str:
        s = self.open.setdefault(name, Stream(escaped, made))
        out, s.pending = chunks.feed(s.pending, text, self.values, s.escaped)
        return out

    def rest(self, name: str) -> str:
        s = self.open.pop(name, None)
        return chunks.flush(s.pending, self.values, s.escaped) if s else ""

    def end(self, name: str) -> list[Event]:
        s = self.open.get(name)
        rest = self.rest(name)
        return [s.made(rest)] if s and rest else []

    def end_all(self, prefix: str = "") -> list[Event]:
        return [e for name in list(self.open) if name.startswith(prefix) for e in self.end(name)]

    def in_place(self, event: Event, streamed: list[tuple[dict, str]] = ()) -> None:
        """Restore all of an event's strings but the ``streamed`` fields, which have been seen to."""
        if event.value is None or "[REDACTED_" not in event.data:
            return
        kept = [(owner, key, owner.pop(key)) for owner, key in streamed]
        d = self.dialect
        encoded = lambda path: path.rpartition(".")[2] in d.encoded_keys
        Walk(d, lambda v: restore_text(v.text, self.values, encoded(v.path)), inside=False)(event.value)
        for owner, key, text in kept:
            owner[key] = text
        event.changed = True

    def handle(self, event: Event) -> list[Event]:
        return HANDLERS[self.dialect.name](self, event)


def _put(event: Event, owner: dict, key: str, text: str) -> None:
    if owner[key] != text:
        owner[key] = text
        event.changed = True


def messages(session: Session, event: Event) -> list[Event]:
    value = event.value
    if value is None:
        return [event]
    index, kind = value.get("index"), value.get("type")
    name = f"block:{index}"
    if kind == "content_block_stop":
        return [*session.end(name), event]
    delta = value.get("delta") if kind == "content_block_delta" else None
    delta = delta if isinstance(delta, dict) else {}
    part = {"text_delta": "text", "input_json_delta": "partial_json"}.get(str(delta.get("type")))
    if part:
        made = lambda rest: Event(["event: content_block_delta"], {"type": "content_block_delta", "index": index, "delta": {"type": delta["type"], part: rest}}, True)
        text = delta[part] if isinstance(delta.get(part), str) else ""
        out = session.feed(name, text, part == "partial_json", made)
        if out != text:
            delta[part] = out
            event.changed = True
    elif delta.get("type") not in ("thinking_delta", "signature_delta"):
        session.in_place(event)
    return [event]


def chat(session: Session, event: Event) -> list[Event]:
    value = event.value
    if value is None:
        return [*session.end_all(), event] if event.data.strip() == "[DONE]" else [event]
    envelope = {k: v for k, v in value.items() if k not in ("choices", "usage")}
    before: list[Event] = []
    streamed: list[tuple[dict, str]] = []
    at = lambda x, place: str(x["index"]) if x.get("index") is not None else str(place)
    choices = value.get("choices")
    for place, choice in enumerate(choices if isinstance(choices, list) else []):
        if not isinstance(choice, dict):
            continue
        number, last = at(choice, place), choice.get("finish_reason") is not None

        def chunk(delta: dict, number: str = number) -> Event:
            return Event([], envelope | {"choices": [{"index": Number(number), "delta": delta, "finish_reason": None}]}, True)

        delta = choice.get("delta") if isinstance(choice.get("delta"), dict) else {}
        parts = [(delta, k, f"c:{number}:{k}", False, lambda rest, k=k: chunk({k: rest})) for k in ("content", "reasoning_content", "reasoning")]
        calls = delta.get("tool_calls")
        for j, call in enumerate(calls if isinstance(calls, list) else []):
            function = call.get("function") if isinstance(call, dict) else None
            if isinstance(function, dict):
                n = at(call, j)
                parts.append((function, "arguments", f"c:{number}:tool:{n}", True, lambda rest, n=n: chunk({"tool_calls": [{"index": Number(n), "function": {"arguments": rest}}]})))
        for owner, key, name, escaped, made in parts:
            if isinstance(owner.get(key), str):
                out = session.feed(name, owner[key], escaped, made)
                _put(event, owner, key, out + session.rest(name) if last else out)
                streamed.append((owner, key))
        if last:
            before += session.end_all(f"c:{number}:")
    session.in_place(event, streamed)
    return [*before, event]


def responses(session: Session, event: Event) -> list[Event]:
    value = event.value
    if value is None:
        return [event]
    kind = str(value.get("type") or "")
    text_name, call_name = f"o:{value.get('output_index')}:{value.get('content_index')}", f"f:{value.get('output_index')}"
    streams = {"response.output_text": (text_name, False), "response.function_call_arguments": (call_name, True)}
    name, escaped = streams.get(kind.rpartition(".")[0], (None, False))
    if name and kind.endswith(".delta") and isinstance(value.get("delta"), str):
        labelled = any(not x.startswith("data:") for x in event.lines)
        made = lambda rest: Event([f"event: {kind}"] if labelled else [], value | {"delta": rest}, True)
        _put(event, value, "delta", session.feed(name, value["delta"], escaped, made))
        session.in_place(event, [(value, "delta")])
        return [event]
    before = session.end(name) if name and kind.endswith(".done") else []
    inner = value.get("response")
    if isinstance(inner, dict) and isinstance(inner.get("id"), str) and inner["id"] and session.response_id is None:
        session.response_id = inner["id"]
    if not kind.startswith("response.reasoning"):
        session.in_place(event)
    return [*before, event]


HANDLERS = {"anthropic-messages": messages, "openai-chat": chat, "openai-responses": responses}


def register_handler(dialect: str, handler: Callable[[Session, Event], list[Event]]) -> None:
    """Say how a dialect's events are restored."""
    HANDLERS[dialect] = handler


def restore(body: str, values: dict[str, str], dialect: Dialect) -> tuple[str, str | None]:
    """A whole event stream restored, and the response's id if it says one."""
    session = Session(dialect, values)
    out = [e.text() for event in parse(body) for e in session.handle(event)]
    return "".join([*out, *(e.text() for e in session.end_all())]), session.response_id


def restore_streams(streams: DataFrame, key: str, dialect: str, body: str = "body", values: str = "values") -> DataFrame:
    """(key, restored, response_id) for event streams that carry their vault as a map from placeholder to value."""
    schema = extended(streams.select(key).schema, "restored string, response_id string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, None) if b is None else restore(b, dict(v or []), DIALECTS[dialect]) for b, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=[key, "restored", "response_id"])

    return streams.select(key, body, values).mapInArrow(run, schema)
