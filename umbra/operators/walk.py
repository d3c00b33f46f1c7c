"""JSON request bodies: which strings are user data, in which order, and how they are put back.

A dialect is a table of policies.  ``leaves`` turns bodies into rows, a row a string to examine,
so that detection and numbering are DataFrame work; ``rebuild`` puts replaced strings back into
the body, every number as it was written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.patterns import PLACEHOLDER
from ..sources.tables import extended, written
from . import vault as V
from .detect import detect

NOTE = (
    "Parts of this conversation were exchanged for placeholders of the form [REDACTED_KIND_n] before it was sent. "
    "A placeholder always means the same value, which the user knows; write it down unchanged wherever the value is needed, "
    "in prose, code or tool calls, and it will be exchanged back. Do not ask for the value or treat it as missing."
)


@dataclass(frozen=True)
class Dialect:
    name: str
    note: str  # where the note goes: system, messages or instructions
    skip_keys: frozenset[str] = frozenset()
    skip_types: frozenset[str] = frozenset()
    skip_paths: tuple[tuple[str, ...], ...] = ()
    opaque_keys: frozenset[str] = frozenset()
    encoded_keys: frozenset[str] = frozenset()  # strings that hold JSON themselves
    first_keys: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    chain_key: str = ""


_keys = lambda text: frozenset(text.split())
# The policies of the three interfaces.
MESSAGES = Dialect(
    "anthropic-messages", "system", _keys("model type role id tool_use_id name media_type stop_reason stop_sequence cache_control signature"), _keys("thinking redacted_thinking base64"),
    (("tools", "*", "input_schema"),), _keys("input"), first_keys=("tools", "system", "messages"), dropped=("metadata",),
)
CHAT = Dialect(
    "openai-chat", "messages", _keys("model role type id tool_call_id name object finish_reason logprobs response_format prompt_cache_key service_tier system_fingerprint file_data"), _keys("input_audio"),
    (("tools", "*", "function", "parameters"),), encoded_keys=_keys("arguments"), first_keys=("tools", "messages"), dropped=("user", "safety_identifier", "metadata"),
)
RESPONSES = Dialect(
    "openai-responses", "instructions", _keys("model role type id call_id item_id name status object previous_response_id encrypted_content prompt_cache_key service_tier"), _keys("reasoning input_image input_file computer_screenshot"),
    (("tools", "*", "parameters"), ("text", "format", "schema")), encoded_keys=_keys("arguments"), first_keys=("tools", "instructions", "input"), dropped=("user", "safety_identifier", "metadata"), chain_key="previous_response_id",
)
DIALECTS = {d.name: d for d in (MESSAGES, CHAT, RESPONSES)}


def register_dialect(dialect: Dialect) -> Dialect:
    """Make a further dialect known by its name; ``streaming.events.register_handler`` adds its event streams."""
    DIALECTS[dialect.name] = dialect
    return dialect


def chain_ref(body: Column, dialect: Dialect) -> Column:
    """``struct<ref, ok>``: the id of the response that a request continues (null: none), and whether it is a text or not there at all."""
    if not dialect.chain_key:
        return F.struct(F.lit(None).cast("string").alias("ref"), F.lit(True).alias("ok"))
    value = F.variant_get(F.try_parse_json(body), f"$.{dialect.chain_key}", "variant")
    kind = F.schema_of_variant(value)
    none = value.isNull() | F.is_variant_null(value) | (kind == "VOID")
    return F.struct(F.when(~none & (kind == "STRING"), F.nullif(value.cast("string"), F.lit(""))).alias("ref"), (F.try_parse_json(body).isNotNull() & (none | (kind == "STRING"))).alias("ok"))


def response_id(body: Column) -> Column:
    """The id that a response's body says, null without one."""
    value = F.variant_get(F.try_parse_json(body), "$.id", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(value.cast("string"), F.lit("")))


class Number(str):
    """A number as it was written."""


def decode(body: str):
    """A JSON value with its numbers as text; anything behind it, or an unknown constant, is an error."""

    def refuse(name: str):
        raise ValueError(name)

    return json.loads(body, parse_float=Number, parse_int=Number, parse_constant=refuse)


def encode(value) -> str:
    """Compact, keys in order of their bytes, U+2028 and U+2029 escaped, numbers as written."""
    if isinstance(value, Number):
        return str.__str__(value)
    if isinstance(value, dict):
        return "{" + ",".join(encode_text(k) + ":" + encode(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(encode, value)) + "]"
    return encode_text(value) if isinstance(value, str) else json.dumps(value)


def encode_text(text: str) -> str:
    return json.dumps(text, ensure_ascii=False).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


@dataclass
class Visit:
    """One string on the way through a body."""

    path: str
    key: str
    opaque: bool
    encoded: bool
    text: str


@dataclass
class Walk:
    """``change`` gets each visited string and returns what takes its place (None: nothing changes)."""

    dialect: Dialect
    change: Callable[[Visit], str | None]
    inside: bool = True  # decode strings that hold JSON; else they are visited as text
    path: list[str] = field(default_factory=list)

    def __call__(self, value, opaque: bool = False, key: str = "", encoded: bool = False):
        if isinstance(value, dict):
            return self._object(value, opaque, encoded)
        if isinstance(value, list):
            self.path.append("*")
            value[:] = [self(v, opaque, "", encoded) for v in value]
            self.path.pop()
            return value
        if isinstance(value, str) and not isinstance(value, Number):
            new = self.change(Visit(".".join(self.path), key, opaque, encoded, value))
            return value if new is None else new
        return value

    def _object(self, value: dict, opaque: bool, encoded: bool):
        d = self.dialect
        if not opaque and isinstance(value.get("type"), str) and value["type"] in d.skip_types:
            return value
        first = [k for k in d.first_keys if k in value]
        for k in first + sorted(set(value).difference(first), key=lambda k: k.encode("utf-8", "surrogatepass")):
            child = value[k]
            parent = self.path[-1] if self.path else ""
            self.path.append(k)
            text = isinstance(child, str) and not isinstance(child, Number)
            image = text and k == "url" and child.startswith("data:") and (parent == "image_url" or parent == "source" and value.get("type") == "url")
            skipped = not opaque and (k in d.skip_keys or tuple(self.path) in d.skip_paths or image)
            if not skipped:
                if text and k in d.encoded_keys and self.inside:
                    value[k] = self._encoded(child)
                else:
                    value[k] = self(child, opaque or k in d.opaque_keys, k if opaque and text else "", encoded)
            self.path.pop()
        return value

    def _encoded(self, text: str) -> str:
        try:
            inner = decode(text)
        except ValueError:
            return self(text)
        changed = []
        keep, self.change = self.change, lambda v: (new := keep(v), changed.append(new is not None))[0]
        out = self(inner, True, "", True)
        self.change = keep
        return encode(out) if any(changed) else text


def _drop(body, dialect: Dialect):
    if isinstance(body, dict):
        for k in dialect.dropped:
            body.pop(k, None)
    return body


def leaves(requests: DataFrame, key: str, body: str = "body", dialect: Dialect = MESSAGES) -> DataFrame:
    """(key, ord, path, field, opaque, encoded, text): the strings of each body in visiting order; a body that is no JSON has none."""
    schema = extended(requests.select(key).schema, "ord int, path string, field string, opaque boolean, encoded boolean, text string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in arrow]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: list[Visit] = []
                try:
                    Walk(dialect, lambda v: found.append(v))(_drop(decode(text), dialect))
                except (ValueError, TypeError):
                    continue
                for i, v in enumerate(found):
                    for column, x in zip(out, (k, i, v.path, v.key, v.opaque, v.encoded, v.text)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return requests.select(key, body).mapInArrow(run, schema)


def add_note(body, dialect: Dialect):
    """The note, appended to what the dialect has for a system prompt; never without messages."""
    block = {"type": "text", "text": NOTE}
    joined = lambda s: s + "\n\n" + NOTE if s else NOTE
    if not isinstance(body, dict):
        return body
    if dialect.note == "messages":
        messages = body.get("messages")
        if isinstance(messages, list):
            head = messages[0] if messages and isinstance(messages[0], dict) and messages[0].get("role") in ("system", "developer") else {}
            content = head.get("content")
            if isinstance(content, list):
                head["content"] = [*content, block]
            elif isinstance(content, str):
                head["content"] = joined(content)
            else:
                body["messages"] = [{"role": "system", "content": NOTE}, *messages]
    elif dialect.note == "instructions" or "messages" in body:
        prompt = body.get(dialect.note)
        if prompt is None or isinstance(prompt, str) and not isinstance(prompt, Number):
            body[dialect.note] = joined(prompt or "")
        elif isinstance(prompt, list) and dialect.note == "system":
            body[dialect.note] = [*prompt, block]
    return body


def rebuild(requests: DataFrame, texts: DataFrame, key: str, body: str = "body", dialect: Dialect = MESSAGES, note: bool = True, out: str = "redacted_body") -> DataFrame:
    """``requests`` with the strings of ``texts(key, ord, new, hidden)`` put back in visiting order; ``hidden`` says that the vault holds something."""

    def work(text: str, strings: Iterator[str], hidden: bool) -> str | None:
        try:
            value = _drop(decode(text), dialect)
        except ValueError:
            return None
        # An unchanged string leaves an encoded body as it was written.
        value = Walk(dialect, lambda v: (lambda n: None if n is None or n == v.text else n)(next(strings, None)))(value)
        return encode(add_note(value, dialect) if note and hidden else value)

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, news, hiddens in batches:  # a request at a time, so that a batch is held as Arrow alone
            yield pa.array((None if not b.is_valid else work(b.as_py(), iter(n.as_py()), h.as_py()) for b, n, h in zip(bodies, news, hiddens)), pa.string())

    gathered = texts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "new"))), lambda x: x["new"]).alias("new"), F.bool_or("hidden").alias("hidden"))
    joined = requests.join(gathered, key, "left")
    return joined.withColumn(out, F.arrow_udf(run, "string")(F.col(body), F.coalesce("new", F.array().cast("array<string>")), F.coalesce("hidden", F.lit(False)))).drop("new", "hidden")


def redact_requests(requests: DataFrame, key: str, body: str = "body", dialect: Dialect = MESSAGES, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Redact whole requests in two passes: (requests with redacted_body, vault, counts by key and kind).

    The first pass numbers what the rules find, in visiting order; the second also replaces
    every other place of those values in the request.  A decoded argument under a secret key is a
    secret as a whole.
    """
    found = leaves(requests, key, body, dialect)
    whole = F.col("opaque") & (F.col("field") != "") & scalars.secret_field(F.col("field"), F.col("text"))
    found = detect(found.withColumn("whole", whole), candidates="candidates", **how)
    secret = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("SECRET").alias("kind"), F.lit("field").alias("rule"), F.lit(0).alias("priority"), F.lit(0).alias("ord")))
    found = written(found.withColumn("spans", F.when(F.col("whole"), secret).otherwise(F.col("spans"))))
    vault = written(V.number(V.appearances(found, [key], ["ord"]), [key], ["ord"]))
    again = V.second_pass(found.where(~F.col("whole")), vault, [key]).unionByName(found.where("whole"))
    done = V.redact(again, vault, [key], out="new")
    hidden = vault.select(key).distinct().withColumn("hidden", F.lit(True))
    texts = done.select(key, "ord", "new").join(hidden, key, "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    counts = again.select(key, F.explode("spans.kind").alias("kind")).groupBy(key, "kind").agg(F.count("*").alias("n"))
    return rebuild(requests, texts, key, body, dialect), vault, counts


def restore_text(text: str, values: dict[str, str], escaped: bool = False) -> str:
    """Placeholders of ``values`` put back, as JSON text inside a string if ``escaped``."""
    return re.sub(PLACEHOLDER, lambda m: m[0] if m[0] not in values else encode_text(values[m[0]])[1:-1] if escaped else values[m[0]], text)


def restore_body(body: str, values: dict[str, str], dialect: Dialect) -> str:
    """A response body restored; encoded strings are restored as text, types to skip stay."""
    if "[REDACTED_" not in body:
        return body
    walk = Walk(dialect, lambda v: restore_text(v.text, values, v.key in dialect.encoded_keys or v.path.rpartition(".")[2] in dialect.encoded_keys), inside=False)
    return encode(walk(decode(body)))


def restore_bodies(responses: DataFrame, body: str, values: str, dialect: Dialect, out: str = "restored") -> DataFrame:
    """``responses`` with their bodies restored from maps of placeholders; null and bodies that are no JSON stay."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, vaults in batches:
            done = []
            for text, held in zip(texts.to_pylist(), vaults.to_pylist()):
                try:
                    done.append(text and restore_body(text, dict(held or ()), dialect))
                except ValueError:
                    done.append(text)
            yield pa.array(done, pa.string())

    return responses.withColumn(out, F.arrow_udf(run, "string")(F.col(body), F.col(values)))


def bodies(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Requests of whole conversations: (key, body), the turns in order as messages."""
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    gathered = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))).alias("t"))
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.transform("t", lambda t: t["m"]).alias("messages")))
    return gathered.select(key, body.alias("body"))
