"""Queries over JSON bodies, event streams and texts put together for the rules that the tables do not exercise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars
from ..operators import admission, detect, vault, walk
from ..sources import files
from ..sources.tables import spread, table, written
from ..streaming import events
from .catalogue import KINDS_SQL, _spans_sql, detected, query


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey")


def _text(*parts: str) -> Column:
    """Parts of a text, the supplier's key where a part is ``#``."""
    return F.concat(*[F.col("s_suppkey").cast("string") if p == "#" else F.lit(p) for p in parts])


_ONE = "[REDACTED_EMAIL_1]"
MAIL = ("a", "#", "@mail.com")


def _streams(spark: SparkSession, sf_dir: str, body: Column) -> DataFrame:
    return _suppliers(spark, sf_dir).select("s_suppkey", body.alias("body"), F.create_map(F.lit(_ONE), _text(*MAIL)).alias("values"))


def _said(column: str, key: str) -> Column:
    """What the strings under a key of a stream's events say together."""
    return F.array_join(F.regexp_extract_all(column, F.lit(f'"{key}":"([^"]*)"'), F.lit(1)), "")


def _sse(*lines: str) -> Column:
    return F.lit("".join(f"data: {line}\n\n" for line in lines))


# ---- event streams ----------------------------------------------------------------------------------


@query("select s_suppkey, concat('mail a', s_suppkey, '@mail.com now [', 'a', s_suppkey, '@mail.com') as said, 4 as events from supplier")
def sse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placeholder over two deltas, an open bracket at the end of a block, and arguments in another block."""
    delta = lambda i, kind, key, text: f'{{"delta":{{"type":"{kind}","{key}":"{text}"}},"index":{i},"type":"content_block_delta"}}'
    body = _sse(delta(0, "text_delta", "text", "mail [REDA"), delta(0, "text_delta", "text", "CTED_EMAIL_1] now ["), '{"index":0,"type":"content_block_stop"}', delta(1, "input_json_delta", "partial_json", _ONE))
    done = events.restore_streams(_streams(spark, sf_dir, body), "s_suppkey", "anthropic-messages")
    # The rest of a block is an event of its own, before the block's end.
    return done.select("s_suppkey", F.concat(_said("restored", "text"), _said("restored", "partial_json")).alias("said"), (F.regexp_count("restored", F.lit("data: ")) - 1).cast("long").alias("events"))


@query("select s_suppkey, concat('x a', s_suppkey, '@mail.com [') as said, concat('{to:a', s_suppkey, '@mail.com}') as arguments, true as done from supplier")
def sse_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = lambda delta, finish="null": f'{{"choices":[{{"delta":{delta},"finish_reason":{finish},"index":0}}],"id":"c"}}'
    call = lambda text: f'{{"tool_calls":[{{"function":{{"arguments":"{text}"}},"index":0}}]}}'
    said = lambda text: f'{{"content":"{text}"}}'
    body = _sse(chunk(call("{to:[REDACTED_EM")), chunk(call("AIL_1]}")), chunk(said("x [REDACTED_EMAIL")), chunk(said("_1] [")), chunk("{}", '"stop"'), "[DONE]")
    done = events.restore_streams(_streams(spark, sf_dir, body), "s_suppkey", "openai-chat")
    return done.select("s_suppkey", _said("restored", "content").alias("said"), _said("restored", "arguments").alias("arguments"), F.col("restored").endswith("data: [DONE]\n\n").alias("done"))


@query("select s_suppkey, concat('a', s_suppkey, '@mail.com ') as said, concat('a', s_suppkey, '@mail.com') as text, concat('r', s_suppkey) as response_id from supplier")
def sse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas, the whole text when it is done, reasoning that stays as it is, and the response's id."""
    place = '"content_index":0,"output_index":0'
    delta = lambda text: f'{{{place},"delta":"{text}","type":"response.output_text.delta"}}'
    created = F.concat(F.lit('event: response.created\ndata: {"response":{"id":"r'), F.col("s_suppkey").cast("string"), F.lit('"},"type":"response.created"}\n\n'))
    body = F.concat(created, _sse(delta("[REDACTED_EM"), delta("AIL_1] "), f'{{{place},"text":"{_ONE}","type":"response.output_text.done"}}', '{"type":"response.reasoning_text.done","reasoned":"[REDACTED_EMAIL_1]"}'))
    done = events.restore_streams(_streams(spark, sf_dir, body), "s_suppkey", "openai-responses")
    kept = done.where(F.col("restored").contains(f'"reasoned":"{_ONE}"'))
    return kept.select("s_suppkey", _said("restored", "delta").alias("said"), _said("restored", "text").alias("text"), "response_id")


@query("select s_suppkey, s_suppkey % 4 in (0, 2) as streamed, s_suppkey % 5 < 3 as loopback from supplier")
def sniff_and_loopback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event streams by their type or their beginning; hosts of this machine."""
    key = F.col("s_suppkey")
    kind = F.when(key % 4 == 0, "text/event-stream; charset=utf-8").when(key % 4 == 1, "application/json")
    body = F.when(key % 4 == 3, "{}").otherwise("event: response.created")
    host = F.get(F.array(*map(F.lit, ("LocalHost", "127.0.0.9", "[::1]", "10.0.0.1", "127.0.0.300"))), (key % 5).cast("int"))
    return _suppliers(spark, sf_dir).select("s_suppkey", admission.is_event_stream(kind, body).alias("streamed"), admission.is_loopback(host).alias("loopback"))


# ---- request and response bodies -----------------------------------------------------------------


@query("""
select s_suppkey, unnest([0, 1, 2, 3, 4]) as ord, unnest(['tool', 'system ' || s_suppkey, 'first', 'inner', 'p w']) as text, unnest(['', '', '', 'model', 'password']) as field, unnest([false, false, false, true, true]) as opaque
from supplier""")
def walk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key order, skipped keys, types, paths and pictures, a dropped key, and tool input as user data."""
    body = _text(
        '{"metadata":{"user_id":"no"},"model":"no","zone":7,"messages":[{"role":"no","content":[{"type":"text","text":"first"},{"type":"thinking","thinking":"no"},{"type":"image","source":{"type":"url","url":"data:no"}}]},'
        '{"role":"no","content":[{"type":"tool_use","id":"no","name":"no","input":{"password":"p w","model":"inner","n":1.50,"flag":true}}]}],"system":"system ', "#", '","tools":[{"name":"no","input_schema":{"description":"no"},"description":"tool"}]}',
    )
    rows = walk.leaves(_suppliers(spark, sf_dir).withColumn("body", body), "s_suppkey")
    return rows.select("s_suppkey", "ord", "text", "field", "opaque")


@query("select s_suppkey, '{\"a\":[1e400,' || s_suppkey || '],\"b\":0.70,\"t\":\"é<&>\"}' as redacted_body from supplier")
def json_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers stay as written, keys are ordered, nothing is escaped that need not be; a dropped key is gone."""
    body = _text('{"t": "é<\\u0026>", "b":0.70, "user":"no",  "a":[1e400,', "#", "]}")
    done, _, _ = walk.redact_requests(_suppliers(spark, sf_dir).withColumn("body", body), "s_suppkey", dialect=walk.CHAT)
    return done.select("s_suppkey", "redacted_body")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _text('{"messages":[{"role":"user","content":"write to a', "#", '@mail.com and b@mail.com"},{"role":"assistant","content":[{"type":"tool_use","input":{"api_key":"s3cr3t ', "#", '","n":[{"token":"$VAR"}],"list":{"secret":["b@mail.com"]}}}]}]}')
    return _suppliers(spark, sf_dir).withColumn("body", body)


@query("select s_suppkey, unnest(['EMAIL', 'SECRET']) as kind, unnest([3, 1]) as n from supplier")
def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redactions of each request by kind: a secret field as a whole, references and lists under secret keys not."""
    return walk.redact_requests(_requests(spark, sf_dir), "s_suppkey")[2]


@query("""
select s_suppkey, 'write to [REDACTED_EMAIL_1] and [REDACTED_EMAIL_2]' as said, '[REDACTED_SECRET_1]' as api_key, true as noted, 'write to a' || s_suppkey || '@mail.com and b@mail.com' as restored from supplier
""")
def request_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies redacted, with their note, and restored from their vault."""
    done, numbered, _ = walk.redact_requests(_requests(spark, sf_dir), "s_suppkey")
    maps = vault.vault_maps(numbered, ["s_suppkey"])
    back = walk.restore_bodies(done.join(maps, "s_suppkey"), "redacted_body", "by_placeholder", walk.MESSAGES)
    message = lambda body: F.get_json_object(body, "$.messages[0].content")
    return back.select("s_suppkey", message("redacted_body").alias("said"), F.get_json_object("redacted_body", "$.messages[1].content[0].input.api_key").alias("api_key"), F.coalesce(F.get_json_object("redacted_body", "$.system") == walk.NOTE, F.lit(False)).alias("noted"), message("restored").alias("restored"))


@query("""
select s_suppkey, unnest(['anthropic-messages', 'openai-chat', 'openai-chat', 'openai-responses']) as dialect, unnest(['system', 'message', 'none', 'instructions']) as place from supplier
""")
def notes_by_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the note goes: a system prompt, a message in front, the instructions; nowhere without messages."""
    said = '"content":"to c@mail.com","role":"user"'
    cases = ((walk.MESSAGES, f'{{"messages":[{{{said}}}]}}'), (walk.CHAT, f'{{"messages":[{{{said}}}]}}'), (walk.CHAT, '{"input":"to c@mail.com"}'), (walk.RESPONSES, '{"input":"to c@mail.com","instructions":"be kind"}'))
    out = None
    for dialect, body in cases:
        done, _, _ = walk.redact_requests(_suppliers(spark, sf_dir).withColumn("body", F.lit(body)), "s_suppkey", dialect=dialect)
        at = lambda path: F.coalesce(F.get_json_object("redacted_body", path).endswith(walk.NOTE), F.lit(False))
        place = F.when(at("$.system"), "system").when(at("$.instructions"), "instructions").when(at("$.messages[0].content"), "message").otherwise("none")
        rows = done.select("s_suppkey", F.lit(dialect.name).alias("dialect"), place.alias("place"))
        out = rows if out is None else out.union(rows)
    return out


@query("""
select s_suppkey, '{"content":[{"text":"hi a' || s_suppkey || '@mail.com [REDACTED_EMAIL_2]","type":"text"},{"thinking":"[REDACTED_EMAIL_1]","type":"thinking"}]}' as restored from supplier
""")
def response_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses restored: unknown placeholders and skipped types stay."""
    body = F.lit('{"content":[{"type":"text","text":"hi [REDACTED_EMAIL_1] [REDACTED_EMAIL_2]"},{"type":"thinking","thinking":"[REDACTED_EMAIL_1]"}]}')
    return walk.restore_bodies(_streams(spark, sf_dir, body), "body", "values", walk.MESSAGES).select("s_suppkey", "restored")


@query("""
select s_suppkey, case s_suppkey % 6 when 0 then 'r' || s_suppkey end as ref, s_suppkey % 6 not in (3, 5) as ok, case s_suppkey % 6 when 4 then 'resp' || s_suppkey end as response_id from supplier
""")
def chain_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which response a request continues, and the id that a response says; an id that is no text is refused."""
    case = F.col("s_suppkey") % 6
    body = F.when(case == 0, _text('{"previous_response_id":"r', "#", '"}')).when(case == 1, '{"previous_response_id":null}').when(case == 2, '{"id":7}').when(case == 3, '{"previous_response_id":7}').when(case == 4, _text('{"id":"resp', "#", '"}')).otherwise("no json")
    rows = _suppliers(spark, sf_dir).withColumn("body", body)
    return rows.select("s_suppkey", walk.chain_ref(F.col("body"), walk.RESPONSES).alias("c"), walk.response_id(F.col("body")).alias("response_id")).select("s_suppkey", "c.ref", "c.ok", "response_id")


# ---- rules on texts put together -----------------------------------------------------------------

_H = "sha256(s_suppkey::varchar)"
_HEX = "sha2(cast(s_suppkey as string), 256)"
#: Case -> (the text in Spark SQL, the kind and value that must be found in it, in DuckDB SQL; None: nothing).
VARIANTS = {
    "proxy-token": ("concat('use nspy', '_', {h}, ' now')", "TOKEN", "concat('nspy', '_', {h})"),
    "placeholder": ("'see [REDACTED_EMAIL_7] and [REDACTED_SECRET_1]'", None, None),
    "windows": ("concat('in C:\\\\Users\\\\Jo Do', s_suppkey, '\\\\x')", "USER", "concat('Jo Do', s_suppkey)"),
    "windows-open": ("concat('in c:/users/jo', s_suppkey, ' said')", "USER", "concat('jo', s_suppkey)"),
    "wsl": ("concat('in /mnt/c/Users/jo', s_suppkey, '/x')", "USER", "concat('jo', s_suppkey)"),
    "nobody": ("'in /Users/Shared/x, C:\\\\Users\\\\Public\\\\x, /mnt/c/Users/All Users/x'", None, None),
    "no-home": ("concat('in /usr/home/jo', s_suppkey)", None, None),
    "gutter": ("concat('     1\\tkind: Secret\\n     2\\tdata:\\n     3\\t  k: ', {h}, '\\n')", "SECRET", "{h}"),
    "gutter-arrow": ("concat(' 7→API_KEY=', {h}, '\\n')", "SECRET", "{h}"),
    "yaml-block": ("concat('kind: Secret\\nstringData:\\n  k: |\\n    ', {h}, '\\nx: 1')", "SECRET", "{h}"),
    "no-secret-yaml": ("concat('kind: ConfigMap\\ndata:\\n  k: v', s_suppkey, '\\n')", None, None),
    "dotenv-flag": ("'USE_KEY=true\\nAUTH=$OTHER\\nMONKEY=abc\\n'", None, None),
    "keyword-reference": ("concat('my password: ${{DB_', s_suppkey, '}} and token=$TOKEN_', s_suppkey)", None, None),
    "keyword-dollar": ("concat('the password: $ecret', s_suppkey)", "PASSWORD", "concat('$ecret', s_suppkey)"),
    "house-number": ("concat('v1.', s_suppkey, ' Main Street, a', s_suppkey, ' Main Street, 12,345 Main Street')", None, None),
    "prose": ("concat(s_suppkey, ' Main Way to do it')", None, None),
    "street-full-stop": ("concat('at ', s_suppkey, ' Old Mill Rd. It')", "ADDRESS", "concat(s_suppkey, ' Old Mill Rd')"),
    "street-closed": ("concat('(at ', s_suppkey, ' Old Mill Rd.)')", "ADDRESS", "concat(s_suppkey, ' Old Mill Rd')"),
    "street-uk": ("concat('at ', s_suppkey, ' High Street\\nOxford OX1 2JD today')", "ADDRESS", "concat(s_suppkey, ' High Street', chr(10), 'Oxford OX1 2JD')"),
    "street-ca": ("concat('at ', s_suppkey, ' Elgin Street, Ottawa, ON K1A 0B1')", "ADDRESS", "concat(s_suppkey, ' Elgin Street, Ottawa, ON K1A 0B1')"),
    "box-us": ("concat('PO Box ', s_suppkey, ', Little Rock, AR 72201-1234')", "ADDRESS", "concat('PO Box ', s_suppkey, ', Little Rock, AR 72201-1234')"),
    "no-state": ("concat('in Little Rock, XX ', lpad(cast(s_suppkey as string), 5, '0'))", None, None),
    "no-postcode": ("'at ZZ1 1AA or SW1A 1CA or xSW1A 1AA'", None, None),
    "province": ("concat('ON K1A', s_suppkey % 10, 'B1 and K1A0B1')", "ADDRESS", "concat('K1A', s_suppkey % 10, 'B1')"),
    "no-tld": ("concat('jo@mail.nosuchzone and host', s_suppkey, '.nosuchzone and README.md and app.run(x)')", None, None),
    "new-tld": ("concat('see photos', s_suppkey, '.photography now')", "DOMAIN", "concat('photos', s_suppkey, '.photography')"),
    "no-ip": ("'at 127.0.0.1, 0.0.0.0, ::1, 999.1.1.1, 01.2.3.4, dead::beef'", None, None),
    "low-entropy": ("concat('sha ', {h})", None, None),
}


@query(
    "select s_suppkey, made_for, kind, value from ("
    + " union all ".join(f"select s_suppkey, '{name}' as made_for, '{kind}' as kind, {value.format(h=_H)} as value from supplier" for name, (_, kind, value) in VARIANTS.items() if kind)
    + " union all select s_suppkey, 'province', 'ADDRESS', 'K1A0B1' from supplier)"
)
def detect_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further shapes of the rules, and texts in which nothing is to be found."""
    rows = ", ".join(f"struct('{name}' as made_for, {text.format(h=_HEX)} as text)" for name, (text, _, _) in VARIANTS.items())
    texts = _suppliers(spark, sf_dir).select("s_suppkey", F.expr(f"inline(array({rows}))"))
    found = files.explain(detect.detect(spread(texts)), ["s_suppkey", "made_for"])
    return found.select("s_suppkey", "made_for", "kind", "value")


INVOICE = P.Rule("invoice", "INVOICE", P.PRIORITY["term"], P.B + r"INV-([0-9]+)" + P.E, r"\bINV-([0-9]+)\b", ("INV-",), True)


@query("select s_suppkey, kind, value from (select s_suppkey, 'INVOICE' as kind, s_suppkey::varchar as value from supplier union all select s_suppkey, 'EMAIL', 'a' || s_suppkey || '@mail.com' from supplier)")
def detect_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the caller's own beside the others."""
    docs = _suppliers(spark, sf_dir).withColumn("text", _text("INV-", "#", " to a", "#", "@mail.com, xINV-1"))
    return files.explain(detect.detect(docs, more=[INVOICE]), ["s_suppkey"]).select("s_suppkey", "kind", "value")


@query("""
with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages)
select page_id, host from p where host not in ('thther.example.org', 'blog.tionsh.example.net')
""")
def allow_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed values are compared as a whole and without case; what is allowed is left alone."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"))
    found = detect.detect(spread(pages), allow=["Thther.Example.org", "blog.tionsh.example.net", "example.com"])
    return files.explain(found, ["page_id"]).where("kind = 'DOMAIN'").select("page_id", F.col("value").alias("host"))


_FIELD_SQL = "regexp_matches(regexp_replace(lower(k), '[_.-]', '', 'g'), '(" + "|".join(scalars.FIELD_ENDS) + ")$')"


@query(f"""
with r as (select c_custkey, (['Api-Key', 'monkey', 'client.secret', 'AUTHOR', 'x_PASSWORD', 'DB.TOKEN', 'token_id'])[c_custkey % 7 + 1] as k, (['', '$X', 'True', 'v', 'no', '0', 'a b'])[c_custkey % 5 + 1] as v from customer)
select c_custkey, {_FIELD_SQL} as field_secret,
  regexp_matches(upper(k), '(^|[_.-])({"|".join(scalars.DOTENV_ENDS)})$') as env_secret,
  v = '' or regexp_matches(v, '^[$=]') or lower(v) in ('true', 'false', 'yes', 'no', 'null', '0', '1') as skipped,
  regexp_extract('[REDACTED_' || upper(regexp_replace(k, '[^A-Za-z]', '', 'g')) || '_' || c_custkey || ']', '^\\[REDACTED_(.*)_\\d+\\]$', 1) as kind,
  trim(regexp_replace(' a  ' || k || chr(9) || ' b ', '\\s+', ' ', 'g')) as squeezed,
  trim(regexp_replace(k || '#' || v || ' # ' || k, '(^|[ \\t])#.*', '\\1')) as uncommented
from r
""")
def scalar_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret keys of fields and environment files, values that are no secrets, kinds of placeholders, blanks made even."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values)).cast("int"))
    keys = ("Api-Key", "monkey", "client.secret", "AUTHOR", "x_PASSWORD", "DB.TOKEN", "token_id")
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(keys).alias("k"), pick(("", "$X", "True", "v", "no")).alias("v"))
    placeholder = F.format_string("[REDACTED_%s_%d]", F.upper(F.regexp_replace("k", "[^A-Za-z]", "")), F.col("c_custkey"))
    return rows.select(
        "c_custkey",
        scalars.field_is_secret(F.col("k")).alias("field_secret"),
        scalars.dotenv_is_secret(F.col("k")).alias("env_secret"),
        scalars.skips_value(F.col("v")).alias("skipped"),
        scalars.kind_of_placeholder(placeholder).alias("kind"),
        scalars.squeeze(F.concat(F.lit(" a  "), "k", F.lit("\t b "))).alias("squeezed"),
        scalars.strip_comment(F.concat("k", F.lit("#"), "v", F.lit(" # "), "k")).alias("uncommented"),
    )


# ---- whole runs ------------------------------------------------------------------------------------


@query(f"with {KINDS_SQL} select doc_id, count(*) as n, true as whole from (select doc_id from em union all select doc_id from ip union all select doc_id from kw) group by doc_id")
def redact_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document redacted with one vault for the whole run, and put back from it."""
    # Documents without spans are their own redacted form; what follows has rows of the others alone.
    found = written(detected(spark, sf_dir).where(F.size("spans") > 0))
    numbered = written(vault.number_all(vault.appearances(found, [], ["doc_id"]), ["doc_id"]))
    done = vault.redact_all(found, numbered, ["doc_id"])
    hidden = F.regexp_count("redacted", F.lit(P.PLACEHOLDER)) - F.regexp_count("text", F.lit(P.PLACEHOLDER))
    # Restored by its own placeholders: those of the documents meet the vault as spans did.
    each = done.select("doc_id", F.posexplode(F.regexp_extract_all("redacted", F.lit(P.PLACEHOLDER), F.lit(0))).alias("at", "placeholder"))
    values = each.join(numbered.select("placeholder", "value"), "placeholder").groupBy("doc_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("placeholder", "value")))).alias("by_placeholder"))
    back = done.join(values, "doc_id").withColumn("restored", vault.restore(F.col("redacted"), F.col("by_placeholder")))
    return back.select("doc_id", hidden.cast("long").alias("n"), (F.col("restored") == F.col("text")).alias("whole"))


@query(f"with {_spans_sql()} select v as value, arg_max(kind, (doc_id, pos)) as kind from spans where kind in ('PASSWORD', 'SECRET') group by v")
def remembered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents hold that is worth remembering: values of the kinds that context finds, under their latest kind."""
    return vault.found(vault.appearances(detected(spark, sf_dir), [], ["doc_id"]), [], ["doc_id"]).select("value", "kind")
