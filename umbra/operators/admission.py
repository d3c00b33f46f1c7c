"""Which requests are let in, where they go, and what they carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 32 << 20
# Headers that pass, and those that carry a client's own key.
FORWARDED = ("content-type", "accept", "anthropic-version", "anthropic-beta", "openai-beta")
CREDENTIALS = ("x-api-key", "authorization")
# Paths with a dialect.
PATHS = {
    "/v1/messages": "anthropic-messages",
    "/v1/messages/count_tokens": "anthropic-messages",
    "/v1/chat/completions": "openai-chat",
    "/v1/embeddings": "openai-chat",
    "/v1/responses": "openai-responses",
}


def dialect_of(path: Column) -> Column:
    """The dialect's name; null for other endpoints."""
    out = F.lit(None).cast("string")
    for p, name in PATHS.items():
        out = F.when(path == p, name).otherwise(out)
    return out


def status(upgrade: Column, encoding: Column, size: Column, content_type: Column, dialect: Column, valid_json: Column, chain_miss: Column) -> Column:
    """What a request is answered: 400, 409, 413, 415, or 200 if it is let in; the first that applies."""
    media = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    odd = (F.coalesce(encoding, F.lit("")) != "") & (F.lower(encoding) != "identity")
    return (
        F.when(F.coalesce(upgrade, F.lit("")) != "", 400)
        .when(odd, 415)
        .when(size > MOST_BYTES, 413)
        .when((size > 0) & (dialect.isNull() | (media != "application/json")), 415)
        .when((size > 0) & ~valid_json, 400)
        .when((size > 0) & chain_miss, 409)
        .otherwise(200)
    )


def outbound(headers: Column, passthrough: bool = True, extra: Sequence[str] = (), dropped: Sequence[str] = ()) -> Column:
    """The headers that go out, of a map with lower-case names; the user agent is the proxy's own and set elsewhere."""
    names = {*FORWARDED, *(e.lower() for e in extra), *(CREDENTIALS if passthrough else ())} - {d.lower() for d in dropped} - {"user-agent"}
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(sorted(names)))


def match_route(requests: DataFrame, prefixes: Sequence[str], path: str = "path") -> DataFrame:
    """``requests`` with ``route``, the first prefix that is the path or is followed by a slash, and ``api_path``."""
    route = F.lit(None).cast("string")
    for p in reversed(prefixes):
        route = F.when((F.col(path) == p) | F.col(path).startswith(p + "/"), p).otherwise(route)
    rest = F.substring(F.col(path), F.length("route") + 1, F.length(path))
    return requests.withColumn("route", route).withColumn("api_path", F.when(F.col("route").isNotNull(), F.when(rest == "", "/").otherwise(rest)))


def forward_path(upstream: Column, api: Column) -> Column:
    """``api`` without its version where the upstream's own path ends in it."""
    versioned = F.regexp_replace(upstream, "/$", "").endswith("/v1")
    return F.when(versioned & ((api == "/v1") | api.startswith("/v1/")), F.substring(api, 4, 2**31 - 1)).otherwise(api)


def is_loopback(host: Column) -> Column:
    return host.rlike(r"^(?i:localhost)$|^127(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$|^\[?::1\]?$")


def is_event_stream(content_type: Column, body: Column) -> Column:
    """By its type, or, without one, by how it begins."""
    return F.coalesce(content_type.startswith("text/event-stream"), F.lit(False)) | ((F.coalesce(content_type, F.lit("")) == "") & body.startswith("event: response."))
