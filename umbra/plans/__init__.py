"""The queries: importing any of these modules registers all of them."""

from . import catalogue, payloads, stores  # noqa: F401
