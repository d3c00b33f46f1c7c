"""Findings of the fifth round: texts with many candidates."""

import pytest

from umbra.functions import spans
from umbra.operators import detect, vault
from umbra.plans.catalogue import ORACLE_SQL, QUERIES

from .test_queries import SF, duck, rows  # noqa: F401

QUERIES_OF_ALL_SPANS = ["redact_text", "explain_spans", "redact_counts_by_kind", "scan_summary", "vault_numbering", "remembered_values", "restore_roundtrip", "redact_run"]


@pytest.mark.parametrize("name", [*QUERIES_OF_ALL_SPANS, "literal_join_back", "request_redaction"])
def test_texts_with_many_candidates_are_resolved_in_python(spark, duck, monkeypatch, name):
    """As if every text with a candidate had many."""
    monkeypatch.setattr(spans, "FEW", 0)
    monkeypatch.setattr(vault, "FEW", 0)
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_more_candidates_than_the_fold_takes(spark):
    """Scans and the resolution of many candidates both go to Python, one after the other, and so does the second pass."""
    text = "".join(f"jo{i}@mail.com at 10.0.{i % 250}.7, token=hunter{i}x\n" for i in range(100))
    docs = spark.createDataFrame([(1, text), (2, "call jo1@mail.com"), (3, None)], "doc_id long, text string")
    found = detect.detect(docs, candidates="candidates")
    assert {r["doc_id"]: len(r["spans"]) for r in found.collect()} == {1: 300, 2: 1, 3: 0}
    numbered = vault.number(vault.appearances(found, ["doc_id"], []), ["doc_id"], [])
    again = vault.second_pass(found, numbered, ["doc_id"])
    assert {r["doc_id"]: len(r["spans"]) for r in again.collect()} == {1: 300, 2: 1, 3: 0}
