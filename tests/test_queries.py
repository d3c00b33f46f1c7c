"""Every query that has SQL for the same rows gives those rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from umbra.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    if isinstance(v, (str, bool)):
        return v
    return round(float(v), 6)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_requests_leak_nothing(spark):
    got = QUERIES["request_redaction"](spark, SF).collect()
    assert got and not any(r["leaked"] for r in got) and all(r["n_placeholders"] >= 2 for r in got)


def test_documents_are_redacted(spark):
    got = QUERIES["redact_text"](spark, SF)
    assert got.count() == 200 and got.where("n_spans > 0 and not contains(redacted, '[REDACTED_')").count() == 0


HEX = "3f7a9c2e5b8d1046af37c9e2b5d80164"
PLANTED = [
    "mail jo@mail.com, again jo@mail.com\nand di@mail.com at 192.0.2.17",
    "host db.corp.internal up\nkey sk-" + "ant-" + HEX + " in /home/jo.doe/x",
    "see 2001:db8::7a1 ok, write to PO Box 77\n\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- end",
    "password=hunter22\n",
    "my password: hunter23, nothing else",
    None,
    "plain text",
]
KINDS = {"EMAIL": 3, "IPV4": 1, "DOMAIN": 1, "TOKEN": 1, "USER": 1, "IPV6": 1, "ADDRESS": 1, "PRIVATE_KEY": 1, "SECRET": 1, "PASSWORD": 1}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('planted')}"
    spark.createDataFrame(list(enumerate(PLANTED)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_all_kinds_are_counted_numbered_and_restored(spark, planted):
    counts = {r["kind"]: r["n"] for r in QUERIES["redact_counts_by_kind"](spark, planted).collect()}
    assert counts == KINDS
    assert QUERIES["scan_summary"](spark, planted).first()["summary"] == " ".join(f"{k}={n}" for k, n in sorted(KINDS.items()))
    numbers = {r["kind"]: (r["n_values"], r["greatest"]) for r in QUERIES["vault_numbering"](spark, planted).collect()}
    assert numbers == {k: (n, n) for k, n in (KINDS | {"EMAIL": 2}).items()}
    assert {r["doc_id"]: r["restored"] for r in QUERIES["restore_roundtrip"](spark, planted).collect()} == dict(enumerate(PLANTED))


def test_every_span_of_every_document_is_explained(spark, planted):
    values = {
        0: [("EMAIL", "jo@mail.com"), ("EMAIL", "jo@mail.com"), ("EMAIL", "di@mail.com"), ("IPV4", "192.0.2.17")],
        1: [("DOMAIN", "db.corp.internal"), ("TOKEN", "sk-" + "ant-" + HEX), ("USER", "jo.doe")],
        2: [("IPV6", "2001:db8::7a1"), ("ADDRESS", "PO Box 77"), ("PRIVATE_KEY", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----")],
        3: [("SECRET", "hunter22")],
        4: [("PASSWORD", "hunter23")],
    }
    want = set()
    for i, found in values.items():
        end = 0
        for n, (kind, value) in enumerate(found):
            at = PLANTED[i].index(value, end)
            before, end = PLANTED[i][:at], at + len(value)
            want.add((i, n, before.count("\n") + 1, at - before.rfind("\n"), kind, value))
    got = [tuple(r) for r in QUERIES["explain_spans"](spark, planted).drop("rule").collect()]
    assert len(got) == len(want) and set(got) == want


def test_all_hosts_of_an_address_are_filtered(spark, tmp_path):
    urls = ["https://a.test.com/?next=https://b.test.org/x", "https://www.example.com/?u=https://c.test.net", "https://d.test.com/?u=https://img.example.com"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["allow_filter"](spark, str(tmp_path)).collect())
    assert got == [(0, "a.test.com"), (0, "b.test.org"), (1, "c.test.net"), (2, "d.test.com")]
