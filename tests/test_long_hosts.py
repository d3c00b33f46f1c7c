"""Host names of any length, which exhausted the stack."""

import random

import duckdb
import pytest

from umbra.functions import patterns as P
from umbra.plans.catalogue import ORACLE_SQL, QUERIES

from .test_queries import rows
from .test_round_six import QUERIES_OF_ALL_SPANS

LABELS = 12_000
HOSTS = ["a." * LABELS, "x@" + "ab-cd." * LABELS, "1." * LABELS, "word.another." * 3000 + "com and x@y.zz then " + "b1." * LABELS + "org", "jo@" + "mail." * LABELS + "com password=hunter22", "see.com." * LABELS + "1", "a.b" * LABELS + "-x@y.com", None, ""]


@pytest.fixture(scope="module")
def hosts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hosts"))
    spark.createDataFrame([*enumerate(HOSTS, 1)], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_hosts_of_any_length_leave_the_stack_alone(spark):
    """In the driver's JVM, where an exhausted stack is an error and not the end of the session."""
    for name in ("domain", "email"):
        pattern = spark._jvm.java.util.regex.Pattern.compile(P.BY_NAME[name].java)
        for text in filter(None, HOSTS):
            pattern.matcher(text).replaceAll("")


def test_hosts_and_mailboxes_match_as_plain_loops_do(spark):
    """The possessive loops and the starts that are left out change no match."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    plain = {"domain": rf"(?i){P.B}(?:{label}\.)+[a-z]{{2,63}}{P.E}", "email": rf"(?i)[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{{2,63}}{P.E}"}
    rng = random.Random(6)
    parts = ["a", "b1", "com", "Z", "-", "--", ".", ".", ".", "_", " ", "@", "@", "net", "x" * 61, "y" * 62, "z" * 63, "w" * 64, "1", "/", "%", "+", "é", "co.uk", "a@b.com", "\n", "a-b", "..", "-.", "com-", ".com"]
    text = "\x00".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(20_000))
    for name, old in plain.items():
        marked = [spark._jvm.java.util.regex.Pattern.compile(p).matcher(text).replaceAll("<$0>") for p in (old, P.BY_NAME[name].java)]
        assert marked[0].count("<") > 1000 and marked[0] == marked[1], name


@pytest.mark.parametrize("name", QUERIES_OF_ALL_SPANS)
def test_queries_over_long_hosts(spark, hosts, name):
    got = rows(QUERIES[name](spark, hosts).toPandas())
    if name == "redact_run":  # its SQL knows addresses and passwords alone
        assert len(got[1]) == 5 and all(whole for *_, whole in got[1])
    else:
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{hosts}/documents.parquet/*.parquet'")
        assert got == rows(con.execute(ORACLE_SQL[name]).df())
