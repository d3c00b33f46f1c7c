import itertools
import random

import pytest
from pyspark.sql import functions as F

from umbra.functions import rescans
from umbra.functions.tlds import ROOT_ZONE
from umbra.operators import detect, vault
from umbra.operators.terms import Finder, Literals, TermsError, parse
from umbra.sources import files

HEX = "3f7a9c2e5b8d1046af37c9e2b5d80164"
MIXED = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF"

POSITIVE = [
    ("mail jo@mail.com now", "EMAIL", "jo@mail.com"),
    ("at 192.0.2.17.", "IPV4", "192.0.2.17"),
    ("see 2001:db8::7a1 ok", "IPV6", "2001:db8::7a1"),
    ("host db.corp.internal up", "DOMAIN", "db.corp.internal"),
    ("go https://README.md/x", "DOMAIN", "README.md"),
    ("key sk-" + "ant-" + HEX, "TOKEN", "sk-ant-" + HEX),
    ("Bearer " + HEX + "=", "TOKEN", HEX + "="),
    ("ftp://u:pa55w0rd@h/x", "PASSWORD", "pa55w0rd"),
    ("my password: hunter22", "PASSWORD", "hunter22"),
    ("x DB_password=hunter22 x", "PASSWORD", "hunter22"),
    ("password=hunter22", "SECRET", "hunter22"),
    ("run " + MIXED, "TOKEN", MIXED),
    ("in /home/jo.doe/x", "USER", "jo.doe"),
    ("in C:\\Users\\Jo Doe\\x", "USER", "Jo Doe"),
    ("in C:\\Users\\Jo said", "USER", "Jo"),
    ("at 12 Old Mill Road, Springfield, IL 62704", "ADDRESS", "12 Old Mill Road, Springfield, IL 62704"),
    ("at 12 Old Mill Road", "ADDRESS", "12 Old Mill Road"),
    ("PO Box 77", "ADDRESS", "PO Box 77"),
    ("at SW1A 1AA today", "ADDRESS", "SW1A 1AA"),
    ("at K1A 0B1 today", "ADDRESS", "K1A 0B1"),
    ("ON K1A0B1", "ADDRESS", "K1A0B1"),
    ("     1\tkind: Secret\n     2\tdata:\n     3\t  k: dmFsdWU=\n", "SECRET", "dmFsdWU="),
    ("kind: Secret\ndata:\n  k: |\n    one\n    two\nx: 1", "SECRET", "one\n    two"),
    ('{"auths": {"r": {"auth": "YWJj"}}}', "SECRET", "YWJj"),
    ("😀 mail jo@mail.com", "EMAIL", "jo@mail.com"),
]
NEGATIVE = [
    "at 127.0.0.1 or 999.1.1.1 or 1.2.3",
    "see README.md and user.name and app.run(x)",
    "errors.New and sync.Map",
    "password=$TOKEN and token: ${DB_TOKEN}",
    "a password_hash of tokenizer",
    "3 Main Way to do it",
    "v1.2 Main Street",
    "in /usr/home/x and https_/home",
    "/Users/Shared/x",
    "jo@mail.nosuchzone",
    "dead::beef and a::b",
    "sha " + HEX,
    "",
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for t, _, _ in POSITIVE] + NEGATIVE
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = files.explain(detect.detect(df), ["i"]).collect()
    return {i: [(r["kind"], r["value"]) for r in rows if r["i"] == i] for i in range(len(texts))}


@pytest.mark.parametrize("i", range(len(POSITIVE)), ids=[t[:24] for t, _, _ in POSITIVE])
def test_found(found, i):
    assert found[i] == [POSITIVE[i][1:]]


@pytest.mark.parametrize("i", range(len(NEGATIVE)))
def test_left_alone(found, i):
    assert found[len(POSITIVE) + i] == []


def test_nulls_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "jo@mail.com", None)], "i int, text string, kind string")
    assert sorted(r["n"] for r in detect.detect(df).select(F.size("spans").alias("n")).collect()) == [0, 1]
    assert detect.detect(df.limit(0)).count() == 0


def test_ascii_boundaries(spark):
    """A non-ASCII letter beside a match does not hide it; lone carriage returns and vertical tabs are no line ends or blanks."""
    df = spark.createDataFrame([(0, "é192.0.2.1é"), (1, "x\rAPI_KEY=abcdefgh")], "i int, text string")
    rows = {r["i"]: r["value"] for r in files.explain(detect.detect(df), ["i"]).collect()}
    assert rows[0] == "192.0.2.1"
    assert [s[3] for s in rescans.scan("x\rAPI_KEY=abcdefgh")] == []


def test_long_quoted_value():
    text = '{"terraform_version": 1, "password": "' + "a" * 200_000 + '"}'
    (s, e, *_), = [x for x in rescans.scan(text) if x[3] == "tfstate"]
    assert e - s == 200_000


def test_round_trip_and_idempotence(spark):
    text = "jo@mail.com at 192.0.2.1, again jo@mail.com; token: abcdefgh"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    hit = detect.detect(df)
    numbered = vault.number(vault.appearances(hit, ["doc_id"], []), ["doc_id"], [])
    done = vault.redact(hit, numbered, ["doc_id"])
    back = vault.restored(done, numbered, ["doc_id"]).first()
    assert back["redacted"] == "[REDACTED_EMAIL_1] at [REDACTED_IPV4_1], again [REDACTED_EMAIL_1]; token: [REDACTED_PASSWORD_1]"
    assert back["restored"] == text
    again = detect.detect(done.select("doc_id", F.col("redacted").alias("text")))
    assert again.select(F.size("spans")).first()[0] == 0
    assert hit.select(vault.redact_row(F.col("text"), F.col("spans"))).first()[0] == back["redacted"]


def test_terms(spark):
    terms = parse("\ufeffOrion Next # a project\nOrion\n[TEAM]\nBlue Team\nre:T-[0-9]+\n[ALLOW]\nOrion\n")
    assert terms.count == 4 and terms.sections == {"TERM", "TEAM"}
    find = lambda t: sorted((t[s:e], k) for s, e, k, _ in Finder(terms)(t))
    assert find("Orion Nextish") == [("Orion", "TERM")]
    assert find("orion\tnext, blue  team T-17 xOrion") == [("T-17", "TEAM"), ("blue  team", "TEAM"), ("orion\tnext", "TERM")]
    df = spark.createDataFrame([(1, "Orion and Orion Next")], "i int, text string")
    assert [r["value"] for r in files.explain(detect.detect(df, terms=terms), ["i"]).collect()] == ["Orion Next"]


def test_terms_problems_name_lines_only():
    with pytest.raises(TermsError) as e:
        parse("ab\n[bad]\nre:(\nre:a*\n[ALLOW]\nre:x\n")
    assert str(e.value).split("\n") == [
        "terms line 1: term shorter than 3 characters",
        "terms line 2: invalid section name",
        "terms line 3: invalid regex",
        "terms line 4: regex matches the empty string",
        "terms line 6: regex not allowed in ALLOW",
    ]


def test_literals_equal_naive_search():
    rng = random.Random(5)
    values = ["".join(rng.choices("ab-", k=rng.randint(3, 6))) for _ in range(40)]
    text = "".join(rng.choices("ab- ", k=400))
    lits = Literals([("SECRET", v) for v in values])
    naive = {(i, i + len(v), v) for v in set(values) if len(v) >= 4 for i in range(len(text)) if text.startswith(v, i)}
    assert set(lits.hits(text)) == naive


def test_resolve_against_a_plain_version(spark):
    from umbra.functions.spans import NONE, resolve

    rng = random.Random(3)
    kinds = [("", "placeholder", 0), ("EMAIL", "email", 7), ("DOMAIN", "domain", 11), ("SECRET", "known", 13), ("TERM", "terms", 12)]
    cases = []
    for _ in range(60):
        case = []
        for n in range(rng.randint(0, 7)):
            s = rng.randint(0, 12)
            k, r, p = rng.choice(kinds)
            case.append((s, s + rng.randint(0, 6), k, r, p, n))
        cases.append(case)

    def plain(case):
        taken = []
        for c in sorted((c for c in case if c[0] < c[1]), key=lambda c: (c[4], c[0] - c[1], c[0], c[5])):
            hit = [t for t in taken if t[0] < c[1] and t[1] > c[0]]
            if hit and (c[3] != "known" or any(t[0] < c[0] or t[1] > c[1] or t[2] == "" for t in hit)):
                continue
            taken = [t for t in taken if t not in hit] + [c]
        return sorted(t for t in taken if t[2])

    df = spark.createDataFrame(list(enumerate(cases)), f"i int, c {NONE}")
    got = {r["i"]: [tuple(x) for x in r["s"]] for r in df.select("i", resolve(F.col("c")).alias("s")).collect()}
    assert all(got[i] == plain(c) for i, c in enumerate(cases))


def test_number_all_has_no_gaps(spark):
    rows = [(d, f"v{(d * 7) % 13}", "A" if d % 2 else "B") for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, value string, kind string").withColumn("start", F.lit(0))
    got = {r["value"]: (r["kind"], r["n"]) for r in vault.number_all(df, ["doc_id"]).collect()}
    want, count = {}, {}
    for _, v, k in rows:
        if v not in want:
            count[k] = count.get(k, 0) + 1
            want[v] = (k, count[k])
    assert got == want


def test_splits_of_a_placeholder():
    from umbra.streaming import chunks

    values = {"[REDACTED_EMAIL_1]": "jo@mail.com"}
    text = "a [x] [REDACTED_EMAIL_1] [REDACTED_EMAIL_2] ["
    whole = text.replace("[REDACTED_EMAIL_1]", "jo@mail.com")
    for i, j in itertools.combinations(range(len(text) + 1), 2):
        out, pending = "", ""
        for part in (text[:i], text[i:j], text[j:]):
            done, pending = chunks.feed(pending, part, values)
            out += done
        assert out + chunks.flush(pending, values) == whole


def test_literal_places_overlap_and_are_linear(spark):
    text = "-a-a-a -a-a \\E(x) " + "long text " * 30_000 + "-a-a"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    values = spark.createDataFrame([(1, "-a-a", "SECRET"), (1, "\\E(x)", "SECRET"), (1, "none", "SECRET")], "doc_id int, value string, kind string")
    got = vault.literal_hits(df, values, ["doc_id"], ["doc_id"]).first()["known"]
    want = [i for v in ("-a-a", "\\E(x)") for i in range(len(text)) if text.startswith(v, i)]
    kept = [s["start"] for s in got]
    assert sorted(kept) == sorted(i for i in want if not (text[i] == "-" and text[i + 4 : i + 5].isalpha()))


def test_every_name_of_the_root_zone_is_a_tld_and_no_other(spark):
    plain = [t for t in ROOT_ZONE if t.isalpha()]
    others = ["zz", "xq", "qz", "nosuchzone", "berli"]
    rows = [(t, f"mail jo@mail.{t} or https://www.mail.{t}/x") for t in [*plain, *others]]
    df = spark.createDataFrame(rows, "tld string, text string").repartition(8)
    got = {r["tld"]: [s["kind"] for s in r["spans"]] for r in detect.detect_rules(df, ("email", "domain")).collect()}
    assert len(ROOT_ZONE) == 1438 and {"berlin", "london", "nyc", "swiss", "google"} <= set(plain)
    assert got == {t: ["EMAIL", "DOMAIN"] for t in plain} | {t: [] for t in others}


def test_terms_against_a_plain_search():
    from umbra.operators.terms import Terms, fold, whole_word

    rng = random.Random(9)
    words = ["ab", "Ab c", "abc", "c d", "É", "éa b", ".net", "b", "a  b"]
    for _ in range(300):
        terms = Terms(literals={"X": rng.sample(words, 4), "Y": rng.sample(words, 3)})
        text = "".join(rng.choice(["a", "b", "c", "d", " ", "  ", "\n", "é", "É", ".net", "Ab", "_"]) for _ in range(rng.randint(0, 25)))
        want = set()
        for section, literals in terms.literals.items():
            at = 0
            while at < len(text):
                ends = []
                for literal in literals:
                    parts = [fold(p) for p in literal.split()]
                    for end in range(at + 1, len(text) + 1):
                        piece = text[at:end]
                        if not piece[0].isspace() and not piece[-1].isspace() and [fold(p) for p in piece.split()] == parts and whole_word(text, at, end):
                            ends.append(end)
                if ends:
                    want.add((at, max(ends), section, "terms"))
                at = max(ends, default=at + 1)
        assert set(Finder(terms)(text)) == want, (terms, text)


def test_user_patterns_take_linear_time_and_follow_their_engine():
    import time

    from umbra.operators.terms import matches, pattern_problem

    began = time.perf_counter()
    assert matches(["a" * 200_000], "(a|aa)+!") == [[]] and time.perf_counter() - began < 5
    assert matches(["x1 é22\ufdd0333", None, ""], r"\d+") == [[(1, 2), (4, 6), (7, 10)], [], []]
    assert pattern_problem("(?=x)") == "invalid regex" and pattern_problem("a|") == "regex matches the empty string" and pattern_problem(r"(?i)t-\d+") is None


def test_many_terms_in_a_long_text():
    import time

    terms = parse("\n".join(f"term number {i}" for i in range(10_000)))
    text = "a term  number 77 and Term number 9999\n" * 5_000
    began = time.perf_counter()
    found = Finder(terms)(text)
    assert len(found) == 10_000 and text[found[0][0] : found[0][1]] == "term  number 77" and time.perf_counter() - began < 20


def test_texts_worth_scanning_are_all_that_hold_something(spark):
    rng = random.Random(14)
    parts = ["12", "3A", "Old", "Mill Road", " ", ", ", "\n", "IL 62704", "PO Box 7", "C:\\Users\\", "/mnt/c/Users/", "jo", "::1", "2001:db8:", ":7a1", "a:b:c:d:e:f:1:2", "kind: Secret\ndata:\n  k: v\n", "API_KEY=", "abc", "     1\t", "→", "export ", '"auths": {"auth": "x"}', '"serial":1,"lineage":2,"token": "x"', "client-key-data: x", "SW1A 1AA", "P.O. BOX\t12", '{"kind": "Secret", "data": {"k": "v"}}']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(6000)] + [t for t, _, _ in POSITIVE]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    worth = {r["i"] for r in df.where(rescans.worth_scanning(F.col("text"))).select("i").collect()}
    held = {i for i, t in enumerate(texts) if any(rescans.scan(t))}
    assert held <= worth and len(held) > 1000


def test_dictionary_join_equals_the_automaton(spark):
    import random

    from umbra.operators import dictionary
    from umbra.operators.terms import Literals

    rng = random.Random(9)
    letters = ["a", "b", "ab", "é", "😀", "_", " ", " ", "-", ".", "\n", "7"]
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [make(rng.randrange(400)) for _ in range(60)] + ["", None, "abab"]
    values = {make(rng.choice([3, 4, 5, 8, 9, 17])) for _ in range(1500)} | {"abab", "ab a", "x" * 40}
    for t in texts:
        for _ in range(3):
            if t:
                at = rng.randrange(len(t))
                values.add(t[at : at + rng.choice([4, 6, 10, 20, 50])])
    literals = [(v, f"K{len(v) % 3}") for v in values]
    automaton = Literals([(k, v) for v, k in literals])
    want = {i: sorted((s, e, k) for s, e, k, _ in automaton(t)) for i, t in enumerate(texts) if t and automaton(t)}
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    rows = spark.createDataFrame([*literals, *literals[:50]], "value string, kind string").repartition(3)
    got = {r["i"]: sorted((h["start"], h["end"], h["kind"]) for h in r["hits"]) for r in dictionary.dictionary_hits(docs, rows, "i").collect()}
    assert len(want) > 30 and got == want
    assert dictionary.dictionary_hits(docs, rows.limit(0), "i").count() == 0
