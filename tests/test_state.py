import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from umbra.operators import admission, metrics, state, vault
from umbra.sources import files
from umbra.streaming import stores

T0 = dt.datetime(2024, 1, 1)
at = lambda minutes: T0 + dt.timedelta(minutes=minutes)


def test_idle_set_expires_exactly_at_its_time(spark):
    rows = [("a", at(0), "v1", "K"), ("a", at(59), "v2", "K"), ("a", at(119), "v3", "K")]
    df = spark.createDataFrame(rows, "client string, ts timestamp, value string, kind string")
    lives = state.alive_spans(df, ["client"]).orderBy("life").collect()
    assert [(r["began"], r["expires"]) for r in lives] == [(at(0), at(119)), (at(119), at(179))]
    live = lambda m: {r["value"] for r in state.live_values(df, ["client"], F.lit(at(m))).collect()}
    assert live(58) == {"v1"} and live(118) == {"v1", "v2"} and live(119) == {"v3"} and live(179) == set()


def test_bounds_by_count_and_bytes(spark):
    rows = [("a", at(i), "é" * (i + 1), "K") for i in range(6)]
    df = spark.createDataFrame(rows, "client string, ts timestamp, value string, kind string")
    live = lambda **b: sorted(len(r["value"]) for r in state.live_values(df, ["client"], F.lit(at(9)), **b).collect())
    assert live() == [1, 2, 3, 4, 5, 6] and live(most_values=2) == [5, 6] and live(most_bytes=22) == [5, 6] and live(most_bytes=11) == []


def test_chains(spark):
    puts = spark.createDataFrame([("c", "r", at(0)), ("c", "r", at(30))], "client string, response_id string, ts timestamp")
    gets = spark.createDataFrame([(1, "c", "r", at(10)), (2, "c", "r", at(89)), (3, "c", "r", at(90)), (4, "d", "r", at(10))], "id int, client string, response_id string, ts timestamp")
    assert {r["id"]: r["put_ts"] for r in state.chain_hits(gets, puts, ["client"]).collect()} == {1: at(0), 2: at(30), 3: None, 4: None}
    assert {r["id"] for r in state.chain_misses(gets, puts, ["client"]).collect()} == {3, 4}
    assert [r["ts"] for r in state.kept_chains(puts, most=1).collect()] == [at(30)]
    links = spark.createDataFrame([(i, i - 1 if i % 10 else None) for i in range(40)], "id int, parent int")
    assert all(r["root"] == r["id"] // 10 * 10 and r["depth"] == r["id"] % 10 for r in state.chain_roots(links).collect())


def test_rendezvous(spark):
    nodes = [f"10.0.0.{i}" for i in (1, 2, 3)]
    keys = spark.createDataFrame([(f"c{i}", "/r") for i in range(1000)], "client string, route string")
    got = {r["client"]: r["owner"] for r in state.owners(keys, nodes).collect()}
    want = {c: max(sorted(nodes), key=lambda n: hashlib.sha256(f"{n}\0{c}\0/r".encode()).digest()[:8]) for c in got}
    assert got == want and all(250 <= list(got.values()).count(n) <= 420 for n in nodes)
    fewer = {r["client"]: r["owner"] for r in state.owners(keys, nodes[:2]).collect()}
    assert all(fewer[c] == n for c, n in got.items() if n in nodes[:2])


def test_tokens_file_and_authentication(spark, tmp_path):
    h = hashlib.sha256(b"secret").hexdigest()
    (tmp_path / "tokens").write_text(f"﻿# who\n\nann:{h}\nbob:12\nann:{'0' * 64}\ncid:{h}\n")
    rows = files.read_tokens(spark, f"{tmp_path}/tokens").orderBy("line").collect()
    assert [(r["line"], r["problem"]) for r in rows] == [(3, None), (4, "hash is not 64 hex digits"), (5, "duplicate name"), (6, "duplicate hash")]
    tokens = spark.createDataFrame([("ann", h)], "name string, hash string")
    requests = spark.createDataFrame([(1, "secret"), (2, ""), (3, None), (4, "x")], "id int, token string")
    assert {r["id"]: (r["client"], r["status"]) for r in state.authenticate(requests, tokens).collect()} == {1: ("ann", 200), 2: (None, 401), 3: (None, 401), 4: (None, 401)}


def test_histogram_quantile_and_exposition(spark):
    log = spark.createDataFrame([("/a", "GET", 0, True, 0.01, at(0)), ("/a", "BREW", 700, False, 400.0, at(1)), ("-", "GET", 404, False, 0.3, at(1))], "route string, method string, status int, forwarded boolean, seconds double, ts timestamp")
    h = metrics.duration_histogram(log)
    counts = {(r["route"], r["le"]): r["count"] for r in h.where("handling = 'local'").collect()}
    assert counts["/a", "300"] == 0 and counts["/a", "+Inf"] == 1 and counts["unmatched", "0.25"] == 0 and counts["unmatched", "0.5"] == 1
    q = {r["route"]: r["quantile"] for r in metrics.quantile(h.where("handling = 'local'"), ["route"], 0.5).collect()}
    assert q == {"/a": 300.0, "unmatched": 0.375}
    red = spark.createDataFrame([('/a"b', "EMAIL", 2)], "route string, kind string, n long")
    lines = [r["line"] for r in metrics.exposition(metrics.requests_total(log), h, red, spark.range(7, 8).toDF("n")).collect()]
    assert [x.split()[2] for x in lines if x.startswith("# TYPE")] == [f"umbra_{name}" for name, *_ in metrics.FAMILIES]
    assert lines[1:3] == ["# TYPE umbra_http_requests_in_flight gauge", "umbra_http_requests_in_flight 7"]
    assert lines[5] == 'umbra_http_requests_total{route="/a",method="GET",status="200",handling="forwarded"} 1'
    first = [x.rpartition(" ") for x in lines if 'handling="local"' in x and 'route="/a"' in x and "duration" in x]
    assert [name.partition("{")[0].rpartition("_")[2] for name, _, _ in first] == ["bucket"] * 14 + ["sum", "count"] and [n for *_, n in first][-3:] == ["1", "400", "1"]
    assert lines[-1] == 'umbra_redactions_total{route="/a\\"b",kind="EMAIL"} 2'
    flights = {r["t"]: r["in_flight"] for r in metrics.in_flight(log).collect()}
    assert flights[at(1)] == 2 and max(flights) == at(1) + dt.timedelta(seconds=400) and flights[max(flights)] == 0


def test_doubles_in_their_fewest_digits(spark):
    from umbra.functions import scalars

    want = {0.0: "0", 1.0: "1", 0.3: "0.3", 400.25: "400.25", 999999.5: "999999.5", 1e6: "1e+06", 1234567.5: "1.2345675e+06", 1e7: "1e+07", 1.25e123: "1.25e+123", 0.001: "0.001", 0.00025: "0.00025", 0.0001: "0.0001", 0.00009: "9e-05", -1.5: "-1.5", -2500000.0: "-2.5e+06", float("inf"): "+Inf"}
    got = spark.createDataFrame([(v,) for v in want], "v double").select("v", scalars.shortest(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in got} == want


def test_admission_predicates(spark):
    row = spark.range(1).select(
        *[admission.is_loopback(F.lit(h)).alias(f"l{i}") for i, h in enumerate(("localhost", "127.0.0.9", "::1", "10.0.0.1", "127.0.0.300"))],
        admission.is_event_stream(F.lit(None).cast("string"), F.lit("event: response.created")).alias("s0"),
        admission.is_event_stream(F.lit("application/json"), F.lit("event: response.created")).alias("s1"),
    ).first()
    assert list(row) == [True, True, True, False, False, True, False]


def test_files(spark, tmp_path):
    for name, text in (("a", "jo@mail.com\n x jo@mail.com"), ("b", "192.0.2.1")):
        (tmp_path / name).write_text(text)
    from umbra.operators import detect

    docs = files.read_texts(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    found = detect.detect(docs)
    lines = [r["l"] for r in files.explain(found, ["file_ord"]).orderBy("file_ord", "n").select(files.explain_line().alias("l")).collect()]
    assert lines[1] == '2:4  EMAIL  email  "jo@mail.com"'
    assert files.summary(files.kind_counts(found)).first()[0] == "EMAIL=2 IPV4=1"
    assert files.summary(files.kind_counts(found.limit(0))).first()[0].startswith("nothing redacted")
    (tmp_path / "terms").write_text("Orion\n")
    held = files.Reloaded(spark, f"{tmp_path}/terms", lambda p: files.read_terms(spark, p))
    assert held.get().count == 1
    (tmp_path / "bad").write_text("Orion\n[ALLOW]\nmail.com\nmy password: hunter22\n")
    with pytest.raises(ValueError, match="terms line 4: ALLOW entry looks like"):
        files.read_terms(spark, f"{tmp_path}/bad")
    (tmp_path / "terms").write_text("xx\n")
    assert held.get().count == 1 and held.error and held.version == 1
    (tmp_path / "terms").unlink()
    assert held.get().count == 1 and held.error == "no such file"
    (tmp_path / "terms").write_text("Orion\nVega 7\n")
    assert held.get().count == 2 and held.error is None and held.version == 2


def test_entropy_is_that_of_bytes(spark):
    import math

    from umbra.functions import scalars

    rng = random.Random(1)
    rows = [("".join(rng.choices("abcABC012+/", k=40)),) for _ in range(30)]
    for r in spark.createDataFrame(rows, "v string").select("v", scalars.shannon(F.col("v")).alias("h")).collect():
        n = [r["v"].count(c) / 40 for c in sorted(set(r["v"]))]
        assert abs(r["h"] + sum(p * math.log2(p) for p in n)) < 1e-9


def test_down_spans_against_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(f"n{rng.randint(0, 2)}", T0 + dt.timedelta(seconds=rng.randint(0, 9000))) for _ in range(600)]
    rows += [("steady", T0 - dt.timedelta(seconds=5 * k)) for k in range(-1500, 1500)]  # every five seconds, over hours
    rows += [("dense", T0 + dt.timedelta(microseconds=rng.randint(0, 8_000_000_000))) for _ in range(5000)]
    rows += [("once", T0), ("once", T0), (None, T0), ("n0", None)]
    want = set()
    for node in {n for n, _ in rows} - {None}:
        until = None
        for t in sorted(t for n, t in rows if n == node and t):
            if until is None or t >= until:
                until = t + dt.timedelta(seconds=10)
                want.add((node, t, until))
    failures = spark.createDataFrame(rows, "node string, ts timestamp")
    for piece in ("INTERVAL 1 HOUR", "INTERVAL 11 SECONDS"):
        got = [tuple(r) for r in state.down_spans(failures, piece=piece).select("node", "began", "until").collect()]
        assert len(got) == len(want) and set(got) == want
    assert state.down_spans(failures.limit(0)).count() == 0


def test_nodes_that_are_down_are_passed_over(spark):
    nodes = ["10.0.0.1", "10.0.0.2"]
    downs = spark.createDataFrame([("10.0.0.1", at(1), at(1) + dt.timedelta(seconds=10)), ("10.0.0.2", at(5), at(5) + dt.timedelta(seconds=10))], "node string, began timestamp, until timestamp")
    times = [at(0), at(1), at(1) + dt.timedelta(seconds=9), at(1) + dt.timedelta(seconds=10), at(5)]
    rows = [(i, f"c{c}", "/r", t) for i, t in enumerate(times) for c in range(20)]
    got = state.owners_up(spark.createDataFrame(rows, "i int, client string, route string, ts timestamp"), nodes, downs).collect()
    free = {c: n for c, n in ((r["client"], r["owner"]) for r in got if r["i"] == 0)}
    assert set(free.values()) == set(nodes) and all(r["owner"] == free[r["client"]] for r in got if r["i"] in (0, 3))
    assert all(r["owner"] == "10.0.0.2" for r in got if r["i"] in (1, 2)) and all(r["owner"] == "10.0.0.1" for r in got if r["i"] == 4)


def test_vaults_continue_along_branching_chains(spark):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "c"), ("x", None), ("y", "x")], "id string, parent string")
    found = spark.createDataFrame([("a", 0, "E", "v1"), ("a", 5, "E", "v2"), ("b", 0, "E", "v3"), ("b", 9, "S", "v1"), ("c", 0, "E", "v4"), ("d", 3, "E", "v3"), ("d", 1, "S", "v5"), ("y", 0, "E", "v1")], "id string, start int, kind string, value string")
    got = {(r["id"], r["value"]): (r["root"], r["placeholder"]) for r in vault.number_chains(found, links).collect()}
    assert got == {
        ("a", "v1"): ("a", "[REDACTED_E_1]"), ("a", "v2"): ("a", "[REDACTED_E_2]"), ("b", "v3"): ("a", "[REDACTED_E_3]"), ("c", "v4"): ("a", "[REDACTED_E_3]"),
        ("d", "v5"): ("a", "[REDACTED_S_1]"), ("d", "v3"): ("a", "[REDACTED_E_4]"), ("y", "v1"): ("x", "[REDACTED_E_1]"),
    }


def test_vaults_along_trees_against_a_plain_fold(spark):
    rng = random.Random(4)
    links, children = [], {}
    for i in range(400):
        # Long chains, branches, wide families, and parents that no row has.
        parent = None if i % 97 == 0 else -5 if i % 131 == 0 else i - 1 if rng.random() < 0.8 else rng.randrange(i)
        links.append((i, parent))
    links += [(1000 + i, 17) for i in range(60)]
    found = [(i, rng.randrange(100), rng.choice("AB"), f"v{rng.randrange(30)}") for i, _ in links for _ in range(rng.randrange(4))]
    parents, want = dict(links), {}
    for i, _ in links:
        chain, at = [], i
        while at in parents:
            chain.append(at)
            at = parents[at]
        root = chain[-1] if at is None else at
        known, counts = {}, {}
        for request in reversed(chain):
            firsts = {}
            for r, start, kind, value in found:
                if r == request:
                    firsts[value] = min(firsts.get(value, (start, kind)), (start, kind))
            for (start, kind), value in sorted((f, v) for v, f in firsts.items()):
                if value not in known:
                    counts[kind] = counts.get(kind, 0) + 1
                    known[value] = (request, kind, counts[kind])
        want |= {(i, value): (root, kind, n) for value, (request, kind, n) in known.items() if request == i}
    rows = vault.number_chains(spark.createDataFrame(found, "id long, start int, kind string, value string"), spark.createDataFrame(links, "id long, parent long")).collect()
    got = {(r["id"], r["value"]): (r["root"], r["kind"], r["n"]) for r in rows}
    assert len(rows) == len(got) and got == want


def test_streaming_stores_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    minutes = sorted(rng.sample(range(600), 150))
    rows = [("c", "/r", at(m), None if i % 3 == 0 else f"v{rng.randint(0, 9)}", None if i % 3 == 0 else "SECRET", i if i % 3 == 0 else None) for i, m in enumerate(minutes)]
    schema = "client string, route string, ts timestamp, value string, kind string, request long"
    for k in range(3):
        spark.createDataFrame(rows[k * 50 : (k + 1) * 50], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stores.known_values(source, most_values=5).writeStream.format("memory").queryName("known").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {(r["request"], r["value"], r["rank"]) for r in spark.table("known").collect()}
    every = spark.createDataFrame(rows, schema)
    batch = state.live_values_at(every.where("request is null"), every.where("request is not null").select("client", "ts", "request"), ["client"], "request", most_values=5)
    assert got and got == {(r["request"], r["value"], r["rank"]) for r in batch.collect()}

    chains = [("c", "/r", f"r{i % 4}", t, f"vault{i}" if i % 2 else None, None if i % 2 else i) for i, (_, _, t, *_) in enumerate(rows)]
    schema = "client string, route string, response_id string, ts timestamp, vault string, request long"
    spark.createDataFrame(chains, schema).coalesce(1).write.parquet(f"{tmp_path}/chains")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/chains")
    q = stores.chain_vaults(source).writeStream.format("memory").queryName("chains").outputMode("append").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    every = spark.createDataFrame(chains, schema)
    batch = state.chain_hits(every.where("request is not null").select("client", "response_id", "ts", "request"), every.where("request is null"), ["client"])
    assert {(r["request"], r["hit"]) for r in spark.table("chains").collect()} == {(r["request"], r["put_ts"] is not None) for r in batch.collect()}


def test_many_files_are_one_scan_and_redacted_texts_are_written(spark, tmp_path):
    from umbra.operators import detect

    paths = []
    for i in range(30):
        (tmp_path / f"f +%{i}.txt").write_text(f"mail a{i}@mail.com")
        paths.append(f"{tmp_path}/f +%{i}.txt")
    with pytest.raises(ValueError, match="one file"):
        files.read_texts(spark, [f"{tmp_path}"])
    docs = files.read_texts(spark, [*paths, paths[3]])
    assert docs.inputFiles() and len(docs._jdf.queryExecution().optimizedPlan().collectLeaves().toString().split("Relation")) - 1 == 1
    rows = sorted((r["file_ord"], r["file"], r["text"]) for r in docs.collect())
    assert [(i, p) for i, p, _ in rows] == [*enumerate(paths), (30, paths[3])] and rows[30][2] == rows[3][2] == "mail a3@mail.com"
    found = detect.detect(docs)
    numbered = vault.number_all(vault.appearances(found, [], ["file_ord"]), ["file_ord"])
    counts = files.write_redacted(vault.redact_all(found, numbered, ["file_ord"]), f"{tmp_path}/out")
    assert {tuple(r) for r in counts.collect()} == {("EMAIL", 31)}
    back = {r["file_ord"]: r["redacted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert back[0] == "mail [REDACTED_EMAIL_1]" and back[3] == back[30] and len(set(back.values())) == 30
