"""Periodic runs, interval joins and repeated passages against brute force."""

import datetime as dt
import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from umbra.llm import intervals, periods, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found = {}
    for period in range(1, len(words) // 4 + 1):
        start = 0
        while start + period < len(words):
            end = start
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end - start + period
            if end > start and length >= max(6, 4 * period):
                found.setdefault((start, length), period)  # the smallest period comes first
            start = end + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def test_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(150):
        batch = []
        for _ in range(rng.randint(1, 8)):
            words = [str(rng.randrange(rng.choice([1, 2, 3, 10]))) for _ in range(rng.choice([0, 1, 5, 6, 8, 20, 60, 150]))]
            if rng.random() < 0.6 and len(words) > 5:
                at = rng.randrange(len(words))
                words[at:at] = ([str(rng.randrange(3)) for _ in range(rng.randint(1, 6))] * 20)[: rng.randint(0, 60)]
            batch.append((words * 5)[: rng.randint(0, 5 * len(words) + 1)] if rng.random() < 0.3 else words)
        assert periods.runs_of(batch) == [plain_runs(words) for words in batch]


def test_periodic_runs_query(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "c d", "e"]) for _ in range(rng.randrange(60))) + "\n" * (i % 3)) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t "), (None, "x y " * 9), (None, None), (5, rows[5][1]), (400, "w " * 20_000)]
    want = Counter()
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n < 1000 else [(0, n, 1)]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        milli = 1000 * best[1] // best[2] if runs else None
        want[(doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())] += 1
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, Runs int, n_words string").repartition(3)
    assert Counter(tuple(r) for r in periods.digest(docs).collect()) == want
    found = periods.find_runs(docs)
    assert found.columns == ["doc_id", "Runs", "n_words", "text", "n_words_", "runs_", "strongest", "collapsed"]
    assert found.where("doc_id = 302").select("n_words_", "collapsed").first() == (0, "")
    assert periods.digest(docs.limit(0)).count() == 0


T0 = dt.datetime(2024, 1, 1)


def plain_pairs(sales, lines, clicks):
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    sessions = []
    for client in {c for c, *_ in clicks} - {None}:
        for t, kind in sorted((t, k or "") for c, t, k in clicks if c == client and t):
            if sessions and sessions[-1][0] == client and t - sessions[-1][2] <= dt.timedelta(minutes=15):
                last = sessions[-1]
                last[3] = (last[3] if t == last[2] else False) or kind == "error"
                last[2] = t
            else:
                sessions.append([client, t, t, kind == "error"])
    out = {}
    for sale, client, status, sold in sales:
        if client is None or sold is None:
            continue
        end = max([sold, *[s for i, s in lines if i == sale and i is not None and s]])
        a, b = micros(sold) // 21_600_000_000, float("inf") if status == "open" else micros(end) // 21_600_000_000
        for other, first, last, is_open in sessions:
            c, d = micros(first) // 21_600_000_000, float("inf") if is_open else micros(last) // 21_600_000_000
            if other == client and a <= d and c <= b:
                name = [["overlaps", "finished_by", "contains"], ["starts", "equals", "started_by"], ["during", "finishes", "overlapped_by"]][(a >= c) + (a > c)][(b >= d) + (b > d)]
                n, slots, crc = out.get((sale, name), (0, None, 0))
                shared = min(b, d) - max(a, c) + 1
                out[sale, name] = (n + 1, slots if shared == float("inf") else (slots or 0) + int(shared), crc + zlib.crc32(str(micros(first)).encode()))
    return Counter((*k, *v) for k, v in out.items())


def test_sales_and_sessions(spark):
    rng = random.Random(3)
    when = lambda hours: None if rng.random() < 0.03 else T0 + dt.timedelta(seconds=rng.randrange(hours * 3600))
    client = lambda: None if rng.random() < 0.05 else rng.choice([1, 1, 1, 2, 3, 4])
    sales = [(i, client(), rng.choice(["open", "done", None]), when(2000)) for i in range(150)] + [(None, 1, "done", T0), (None, 1, "done", T0)]
    sales += [(900, 9, "open", dt.datetime(1969, 12, 31, 23)), (901, 9, "done", dt.datetime(1969, 12, 30))]
    lines = [(rng.choice([None, *range(150)]), when(3000)) for _ in range(300)] + [(901, T0)]
    clicks = [(client(), when(2000), rng.choice(["error", "view", None])) for _ in range(400)]
    for _ in range(60):  # sessions of several clicks, at equal times and with gaps of just fifteen minutes
        c, t = rng.choice([1, 2]), when(2000) or T0
        clicks += [(c, t + dt.timedelta(minutes=15 * k) + dt.timedelta(microseconds=rng.choice([0, 0, 1])), rng.choice(["error", "view"])) for k in range(rng.randrange(5))]
        clicks += [(c, t, "view"), (c, t, "error")]
    clicks += [(9, dt.datetime(1969, 12, 31, 22, 59, 59, 999_999), "error"), (9, dt.datetime(1969, 12, 31), "view")]
    want = plain_pairs(sales, lines, clicks)
    for kind in ("timestamp", "timestamp_ntz"):
        frames = [
            spark.createDataFrame(sales, f"sale_id long, client_id long, status string, sold_at {kind}").withColumn("bucket", F.lit(1)),
            spark.createDataFrame(lines, f"sale_id long, shipped_at {kind}").withColumn("client_id", F.lit("x")),
            spark.createDataFrame(clicks, f"client_id long, ts {kind}, kind string").withColumn("session", F.lit(1)),
        ]
        got = intervals.sales_with_sessions(*frames)
        assert Counter(tuple(r) for r in got.select("sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc").collect()) == want
    assert intervals.sales_with_sessions(frames[0].limit(0), frames[1].limit(0), frames[2].limit(0)).count() == 0
    # Buckets of any width give the same pairs.
    slots = spark.createDataFrame([(1, a, a + n if n < 9 else None) for a in range(-5, 40, 3) for n in range(0, 11, 2)], "client_id long, a long, b long").distinct()
    right = slots.withColumns({"n": F.lit(2).cast("long"), "total": F.col("a")})
    widths = [Counter(tuple(r) for r in intervals.overlap_join(slots, right, w).collect()) for w in (1, 4, 28)]
    assert widths[0] and widths[0] == widths[1] == widths[2]


def plain_passages(rows, least):
    counts = Counter()
    raw = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    for _, data in raw:
        counts.update(data[i : i + least] for i in range(len(data) - least + 1))
    out = Counter()
    for doc_id, data in raw:
        spans = []
        for i in range(len(data) - least + 1):
            if counts[data[i : i + least]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        out[(doc_id, len(data), tuple(map(tuple, spans)), hashlib.sha256(kept + data[at:]).hexdigest())] += 1
    return out


def found_passages(docs, **options):
    return Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), r["kept_sha256"]) for r in repeats.passages(docs, **options).collect())


def test_suffix_arrays_by_grouping():
    rng = random.Random(4)
    for _ in range(1500):
        text = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60]))]
        assert repeats.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert repeats.suffix_array([]) == []


def test_repeated_passages(spark):
    rng = random.Random(5)
    words = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    passages = [words(n, 1000) for n in (60, 80, 120, 300)]
    short = words(60, 999)[:330]  # common, and shorter than a window
    rows = []
    for i in range(120):
        text = words(rng.randint(0, 150), 5000)
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            text += " " + p[rng.choice([0, 0, 50]) : len(p) - rng.choice([0, 0, 90])] + " " + words(rng.randint(0, 80), 5000)
        text += short + words(rng.randint(0, 60), 5000) if rng.random() < 0.5 else ""
        text += "ab" * rng.randint(0, 900) if rng.random() < 0.05 else "ä" * rng.randint(0, 900) if rng.random() < 0.05 else ""
        rows.append((i if rng.random() < 0.9 else None, text if rng.random() < 0.95 else None))
    rows += [*rows[:9], (500, rows[3][1]), (501, ""), (502, "x" * 399), (503, "x" * 400), (504, "q" * 401), (505, "q" * 1200)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tid int").repartition(4)
    want = plain_passages(rows, 400)
    assert sum(bool(k[2]) for k in want) > 40
    # Grams with many different stretches are split until they are few.
    for crowd in (128, 3):
        assert found_passages(docs, crowd=crowd) == want
    assert repeats.passages(docs.limit(0)).count() == 0


def test_repeated_passages_of_other_lengths(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least in (1, 8, 13):
        assert found_passages(docs, least=least, crowd=4) == plain_passages(rows, least)
