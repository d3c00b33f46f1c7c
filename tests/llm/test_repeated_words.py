"""Strings of a number of words that repeat, however few bytes they have."""

from __future__ import annotations

import random
import re
from collections import Counter

from umbra.llm import repeats


def plain_repeated_words(rows, words):
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)] for _, data in texts]
    windows = [[data[p[i][0] : p[i + words - 1][1]] for i in range(len(p) - words + 1)] for (_, data), p in zip(texts, places)]
    counts = Counter(w for ws in windows for w in ws)
    return Counter((doc_id, len({j for i, w in enumerate(ws) if counts[w] > 1 for j in range(i, i + words)})) for (doc_id, _), ws in zip(texts, windows))


def found_repeated_words(docs, words, **options):
    return Counter((r["doc_id"], r["n_repeated_words"]) for r in repeats.passages(docs, words=words, **options).collect())


def test_short_passages_of_many_words(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    shared = [prose(n) for n in (50, 51, 55, 59, 49, 120)]  # the first five have fewer than 400 bytes
    assert all(len(p) < 400 for p in shared[:5])
    rows = []
    for i in range(90):
        text = prose(rng.randint(0, 90))
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(shared)
            words = p.split(" ")
            cut = rng.choice([0, 0, 0, 3])
            text += rng.choice([" ", "\n", "é "]) + " ".join(words[cut:]) + rng.choice([" ", ".", " "]) + prose(rng.randint(0, 90))
        text += " la" * rng.randint(40, 90) if rng.random() < 0.05 else ""
        rows.append((i, text if rng.random() < 0.95 else None))
    rows += [*rows[:5], (500, rows[7][1]), (501, ""), (502, " ".join("ab"[k % 2] for k in range(50))), (503, " ".join("ab"[k % 2] for k in range(50))), (504, shared[0].replace(" ", "\n"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_repeated_words(rows, 50)
    assert sum(n > 0 for _, n in want) > 30
    assert found_repeated_words(docs, 50) == want
    for words in (1, 17, 64):
        assert found_repeated_words(docs, words, crowd=4) == plain_repeated_words(rows, words)
    # What is removed stays the same; the query's rows carry the count.
    key = ["doc_id", "n_bytes", "spans", "kept_sha256"]
    removed = [sorted(map(str, repeats.passages(docs, words=w).select(*key).collect())) for w in (0, 50)]
    assert removed[0] == removed[1]
    got = repeats.digest(docs).where("n_removed = 0 and n_repeated_words >= 50").count()
    assert got > 5


def test_words_over_pieces(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(repeats, "PIECE", 64)
    data = " ".join("x" * rng.randint(1, 9) + rng.choice("abc") for _ in range(400)).encode() + b" "
    starts, stops = repeats.word_places(data + data)
    assert (data + data).split() == [(data + data)[a:b] for a, b in zip(starts, stops)]
    seed, place, first, last = repeats.word_anchors(data + data, starts, stops, repeats.np.array([400, 400, 800]), 50)
    stretches = list(zip(seed.tolist(), place.tolist(), first.tolist(), last.tolist()))
    covered = [x for _, _, a, b in stretches for x in range(a, b + 1)]
    assert covered == [*range(351), *range(400, 751)]
    assert all(a <= p <= b + 34 and p >= b for _, p, a, b in stretches)
    # Equal texts have equal anchors at equal places.
    merged = lambda lo: {(s, p - lo) for s, p, a, _ in stretches if lo <= a < lo + 400}
    assert merged(0) == merged(400)
