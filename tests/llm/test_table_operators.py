import gzip
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from umbra.llm import media, mixing, neardup, packing, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *([None] * (5 - len(r)))) for r in rows], DOCS)


def words(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 5000, n))


# ---- near duplicates -------------------------------------------------------------------------------


def plain_classes(rows):
    """Smallest id of each class, by comparing all pairs."""
    bags = {}
    for i, t in rows:
        w = (t or "").lower().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for x in ids:
        for y in ids:
            a, b = bags[x], bags[y]
            if x < y and a and b and (both := sum((a & b).values())) >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for k in rng.integers(0, len(w), edits):
            w[k] = f"e{rng.integers(1_000_000)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(11)
    base, passage = words(rng, 150), words(rng, 60)
    texts = [words(rng, int(n)) for n in rng.integers(1, 300, 40)]
    texts += [base] + family(rng, base, 60, 2) + family(rng, base, 25, 4) + [base.upper()] * 2
    texts += [passage + " " + words(rng, 40) for _ in range(25)]
    texts += ["spam egg " * 200, "spam egg " * 230, "spam egg " * 100, "one two", "one two", "One  two", "", "  ", None, "　"]
    texts += texts[3:8] * 3
    return list(enumerate(texts))


def test_near_duplicates_against_all_pairs(spark, copies):
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, copies).withColumn("digest", F.lit(1))).collect()}
    assert got == plain_classes(copies)
    assert neardup.classes(docs(spark, []).limit(0)).count() == 0


def test_one_of_each_class_stays(spark, copies):
    rows = [(i, t, "en", "s", 1) for i, t in copies] + [(0, copies[0][1], "en", "s", 1), (None, copies[1][1] + " x", "en", "s", 1), (None, "nobody else has this text at all", "en", "s", 1)]
    df = docs(spark, rows).withColumn("class_id", F.lit("clash"))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    want = {i for i, c in plain_classes(copies).items() if i == c}
    assert {i for i in ids if i is not None} == want and ids[0] == 1 and ids[None] <= 2


def test_unlike_texts_without_id_or_under_one_id_all_stay(spark):
    rng = np.random.default_rng(23)
    alone, twins = [words(rng, 60) for _ in range(6)], [words(rng, 60) for _ in range(2)]
    near = words(rng, 150)
    rows = [(None, t) for t in alone] + [(4, t) for t in twins] + [(None, near), (None, near + " end"), (None, alone[0]), (9, alone[5])]
    kept = Counter((r["doc_id"], r["text"]) for r in neardup.keep_one(docs(spark, rows)).collect())
    one = {k for k in kept if k[1] in (near, near + " end")}
    assert len(one) == 1
    assert kept == Counter([(None, t) for t in alone[:5]] + [(9, alone[5])] + [(4, t) for t in twins] + list(one))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        h = np.sort(rng.integers(0, 2**63, 70).astype(np.uint64))
        a, b = rng.integers(1, 30, 70), rng.integers(1, 30, 70)
        alone, among = neardup.signatures([(h, a)]), neardup.signatures([(h, b)] + [(h + np.uint64(7), a)] * 40)
        errors.append((alone[0] == among[0]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02
    p, q = neardup.signatures([(h, a), (h, b)])
    packed = neardup.packed_slots(np.array([p, q])).view(np.uint64)
    fields = lambda x: [(int(v) >> 2 * i) & 3 for v in x for i in range(32)]
    assert sum(x == y for x, y in zip(fields(packed[0]), fields(packed[1]))) >= (p == q).sum()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in edges if a != b], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["comp"], "big") for r in neardup.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert neardup.components(df.limit(0)).count() == 0


# ---- packing ---------------------------------------------------------------------------------------


def test_packing_holds_every_id_once(spark):
    import pandas as pd
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    texts = ["", None, "Hello, WORLD's 12 İstanbul ΣΑΣ <|endoftext|> \x1c x", "naïve café, don't", "Ab\u00a0cd\u0085ef x².y, 12.5 É,ß", "a,.b .. ,c", "e\u0301 \u1e9b\u0323", "word " * 3000, "x" * 5000] + [words(rng, int(n)) for n in rng.integers(1, 900, 60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "nobody"), (7, texts[7])]
    got = packing.pack(docs(spark, rows).withColumn("offset", F.lit("clash"))).toPandas()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    for i, t in rows:
        own = got[got.doc_id.isna() if i is None else got.doc_id == i].drop_duplicates(["start"]).sort_values("start")
        want, at = ids(t), 0
        for s, n, c, total in own[["start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False):
            assert s == at and total == len(want) and zlib.crc32(want[s : s + n].tobytes()) == c
            at += n
        assert at == len(want)
    assert len(got) == sum(-(-len(ids(t)) // 2048) for _, t in rows)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 2048
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    assert isinstance(got, pd.DataFrame) and packing.pack(docs(spark, []).limit(0)).count() == 0


def test_ids_are_the_tokenizers_for_every_code_point_and_mixtures():
    import struct

    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    encoder, tokenizer = packing.WordEncoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(9)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[i : i + 1])) + "a" for i in range(0, len(points), 3)]
    pools = [list(map(chr, p)) for p in (range(0x20, 0x250), range(0x300, 0x3FF), range(0x0900, 0x1000), range(0x1E00, 0x2100), range(0xAC00, 0xAD00))]
    pools.append(["<|endoftext|>", "'s", "'LL", "..", ", ", " ", "\n", "Σ", "ς", "İ", "ǅ", "a\u0301", "\u1100\u1161", "12", "_"])
    texts += ["".join(rng.choice(pools[k]) for k in rng.integers(0, len(pools), n)) for n in rng.integers(2, 9, 40_000)]
    texts += ["\u0378", "x\u0558y", "a \u088f b" * 50, "I\u0307\u1abdL"]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, x, y in zip(texts, encoder.encode(texts), want) if x != y] == []


def test_full_pieces_are_sequences_by_themselves(spark):
    rows = [(i, "word " * n) for i, n in enumerate([2047, 4095, 6143, 1, 0, 2048, 10_000])] + [(None, "word " * 2047)]
    got = packing.pack(docs(spark, rows).repartition(3)).toPandas()
    full = got[got.length == 2048]
    assert len(full) == 1 + 2 + 3 + 1 + 4 + 1 and (full.offset == 0).all() and (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique())) and got.length.sum() == sum(len((t or "").split()) + 1 for _, t in rows)


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(8)
    h = np.bincount(np.clip(rng.lognormal(4, 0.9, 30_000).astype(int), 1, 256), minlength=257)
    plan = packing.solve(h)
    bound = (h * np.arange(257)).sum() / 256
    assert bound <= plan.sequences <= bound * 1.01 + 2
    load = np.zeros(plan.sequences)
    for c in np.flatnonzero(h):
        np.add.at(load, plan.place(c, np.arange(h[c])), c)
    assert load.max() <= 256 and load.min() > 0
    assert packing.solve(np.zeros(257, int)).sequences == 0


def test_knapsack_against_enumeration():
    sizes, values = np.array([3, 5, 7]), np.array([0.4, 0.75, 1.0])
    best = max(a * 0.4 + b * 0.75 + c for a in range(7) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 20)
    value, copies = packing.knapsack(values, sizes, 20)
    assert value == pytest.approx(best) and copies @ sizes <= 20 and copies @ values == pytest.approx(best)


# ---- mixing ----------------------------------------------------------------------------------------


def test_mixing_realises_the_weights(spark):
    rng = np.random.default_rng(2)
    rows = [(i, words(rng, int(n)), "en", "hot" if i < 500 else f"s{i % 5}", 1) for i, n in enumerate(rng.integers(1, 60, 700))]
    rows += [(900, None, "en", "s1", 1), (901, "a b", "en", None, 1), (5, rows[5][1], "en", "hot", 1), (902, "", "en", "void", 0)]
    df = docs(spark, rows).withColumn("key", F.lit("clash"))
    plan = mixing.plan(df).toPandas()
    tokens = Counter()
    for _, t, _, s, _ in rows:
        tokens[s or ""] += len((t or "").split())
    taken = Counter()
    for r in plan.itertuples():
        taken[r.source] += r.n_tokens * r.n_rows
    rates = {s: taken[s] / n for s, n in tokens.items() if n}
    assert min(rates.values()) >= 1 and max(rates.values()) <= 2 * min(rates.values()) + 0.6
    assert rates["hot"] == 1 and set(plan.doc_id.dropna()) == {r[0] for r in rows}
    for (s, e), g in plan.groupby(["source", "epoch"]):
        g = g[g.n_tokens > 0].sort_values("position")
        mass = (g.n_tokens * g.n_rows).to_numpy()
        assert (np.diff(g.position) == mass[:-1]).all()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == int((plan.n_rows).sum())
    assert mixing.mix(df.limit(0)).count() == 0


def plain_plan(spark, rows, max_repeats):
    """(doc_id, epoch) -> (position, block): every source's documents in the order of their hash, epoch after epoch, up to its quota."""
    units = Counter((i, s or "", t) for i, t, _, s, *_ in rows)
    key = lambda i, s, t: hashlib.md5("|".join(["null" if i is None else str(i), s, "null" if t is None else hashlib.md5(t.encode()).hexdigest()]).encode()).hexdigest()
    listed = [(key(*u), *u, len((u[2] or "").split()), n) for u, n in units.items()]
    held = Counter()
    for *_, s, _, k, n in listed:
        held[s] += k * n
    shares = {s: n / sum(held.values()) for s, n in held.items() if n}
    low, high = 0.0, 1.0  # plain bisection: the least exponent that keeps the rates of repetition within the limit
    worst = lambda a: (max(shares.values()) / min(shares.values())) ** (1 - a)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if worst(mid) <= max_repeats + 1e-12 else (mid, high)
    high = 0.0 if worst(0.0) <= max_repeats else high
    raised = {s: p**high for s, p in shares.items()}
    whole = max(held[s] / raised[s] for s in raised)
    asked = [(k, e) for k, *_ in listed for e in range(5)]
    df = spark.createDataFrame(asked, "key string, epoch int")
    order = {(r["key"], r["epoch"]): r["h"] for r in df.withColumn("h", F.xxhash64("key", "epoch", F.lit(mixing.SEED))).collect()}
    unsigned = lambda h: h & (2**64 - 1)
    out = {}
    for source in held:
        quota = raised.get(source, 0) * whole
        for epoch in range(5):
            at = epoch * held[source]
            for k, i, s, t, n, times in sorted((u for u in listed if u[2] == source), key=lambda u: (unsigned(order[u[0], epoch]) >> 52, order[u[0], epoch], u[0])):
                if epoch == 0 or at < quota - 1e-6 * max(1, quota) and held[source]:
                    out[i, s, t, epoch] = (at, int(at // max(1.0, raised.get(source, 0) / sum(raised.values()) * 100)))
                at += n * times
    return out


def test_mixing_plan_against_a_plain_version(spark):
    rng = np.random.default_rng(12)
    rows = [(i, words(rng, int(n)), "en", ("hot", "hot", "hot", "warm", "cold")[i % 5] if i % 7 else "rare", 1) for i, n in enumerate(rng.integers(1, 60, 300))]
    rows += [(400, None, "en", "hot", 1), (401, "a b", "en", None, 1), (5, rows[5][1], "en", "warm", 1), (402, "", "en", "void", 0), (None, "x y z", "en", "cold", 1), rows[8], rows[8], (403, "w " * 4000, "en", "cold", 1)]
    for limit in (2.0, 1.3):
        plan = mixing.plan(docs(spark, rows).withColumn("epoch", F.lit("clash")), max_repeats=limit, block=100)
        texts = {hashlib.md5("|".join(["null" if r[0] is None else str(r[0]), r[3] or "", "null" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()]).encode()).hexdigest(): r[1] for r in rows}
        got = {(r["doc_id"], r["source"], texts[r["key"]], r["epoch"]): (r["position"], r["block"]) for r in plan.collect()}
        want = plain_plan(spark, rows, limit)
        assert set(got) == set(want) and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert sum(got[k] != want[k] for k in got) <= 0.01 * len(got)  # a position on a block's edge


def test_mixed_rows_lie_in_order_of_block(spark):
    rng = np.random.default_rng(13)
    rows = [(i, words(rng, 30), "en", ("hot", "cold")[i % 4 == 0], 1) for i in range(400)]
    df = docs(spark, rows).repartition(3)
    blocks = {(r["doc_id"], r["epoch"]): r["block"] for r in mixing.plan(df, block=2000).collect()}
    files = mixing.mix(df, block=2000).select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()
    for p in {r["p"] for r in files}:
        seen, order = Counter(), []
        for r in sorted((r for r in files if r["p"] == p), key=lambda r: r["at"]):
            order.append(sorted(b for (i, _), b in blocks.items() if i == r["doc_id"])[seen[r["doc_id"]]])
            seen[r["doc_id"]] += 1
        assert order == sorted(order)


def test_bisection_meets_its_targets(spark):
    shares = np.array([0.7, 0.2, 0.06, 0.04])
    counts = spark.createDataFrame([(f"s{i}", int(1e6 * p)) for i, p in enumerate(shares)], "source string, tokens long")

    def entropy(w):
        return -(w * np.log(w)).sum()

    for target in (0.75, 0.9):
        w = np.array([r["weight"] for r in mixing.weights(counts, target_entropy=target, max_repeats=None).orderBy("source").collect()])
        assert entropy(w) / np.log(4) == pytest.approx(target, abs=1e-4)
    for limit in (1.5, 4.0):
        rows = mixing.weights(counts, max_repeats=limit).orderBy("source").collect()
        rates = np.array([r["quota"] / r["tokens"] for r in rows])
        assert rates.min() == pytest.approx(1) and rates.max() == pytest.approx(limit, rel=1e-3)
    assert mixing.weights(counts, target_entropy=0.0, max_repeats=None).first()["exponent"] == 1.0


# ---- media -----------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    rng = np.random.default_rng(6)
    long = words(rng, 30_000)
    texts = ["", None, "é😀", long, long + "!", "x" * 100_000, words(rng, 500), words(rng, 500)] + [long] * 3
    rows = docs(spark, [*enumerate(texts), (None, "no id"), (None, "no id")]).repartition(3)
    for clash in ("digest", "home", "row", "chunks", "payload_bytes", "block"):
        rows = rows.withColumn(clash, F.lit("clash"))
    got = {r["doc_id"]: r for r in media.digest(rows).collect()}
    assert got[None]["n_bytes"] == 5 and media.digest(rows).where("doc_id is null").count() == 2
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    same = ("media_bytes", "media_sha256", "feature")
    assert all(got[8][k] == got[3][k] for k in same) and all(got[0][k] == got[1][k] for k in same)
    assert media.digest(docs(spark, []).limit(0)).count() == 0


def test_chunks_are_cut_by_content():
    gear, rng = media._gear(), np.random.default_rng(0)
    data = rng.integers(0, 256, 300_000).astype(np.uint8).tobytes()
    pieces = lambda p: [p[a:b] for a, b in zip([0, *media.cuts(p, gear)], media.cuts(p, gear))]
    a, b = pieces(data), pieces(data[:1000] + b"inserted" + data[1000:])
    assert b"".join(a) == data and len(set(a) & set(b)) >= len(a) - 3
    assert all(media.LEAST <= len(x) <= media.MOST for x in a[:-1]) and media.cuts(b"", gear) == []
    h = 0
    for i, byte in enumerate(data[:200]):  # the vector form equals the rolling one
        h = ((h << 1) + int(gear[byte])) & 0xFFFFFFFF
    v = gear[np.frombuffer(data[:200], np.uint8)]
    for s in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(v)
        shifted[s:] = v[:-s] << np.uint32(s)
        v = v + shifted
    assert int(v[-1]) == h


def test_short_lists_are_noticed(spark, tmp_path):
    rng = np.random.default_rng(1)
    lists = media.store(docs(spark, [(1, words(rng, 9000))]), f"file://{tmp_path}/p")
    size = lambda rows: media.rebuild(rows, f"file://{tmp_path}/p", lambda p, n, s: (len(p),), "n long").first()["n"]
    assert size(media.deduplicate(lists)) == lists.first()["payload_bytes"] > 3 * media.LEAST
    with pytest.raises(Exception, match="damaged"):
        size(lists.withColumn("chunks", F.slice("chunks", 2, 10_000)))


def test_chunks_that_many_tasks_store_are_kept_at_one_place(spark, tmp_path):
    rng = np.random.default_rng(2)
    common = words(rng, 4000)
    lists = media.store(docs(spark, [(i, common + words(rng, 50)) for i in range(12)]).repartition(6), f"file://{tmp_path}/p")
    places = lambda rows: rows.select(F.explode("chunks").alias("c")).groupBy("c.digest").agg(F.count_distinct("c.pack", "c.start").alias("n")).agg(F.max("n")).first()[0]
    done = media.deduplicate(lists)
    assert places(lists) > 1 and places(done) == 1 and done.count() == 12


def test_deduplicated_lists_against_a_plain_version(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    common = words(rng, 3000)
    texts = [common + words(rng, int(n)) for n in rng.integers(0, 3000, 30)] + ["", None, common, common, "z" * 70_000]
    lists = media.store(docs(spark, [*enumerate(texts), (None, common)]).repartition(5), f"file://{tmp_path}/p")
    rows = lists.collect()
    least = {}
    for r in rows:
        for c in r["chunks"]:
            place = (c["pack"], c["start"], c["stored"])
            least[c["digest"]] = min(least.get(c["digest"], place), place)
    want = sorted((r["home"], r["row"], [(c["digest"], c["length"], *least[c["digest"]]) for c in r["chunks"]]) for r in rows)
    for readers in (20_000, 1):
        monkeypatch.setattr(media, "MOST_READERS", readers)
        monkeypatch.setattr(media, "READ_BYTES", 50_000)
        done = media.deduplicate(lists)
        assert sorted((r["home"], r["row"], [(c["digest"], c["length"], c["pack"], c["start"], c["stored"]) for c in r["chunks"]]) for r in done.collect()) == want
    # Cuts are where the hash of the last 32 bytes says, found byte by byte.
    gear, data = media._gear(), common.encode()[:40_000]
    ends, h, at = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(gear[byte])) & 0xFFFFFFFF
        if i + 1 - at >= media.LEAST and h >> (32 - media.BITS) == 0 or i + 1 - at == media.MOST or i + 1 == len(data):
            ends.append(i + 1)
            at = i + 1
    assert media.cuts(data, gear) == ends


def test_damaged_chunks_are_noticed(spark, tmp_path):
    lists = media.deduplicate(media.store(docs(spark, [(1, "abc " * 300)]), f"file://{tmp_path}/p"))
    (pack,) = [p for p in (tmp_path / "p").iterdir()]
    data = bytearray(pack.read_bytes())
    data[10] ^= 1
    pack.write_bytes(bytes(data))
    with pytest.raises(Exception):
        media.rebuild(lists, f"file://{tmp_path}/p", lambda p, n, s: (len(p),), "n long").collect()


# ---- WARC ------------------------------------------------------------------------------------------


def pages(spark):
    big = "é" * 700
    rows = [(1, "http://a/\n1", big), (2, "u2", big), (3, "u3", big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (7, None, ""), (3, "u3", big), (None, "u", big), (9, "u", "z" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    got = warc.round_trip(pages(spark).withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1)).withColumn("keeper", F.lit(0))).collect()
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    rows = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    big = sha("é" * 700)
    assert rows == Counter({(1, 1400, big, "revisit", 3): 1, (2, 1400, big, "revisit", 3): 1, (3, 1400, big, "response", None): 2, (None, 1400, big, "revisit", 3): 1, (4, 5, sha("small"), "response", None): 1, (5, 5, sha("small"), "response", None): 1, (6, 0, sha(""), "response", None): 1, (7, 0, sha(""), "response", None): 1, (9, 300_000, sha("z" * 300_000), "response", None): 1})
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_warc_predicates_and_skipped_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark), path)
    read = spark.read.format("warc").load(path)
    some = read.where(F.col("record_type") == "revisit")
    assert some.count() == 3 and "Filter" not in some._jdf.queryExecution().sparkPlan().toString().split("BatchScan")[0]
    assert read.where(F.col("target_uri").isin("u4", "u5")).count() == 2
    assert read.where(F.col("record_id").startswith("<urn:page:9")).first()["payload_bytes"] == 300_000
    bare = spark.read.format("warc").option("payload", "false").load(path)
    assert bare.where("payload is not null").count() == 0 and bare.count() == 10


def test_warc_files_that_end_within_a_record(tmp_path):
    import io

    row = lambda i: {"record_id": f"<urn:page:{i}>", "record_type": "response", "target_uri": "u", "date": None, "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": bytes([65 + i]) * 5000}
    plain, packed, foreign = (b"".join(f(warc.record(row(i))) for i in range(2)) for f in (lambda x: x, warc.member, gzip.compress))

    def sizes(data, want=True):
        return [len(s.block(int(head[b"content-length"]))) if want else 0 for head, s in warc.Stream(io.BytesIO(data), len(data))]

    for data in (plain, packed, foreign):
        assert len(sizes(data)) == 2
        for cut in (len(data) - 200, len(data) // 2 + 30, len(data) // 2 - 20):
            for want in (True, False):
                with pytest.raises(ValueError, match="ends within"):
                    sizes(data[:cut], want)


def test_warc_members_too_long_for_their_field_and_rolled_files(spark, tmp_path, monkeypatch):
    import io

    row = {"record_id": "<urn:page:1>", "record_type": "response", "target_uri": "u", "date": None, "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": b"x" * 9000}
    monkeypatch.setattr(warc, "SAID_BELOW", 4000)
    data = warc.member(warc.record(row)) * 3
    assert data[3] == 0 and [len(warc.payload_of(s.block(int(h[b"content-length"])))) for h, s in warc.Stream(io.BytesIO(data), len(data))] == [9000] * 3
    warc.register(spark)
    rows = warc.records(spark.createDataFrame([(i, "u", f"{i} " * 5000) for i in range(20)], "page_id long, url string, html string"))
    rows.coalesce(1).write.format("warc").option("maxFileBytes", 200).mode("append").save(f"file://{tmp_path}/w")
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 3 and spark.read.format("warc").load(f"file://{tmp_path}/w").count() == 20


def test_warc_of_other_writers(spark, tmp_path):
    row = lambda i: {"record_id": f"<urn:page:{i}>", "record_type": "response", "target_uri": "u", "date": None, "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": bytes([65 + i]) * (i * 3000)}
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(row(i))) for i in range(5)))
    (tmp_path / "b.warc").write_bytes(b"".join(warc.record(row(i)) for i in range(5)))
    warc.register(spark)
    got = spark.read.format("warc").load(f"file://{tmp_path}").collect()
    assert sorted(len(r["payload"]) for r in got) == sorted([i * 3000 for i in range(5)] * 2)


# ---- the pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = df.columns, df.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.materialise(stage(spark, df, sf))
        assert df.columns == columns, name
    ids = {r["doc_id"] for r in df.select("doc_id").collect()}
    assert 0.5 * before < len(ids) <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf).toPandas()
    assert set(packed.doc_id) == ids and packed.groupby("sequence_id").length.sum().max() <= 2048
