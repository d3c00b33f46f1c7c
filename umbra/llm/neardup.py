"""Near duplicates by BagMinHash: weighted-Jaccard signatures, banding, exact verification, components.

A text is the multiset of its five-word shingles.  Each shingle runs Poisson processes over
its weight axis, which is discretised into unit steps and grouped into dyadic blocks
([0,1), [1,2), [2,4), ...): a block's process has the block's whole rate, a point lands on a
step of the block and counts only if that step lies below the shingle's weight.  Points are
made in order of time and stop once no signature slot can be improved, so that a heavy or a
late shingle costs little.  Two signatures agree in a slot with the probability of their
weighted Jaccard similarity.

Texts are handled once, however many documents hold them.  Texts that share a band meet at one
centre of their bucket, a star instead of all pairs: at the text whose buckets hold most texts,
which in a family of copies is the original.  Links are verified on the exact multisets.  Where
a bucket still holds several components, texts of different components are compared with one
another as well, so that no link is lost to the choice of the centre.  Of these pairs only those
are made whose lengths, signatures and shingles allow similarity 0.8.  Shingles that no other
text in question holds cannot be shared, and what either of two texts lacks of their common
centre they cannot share either; both bound the overlap from above, and lose no pair.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, free_names, materialise

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: At similarity 0.8, 32 bands of 4 slots miss a pair with probability 4.7e-8.
BANDS, BAND_SLOTS = 32, 4
SLOTS = BANDS * BAND_SLOTS
#: Equal slots, by two bits each, that a pair of the second round needs before its texts are
#: fetched: at similarity 0.8 a pair has fewer with probability 1.4e-8, less than the 4.7e-8 that the bands miss.
LEAST_EQUAL_SLOTS = 84
#: Two-bit fields of a long, and their low bits.
FIELDS = 32
LONGS = SLOTS // FIELDS
_LOW = 0x5555555555555555
CACHE_WORDS = 200_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        return x ^ (x >> np.uint64(31))


class Shingler:
    """A text's shingle hashes and their multiplicities."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE_WORDS, len(h))  # shorter texts are one shingle
        with np.errstate(over="ignore"):
            s = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                s = _mix(s + _GOLD) + h[k : len(h) - n + 1 + k]
        return np.unique(_mix(s), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BagMinHash: a row of ``SLOTS`` times for each multiset (hashes, multiplicities), none of them empty.

    Times are whole numbers of 2^-44: their sums do not depend on how many points are made at
    once, so that a point has the same time in every text.
    """
    n = len(bags)
    sig = np.full(n * SLOTS, np.iinfo(np.int64).max)
    if not n:
        return sig.reshape(0, SLOTS)
    hashes = np.concatenate([b[0] for b in bags])
    weights = np.concatenate([b[1] for b in bags])
    owner = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    # One item for each shingle and dyadic block that begins below the shingle's weight.
    level = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(int), 0)
    item = np.repeat(np.arange(len(hashes)), level + 1)
    block = np.arange(len(item)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    low = np.where(block > 0, np.left_shift(1, np.maximum(block - 1, 0)), 0)
    size = np.where(block > 0, low, 1)
    with np.errstate(over="ignore"):
        seed = _mix(hashes[item] + block.astype(np.uint64) * _GOLD)
    below = weights[item] - low  # steps of the block that lie under the weight
    owner, time, at = owner[item], np.zeros(len(item), np.int64), 0
    while len(seed):
        k = int(np.clip(65536 // len(seed), 1, 32))
        with np.errstate(over="ignore"):
            bits = _mix(seed[:, None] + np.arange(at + 1, at + k + 1, dtype=np.uint64) * _GOLD)
            where = _mix(bits + _GOLD)
        gaps = (-np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) * (2.0**44 / (SLOTS * size))[:, None]).astype(np.int64) + 1
        times = time[:, None] + np.cumsum(gaps, axis=1)
        step = (where >> np.uint64(16)).astype(np.int64) & np.int64(2**40 - 1)
        counts = step % size[:, None] < below[:, None]
        slot = owner[:, None] * SLOTS + (where & np.uint64(SLOTS - 1)).astype(np.int64)
        np.minimum.at(sig, slot[counts], times[counts])
        time, at = times[:, -1], at + k
        alive = time < sig.reshape(n, SLOTS).max(axis=1)[owner]
        seed, owner, time, size, below = seed[alive], owner[alive], time[alive], size[alive], below[alive]
    return sig.reshape(n, SLOTS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row's bands."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, BAND_SLOTS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _GOLD
        for k in range(BAND_SLOTS):
            key = _mix(key + bits[:, :, k])
    return key.view(np.int64)


def packed_slots(sig: np.ndarray) -> np.ndarray:
    """Two bits of each slot, 32 slots in a long."""
    bits = (_mix(sig.view(np.uint64)) & np.uint64(3)).reshape(len(sig), LONGS, FIELDS)
    return np.bitwise_or.reduce(np.left_shift(bits, 2 * np.arange(FIELDS, dtype=np.uint64)), axis=2).view(np.int64)


def equal_slots(p: str, q: str) -> Column:
    """How many slots agree, of two columns of packed slots."""
    differ = [F.col(p)[i].bitwiseXOR(F.col(q)[i]) for i in range(LONGS)]
    unequal = [F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW))) for x in differ]
    return F.lit(SLOTS) - reduce(lambda a, b: a + b, unequal)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The mass that two multisets share."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())


def text_digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def sign(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, digest of the text (null without words), number of shingles, band keys, packed slots.

    A task signs a text once; further rows with it have null keys.  It remembers the digests of
    300,000 texts; of others it signs each copy, which only costs time.
    """

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        shingler, seen = Shingler(), set()
        for chunk in chunks:
            digests, bags, fresh = [], [], []
            for i, text in enumerate(chunk["text"]):
                digest = text_digest(text) if text and not text.isspace() else None
                digests.append(digest)
                if digest is not None and digest not in seen:
                    if len(seen) < 300_000:
                        seen.add(digest)
                    bags.append(shingler(text))
                    fresh.append(i)
            sig = signatures(bags)
            keys, slots = band_keys(sig), packed_slots(sig)
            out: dict[str, list] = {"doc_id": chunk["doc_id"], "digest": digests} | {k: [None] * len(digests) for k in ("n", "bands", "slots")}
            for row, i in enumerate(fresh):
                out["n"][i], out["bands"][i], out["slots"][i] = int(bags[row][1].sum()), keys[row], slots[row]
            yield out

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, digest binary, n long, bands array<long>, slots array<long>")


#: Longs of the bitmap in which a text's lacks, against its centre, are hashed; collisions only loosen the bound.
LACK_LONGS = 4


def lacks(text: tuple[np.ndarray, np.ndarray], centre: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A bitmap of the centre's shingles that the text does not hold as often."""
    at = np.minimum(np.searchsorted(text[0], centre[0]), max(0, len(text[0]) - 1))
    held = np.where(text[0][at] == centre[0], text[1][at], 0) if len(text[0]) else np.zeros(len(centre[0]), np.int64)
    missing = centre[0][held < centre[1]]
    bits = np.zeros(64 * LACK_LONGS, np.uint8)
    bits[(_mix(missing) % np.uint64(64 * LACK_LONGS)).astype(np.int64)] = 1
    return np.packbits(bits).view(">i8").astype(np.int64).tolist()


def compare(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``pairs(a, b)`` of digests with linked, their shared mass, and what b lacks of a; ``texts(digest, text)`` has each digest once."""

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        shingler = Shingler()
        recent: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def bag(digest: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if digest not in recent:
                recent[digest] = shingler(text)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[digest]

        for chunk in chunks:
            out: dict[str, list] = {"a": chunk["a"], "b": chunk["b"], "linked": [], "shared": [], "lacks": []}
            for a, b, s, t in zip(chunk["a"], chunk["b"], chunk["text"], chunk["other"]):
                p, q = bag(a, s), bag(b, t)
                shared = overlap(p, q)
                out["linked"].append(shared >= threshold * (int(p[1].sum() + q[1].sum()) - shared))
                out["shared"].append(shared)
                out["lacks"].append(lacks(q, p))
            yield out

    with_b = pairs.select("a", "b").join(texts.select(F.col("digest").alias("b"), F.col("text").alias("other")), "b")
    both = with_b.join(texts.select(F.col("digest").alias("a"), "text"), "a")
    return materialise(arrow_pass(both.select("a", "b", "text", "other"), rows, "a binary, b binary, linked boolean, shared long, lacks array<long>"))


def linked(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, comp), comp one of the component's nodes.

    Edges are stars in the main, a centre a with thousands of texts b.  Each b is hung on the
    least of its centres, whose other centres are tied to that one; only the ties go through the
    rounds, so that a large family is a few edges between centres there.
    """
    edges = edges.where("a != b")
    hung = materialise(edges.groupBy("b").agg(F.min("a").alias("m")))
    tops = materialise(edges.select("a").distinct())
    ties = edges.join(hung, "b").where("a != m").select("a", F.col("m").alias("b"))
    above = hung.join(tops.select(F.col("a").alias("b")), "b", "left_semi").select(F.col("b").alias("a"), F.col("m").alias("b"))
    found = materialise(_starred(materialise(ties.union(above).distinct()))).select(F.col("node").alias("m"), "comp")
    leaves = hung.join(tops.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("b").alias("node"), "m")
    placed = leaves.union(tops.select(F.col("a").alias("node"), F.col("a").alias("m")))
    return placed.join(found, "m", "left").select("node", F.coalesce("comp", "m").alias("comp"))


def _starred(edges: DataFrame) -> DataFrame:
    """(node, comp), comp the smallest node, by large-star and small-star rounds."""

    def starred(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lower = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(lower, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hung.union(lower.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        edges = materialise(starred(edges))
        before, now = now, state(edges)
        if now == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def shareable(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(digest, n, common) for ``asked(digest, n)``: of each text's shingles, how many another of these texts holds too."""

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        shingler = Shingler()
        for chunk in chunks:
            bags = [shingler(t) for t in chunk["text"]]
            sizes = [len(b[0]) for b in bags]
            halves = np.frombuffer(b"".join(chunk["digest"]), ">i8").reshape(-1, 2).astype(np.int64)
            yield {
                "shingle": np.concatenate([b[0] for b in bags]).view(np.int64),
                "d1": np.repeat(halves[:, 0], sizes),
                "d2": np.repeat(halves[:, 1], sizes),
                "mass": np.concatenate([b[1] for b in bags]),
            }

    each = arrow_pass(texts.join(asked.select("digest"), "digest", "left_semi").select("digest", "text"), rows, "shingle long, d1 long, d2 long, mass long")
    alone = each.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("d1").alias("d1"), F.min("d2").alias("d2"), F.min("mass").alias("mass")).where("texts = 1")
    lonely = alone.groupBy("d1", "d2").agg(F.sum("mass").alias("lonely"))
    half = lambda c, at: F.conv(F.substring(F.hex(c), at, 16), 16, -10).cast("long")
    keyed = asked.withColumn("d1", half(F.col("digest"), 1)).withColumn("d2", half(F.col("digest"), 17))
    return materialise(keyed.join(lonely, ["d1", "d2"], "left").select("digest", "n", (F.col("n") - F.coalesce("lonely", F.lit(0))).alias("common")))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)``: (doc_id, digest, class_id, class_size), a row per document.

    class_id is the smallest doc_id of the class.  Null and blank texts are in no class but
    their own (class_id their doc_id).  A null doc_id takes part by its text and only names a
    class that has no other.  Equal texts, and repeated rows, are one class whatever their
    number; texts of any length are compared whole; ties between centres go to the greater
    digest, and change no class.  An empty table gives no rows; other columns, whatever their
    names, are ignored.
    """
    return components_of(docs, threshold).drop("comp")


def components_of(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """As ``classes``, with comp: the digest that stands for the class, null for blank texts.

    Unlike class_id, which is null for all classes without an id and may be shared where one id
    has several texts, comp tells every class from the others.
    """
    signed = materialise(sign(docs))
    banded = signed.where("bands is not null").select("digest", F.explode("bands").alias("key"))
    # Counts and centres are tables of their own, so that the joins with them can be split where a bucket is hot.
    crowded = banded.groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("key", "size")
    members = materialise(banded.join(materialise(crowded), "key"))
    reach = members.groupBy("digest").agg(F.sum("size").alias("reach"))
    centres = members.select("key", "digest").join(reach, "digest").groupBy("key").agg(F.max(F.struct("reach", "digest")).alias("c")).select("key", F.col("c.digest").alias("a"), F.col("c.reach").alias("reach"))
    pairs = materialise(members.select("key", F.col("digest").alias("b")).join(materialise(centres), "key").where("a != b").select("a", "b", "reach").distinct())

    # The texts in question, each once; the documents are joined by id and text, so that copies do not meet in one task.
    asked = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    holders = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("digest")))
    wanted = holders.join(asked, "digest", "left_semi").select(key.alias("key"))
    keyed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("digest")).select("digest", "text", key.alias("key"))
    texts = materialise(keyed.join(wanted, "key", "left_semi").select("digest", "text").dropDuplicates(["digest"]))

    stars = compare(pairs, texts, threshold)
    links = linked(stars)
    comp = materialise(components(links))

    # Buckets that still hold several components: compare across them.
    info = signed.where("bands is not null").select("digest", "n", "slots").join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("n").alias("n"), F.max("slots").alias("slots"))
    info = materialise(info.join(comp.withColumnRenamed("node", "digest"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest")))
    placed = materialise(members.select("key", "digest").distinct().join(info, "digest"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    placed = materialise(placed.join(materialise(mixed), "key", "left_semi"))
    # A text's home is the centre of most reach that it has been compared with; a centre is at home with itself.
    away = stars.join(pairs, ["a", "b"]).groupBy(F.col("b").alias("digest")).agg(F.max(F.struct("reach", F.col("a").alias("home"), "shared", "lacks")).alias("h")).select("digest", "h.home", "h.shared", "h.lacks")
    away = away.join(placed.select("digest").distinct(), "digest", "left_semi")
    homes = away.select(F.col("home").alias("digest")).distinct()
    common = shareable(texts, placed.select("digest", "n").union(info.join(homes, "digest", "left_semi").select("digest", "n")).distinct())
    sizes = common.select(F.col("digest").alias("home"), F.col("n").alias("home_n"))
    outside = away.join(sizes, "home").join(common.select("digest", "common"), "digest").select("digest", "home", "home_n", "lacks", (F.col("common") - F.col("shared")).alias("beside"))
    facts = common.select("digest", "common").join(outside, "digest", "left").join(placed.groupBy("digest").agg(F.collect_set("key").alias("keys")), "digest")
    placed = placed.join(materialise(facts), "digest")
    x, y = placed.alias("x"), placed.alias("y")
    enough = lambda mass: mass * (1 + threshold) >= threshold * (F.col("x.n") + F.col("y.n")) - 1e-6
    together = reduce(lambda a, b: a + b, [F.bit_count(F.col("x.lacks")[i].bitwiseOR(F.col("y.lacks")[i])) for i in range(LACK_LONGS)])
    same_home = F.col("x.home_n") - together + F.least("x.beside", "y.beside")
    alike = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.comp") < F.col("y.comp"))
        & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n"))
        & enough(F.least("x.common", "y.common"))
        & (F.coalesce(F.col("x.home") != F.col("y.home"), F.lit(True)) | enough(same_home))
        & (equal_slots("x.slots", "y.slots") >= LEAST_EQUAL_SLOTS)
        # Of the buckets that a pair shares, the first alone gives it.
        & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
    )
    across = x.join(y, alike).select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b"))
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialise(across.join(known, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = links.union(linked(compare(more, texts, threshold)))
        comp = materialise(components(links))

    # From texts to documents: one row a text, then one a class, map-side first.
    by_text = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"))
    by_text = materialise(by_text.join(comp.withColumnRenamed("node", "digest"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest")))
    by_comp = materialise(by_text.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("docs").alias("class_size")))
    # Tables of their own again: a text may have very many copies, a class very many texts.
    named = materialise(by_text.join(by_comp, "comp").select("digest", "class_id", "class_size", "comp"))
    blank = signed.where("digest is null").select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("binary").alias("comp"))
    return signed.where("digest is not null").select("doc_id", "digest").join(named, "digest").select("doc_id", "digest", "class_id", "class_size", "comp").union(blank)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps the row with its smallest doc_id.

    Repeated rows (one id, one text) stay once; null and blank texts stay.  Of a class whose
    smallest id has several of its texts the one with the smallest digest stays; texts without an
    id stay if their class has none with one.  An empty table stays empty; other columns,
    whatever their names, come along.
    """
    (own,) = free_names(docs, "__umbra_row")
    key = lambda doc_id, digest: F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lower(F.coalesce(digest, F.lit("blank")))))
    found = components_of(docs, threshold)
    stay = found.where(F.col("digest").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    # One text of each class, should its smallest id come with several of its texts.
    stay = stay.groupBy("comp").agg(F.min(F.struct("digest", "doc_id")).alias("s")).select(key(F.col("s.doc_id"), F.hex("s.digest")).alias(own))
    worded = F.col("text").rlike(r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]")
    rows = docs.where(worded).withColumn(own, key(F.col("doc_id").cast("long"), F.md5("text"))).join(stay, own, "left_semi").dropDuplicates([own]).drop(own)
    return rows.union(docs.where(F.col("text").isNull() | ~worded))
