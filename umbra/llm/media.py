"""Media columns as deduplicated content-defined chunks.

A payload is cut where a rolling gear hash over the last 32 bytes has 12 leading zero bits, at
least 512 and at most 16384 bytes apart, so that an insertion moves only the cuts beside it.
Writing tasks append the deflated chunks to packs in the shared folder, a chunk once a task,
and return each row's chunk list.  A Spark join by digest then points every list at one copy of
each chunk, and reading follows the lists, checks every chunk against its digest and every
payload against its length and its own digest.  Packs of failed attempts are never pointed at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, materialise, shared_dir

LEAST, BITS, MOST = 512, 12, 16384
DIGEST_BYTES = 20
PACK_BYTES = 256 << 20
#: Digests that a writing task remembers; beyond it starts anew, which only stores some chunks again.
SEEN = 1_000_000
#: Payload bytes that a reading task should rebuild, and rows of a list block that stay together.
READ_BYTES, READ_ROWS = 32 << 20, 500
#: Tasks that read back, at most; a task takes its blocks one after another, whatever their number.
MOST_READERS = 20_000
#: A text's bytes are filled up with 255 to a positive multiple of this.
UNIT = 576
MAGIC = b"CDC1"


def _gear() -> np.ndarray:
    """256 pseudo-random words, from a multiplicative rule."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def cuts(payload: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of a payload; the last is its length, an empty payload has none."""
    h = gear[np.frombuffer(payload, np.uint8)]
    # h[i] becomes the sum of gear[b[i - j]] << j over the last 32 bytes, by doubling.
    for s in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[s:] = h[:-s] << np.uint32(s)
        h = h + shifted
    marks = (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist()
    out, at = [], 0
    while at < len(payload):
        k = bisect_left(marks, at + LEAST)
        end = min(marks[k] if k < len(marks) else len(payload), at + MOST, len(payload))
        out.append(end)
        at = end
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST_BYTES).digest()


def text_payload(text: str | None) -> tuple[bytes, int]:
    """A text's bytes padded to a positive multiple of ``UNIT``, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


LISTED = "doc_id long, n_bytes long, payload_bytes long, payload_digest binary, home string, row long, chunks array<struct<digest:binary,length:int,pack:string,start:long,stored:int>>"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write the payloads of ``docs(doc_id, text)`` as packs below ``path``: the rows' chunk lists, in order.

    (home, row) names a row: the first pack of its task and its number there.  The result is
    a table in the shared folder, so that only lists of successful attempts are seen.
    """

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        system, root = _system(path)
        system.create_dir(root, recursive=True)
        gear, seen = _gear(), {}
        out, pack, at, home, row = None, "", 0, None, 0
        for batch in chunks:
            listed: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_digest", "home", "row", "chunks")}
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                payload, n = text_payload(text)
                mine, begin = [], 0
                for end in cuts(payload, gear):
                    chunk = payload[begin:end]
                    digest = digest_of(chunk)
                    if digest not in seen:
                        if out is None or at > PACK_BYTES:
                            if out is not None:
                                out.close()
                            pack, at = uuid.uuid4().hex, 0
                            out = system.open_output_stream(f"{root}/{pack}", compression=None)
                        data = zlib.compress(chunk, 1)
                        out.write(data)
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[digest] = {"digest": digest, "length": len(chunk), "pack": pack, "start": at, "stored": len(data)}
                        at += len(data)
                    mine.append(seen[digest])
                    begin = end
                home = home or pack
                for column, value in zip(listed.values(), (doc_id, n, len(payload), digest_of(payload), home, row, mine)):
                    column.append(value)
                row += 1
            yield listed
        if out is not None:
            out.close()

    return materialise(arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, LISTED))


def deduplicate(lists: DataFrame) -> DataFrame:
    """The same lists, every digest at the one place that all rows use.

    A task has a digest at one place or a few, so that references are first reduced to a row for
    each task and digest: a chunk that a third of all payloads hold is met by as many rows as
    there are tasks.  Lists are dealt out in blocks of rows of one task, in its order, by the
    payload bytes that they stand for.
    """
    refs = lists.select("home", "row", "doc_id", "n_bytes", "payload_bytes", "payload_digest", F.posexplode("chunks").alias("pos", "c"))
    own = materialise(refs.groupBy("home", F.col("c.digest").alias("digest")).agg(F.min(F.struct("c.pack", "c.start", "c.stored")).alias("at")))
    shared = own.groupBy("digest").agg(F.min("at").alias("at"), F.count("*").alias("tasks")).where("tasks > 1").select("digest", "at")
    # Only digests that several tasks have stored change places.
    moved = materialise(own.select("home", "digest").join(shared, "digest").select(F.col("home").alias("h"), F.col("digest").alias("moved"), "at"))
    placed = refs.join(moved, (F.col("home") == F.col("h")) & (F.col("c.digest") == F.col("moved")), "left")
    chunk = F.struct("pos", F.col("c.digest").alias("digest"), F.col("c.length").alias("length"), *[F.coalesce(F.col(f"at.{k}"), F.col(f"c.{k}")).alias(k) for k in ("pack", "start", "stored")])
    total = lists.agg(F.sum("payload_bytes")).first()[0] or 0
    dealt = placed.withColumn("block", F.floor(F.col("row") / READ_ROWS)).repartition(min(MOST_READERS, max(1, -(-total // READ_BYTES))), "home", "block")
    facts = [F.first(c).alias(c) for c in ("doc_id", "n_bytes", "payload_bytes", "payload_digest")]
    whole = dealt.groupBy("home", "block", "row").agg(*facts, F.sort_array(F.collect_list(chunk)).alias("chunks"))
    return whole.sortWithinPartitions("home", "row")


class Packs:
    """Ranges of pack files, read in blocks; a few blocks are held."""

    BLOCK, HELD = 1 << 20, 12

    def __init__(self, path: str):
        self.system, self.root = _system(path)
        self.blocks: OrderedDict[tuple[str, int], bytes] = OrderedDict()

    def block(self, pack: str, k: int) -> bytes:
        if (pack, k) not in self.blocks:
            with self.system.open_input_file(f"{self.root}/{pack}") as f:
                f.seek(k * self.BLOCK)
                self.blocks[pack, k] = f.read(self.BLOCK)
            if len(self.blocks) > self.HELD:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end((pack, k))
        return self.blocks[pack, k]

    def read(self, pack: str, start: int, stored: int) -> bytes:
        first, last = start // self.BLOCK, (start + stored - 1) // self.BLOCK
        data = b"".join(self.block(pack, k) for k in range(first, last + 1))
        return data[start - first * self.BLOCK :][:stored]


def rebuild(lists: DataFrame, path: str, made: Callable[[bytes, int, bytes], tuple], schema: str) -> DataFrame:
    """Read every row's payload back, verified, and return ``made(payload, n_bytes, stored form)`` as columns.

    The stored form of a payload is its chunk list (lengths and digests) and the chunks as stored.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        packs = Packs(path)
        for batch in chunks:
            out: dict[str, list] = {"doc_id": [], "n_bytes": []} | {k: [] for k in names}
            for doc_id, n, size, digest, listed in zip(*(batch[k] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_digest", "chunks"))):
                recipe, parts, kept = [MAGIC, len(listed).to_bytes(4, "big")], [], []
                for c in listed:
                    data = packs.read(c["pack"], c["start"], c["stored"])
                    chunk = zlib.decompress(data)
                    if len(chunk) != c["length"] or digest_of(chunk) != c["digest"]:
                        raise ValueError(f"a chunk in {c['pack']} at {c['start']} is damaged")
                    recipe.append(c["length"].to_bytes(4, "big") + c["digest"])
                    parts.append(chunk)
                    kept.append(data)
                payload = b"".join(parts)
                if len(payload) != size or digest_of(payload) != digest:
                    raise ValueError(f"the chunk list of a payload of {size} bytes is damaged")
                out["doc_id"].append(doc_id)
                out["n_bytes"].append(n)
                for name, value in zip(names, made(payload, n, b"".join(recipe + kept))):
                    out[name].append(value)
            yield out

    return arrow_pass(lists.select("doc_id", "n_bytes", "payload_bytes", "payload_digest", "chunks"), rows, "doc_id long, n_bytes long, " + schema)


def features(payload: bytes, ends: list[int]) -> str:
    """Chunks, their mean length, and the entropy and mean of the bytes."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    return f"chunks={len(ends)};mean_chunk={len(payload) / len(ends):.1f};entropy={float(-(p * np.log2(p)).sum()):.4f};mean={float((counts * np.arange(256)).sum() / len(payload)):.3f}"


def digest(docs: DataFrame) -> DataFrame:
    """Store every whole text as media, read it back, and describe what was read: a row for each row.

    Null text is an empty payload of padding; a null doc_id is kept; repeated rows and ties have
    equal values, as equal texts have; a text of any length is stored whole, in chunks; an empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    path = shared_dir(docs.sparkSession)

    def made(payload: bytes, n: int, stored: bytes) -> tuple:
        found = cuts(payload, gear)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload, found)

    gear = _gear()
    # Read back as dealt: a table between would be read by the size of the lists, which is small.
    return rebuild(deduplicate(store(docs, path)), path, made, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
