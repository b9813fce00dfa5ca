"""Near duplicates by fingerprints of shingle hashes, compared exactly in tiles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import documents, materialize
from lattica.llm.components import components
from lattica.llm.shingles import text_chunks

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile, and of a part of a bucket, which is what a task holds of either side.
TILE, PART = 256, 4096
#: Bytes of a text that are cut into words at a time.
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bits of each byte, the high one first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _slices(data: bytes) -> Iterator[bytes]:
    """data in pieces of about SLICE bytes, cut at white space."""
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + SLICE)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def _count(words: list[bytes], counts: np.ndarray) -> int:
    """Adds to counts how often each bit is set in the hashes of the words' shingles; their number."""
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(text[a:b], SEED) for a, b in zip(starts, ends[min(SHINGLE, len(words)) - 1 :].tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for byte in range(8):
        counts[8 * byte : 8 * byte + 8] += np.bincount(rows[:, byte], minlength=256) @ _BITS
    return len(rows)


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is in over half of the XXH64 hashes of the text's shingles of four words, A-Z lower-cased, repeats
    included. A text of fewer words has one shingle; one of none, or null, has 0."""
    counts, n = np.zeros(64, np.int64), 0
    kept: list[bytes] = []
    few: list[bytes] = []
    for piece in _slices((text or "").encode().lower()):
        words = kept + piece.split()
        if len(words) >= SHINGLE:
            n += _count(words, counts)
            kept = words[1 - SHINGLE :]
        else:
            kept = words
        few = kept
    if not n and few:
        n = _count(few, counts)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes()) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row: the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for _, _, texts in text_chunks(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def blocks_for(n: int, radius: int = RADIUS, part: int = PART) -> tuple[int, int, int]:
    """(blocks, chosen, bits): the fingerprint's bits are dealt into so many blocks, and a bucket is a choice of some of them with the
    first bits of each. Two fingerprints within the radius agree in blocks - radius of the blocks at least, so they meet in a
    bucket. Bits grow with n, so that a bucket holds about a part; up to a part, there is one bucket of all."""
    need = max(0, int(np.ceil(np.log2(max(n, 1) / part))))
    for blocks in range(radius + 1, 2 * radius + 1):
        chosen = blocks - radius
        if need <= chosen * (64 // blocks):
            break
    return blocks, chosen, min(-(-need // chosen), 64 // blocks)


def _buckets(nodes: DataFrame, blocks: int, chosen: int, bits: int) -> DataFrame:
    """nodes once for each choice of blocks, with the choice and its bits as one number."""
    width = 64 // blocks
    value = lambda b: F.shiftrightunsigned("fp", b * width).bitwiseAND((1 << bits) - 1)
    keys = []
    for c, choice in enumerate(combinations(range(blocks), chosen) if bits else [()]):
        key = F.lit(c).cast("long")
        for b in choice:
            key = F.shiftleft(key, bits).bitwiseOR(value(b))
        keys.append(key)
    return nodes.select("fp", "pop", F.explode(F.array(*keys)).alias("bucket"))


def near(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> list[tuple[int, int]]:
    """Of the links between fingerprints a and b (None: within a), which are in order of population count, a spanning forest.

    Tiles meet one another; a pair of tiles whose counts differ beyond the radius has no link and is skipped. Of a pair of tiles that
    meet, exclusive-or and bit counts give all links, of which only those between different trees of the forest are kept."""
    both = a if b is None else np.concatenate([a, b])
    pops = np.bitwise_count(both).astype(np.int64)
    parent = np.arange(len(both))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label = parent.copy()
    out = []
    for i in range(0, len(a), tile):
        i2 = min(i + tile, len(a))
        for j in range(i, len(a), tile) if b is None else range(len(a), len(both), tile):
            # The tiles of a and of b end where those do.
            j2 = min(j + tile, len(a) if b is None else len(both))
            if pops[j] - pops[i2 - 1] > radius:
                break
            if pops[i] - pops[j2 - 1] > radius:
                continue
            hit = np.bitwise_count(both[i:i2, None] ^ both[None, j:j2]) <= radius
            hit &= label[i:i2, None] != label[None, j:j2]
            if hit.any():
                x, y = np.nonzero(hit)
                pairs = np.column_stack([label[i + x], label[j + y]])
                for k in np.unique(pairs, axis=0, return_index=True)[1].tolist():
                    u, v = int(i + x[k]), int(j + y[k])
                    p, q = root(u), root(v)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((u, v))
                # Roots of all, by halving: labels are exact when the next tiles are compared.
                while not np.array_equal(up := parent[parent], parent):
                    parent[:] = up
                label = parent.copy()
    return [(int(both[u].view(np.int64)), int(both[v].view(np.int64))) for u, v in out]


def links(nodes: DataFrame, radius: int = RADIUS, part: int = PART, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that differ in 1 to radius bits, reduced to forests that connect all that
    the links connect.

    Fingerprints meet in buckets (blocks_for). A bucket of more than a part is cut, in order of population count, into parts of
    about that size, and each pair of parts whose counts are within the radius is a group of its own: a task never holds more
    than two parts, however many fingerprints agree in a bucket's bits."""
    nodes = materialize(nodes.select("fp", F.bit_count("fp").cast("int").alias("pop")), "simhash-nodes")
    blocks, chosen, bits = blocks_for(nodes.count(), radius, part)
    rows = _buckets(nodes, blocks, chosen, bits)
    # Parts: each population count of a bucket is cut by a hash, and small neighbouring ones share a part.
    sizes = rows.groupBy("bucket", "pop").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("bucket").orderBy("pop")
    sizes = sizes.select("bucket", "pop", "n", F.ceil(F.col("n") / part).alias("cuts"), (F.sum("n").over(upto) - F.col("n")).alias("before"))
    sizes = sizes.withColumn("slot", F.when(F.col("cuts") > 1, F.col("pop") * 2 + 1 + F.lit(1 << 40)).otherwise(F.floor(F.col("before") / part)))
    sizes = materialize(sizes, "simhash-sizes")
    cut = sizes.select("bucket", "slot", "pop", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))
    parts = cut.groupBy("bucket", "slot", "cut").agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
    one, two = (parts.select("bucket", F.struct("low", "high", "slot", "cut").alias(x)) for x in "pq")
    pairs = one.join(two, "bucket").where((F.col("p") <= F.col("q")) & (F.col("q.low") - F.col("p.high") <= radius) & (F.col("p.low") - F.col("q.high") <= radius))
    sides = F.when(F.col("p") == F.col("q"), F.array("p")).otherwise(F.array("p", "q"))
    pairs = pairs.select("bucket", "p", "q", F.posexplode(sides).alias("side", "own")).select("bucket", "p", "q", "side", "own.slot", "own.cut")
    placed = rows.join(sizes.select("bucket", "pop", "slot", "cuts"), ["bucket", "pop"]).select("bucket", "fp", "pop", "slot", F.pmod(F.xxhash64("fp"), "cuts").alias("cut"))
    groups = placed.join(pairs, ["bucket", "slot", "cut"]).select("bucket", "p", "q", "side", "pop", "fp").groupBy("bucket", "p", "q")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("pop", "ascending"), ("fp", "ascending")])
        fp, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        n = int((side == 0).sum())
        found = near(fp[:n], fp[n:] if n < len(fp) else None, radius, tile)
        return pa.table([[a for a, _ in found], [b for _, b in found]], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return groups.applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row: the smallest doc_id that links reach, its own included, where
    fingerprints at radius or fewer differing bits link.

    Null and empty texts have the fingerprint 0 and are linked as any other. Null doc_ids are rows like others and never a
    component_id, unless a component has no other. Repeated rows give a row each. An empty table gives none.
    """
    rows = materialize(fingerprints(docs), "simhash-fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(materialize(links(nodes, radius), "simhash-links"), "simhash-components")
    # Labels of components are signed fingerprints; the least doc_id of each is taken over its fingerprints, not its rows.
    of = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = materialize(of, "simhash-members")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """The components of all documents."""
    return classes(documents(spark, sf_dir).select("doc_id", "text"))
