"""N-gram Jaccard join with signature trees.

Sets of word shingles are joined exactly at a Jaccard threshold. Two similar sets share a hash among each one's first few in any
common order (the prefix); sets that share one meet in its group. Groups are joined twice: first each set with its group's hub, the
set that shares the largest part of its prefix, which is what copies of a text were made from, if anything; then, in
groups that still hold several components, a dual traversal of signature trees finds the other pairs that may be
similar. A pair is compared in one group alone where one holds all sets that share its hashes. All candidates are checked
on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import documents, materialize
from lattica.llm.components import components
from lattica.llm.shingles import chunks, mix, sets, text_chunks

SHINGLE, PERCENT = 5, 75
#: Frequent shingles go last in the common order. They are found in a sample, of which nothing but speed depends:
#: documents in it, at least, and as a share; how often a shingle must occur there; how many are kept.
SAMPLE_DOCS, SAMPLE_SHARE, SAMPLE_COUNT, MAX_FREQUENT = 16_000, 0.02, 4, 200_000
#: Hashes of prefixes in a bucket, about.
BUCKET = 1_000_000
#: Bits of a signature for each element, at least, and in all.
BITS, LEAST_BITS, MOST_BITS = 4, 256, 65_536
LEAF = 8
#: Groups with more candidates a set than MANY get finer bitmaps, which tell nearly similar sets from similar ones: bits for each
#: element and in all, and larger leaves.
MANY, FINE_BITS, MOST_FINE_BITS, FINE_LEAF = 8, 32, 131_072, 32
#: So many nodes, at most, are broadcast to their texts; more are joined by a shuffle.
FEW = 200_000
#: Larger groups are dealt to pairs of parts of so many sets, about.
PART = 4096

TOKEN = np.dtype([("h", "<u8"), ("node", "<i8")])


def node_of(s: np.ndarray) -> int:
    """One hash of a whole set."""
    return int((mix(s + np.uint64(len(s))).sum(dtype=np.uint64) ^ np.uint64(len(s))).view(np.int64))


def signature(s: np.ndarray, each: int = BITS, most: int = MOST_BITS) -> bytes:
    """A bitmap of a set, with at least `each` bits an element up to `most`."""
    bits = min(max(1 << (each * len(s) - 1).bit_length(), LEAST_BITS), most)
    bitmap = np.zeros(bits, np.uint8)
    bitmap[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(bitmap, bitorder="little").tobytes()


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the shingles that occur in several sets of a sample, the MAX_FREQUENT most frequent."""
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE_DOCS / max(docs.count(), 1)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0)):
                h, n = np.unique(np.concatenate([*sets(list(dict.fromkeys(texts)), k), np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_COUNT)
    top = counts.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).toArrow()
    return np.sort(top.column("h").to_numpy().view(np.uint64))


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One written table of three kinds of rows. 0: a document, with its node (hash of the set, null if empty), size,
    and, once a chunk of a task and node, its signature. 1: nodes a < b that are a group, sharing a prefix hash. 2: hash
    a of a group of three nodes or more, or a frequent one, and its node b.

    Tasks send each chunk's prefix hashes as one block for each bucket of hashes, once for equal sets. Frequent hashes are in
    buckets by node, so that no hash is one task's: any other has less than one in MAX_FREQUENT of all."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(64, int(chars / 5 * (100 - percent) / 100 / BUCKET))
    node_buckets = max(8, buckets // 4)
    rare_last = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["kind", "part", "doc_id", "text_key", "a", "b", "n", "data"]
    schema = f"kind int, part long, doc_id {id_type}, text_key long, a long, b long, n long, data binary"

    def rows(length: int, doc_type: pa.DataType, kind: int, /, **columns) -> pa.RecordBatch:
        types = {"kind": pa.int32(), "doc_id": doc_type, "data": pa.binary()}
        columns["kind"] = np.full(length, kind, np.int32)
        arrays = [columns[x] if isinstance(columns.get(x), pa.Array) else pa.array(columns[x], types.get(x, pa.int64())) if x in columns else pa.nulls(length, types.get(x, pa.int64())) for x in names]
        return pa.RecordBatch.from_arrays(arrays, names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = rare_last.value
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                seen: set[int] = set()
                nodes, sizes, signatures, found, often = [], [], [], [], []
                for s in sets(texts, k):
                    node = node_of(s) if len(s) else None
                    nodes.append(node)
                    sizes.append(len(s))
                    if node is None or node in seen:
                        signatures.append(None)
                        continue
                    seen.add(node)
                    signatures.append(signature(s))
                    length = len(s) - -(-percent * len(s) // 100) + 1
                    rare = len(s)
                    if len(last):
                        common = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        s = np.concatenate([s[~common], s[common]])
                        rare -= int(common.sum())
                    token = np.empty(length, TOKEN)
                    token["h"], token["node"] = s[:length], node
                    found.append(token)
                    often.append(np.arange(length) >= rare)
                part = batch.slice(a, b - a)
                yield rows(b - a, part.column(0).type, 0, part=np.arange(a, b), doc_id=part.column(0), text_key=part.column(2), a=nodes, n=sizes, data=signatures)
                if found:
                    token = np.concatenate(found)
                    by_hash = mix(token["h"]) % np.uint64(buckets)
                    by_node = mix(token["node"].view(np.uint64)) % np.uint64(node_buckets) + np.uint64(buckets)
                    bucket = np.where(np.concatenate(often), by_node, by_hash).astype(np.int64)
                    token = token[np.argsort(bucket, kind="stable")]
                    used, n = np.unique(bucket, return_counts=True)
                    cut = np.cumsum(n)
                    yield rows(len(used), part.column(0).type, 1, part=used, data=[token[e - z : e].tobytes() for e, z in zip(cut, n, strict=True)])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def close(doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            token = np.frombuffer(b"".join(held), TOKEN)
            token = token[np.lexsort((token["node"], token["h"]))]
            h, node = token["h"], token["node"]
            if len(token):
                keep = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
                h, node = h[keep], node[keep]
            ends = np.flatnonzero(np.r_[h[1:] != h[:-1], True]) if len(h) else np.zeros(0, np.int64)
            size = np.diff(ends, prepend=-1)
            if now is not None and now >= buckets:  # frequent hashes, of which other buckets hold other nodes
                yield rows(len(h), doc_type, 2, a=h.view(np.int64), b=node)
                return
            last = ends[size == 2]
            pairs = np.unique(np.stack([node[last - 1], node[last]], 1), axis=0)
            yield rows(len(pairs), doc_type, 1, a=pairs[:, 0], b=pairs[:, 1])
            large = np.repeat(size >= 3, size)
            yield rows(int(large.sum()), doc_type, 2, a=h[large].view(np.int64), b=node[large])

        for batch in batches:
            doc_type = batch.column("doc_id").type
            kinds, parts = batch.column("kind").to_numpy(), batch.column("part").to_numpy()
            if (kinds == 0).any():
                yield batch.filter(pa.array(kinds == 0))
            for i in np.flatnonzero(kinds == 1):
                if parts[i] != now:
                    yield from close(doc_type)
                    held, now = [], parts[i]
                held.append(batch.column("data")[int(i)].as_py())
        if held:
            yield from close(doc_type)

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(blocks, schema)
    return materialize(dealt.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(groups, schema), "jaccard-groups")


class Tree:
    """A signature tree over sets of one group: inner nodes hold the OR of their bitmaps, the range of sizes, the greatest
    excess of a size over its bitmap's bits, and their component and home (see _open_groups) if they have but one."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, comps: np.ndarray, homes: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((sizes, comps, homes))
        self.bitmaps, self.sizes, self.comps, self.homes, self.rows = bitmaps[order], sizes[order], comps[order], homes[order], rows[order]
        self.bits = np.bitwise_count(self.bitmaps).sum(1, dtype=np.int64)
        self.leaf = leaf
        self.root = self._build(0, len(rows))

    def _build(self, lo: int, hi: int) -> tuple:
        part = slice(lo, hi)
        children = () if hi - lo <= self.leaf else (self._build(lo, (lo + hi) // 2), self._build((lo + hi) // 2, hi))
        bitmap = np.bitwise_or.reduce(self.bitmaps[part]) if not children else children[0][2] | children[1][2]
        comps = self.comps[part]
        comp = comps[0] if comps.min() == comps.max() else None
        home = self.homes[lo] if self.homes[lo] == self.homes[hi - 1] >= 0 else None
        return lo, hi, bitmap, self.sizes[part].min(), self.sizes[part].max(), (self.sizes[part] - self.bits[part]).max(), comp, children, home


def dual(p: Tree, q: Tree, percent: int) -> list[np.ndarray]:
    """Pairs of rows of p and q (the same tree or two) that may reach the threshold and are of different components and homes. A
    pair of nodes is left out if its sizes are too far apart, if the overlap that bitmaps and sizes allow is too small, or if
    both are of one component or home."""
    share = percent / (100 + percent)
    found, stack = [], [(p.root, q.root)]
    while stack:
        x, y = stack.pop()
        if 100 * x[4] < percent * y[3] or 100 * y[4] < percent * x[3] or (x[6] is not None and x[6] == y[6]) or (x[8] is not None and x[8] == y[8]):
            continue
        common = int(np.bitwise_count(x[2] & y[2]).sum())
        if min(x[4], y[4], x[5] + common, y[5] + common) < share * (x[3] + y[3]) - 1e-9:
            continue
        if x[7] and (not y[7] or x[1] - x[0] >= y[1] - y[0]) and not (p is q and x[0] == y[0] and x[1] == y[1]):
            stack += [(c, y) for c in x[7]]
        elif p is q and x[0] == y[0] and x[1] == y[1] and x[7]:
            a, b = x[7]
            stack += [(a, a), (a, b), (b, b)]
        elif y[7]:
            stack += [(x, c) for c in y[7]]
        else:
            i, j = np.meshgrid(np.arange(x[0], x[1]), np.arange(y[0], y[1]), indexing="ij")
            i, j = i.ravel(), j.ravel()
            keep = (p.comps[i] != q.comps[j]) & ((p.homes[i] != q.homes[j]) | (p.homes[i] < 0))
            if p is q and x[0] == y[0]:
                keep &= i < j
            i, j = i[keep], j[keep]
            both = np.bitwise_count(p.bitmaps[i] & q.bitmaps[j]).sum(1, dtype=np.int64)
            bound = np.minimum(p.sizes[i] - p.bits[i], q.sizes[j] - q.bits[j]) + both
            bound = np.minimum(bound, np.minimum(p.sizes[i], q.sizes[j]))
            keep = bound >= share * (p.sizes[i] + q.sizes[j]) - 1e-9
            found.append(np.stack([p.rows[i[keep]], q.rows[j[keep]]], 1))
    return found


def fold(bitmap: bytes, n_bytes: int) -> np.ndarray:
    """A bitmap brought to fewer bits: the OR of its parts, as 64-bit words."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, n_bytes // 8))


def trees_pairs(nodes: np.ndarray, sizes: np.ndarray, comps: np.ndarray, data: list[bytes], sides: np.ndarray, percent: int, homes: np.ndarray | None = None, leaf: int = LEAF) -> np.ndarray:
    """Candidate pairs of nodes of one group: a tree for each width of bitmap; trees of equal and of neighbouring widths meet. sides
    (0, 1 or 2) tells the parts of a large group: pairs of 1 and 2 only, or all pairs of 0. Nodes of one home, if that
    isn't -1, meet in another group."""
    width = np.array([len(x) for x in data])
    homes = np.full(len(nodes), -1) if homes is None else homes
    out = []
    widths = np.unique(width)
    for w in widths:
        for v in (w, 2 * w):
            if v not in widths:
                continue
            for s, t in [(0, 0)] if v == w and not sides.any() else [(0, 0)] if not sides.any() else [(1, 2)] if v == w else [(1, 2), (2, 1)]:
                i, j = np.flatnonzero((width == w) & (sides == s)), np.flatnonzero((width == v) & (sides == t))
                if not len(i) or not len(j):
                    continue
                p = Tree(np.stack([fold(data[x], w) for x in i]), sizes[i], comps[i], homes[i], nodes[i], leaf)
                q = p if v == w and s == t else Tree(np.stack([fold(data[x], w) for x in j]), sizes[j], comps[j], homes[j], nodes[j], leaf)
                out += dual(p, q, percent)
    pairs = np.concatenate([*out, np.zeros((0, 2), np.int64)])
    return np.sort(pairs, 1)


def _texts(docs: DataFrame, repeated: bool) -> DataFrame:
    """docs' texts with their keys, a row for each that can be a node's representative."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return texts.dropDuplicates(["doc_id", "text_key"]) if repeated else texts


def _with_text(rows: DataFrame, node: str, name: str, texts: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """rows with the text, called name, of the representative of the node in the column `node`; few: rows are FEW at most."""
    keyed = rows.join(nodes.select(F.col("node").alias(node), "rep"), node)
    keyed = F.broadcast(keyed) if few else keyed
    met = keyed.alias("r").join(texts.alias("t"), F.expr("r.rep.text_key = t.text_key AND r.rep.doc_id <=> t.doc_id"))
    return met.select("r.*", F.col("t.text").alias(name)).drop("rep")


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The links among candidate pairs (a, b) of nodes, checked on the whole texts of their representatives, written."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                known: dict[int, np.ndarray] = {}
                for at in (0, 1):
                    wanted = dict(zip(part.column(at).to_pylist(), part.column(2 + at).to_pylist(), strict=True))
                    wanted = {x: t for x, t in wanted.items() if x not in known}
                    texts = list(wanted.values())
                    for i, j in chunks(texts):
                        known.update(zip(list(wanted)[i:j], sets(texts[i:j], k), strict=True))
                linked = []
                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    both = len(np.intersect1d(known[a], known[b], assume_unique=True))
                    linked.append(100 * both >= percent * (len(known[a]) + len(known[b]) - both))
                yield part.filter(pa.array(linked)).select(["a", "b"])

    both = _with_text(_with_text(pairs, "a", "x", texts, nodes), "b", "y", texts, nodes)
    return materialize(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), name)


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that sizes and bitmaps allow to reach the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("data").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").where("true").join(side("b"), "b")
    joined = joined.where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True):
                size = min(len(x), len(y))
                x, y = fold(x, size), fold(y, size)
                both = int(np.bitwise_count(x & y).sum())
                top = min(m, n, m - int(np.bitwise_count(x).sum()) + both, n - int(np.bitwise_count(y).sum()) + both)
                keep.append(100 * top >= percent * (m + n - top))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(bound, "a long, b long")


def _hub_pairs(table: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of each group's hub with its other nodes: the hub is in large groups with most of its prefix, in proportion. A
    group is reduced to its hub before the shuffle, and every member gives one pair."""
    members = table.where("kind = 2").select(F.col("a").alias("h"), F.col("b").alias("node"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    shared = members.groupBy("node").agg(F.count(F.lit(1)).alias("shared")).join(nodes.select("node", "n"), "node").select("node", F.struct((F.col("shared") / length).alias("part"), "node").alias("rank"))
    placed = materialize(members.join(shared, "node"), "jaccard-members")
    hubs = placed.groupBy("h").agg(F.max("rank").alias("hub"))
    pairs = placed.join(hubs, "h").select("node", F.col("hub.node").alias("hub")).where("node != hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def _open_groups(members: DataFrame, comps: DataFrame) -> DataFrame:
    """h, node, comp, size, home of groups that hold several components, written.

    A node's home is its largest open group. Two nodes of one home meet there and needn't elsewhere, so a group whose nodes
    all have one other home is left out: texts with a long passage in common share many hashes, but one group compares them."""
    placed = members.join(comps, "node", "left").select("h", "node", F.coalesce("component", "node").alias("comp"))
    open_groups = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("h", "size")
    rows = materialize(placed.join(open_groups, "h"), "jaccard-open")
    homes = rows.groupBy("node").agg(F.max(F.struct("size", "h")).alias("home")).select("node", F.col("home.h").alias("home"))
    rows = rows.join(homes, "node")
    needed = rows.groupBy("h").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo != hi OR lo = h").select("h")
    return materialize(rows.join(needed, "h"), "jaccard-needed")


def _in_parts(rows: DataFrame, percent: int) -> DataFrame:
    """rows (h, node, comp, n and more) of large groups, each once for every pair of parts that it belongs to: parts i <= j, and side 0
    (i = j), 1 (of i) or 2 (of j).

    A part holds PART nodes of one band of sizes, about; parts whose bands aren't neighbours can't be similar. Components
    of more than PART nodes have parts of their own, which don't meet each other; the others stay whole."""
    large = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PART).select("h", "comp", F.col("comp").alias("owner"))
    rows = rows.join(large, ["h", "comp"], "left").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"))
    counts = rows.groupBy("h", "owner", "band").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    same = F.expr("r.h = c.h AND r.owner <=> c.owner AND r.band = c.band")
    dealt = F.pmod(F.xxhash64(F.when(F.col("r.owner").isNull(), F.col("r.comp")).otherwise(F.col("r.node"))), F.col("c.parts"))
    rows = rows.alias("r").join(counts.alias("c"), same).select("r.*", F.struct(F.col("r.owner").alias("owner"), F.col("r.band").alias("band"), dealt.alias("number")).alias("mine"))
    rows = rows.join(rows.groupBy("h").agg(F.array_sort(F.collect_set("mine")).alias("all")), "h")
    meets = lambda x: (F.abs(x["band"] - F.col("mine.band")) <= 1) & (x["owner"].isNull() | F.col("mine.owner").isNull() | (x["owner"] != F.col("mine.owner")))
    rows = rows.withColumn("other", F.explode(F.filter("all", meets)))
    at, to = F.array_position("all", F.col("mine")), F.array_position("all", F.col("other"))
    side = F.when(at == to, 0).when(at < to, 1).otherwise(2)
    return rows.withColumns({"i": F.least(at, to), "j": F.greatest(at, to), "side": side}).drop("owner", "band", "mine", "all", "other")


def _traversed(rows: DataFrame, percent: int, leaf: int, many: int | None) -> DataFrame:
    """Candidate pairs a, b of rows (h, i, j, side, node, comp, n, data, home); of a group with more than `many` a set only
    its h as a, with b null."""
    rows = rows.select("h", "i", "j", "side", "node", "comp", "n", "data", F.when(F.col("home") != F.col("h"), F.col("home")).alias("home"))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[np.ndarray] = []
        marks: list[int] = []

        def close() -> None:
            if len(held) > 1:
                node, comp, n, side = (np.array([x[c] for x in held], np.int64) for c in (0, 1, 2, 4))
                number = {x: i for i, x in enumerate({x[5] for x in held} - {None})}
                homes = np.array([number.get(x[5], -1) for x in held])
                pairs = trees_pairs(node, n, comp, [x[3] for x in held], side, percent, homes, leaf)
                out.append(pairs)
                if many is not None and len(pairs) > many * len(held):
                    out.pop()
                    marks.append(now[0])

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([*out, np.zeros((0, 2), np.int64)]), axis=0)
            a, b = np.r_[pairs[:, 0], np.array(marks, np.int64)], pa.array(pairs[:, 1].tolist() + [None] * len(marks), pa.int64())
            out.clear()
            marks.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), b], ["a", "b"])

        now = None
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("h", "i", "j", "node", "comp", "n", "data", "side", "home")]
            for h, i, j, *row in zip(*columns, strict=True):
                if (h, i, j) != now:
                    close()
                    held, now = [], (h, i, j)
                held.append(row)
            yield flush()
        close()
        yield flush()

    return rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(traverse, "a long, b long")


def _greatest(rows: DataFrame) -> int:
    """The size of the largest group."""
    return rows.agg(F.max("size")).first()[0] or 0


def _second_round(table: DataFrame, nodes: DataFrame, texts: DataFrame, comps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of nodes of different components in groups of three nodes or more, by dual traversal."""
    members = table.where("kind = 2").select(F.col("a").alias("h"), F.col("b").alias("node"))
    rows = _open_groups(members, comps).join(nodes.select("node", "n"), "node")

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in text_chunks(batch.column(1)):
                data = [signature(s, FINE_BITS, MOST_FINE_BITS) for s in sets(part, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(data, pa.binary())], ["node", "data"])

    whole = rows.where(F.col("size") <= PART).withColumns({"i": F.lit(1).cast("long"), "j": F.lit(1).cast("long"), "side": F.lit(0)})
    if _greatest(rows) > PART:
        whole = whole.unionByName(_in_parts(rows.where(F.col("size") > PART), percent))
    coarse = materialize(_traversed(whole.join(nodes.select("node", "data"), "node"), percent, LEAF, MANY), "jaccard-coarse")
    many = coarse.where("b IS NULL").select(F.col("a").alias("h")).distinct()
    found = coarse.where("b IS NOT NULL")
    if many.isEmpty():
        return found
    whole = whole.join(many, "h")
    wanted = materialize(whole.select("node").distinct(), "jaccard-wanted")
    bitmaps = _with_text(wanted, "node", "text", texts, nodes, wanted.count() <= FEW).select("node", "text").mapInArrow(fine, "node long, data binary")
    return found.union(_traversed(whole.join(materialize(bitmaps, "jaccard-bitmaps"), "node"), percent, FINE_LEAF, None))


def jaccard_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, classes) of docs (doc_id, text) joined where 100 * intersection >= percent * union.

    members: doc_id, text_key (hash of the text), node, n_shingles. A node is a distinct set of shingles; node null: no
    words, linked with nothing. links: a, b, nodes that are similar: of those in one component as many as
    connect it. classes: node, component_id (least doc_id of the component).

    Texts of fewer than k words are one shingle. Null texts have none. Repeated rows are copies of each other; a null
    doc_id is less than others only if its class has none else. Other columns are ignored. Equality is that of 64-bit
    hashes of shingles and of sets.
    """
    table = _grouped(docs, k, percent)
    members = table.where("kind = 0").select("doc_id", "text_key", F.col("a").alias("node"), F.col("n").alias("n_shingles"), "data")
    nodes = members.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.max("n_shingles").alias("n"), F.max("data").alias("data")
    )
    nodes = materialize(nodes, "jaccard-nodes")
    pairs = table.where("kind = 1").select("a", "b").union(_hub_pairs(table, nodes, percent)).distinct()
    first = materialize(_bounded(pairs, nodes, percent), "jaccard-pairs")
    repeated = not members.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    texts = _texts(docs, repeated)
    links = _verified(first, texts, nodes, k, percent, "jaccard-links")
    comps = materialize(components(links, "jaccard-stars"), "jaccard-components")
    second = _second_round(table, nodes, texts, comps, k, percent).distinct().join(first, ["a", "b"], "left_anti")
    second = materialize(second, "jaccard-more-pairs")
    if second.limit(1).count():
        links = links.union(_verified(second, texts, nodes, k, percent, "jaccard-more-links"))
        comps = materialize(components(links, "jaccard-stars"), "jaccard-components")
    whole = nodes.join(comps, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = materialize(whole.join(least, "component").select("node", "component_id"), "jaccard-classes")
    return members.drop("data"), links, classes


def similar_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for each row of docs (doc_id, text); see jaccard_classes."""
    members, _, classes = jaccard_classes(docs, k, percent)
    return members.join(classes, "node", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each class, that of the least doc_id; docs' columns, whatever their names. Texts without words
    stay. Of rows that repeat a doc_id and its text one stays, the same in each run."""
    found = similar_documents(docs, k, percent).where("doc_id <=> component_id").select("doc_id", "text_key").distinct()
    met = docs.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND xxhash64(d.text) = f.text_key"), "left_semi").select("d.*")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return met
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = met.groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return one.select("row.*")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The class of every document. Nulls, repeated rows and empty tables: see jaccard_classes."""
    return similar_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
