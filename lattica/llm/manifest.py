"""A Merkle manifest of a table of documents: a tree of digests for each language, and a tree of their roots."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_mod, documents, in_order, materialize

FANOUT = 8
#: Levels that one task makes of a block: 4096 leaves' digests, a matrix of 256 KiB.
DEPTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODE = "tree string, rank long, size long, digest string"
_PATH = "tree string, rank long, path array<struct<l:string,r:string>>, subroot string, root string"
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _arrow(ddl: str) -> pa.Schema:
    run = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds.get(kind, run)) for name, kind in (x.split(" ", 1) for x in ddl.split(", "))])


def leaf(*fields: Column) -> Column:
    """Digest of fields: each "-" if null, else its bytes' number, ":" and its text."""
    said = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*said), 256)


def height(size: int) -> int:
    """Levels above the leaves of a tree of so many."""
    h = 0
    while size > 1:
        size, h = -(-size // FANOUT), h + 1
    return h


def matrix(digests: list[str]) -> np.ndarray:
    """Hex digests as a contiguous matrix of their 64 bytes."""
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)


def levels(leaves: np.ndarray, steps: int) -> list[np.ndarray]:
    """The digest matrices of a block, leaves first. Each level's rows are reshaped by fanout, so that a row is a run, and hashed;
    the last run may be shorter."""
    out = [leaves]
    for _ in range(steps):
        rows = out[-1]
        whole = len(rows) // FANOUT * FANOUT
        runs = [*rows[:whole].reshape(-1, FANOUT * 64), *([rows[whole:].ravel()] if whole < len(rows) else [])]
        out.append(matrix([sha256(run).hexdigest() for run in runs]))
    return out


def siblings(block: list[np.ndarray], i: int) -> list[tuple[bytes, bytes]]:
    """Of leaf i, level by level, the digests before and after its node in the node's run."""
    out = []
    for rows in block[:-1]:
        run = i // FANOUT * FANOUT
        out.append((rows[run:i].tobytes(), rows[i + 1 : run + FANOUT].tobytes()))
        i //= FANOUT
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> str:
    """The root that a leaf's digest and its siblings give."""
    for left, right in path:
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest.decode()


def _block(rows: pa.Table, depth: int) -> tuple[pa.Table, list[np.ndarray]]:
    rows = rows.sort_by("rank")
    return rows, levels(matrix(rows["digest"].to_pylist()), min(depth, height(rows["size"][0].as_py())))


def _root(rows: pa.Table, depth: int) -> pa.Table:
    rows, block = _block(rows, depth)
    tree, rank, size = (rows[c][0].as_py() for c in ("tree", "rank", "size"))
    n = FANOUT**depth
    return pa.table([[tree], [rank // n], [-(-size // n)], [block[-1].tobytes().decode()]], schema=_arrow(_NODE))


def _paths(rows: pa.Table, above: pa.Table, depth: int) -> pa.Table:
    rows, block = _block(rows, depth)
    (top,) = above.to_pylist()
    n = len(rows)
    paths = [[{"l": a.decode(), "r": b.decode()} for a, b in siblings(block, i)] + top["path"] for i in range(n)]
    return pa.table([rows["tree"], rows["rank"], paths, [top["subroot"]] * n, [top["root"]] * n], schema=_arrow(_PATH))


def _prove(rows: pa.Table, above: pa.Table, depth: int) -> pa.Table:
    rows, block = _block(rows, depth)
    (top,) = above.to_pylist()
    upper = [(x["l"].encode(), x["r"].encode()) for x in top["path"]]
    proofs, folded = [], []
    for i, (own, other) in enumerate(zip(rows["digest"].to_pylist(), rows["tampered"].to_pylist(), strict=True)):
        path = siblings(block, i) + upper
        proofs.append(sha256(b"".join(x for pair in path for x in pair)).hexdigest())
        folded.append(fold((other or own).encode(), path))
    n = len(rows)
    return pa.table([rows["doc_id"], rows["digest"], [top["subroot"]] * n, [top["root"]] * n, proofs, folded], schema=_arrow(_PROOF))


def ranked(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df with rank, its place from 0 among the rows of its tree in the given order, and size, the tree's rows. One sort of all trees
    together, so that a tree with most of the rows is spread over tasks; then counts by sorted partition are summed up."""
    rows = in_order(df, F.col("tree"), *order, name=name)
    parts = rows.groupBy("tree", "pid").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("lo"))
    # A row for each tree and partition that holds some of it.
    before = "sum(n) OVER (PARTITION BY tree ORDER BY pid) - n - lo"
    parts = parts.select("tree", "pid", F.expr(before).alias("shift"), F.expr("sum(n) OVER (PARTITION BY tree)").alias("size"))
    return rows.join(parts, ["tree", "pid"]).withColumn("rank", F.col("idx") + F.col("shift")).drop("pid", "idx", "shift")


def _by_block(nodes: DataFrame, depth: int):
    return nodes.withColumn("block", F.floor(F.col("rank") / FANOUT**depth)).groupBy("tree", "block")


def _up(nodes: DataFrame, depth: int, name: str) -> list[DataFrame]:
    """Nodes, and the roots of their blocks, and of theirs, until each tree has one: a round for each `depth` levels."""
    found = [nodes]

    def root(rows: pa.Table) -> pa.Table:
        return _root(rows, depth)

    while (found[-1].agg(F.max("size")).first()[0] or 0) > 1:
        some = found[-1].where("size > 1").select("tree", "rank", "size", "digest")
        found.append(materialize(_by_block(some, depth).applyInArrow(root, _NODE), name))
    return found


def _down(found: list[DataFrame], outer: DataFrame, depth: int, last, schema: str) -> DataFrame:
    """last(rows, above, depth) for the blocks of the leaves, where above is the path from the block's root on. outer holds the path
    of each tree's root (tree, path, subroot, root)."""
    paths = None
    for k, nodes in reversed(list(enumerate(found))):
        above = nodes.where("size = 1").select("tree").join(outer, "tree").select("tree", F.lit(0).cast("long").alias("rank"), "path", "subroot", "root")
        above = above if paths is None else above.unionByName(paths)
        above = above.select(F.col("tree").alias("of"), F.col("rank").alias("at"), "path", "subroot", "root")
        make, kind = (last, schema) if k == 0 else (_paths, _PATH)

        def each(rows: pa.Table, above: pa.Table) -> pa.Table:
            return make(rows, above, depth)

        paths = _by_block(nodes, depth).cogroup(above.groupBy("of", "at")).applyInArrow(each, kind)
    return paths


def manifest(leaves: DataFrame, tree: Column, order: list[Column], depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 and folded_root of leaves (doc_id, digest, tampered).

    Within a tree, leaves stand in the given order. While several nodes remain, every 8 consecutive ones become their digest, the
    last run of fewer too; a tree's last node is its subroot. Subroots, ordered by tree (null first), give the root likewise.
    Aligned blocks of 8 ** depth nodes are made by a task each; the blocks' roots are the next table of nodes. Siblings come down the same
    way, so a task holds one block and one path, however large the tree. proof_sha256 is the digest of a leaf's siblings, and
    folded_root is folded from tampered (where it isn't null, else digest) through them.

    A null tree is a tree of its own. Rows that tie in order stand in order of digest; equal rows are leaves of their own. Without
    rows there is no root, and no row is returned.
    """
    named = leaves.select(F.coalesce(F.concat(F.lit("="), tree), F.lit("-")).alias("tree"), "doc_id", "digest", "tampered")
    rows = materialize(ranked(named, *order, F.col("digest"), name="manifest-sorted"), "manifest-leaves")
    own = _up(rows, depth, "manifest-nodes")
    subroots = own[0].where("size = 1").select("tree", "digest")
    for nodes in own[1:]:
        subroots = subroots.unionByName(nodes.where("size = 1").select("tree", "digest"))
    # "-" sorts before "=": the null tree is first, and the others are in order of their bytes.
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    top = materialize(ranked(top, F.col("of"), name="manifest-sorted"), "manifest-subroots")
    upper = _up(top, depth, "manifest-nodes")
    no_path = F.array().cast("array<struct<l:string,r:string>>")
    root = upper[-1].where("size = 1").select(F.lit("").alias("tree"), no_path.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    paths = _down(upper, root, depth, _paths, _PATH).select("rank", "path", "root")
    outer = materialize(top.join(paths, "rank").select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "manifest-paths")
    return _down(own, outer, depth, _prove, _PROOF)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by lang, in order of doc_id (null first). Where 3 divides the crc32 of doc_id, a text that was
    lower-cased in A-Z is held against the manifest; null ids and texts aren't."""
    docs = documents(spark, sf_dir)
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when((crc_mod("doc_id", 3) == 0) & F.col("text").isNotNull(), leaf(*fields, F.translate("text", UPPER, LOWER)))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf(*fields, F.col("text")).alias("digest"), changed.alias("tampered"))
    found = manifest(leaves, F.col("lang"), [F.col("doc_id").asc_nulls_first()])
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
