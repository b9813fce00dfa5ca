"""Packing by concatenating and cutting: two-pass prefix sums give each document its place on one line of tokens, and
windows of a fixed length cut the line."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import documents, materialize
from lattica.llm.tokens import encoder as shared_encoder

#: Up to so many parts (a file's name each) their first places are broadcast; beyond, joined.
BROADCAST_ROWS = 200_000
#: Texts that are encoded at a time.
STEP = 256


#: A part of the line: the file that a row was read from, the split's start in it, and the task (for rows from no file).
PART = ("file", "split", "pid")


def tokenized(docs: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """Pass 1: (file, split, pid, at, doc_id, n, ids), written: a document's ids, its end id with them, its length, and the tokens
    before it in its part of the line. Ids are little-endian, of 2 or 4 bytes. Spark deals a table's splits to tasks by size, so
    parts are named by where they were read, not by the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, kind)
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        pid, ats = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                ids = [x + end for x in encoder.encode(part.column(1).to_pylist())]
                n = np.array([len(x) // width for x in ids], np.int64)
                at = np.empty(len(n), np.int64)
                where = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                # A split's rows follow each other; a task reads one after the other.
                cuts = [0, *(i for i in range(1, len(n)) if where[i] != where[i - 1]), len(n)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    upto = ats[where[a]] + np.cumsum(n[a:b])
                    at[a:b] = upto - n[a:b]
                    ats[where[a]] = int(upto[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(3), pa.array(np.full(len(n), pid, np.int32)), pa.array(at), part.column(0), pa.array(n), pa.array(ids, pa.binary())],
                    [*PART, "at", "doc_id", "n", "ids"],
                )

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.input_file_name().alias("file"), F.input_file_block_start().alias("split"))
    return materialize(read.mapInArrow(encode, f"file string, split long, pid int, at long, doc_id {kind_of_id}, n long, ids binary"), "packing-tokens")


def with_base(rows: DataFrame, size: str, part: tuple[str, ...] = ("pid",)) -> DataFrame:
    """rows with base: the sum of `size` over all earlier parts: those of files whose names come first (shorter names before, so that
    numbers in them count), then by split and task."""
    totals = rows.groupBy(*part).agg(F.sum(size).alias("sum"))
    order = [F.length("file"), *part] if "file" in part else list(part)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = materialize(totals.select(*part, (F.sum("sum").over(before) - F.col("sum")).alias("base")), "partition-bases")
    return rows.join(F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases, list(part))


def pack(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 0, length: int = 1024) -> DataFrame:
    """The pieces of docs (doc_id, text) in sequences of `length` tokens: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset. Only the last sequence can be short.

    Documents follow each other as the table's files hold them, file after file in order of their names, as Spark wrote them: what
    was sorted before it was written, such as the shards of a mix, stays so. Rows from no file follow by task. The written pass 1
    fixes the order. A document
    that a window's end cuts, within a partition or where two meet, gives a record for each side. Null texts are empty
    and hold the end id alone; repeated rows are documents of their own; an empty table gives no piece; other columns
    are ignored.
    """
    placed = with_base(tokenized(docs, path, kind, end_id), "n", PART)
    width = shared_encoder(path, kind).dtype.str

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                first = part.column("base").to_numpy() + part.column("at").to_numpy()
                n = part.column("n").to_numpy()
                pieces = (first + n - 1) // length - first // length + 1
                row = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = first[row] // length + nth
                begin = np.maximum(sequence * length, first[row])
                stop = np.minimum((sequence + 1) * length, first[row] + n[row])
                ids = [np.frombuffer(x, width).astype("<u4") for x in part.column("ids").to_pylist()]
                start, size = begin - first[row], stop - begin
                raw = [ids[r][s : s + z].tobytes() for r, s, z in zip(row, start, size, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), *map(pa.array, (start, size)), pa.array(raw, pa.binary()), *map(pa.array, (n[row], sequence, begin - sequence * length))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind_of_id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (little-endian unsigned 32-bit, padded to `length` unless the number of
    tokens is a power of two), n_tokens."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.lit(int(pad_id).to_bytes(4, "little").hex())
    short = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) != 0
    padding = F.unhex(F.repeat(pad, F.when(short, length - F.col("n_tokens")).otherwise(0).cast("int")))
    return rows.select("sequence_id", F.concat(ids, padding).alias("ids"), "n_tokens")


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents. Nulls, repeated rows and empty tables: see pack."""
    return digest(pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
