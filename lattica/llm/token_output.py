"""Token ids in Re-Pair grammars: frequent pairs of ids are replaced by nonterminals, shard by shard."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import documents, materialize
from lattica.llm.packing import with_base
from lattica.llm.tokens import encoder as shared_encoder

#: Header of a shard: magic, bytes of a symbol, base (first nonterminal), rules, documents, symbols.
HEADER = struct.Struct("<4sHIIIQ")
MAGIC = b"RPG1"
#: A rule takes 12 bytes in the file, and each place where it stands saves a symbol of 2: it pays from MIN_COUNT places on.
MIN_COUNT, RULES_A_ROUND = 7, 4096
STEP = 256


def _buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA6B)) >> np.uint32(12)


def _places(chosen: np.ndarray, pair: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Of each pair, with its bucket, its place in chosen; any place if it isn't there. Each bucket names one of its chosen pairs; the
    few others are searched for."""
    own = _buckets((chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32))
    named = np.zeros(1 << 20, np.int32)
    named[own] = np.arange(len(chosen))
    which = named[bucket]
    if len(others := np.flatnonzero(named[own] != np.arange(len(chosen)))):
        missed = np.flatnonzero(chosen[which] != pair)
        which[missed] = others[np.minimum(np.searchsorted(chosen[others], pair[missed]), len(others) - 1)]
    return which


def compress(ids: np.ndarray, last: np.ndarray, base: int, max_rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules) of ids, of which `last` marks documents' ends; no rule crosses one. Rule k replaces its pair
    of earlier symbols by symbol base + k.

    Each round counts all pairs in hashed buckets, then exactly those of the fullest buckets, and replaces the most
    frequent pairs from left to right; where two chosen pairs overlap in a run, every other one is replaced. Rounds go on
    until no pair stands in MIN_COUNT places or there is no room for rules.
    """
    seq, last, rules, n_rules = ids.astype(np.uint32), last.copy(), [], 0
    while len(seq) > 1 and (room := min(RULES_A_ROUND, max_rules - n_rules)) > 0:
        inner = ~last[:-1]
        bucket = _buckets(seq[:-1], seq[1:])
        counts = np.bincount(bucket, minlength=1 << 20)
        np.subtract.at(counts, bucket[~inner], 1)
        full = counts[counts >= MIN_COUNT]
        floor = int(np.partition(full, -room)[-room]) if len(full) > room else MIN_COUNT
        at = np.flatnonzero((counts >= floor)[bucket] & inner)
        pair = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        ordered = np.sort(pair)
        edge = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
        times = np.diff(np.r_[edge, len(ordered)])
        often = np.flatnonzero(times >= MIN_COUNT)
        chosen = np.sort(ordered[edge[often[np.argsort(-times[often], kind="stable")[:room]]]])
        if not len(chosen):
            break
        which = _places(chosen, pair, bucket[at])
        hit = chosen[which] == pair
        at, symbol = at[hit], (which[hit] + base + n_rules).astype(np.uint32)
        nth = np.arange(len(at))
        begins = np.r_[True, np.diff(at) != 1]
        take = (nth - np.maximum.accumulate(np.where(begins, nth, 0))) % 2 == 0
        at, symbol = at[take], symbol[take]
        seq[at], last[at] = symbol, last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        n_rules += len(chosen)
    return seq, last, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def pack_shard(doc_ids: list, ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> bytes:
    """A shard: header; rules (pairs, 4 bytes a symbol); expansion lengths of the rules (4 bytes); per document its id
    (8 bytes signed), whether it has one (1 byte), ids (4 bytes) and symbols (4 bytes); then the symbols, of 2 or 4
    bytes. All little-endian. The documents' symbol counts place each document's symbols, for random access."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, last, rules = compress(ids, last, vocabulary, (1 << 16) - vocabulary if vocabulary < 1 << 16 else 1 << 20)
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    lengths = [1] * vocabulary
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    ends = np.flatnonzero(last) + 1
    known = [x is not None for x in doc_ids]
    return b"".join(
        [
            HEADER.pack(MAGIC, width, vocabulary, len(rules), len(doc_ids), len(symbols)),
            rules.astype("<u4").tobytes(),
            np.array(lengths[vocabulary:], "<u4").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array(known, np.uint8).tobytes(),
            sizes.astype("<u4").tobytes(),
            np.diff(ends, prepend=0).astype("<u4").tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
        ]
    )


class Shard:
    """A packed shard, read in place."""

    def __init__(self, blob: bytes):
        magic, width, self.base, n_rules, n_docs, n_symbols = HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair shard")
        at = HEADER.size

        def read(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, dtype, n, at)
            at += found.nbytes
            return found

        self.rules = read("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = read("<u4", n_rules)
        ids = read("<i8", n_docs)
        self.doc_ids = [int(x) if known else None for x, known in zip(ids, read("u1", n_docs), strict=True)]
        self.sizes = read("<u4", n_docs)
        self.ends = np.cumsum(read("<u4", n_docs), dtype=np.int64)
        self.symbols = read(f"<u{width}", n_symbols)

    def _by_level(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols: nonterminals give way to their pairs, level by level."""
        seq = symbols.astype(np.uint32)
        while (at := np.flatnonzero(seq >= self.base)).size:
            pairs = self.rules[seq[at] - self.base]
            place = np.arange(len(seq))
            place += np.cumsum(seq >= self.base) - (seq >= self.base)
            out = np.empty(len(seq) + len(at), np.uint32)
            out[place] = seq
            out[place[at]], out[place[at] + 1] = pairs[:, 0], pairs[:, 1]
            seq = out
        return seq

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols. Of more symbols than there are rules, each rule is expanded once, and symbols take their ids from there."""
        if len(symbols) <= len(self.rules):
            return self._by_level(symbols)
        held = np.concatenate([np.arange(self.base, dtype=np.uint32), self._by_level(np.arange(self.base, self.base + len(self.rules)))])
        length = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        n = length[symbols]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(length) - length)[symbols] - (ends - n), n)
        at += np.arange(len(at))
        return held[at]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own symbols alone."""
        return self.expand(self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]])


def write_shards(docs: DataFrame, path: str, kind: str = "word", end_id: int = 2, shard_tokens: int = 1 << 20) -> DataFrame:
    """Shards of docs (doc_id, text) in ascending doc_id, written: (pid, shard, at, n_tokens, first_id, last_id, blob); at: tokens
    before the shard in its range partition; first_id and last_id: its least and greatest doc_id, for random access. Texts are dealt by ranges of doc_id (and text, so that one id can't fill a partition)
    and sorted; a task cuts its range into shards of about shard_tokens ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, kind)
        vocabulary = encoder.tokenizer.get_vocab_size()
        end = np.array([end_id], encoder.dtype).tobytes()
        pid, shard, at = TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, n = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
            blob = pack_shard(doc_ids, np.frombuffer(b"".join(ids), encoder.dtype), sizes, vocabulary)
            known = [x for x in doc_ids if x is not None] or [None]
            longs = [pa.array([x], pa.int64()) for x in (at, n, known[0], known[-1])]
            return pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([shard], pa.int32()), *longs, pa.array([blob], pa.binary())], names)

        names = ["pid", "shard", "at", "n_tokens", "first_id", "last_id", "blob"]
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                for doc_id, x in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(x + end)
                    n += len(ids[-1]) // encoder.dtype.itemsize
                    if n >= shard_tokens:
                        yield flush()
                        shard, at, doc_ids, ids, n = shard + 1, at + n, [], [], 0
        if ids:
            yield flush()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return materialize(ranged.mapInArrow(encode, "pid int, shard int, at long, n_tokens long, first_id long, last_id long, blob binary"), "repair-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """The documents of shards: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column("blob")[k].as_py())
                first = batch.column("base")[k].as_py() + batch.column("at")[k].as_py()
                ends = np.cumsum(shard.sizes, dtype=np.int64)
                ids = shard.expand(shard.symbols).astype("<u4")
                for j in range(0, len(ends), STEP):
                    span = slice(j, min(j + STEP, len(ends)))
                    raw = [ids[e - z : e].tobytes() for e, z in zip(ends[span], shard.sizes[span], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[span], pa.int64()), pa.array(first + ends[span] - shard.sizes[span]), pa.array(shard.sizes[span].astype(np.int64)), pa.array(raw, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return with_base(shards, "n_tokens").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(shards: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens and ids of a few documents: only shards whose range holds one are read, and of those only the
    documents' own symbols are expanded. Ids that aren't there give no row; repeated rows of one id a row each."""
    wanted = sorted(set(doc_ids))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                shard = Shard(blob.as_py())
                at = [k for k, x in enumerate(shard.doc_ids) if x in keep]
                raw = [shard.document(k).astype("<u4").tobytes() for k in at]
                yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[k] for k in at], pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids"])

    keep = set(wanted)
    near = F.exists(F.array(*map(F.lit, wanted)).cast("array<bigint>"), lambda x: (x >= F.col("first_id")) & (x <= F.col("last_id")))
    between = (F.col("last_id") >= min(wanted, default=0)) & (F.col("first_id") <= max(wanted, default=0))
    return shards.where(between & near).select("blob").mapInArrow(decode, "doc_id long, n_tokens long, ids binary")


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, written as Re-Pair shards and read back.

    Null texts are empty and hold the end id alone; repeated rows are documents of their own (of one doc_id, in the order
    of a hash of their texts); an empty table gives no rows; other columns are ignored."""
    shards = write_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
