"""Language-model scores from an Elias-Fano n-gram trie in memory-mapped levels."""

from __future__ import annotations

import mmap
import struct
import uuid
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path
from urllib.parse import urlsplit
from urllib.request import url2pathname

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_mod, documents, working_dir
from lattica.llm.elias_fano import EliasFano
from lattica.llm.shingles import Words, text_chunks

ORDER, MIN_COUNT, DISCOUNT = 3, 1, 0.75
#: Hash of the end token; a word hashes to it once in 2 ** 64.
END = np.uint64(0x0E0E0E0E0E0E0E0E)
#: Entries of counts in a bucket, about, and characters of text that are taken at a time.
BUCKET, CHARS = 2_000_000, 3_500_000
#: N-grams of a bucket that are searched for at a time.
FOUND = 500_000
#: Probabilities are kept as steps of log10, 255 of them over 10.
STEPS = 25.5
#: Marks a shard within the files that Spark writes; a random value.
MAGIC = bytes.fromhex("9d0f4ce5a3b8417296fe2b60c87a15d3")
HEADER = struct.Struct("<16sQQQQIQQQQQB")
ENTRY = np.dtype([("key", "<u8"), ("n", "<u4")])


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 255).astype(np.uint8)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 4 bytes each if they fit, else in 8."""
    return counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8")


class Shard:
    """A part of a level: the nodes of a range of contexts (level 1: of word hashes, with one context 0).

    Node (context, word) is the key (context - first) * words + word of an Elias-Fano sequence, so a word is found by a
    successor search relative to its context. Beside it lie, by node, quantised probability and count, and by context the
    quantised weight of backing off."""

    def __init__(self, shard: int, first: int, n_contexts: int, words: int, keys: EliasFano, prob: np.ndarray, back: np.ndarray, count: np.ndarray):
        self.shard, self.first, self.n_contexts, self.words = shard, first, n_contexts, words
        self.keys, self.prob, self.back, self.count = keys, prob, back, count

    def to_bytes(self) -> bytes:
        low, high, zeros = self.keys.arrays()
        sizes = (len(low), len(high), len(self.prob), len(self.back), len(self.count))
        head = HEADER.pack(MAGIC, self.shard, self.first, self.n_contexts, self.words, self.keys.width, *sizes, self.count.itemsize)
        return b"".join([head, *(x.tobytes() for x in (low, high, zeros, self.prob, self.back, self.count)), MAGIC[::-1]])

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[Shard | None, int]:
        """The shard at a place of mapped memory, without copying, and where it ends. None: the magic is part of Parquet's
        statistics."""
        start = at
        if at + HEADER.size > len(data):
            return None, at + 1
        _, shard, first, n_contexts, words, width, n_low, n_high, n_prob, n_back, n_count, count_bytes = HEADER.unpack_from(data, at)
        at += HEADER.size
        end = at + 8 * n_low + 12 * n_high + n_prob + n_back + count_bytes * n_count
        if data[end : end + len(MAGIC)] != MAGIC[::-1]:
            return None, start + 1
        found = []
        for kind, n in (("<u8", n_low), ("<u8", n_high), ("<u4", n_high), ("u1", n_prob), ("u1", n_back), (f"<u{count_bytes}", n_count)):
            found.append(np.frombuffer(data, kind, n, at))
            at += found[-1].nbytes
        return cls(shard, first, n_contexts, words, EliasFano(n_count, width, *found[:3]), *found[3:]), at


class Level:
    """A level's files. Where the shared folder is mounted, workers map them there, and only the pages that they look at are read;
    of other stores Spark brings the files to the executors first."""

    def __init__(self, files: list[str], sizes: list[tuple[int, int]], bounds: list[int]):
        self.files = files
        #: first node of each shard, and first context (level 1: hash)
        self.bounds = np.array(bounds, np.uint64)
        n = dict(sizes)
        self.before = np.cumsum([0, *(n.get(i, 0) for i in range(len(bounds)))])

    @property
    def n(self) -> int:
        return int(self.before[-1])

    @cached_property
    def shards(self) -> dict[int, Shard]:
        found = {}
        for name in self.files:
            with Path(url2pathname(urlsplit(name).path) if name.startswith("file:") else SparkFiles.get(name)).open("rb") as f:
                mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            at = mapped.find(MAGIC)
            while at >= 0:
                shard, at = Shard.read(memoryview(mapped), at)
                if shard:
                    found[shard.shard] = shard
                at = mapped.find(MAGIC, at)
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "shards"}

    def _each(self, contexts: np.ndarray) -> Iterator[tuple[np.ndarray, Shard, int]]:
        which = np.searchsorted(self.bounds, contexts, side="right") - 1
        order = np.argsort(which, kind="stable")
        used, n = np.unique(which, return_counts=True)
        end = np.cumsum(n)
        for k, e, z in zip(used, end, n, strict=True):
            if shard := self.shards.get(int(k)):
                yield order[e - z : e], shard, int(self.before[k])

    def find(self, contexts: np.ndarray, words: np.ndarray, n_words: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes or -1, log10 of their probability, their counts) of words in contexts. Each distinct pair is looked up once, in
        order, so that neighbours in memory are read one after the other."""
        keys, back = np.unique(contexts * np.uint64(n_words) + words, return_inverse=True)
        node, prob, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, self.bounds * np.uint64(n_words)), len(keys))
        for k in np.flatnonzero(np.diff(cuts)):
            if shard := self.shards.get(int(k)):
                part = slice(cuts[k], cuts[k + 1])
                at = shard.keys.find(keys[part] - np.uint64(shard.first * n_words))
                hit = np.flatnonzero(at >= 0)
                rows, at = hit + cuts[k], at[hit]
                node[rows], count[rows] = self.before[k] + at, shard.count[at]
                if len(shard.prob):
                    prob[rows] = shard.prob[at] / -STEPS
        return node[back], prob[back], count[back]

    def backoff(self, contexts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(contexts))
        for rows, shard, _ in self._each(contexts):
            out[rows] = shard.back[(contexts[rows] - np.uint64(shard.first)).astype(np.int64)] / -STEPS
        return out


class Trie:
    """Levels, the first of words. train_tokens: N; n_words: V."""

    def __init__(self, levels: list[Level], train_tokens: int):
        self.levels, self.train_tokens = levels, train_tokens

    @property
    def n_words(self) -> int:
        return self.levels[0].n

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.train_tokens + self.n_words + 1))

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids or -1, counts) of word hashes."""
        ids, _, count = self.levels[0].find(hashes, np.zeros(len(hashes), np.uint64))
        return ids, count

    def walk(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For levels 2 and on: (context nodes, nodes, log10 probabilities, counts) of each token's n-gram, -1 for those that
        aren't there. first: places of the texts' first tokens, whose context is the start, number n_words."""
        above = np.r_[np.int64(-1), ids[:-1]]
        above[first] = self.n_words
        for level in self.levels[1:]:
            node, prob, count = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            known = np.flatnonzero((above >= 0) & (ids >= 0))
            node[known], prob[known], count[known] = level.find(above[known].astype(np.uint64), ids[known].astype(np.uint64), self.n_words)
            yield above, node, prob, count
            above = np.r_[np.int64(-1), node[:-1]]
            above[first] = -1

    def score(self, ids: np.ndarray, base: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token: that of its longest n-gram in the trie, with the weights of the contexts that were
        longer."""
        out = base
        for level, (above, node, prob, _) in zip(self.levels[1:], self.walk(ids, first), strict=True):
            weight = np.zeros(len(ids))
            there = np.flatnonzero((above >= 0) & (node < 0))
            weight[there] = level.backoff(above[there].astype(np.uint64))
            out = np.where(node >= 0, prob, out + weight)
        return out


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and ends of texts, tokens of each text)."""
    w = Words(texts)
    n = w.n_words + 1
    out = np.full(int(n.sum()), END)
    out[np.arange(int(w.n_words.sum())) + np.repeat(np.arange(len(n)), w.n_words)] = w.words()
    return out, n


def _blocks(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Sorted counts in a block a bucket: the first key and then differences, which are small, byte by byte in turn, so that equal
    bytes lie together."""
    entry = np.empty(len(keys), ENTRY)
    used, n = np.unique(bucket, return_counts=True)
    end = np.cumsum(n)
    step = np.diff(keys, prepend=keys[:1])
    step[end - n] = keys[end - n]
    entry["key"], entry["n"] = step, counts
    data = [entry[e - z : e].view(np.uint8).reshape(-1, ENTRY.itemsize).T.tobytes() for e, z in zip(end, n, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(data, pa.binary())], ["bucket", "data"])


class _Sums:
    """Keys and their total counts, from blocks. Blocks are summed up whenever they hold as many entries as BUCKET, or as the sums so
    far: what is held grows with the distinct keys, not with the blocks."""

    def __init__(self):
        self.keys, self.counts, self.held, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, data: bytes) -> None:
        self.held.append(data)
        self.n += len(data) // ENTRY.itemsize
        if self.n > max(BUCKET, len(self.keys)):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            entries = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(ENTRY.itemsize, -1).T).view(ENTRY).ravel() for x in self.held]
            keys = np.concatenate([self.keys, *(np.cumsum(x["key"], dtype=np.uint64) for x in entries)])
            counts = np.concatenate([self.counts, *(x["n"].astype(np.int64) for x in entries)])
            self.held, self.n = [], 0
            del entries
            order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first)
        return self.keys, self.counts


def _level(blocks: DataFrame, build, bounds: list[int], min_count: int) -> Level:
    """Buckets of counts built into shards and written."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = _Sums(), None

        def close() -> pa.RecordBatch:
            keys, counts = held.total()
            if min_count > 1:
                total, keep = int(counts.sum()), counts >= min_count
                keys, counts = keys[keep], counts[keep]
            else:
                total = int(counts.sum())
            shard = build(now, keys, counts)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([len(keys)]), pa.array([total]), pa.array([shard.to_bytes()], pa.binary())], ["shard", "n", "total", "blob"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now:
                    if now is not None:
                        yield close()
                    held, now = _Sums(), bucket
                held.add(data)
        if now is not None:
            yield close()

    spark = blocks.sparkSession
    built = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shards, "shard long, n long, total long, blob binary")
    path = f"{working_dir(spark)}/trie-{uuid.uuid4().hex}"
    # Plain pages hold each shard's bytes as they are, to be mapped.
    built.write.options(**{"compression": "none", "parquet.enable.dictionary": "false", "parquet.bloom.filter.enabled": "false"}).parquet(path)
    table = spark.read.schema(built.schema).parquet(path)
    rows = table.select("shard", "n", "total").collect()  # a row a shard
    files = sorted(table.inputFiles())
    mounted = all(x.startswith("file:") for x in files)
    for file in files if not mounted else ():
        spark.sparkContext.addFile(file)
    level = Level(files if mounted else [x.rsplit("/", 1)[-1] for x in files], [(r["shard"], r["n"]) for r in rows], bounds)
    level.total = sum(r["total"] for r in rows)
    return level


def train(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> Trie:
    """A trie of docs (text) up to n-grams of `order` words: all words, and longer n-grams that occur min_count times, by default all.

    Level by level, tasks count the n-grams of whole texts whose parts are in the level above (an n-gram is no more frequent than its
    parts), and buckets of contexts sum the counts and become shards. Probabilities are discounted counts
    interpolated with the level below; a context's weight is what its kept n-grams leave, so they sum to 1. The
    first level is add-one smoothed. What goes to the driver is a row of sizes a shard.
    """
    docs = docs.select("text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shift = max(4, (int(chars / 12) // BUCKET).bit_length())
    schema = "bucket long, data binary"

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0), CHARS):
                keys, counts = np.unique(tokens(texts)[0], return_counts=True)
                yield _blocks(keys, counts, keys >> np.uint64(64 - shift))

    def word_shard(k: int, keys: np.ndarray, counts: np.ndarray) -> Shard:
        none = np.zeros(0, np.uint8)
        first = k << 64 - shift
        return Shard(k, first, 0, 1, EliasFano.build(keys - np.uint64(first), 1 << 64 - shift), none, none, narrow(counts))

    level = _level(docs.mapInArrow(words, schema), word_shard, [k << 64 - shift for k in range(1 << shift)], 1)
    trie = Trie([level], level.total)
    for _ in range(order - 1):
        trie = _longer(docs, trie, min_count, discount, max(16, int(chars / 8) // BUCKET))
    return trie


def _longer(docs: DataFrame, trie: Trie, min_count: int, discount: float, n_buckets: int) -> Trie:
    depth = len(trie.levels)
    n_words = trie.n_words
    contexts = n_words + 1 if depth == 1 else trie.levels[-1].n
    width = max(1, -(-contexts // n_buckets))
    if contexts * n_words >= 1 << 64:
        raise ValueError(f"{contexts} contexts of {n_words} words don't fit keys of 64 bits")
    bounds = [k * width for k in range(max(1, -(-contexts // width)))]
    schema = "bucket long, data binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0), CHARS):
                hashes, n = tokens(texts)
                first = np.cumsum(n) - n
                ids, times = trie.word_ids(hashes)
                above = np.r_[np.int64(-1), ids[:-1]]
                above[first] = n_words
                often = times >= min_count
                keep = often & np.r_[False, often[:-1]]
                keep[first] = often[first]
                for _, node, _, _ in trie.walk(ids, first):
                    above = np.r_[np.int64(-1), node[:-1]]
                    above[first] = -1
                    keep = (above >= 0) & (node >= 0)
                keys, counts = np.unique(above[keep].astype(np.uint64) * np.uint64(n_words) + ids[keep].astype(np.uint64), return_counts=True)
                yield _blocks(keys, counts, keys // np.uint64(n_words * width))

    def shard(k: int, keys: np.ndarray, counts: np.ndarray) -> Shard:
        first, last = k * width, min((k + 1) * width, contexts)
        context, word = keys // np.uint64(n_words), keys % np.uint64(n_words)
        by = (context - np.uint64(first)).astype(np.int64)
        total, below = _below(trie, context, word, first, last)
        kept = np.bincount(by, counts - discount, last - first)
        left = np.clip(1 - kept / np.maximum(total, 1), 1e-10, 1)
        prob = counts - discount
        prob /= total[by]
        below *= left[by]
        prob += below
        del context, word, by, below  # a bucket's arrays are what a task holds
        prob = quantise(np.log10(np.clip(prob, 1e-10, 1, out=prob), out=prob))
        sequence = EliasFano.build(keys - np.uint64(first * n_words), (last - first) * n_words)
        return Shard(k, first, last - first, n_words, sequence, prob, quantise(np.log10(left)), narrow(counts))

    level = _level(docs.mapInArrow(count, schema), shard, bounds, min_count)
    return Trie([*trie.levels, level], trie.train_tokens)


def _below(trie: Trie, context: np.ndarray, word: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(how often each context from first to last goes on, each word's probability in the context without its first word)."""
    words = trie.levels[0]

    def counts_of(level: Level, lo: int, hi: int) -> np.ndarray:
        """Counts of the nodes lo to hi of a level."""
        out = np.zeros(hi - lo, np.int64)
        for k, s in level.shards.items():
            before = int(level.before[k])
            a, b = max(lo, before), min(hi, before + len(s.count))
            if a < b:
                out[a - lo : b - lo] = s.count[a - before : b - before]
        return out

    total = counts_of(trie.levels[-1], first, min(last, trie.levels[-1].n)).astype(float)
    if len(trie.levels) == 1:
        if last > words.n:  # the start goes on once a text: as often as the end occurs
            ends = words.find(np.array([END]), np.zeros(1, np.uint64))[2][0]
            total = np.r_[total, float(ends)]
        distinct, back = np.unique(word, return_inverse=True)
        count = np.zeros(len(distinct), np.int64)
        for k, s in words.shards.items():
            before = int(words.before[k])
            mine = (distinct >= before) & (distinct < before + len(s.count))
            count[mine] = s.count[(distinct[mine] - np.uint64(before)).astype(np.int64)]
        return total, 10 ** trie.base(count)[back]
    # The context's last word: nodes of the level above are keys of their shards.
    level = trie.levels[-1]
    last_word = np.zeros(len(context), np.uint64)
    distinct, back = np.unique(context, return_inverse=True)
    for k, s in level.shards.items():
        before = int(level.before[k])
        mine = np.flatnonzero((distinct >= before) & (distinct < before + len(s.count)))
        if len(mine):
            last_word[mine] = keys_of(s.keys)[(distinct[mine] - np.uint64(before)).astype(np.int64)] % np.uint64(s.words)
    if len(trie.levels) > 2:
        raise ValueError("n-grams of up to three words")
    prob = np.empty(len(word))
    for a in range(0, len(word), FOUND):  # a search holds many times what it returns
        prob[a : a + FOUND] = trie.levels[1].find(last_word[back[a : a + FOUND]], word[a : a + FOUND], trie.n_words)[1]
    return total, 10**prob


def keys_of(sequence: EliasFano) -> np.ndarray:
    """All keys of a sequence."""
    ones = np.flatnonzero(np.unpackbits(sequence.high.view(np.uint8), bitorder="little"))[: sequence.n]
    return ((ones - np.arange(sequence.n)).astype(np.uint64) << np.uint64(sequence.width)) | sequence._low(np.arange(sequence.n))


def scored(docs: DataFrame, trie: Trie) -> DataFrame:
    """docs (doc_id, text) with n_tokens, n_known (tokens that training has), train_tokens, base_score and score (log10).

    Null texts are empty: the end alone. Repeated rows are scored each; other columns are ignored. A trie of no texts
    gives every token the probability 1 of the one unknown token."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1), CHARS):
                hashes, n = tokens(texts)
                first = np.cumsum(n) - n
                ids, count = trie.word_ids(hashes)
                base = trie.base(count)
                sums = [np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), base, trie.score(ids, base, first))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(sums[0]), pa.array(np.full(b - a, trie.train_tokens)), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all texts by a trie of those that aren't held out. Nulls, repeated rows and empty tables: see scored."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_mod("doc_id", 7) == 2
    found = scored(docs, train(docs.where(~held_out)))
    return found.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
