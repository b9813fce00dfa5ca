"""Substring dedup by collinear chaining: shared k-mer seeds are joined, ordered matches chained with gap costs through a Fenwick
tree, and chains aligned, so that fuzzy passages are found.

Each shared seed of a document is linked to the first holder (that of the chunk of texts, and that to the first of all), and to
the holder next before it where that is another: a fuzzy passage whose parts stand in several earlier documents is one
chain with the document before that has it whole. Where a passage's seeds are on one diagonal of an earlier document, the chain with it gives the passage. Where they aren't (their
first holders hold parts of it, or the document is the first itself), the windows of MIN_WORDS words there are keyed
whole, and each key's documents are linked to its first. Followed from holder to holder, both ways end for all documents
with one passage at the same window keys, so no document with an exact passage stays without a partner for it.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain as both_of

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import documents, materialize
from lattica.llm.shingles import Words, mix, powers, text_chunks

#: Words of a seed, and k-mers of the window that chooses one: of WINDOW neighbours one is a seed.
SEED, WINDOW = 4, 2
#: Least words of a passage, and least share of its words that the other document has too.
MIN_WORDS, IDENTITY = 50, 0.8
#: How far the seeds of a window key lie apart: all but the outermost of a passage of more than MIN_WORDS words, whose
#: choice depends on what stands around it.
REACH = MIN_WORDS + 1 - SEED - 2 * (WINDOW - 1)
#: Words that a window key vouches for; so many equal words count as a passage, since a key may link a document of over
#: MIN_WORDS to one that has no more of them.
WHOLE = REACH - (WINDOW - 1) + SEED
#: What a word of a gap costs, in words of seeds.
GAP = 0.1
#: Least words that the segments of a chain hold, and that it spans, before it is aligned: three seeds or more. They set
#: how sensitive the search for fuzzy passages is (see the README); exact ones are far above.
HELD, SPAN = 12, 16
#: Words that an end is extended over without a match before it stops.
DROP = 8
#: Words of a gap without a match over which two passages aren't one.
CUT = 24
#: Seeds in a bucket, about.
BUCKET = 700_000
#: Up to so many ids of documents are broadcast; beyond, joined.
BROADCAST_IDS = 500_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

#: A shared seed: at pos of doc, and at of_pos of the document `of`, the same or of a lower id. h: 48 bits of its hash.
LINK = np.dtype([("doc", "<i8"), ("pos", "<i8"), ("of", "<i8"), ("of_pos", "<i8"), ("h", "<u8")])
_HASH_BITS = 48


def seeds(texts: list[str | None], doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, words by text): the minimizers of texts as links to themselves, of each window of WINDOW k-mers the one
    with the least hash."""
    w = Words(texts)
    n = np.maximum(w.n_words - SEED + 1, 0)
    end = np.cumsum(n)
    at = np.repeat(w.first - (end - n), n) + np.arange(n.sum())
    h = w.hashes(at, at + SEED - 1)
    begin, last = np.repeat(end - n, n), np.repeat(end, n)
    places = np.arange(len(h))
    chosen = np.zeros(len(h), bool)
    # A k-mer is chosen if it is the least of a window that holds it, that is, of the window from one of the k-mers before it.
    for back in range(WINDOW):
        start = np.maximum(places - back, begin)
        least = h[start]
        for ahead in range(1, WINDOW):
            least = np.minimum(least, h[np.minimum(start + ahead, last - 1)])
        chosen |= least == h
    out = np.empty(int(chosen.sum()), LINK)
    text = np.repeat(np.arange(len(n)), n)[chosen]
    out["h"], out["doc"], out["pos"] = h[chosen], doc_ids[text], at[chosen] - w.first[text]
    out["of"], out["of_pos"] = out["doc"], out["pos"]
    return out, w.n_words


def packed(link: np.ndarray, flags: np.ndarray | None = None) -> bytes:
    """Links in order of document and place as differences, byte by byte in turn, which compresses well."""
    doc = link["doc"]
    columns = [np.diff(doc, prepend=doc[:1]), link["pos"], doc - link["of"], link["pos"] - link["of_pos"], link["h"]]
    width = (8, 5, 8, 5, _HASH_BITS // 8)
    raw = [np.int64(doc[0] if len(doc) else 0).tobytes()]
    raw += [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(columns, width, strict=True)]
    return b"".join(raw if flags is None else [*raw, flags.astype(np.uint8).tobytes()])


def unpacked(data: bytes, with_flags: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    width = (8, 5, 8, 5, _HASH_BITS // 8)
    n = (len(data) - 8) // (sum(width) + with_flags)
    at, found = 8, []
    for w in width:
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T
        found.append(raw.view("<i8")[:, 0])
        at += n * w
    out = np.empty(n, LINK)
    out["doc"] = np.frombuffer(data, "<i8", 1)[0] + np.cumsum(found[0])
    out["pos"], out["of"], out["h"] = found[1], out["doc"] - found[2], found[4].view(np.uint64)
    # five bytes of a difference of either sign
    out["of_pos"] = found[1] - ((found[3] << 24) >> 24)
    return out, np.frombuffer(data, np.uint8, n, at) if with_flags else None


def firsts_and_followers(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(firsts, followed, followers): the rows of the first entry of each hash by document and place, whether others follow
    it, and those others linked to it."""
    order = np.lexsort((entry["pos"], entry["doc"], entry["h"]))
    h = entry["h"][order]
    begins = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    firsts = order[begins]
    followers = entry[order[~begins]]
    of = entry[firsts[np.cumsum(begins) - 1][~begins]]
    followers["of"], followers["of_pos"] = of["doc"], of["pos"]
    return firsts, np.diff(np.r_[np.flatnonzero(begins), len(h)]) > 1, followers


def lasts_and_neighbours(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lasts, rows, neighbours): of each hash that several documents have the row of the last one's first entry; and the rows whose
    hash an earlier document has that isn't the first, linked to the last such one."""
    order = np.lexsort((entry["pos"], entry["doc"], entry["h"]))
    h, doc = entry["h"][order], entry["doc"][order]
    if not len(h):
        return order, order, entry[:0]
    of_hash, of_doc = np.r_[True, h[1:] != h[:-1]], np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(of_doc)  # a document's first entry of a hash
    hash_of, first = np.cumsum(of_hash) - 1, np.flatnonzero(of_hash)
    ends = np.r_[hash_of[at][1:] != hash_of[at][:-1], True]
    lasts = order[at[ends & ~of_hash[at]]]
    before = np.r_[-1, at[:-1]][np.cumsum(of_doc) - 1]  # the document's before this one
    there = before >= first[hash_of] + 1
    there &= doc[np.maximum(before, 0)] != doc[first[hash_of]]
    out = entry[order[there]]
    of = entry[order[before[there]]]
    out["of"], out["of_pos"] = of["doc"], of["pos"]
    return lasts, order[there], out


def matches(entry: np.ndarray) -> np.ndarray:
    """The links of entries of several documents to other documents, of one chunk."""
    followers = firsts_and_followers(entry)[2]
    return followers[followers["doc"] != followers["of"]]


class Fenwick:
    """Greatest (value, item) over prefixes."""

    def __init__(self, n: int):
        self.tree: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, item: int) -> None:
        i += 1
        while i < len(self.tree):
            if value > self.tree[i][0]:
                self.tree[i] = (value, item)
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """Over the first i places."""
        found = (-1e18, -1)
        while i:
            found = max(found, self.tree[i])
            i -= i & -i
        return found


def segments(pos: np.ndarray, of_pos: np.ndarray, n: int = SEED) -> list[tuple[int, int, int]]:
    """Matches of n words joined along diagonals where they touch or overlap within a window: (start, other start, length)."""
    order = np.lexsort((pos, pos - of_pos))
    pos, of_pos = pos[order], of_pos[order]
    cut = np.r_[True, (np.diff(pos - of_pos) != 0) | (np.diff(pos) > WINDOW + n)]
    at = np.flatnonzero(cut)
    stop = np.r_[at[1:], len(pos)] - 1
    return sorted(zip(pos[at].tolist(), of_pos[at].tolist(), (pos[stop] - pos[at] + n).tolist(), strict=True))


def chain(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of segments that follow each other in both documents, best first; a segment is in one chain.

    A chain's score is its words less GAP for each word between segments in either document. With that cost the best
    chain before a segment is a prefix maximum of score + GAP * (both ends) over the ends in the other document."""
    slack = SEED - 1  # segments may overlap by less than a seed
    ends = sorted({y + n - slack for _, y, n in parts})
    rank = {v: i for i, v in enumerate(ends)}
    tree = Fenwick(len(ends))
    score, back = [0.0] * len(parts), [-1] * len(parts)
    closing = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    waiting = 0
    for i, (x, y, n) in enumerate(parts):
        while waiting < len(closing) and parts[closing[waiting]][0] + parts[closing[waiting]][2] - slack <= x:
            j = closing[waiting]
            if j < i:
                a, b, m = parts[j]
                tree.put(rank[b + m - slack], score[j] + GAP * (a + m + b + m), j)
            waiting += 1
        value, j = tree.best(bisect_right(ends, y))
        gain = value - GAP * (x + y)
        score[i] = n + max(0.0, gain)
        back[i] = j if gain > 0 else -1
    used, out = set(), []
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and i not in used:
            used.add(i)
            path.append(parts[i])
            i = back[i]
        if path:
            out.append(path[::-1])
    return out


def candidates(pos: np.ndarray, of_pos: np.ndarray, n: int = SEED) -> list[list[tuple[int, int, int]]]:
    """The chains of the matches of n words of two documents that are worth an alignment."""
    if len(pos) * n < HELD:
        return []
    return [x for x in chain(segments(pos, of_pos, n)) if sum(m for *_, m in x) >= HELD and x[-1][0] + x[-1][2] - x[0][0] >= SPAN]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Words of a gap that an alignment matches: the longest common subsequence, by bits of a number for the words of a."""
    common = np.intersect1d(a, b)
    if not len(common):
        return 0
    if len(a) == len(b) and (equal := int((a == b).sum())) >= len(a) - 2:
        return equal
    at: dict[int, int] = {}
    for i, x in enumerate(a[np.isin(a, common)].tolist()):
        at[x] = at.get(x, 0) | 1 << i
    m = int(np.isin(a, common).sum())
    full = open_ = (1 << m) - 1
    for x in b[np.isin(b, common)].tolist():
        hit = open_ & at[x]
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return m - open_.bit_count()


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, matches) that two runs go on alike, word by word, up to the last match before DROP mismatches outweigh."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    score = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    stop = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    score = score[: int(stop[0])] if len(stop) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    to = int(np.argmax(score)) + 1
    return to, int((a[:to] == b[:to]).sum())


def runs(path: list[tuple[int, int, int]], mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, same): a chain as its longest runs of equal words (start, other start, words), and the words that the
    alignment matches in the gap after each but the last."""
    found: list[list[int]] = []
    for x, y, n in path:
        if found:  # what overlaps the segment before is counted once
            shift = max(found[-1][0] + found[-1][2] - x, found[-1][1] + found[-1][2] - y, 0)
            x, y, n = x + shift, y + shift, n - shift
        if n <= 0:
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, mine[x : x + n] == other[y : y + n], False]))
        found += [[x + int(i), y + int(i), int(j - i)] for i, j in edge.reshape(-1, 2)]
    same = []
    for k in range(len(found) - 1):
        (a, b, m), (x, y, _) = found[k : k + 2]
        gap, of_gap = mine[a + m : x], other[b + m : y]
        n = min(len(gap), len(of_gap))
        differ = np.flatnonzero(gap[:n] != of_gap[:n])
        ahead = int(differ[0]) if len(differ) else n
        n -= ahead
        differ = np.flatnonzero(gap[len(gap) - n :][::-1] != of_gap[len(of_gap) - n :][::-1])
        behind = int(differ[0]) if len(differ) else n
        found[k][2] += ahead
        found[k + 1] = [x - behind, y - behind, found[k + 1][2] + behind]
        same.append(_same(gap[ahead : len(gap) - behind], of_gap[ahead : len(of_gap) - behind]))
    return np.array(found, np.int64).reshape(-1, 3), np.array(same, np.int64)


def align(path: list[tuple[int, int, int]], mine: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The passages (start, words, other start, other words, matches) of a chain, aligned over the words of both documents.
    Segments are checked word by word, gaps aligned, ends extended. A chain that isn't a passage as a whole gives its
    longest stretches that are; one with a gap of over CUT words is cut there if both sides are passages."""
    u, v, n = path[-1]
    if u + n > len(mine) or v + n > len(other):
        return []
    run, same = runs(path, mine, other)
    if not len(run):
        return []
    start, of_start = run[:, 0], run[:, 1]
    stop, of_stop = start + run[:, 2], of_start + run[:, 2]
    total = np.cumsum(run[:, 2]) + np.r_[0, np.cumsum(same)]  # matches up to each run's end
    base = total - run[:, 2]
    lost = np.maximum(start[1:] - stop[:-1], of_start[1:] - of_stop[:-1]) - same

    def passage(i: int, j: int) -> tuple[int, int, int, int, int] | None:
        """Runs i to j with ends extended, or as they are if only that has the identity."""
        x, y, at, of, matched = int(start[i]), int(of_start[i]), int(stop[j]), int(of_stop[j]), int(total[j] - base[i])
        left, before = _extend(mine[:x][::-1], other[:y][::-1])
        right, after = _extend(mine[at:], other[of:])
        for l, b, r, a in ((left, before, right, after), (0, 0, 0, 0)):
            n, of_n, m = at - x + l + r, of - y + l + r, matched + a + b
            if n >= MIN_WORDS and m >= IDENTITY * max(n, of_n) or m == n == of_n >= WHOLE:
                return x - l, n, y - l, of_n, m
        # Too short: the nearest equal words beyond the ends with which it is long enough and has the identity.
        x, y, at, of, matched = x - left, y - left, at + right, of + right, matched + before + after
        need = MIN_WORDS - (at - x)
        if need <= 0 or need > MIN_WORDS // 2:
            return None
        far = need + DROP
        a, b = min(far, x, y), min(far, len(mine) - at, len(other) - of)
        left, right = (np.flatnonzero(np.r_[True, e]) for e in (mine[x - a : x][::-1] == other[y - a : y][::-1], mine[at : at + b] == other[of : of + b]))
        more, at_left, at_right = min(((l + r, k, q) for k, l in enumerate(left.tolist()) for q, r in enumerate(right.tolist()) if l + r >= need and matched + k + q >= IDENTITY * (max(at - x, of - y) + l + r)), default=(0, 0, 0))
        if not more:
            return None
        l = int(left[at_left])
        return x - l, at - x + more, y - l, of - y + more, matched + at_left + at_right

    def longest(i: int, j: int) -> Iterator[tuple[int, int]]:
        """Stretches of runs i to j with the identity, those with most matches first."""
        ranked = []
        for k in range(i, j + 1):
            matched = total[k : j + 1] - base[k]
            good = matched >= IDENTITY * np.maximum(stop[k : j + 1] - start[k], of_stop[k : j + 1] - of_start[k])
            good &= matched >= MIN_WORDS // 4
            if good.any():
                to = int(np.flatnonzero(good)[-1])
                ranked.append((-int(matched[to]), k, k + to))
        return ((k, to) for _, k, to in sorted(ranked))

    out, todo = [], [(0, len(run) - 1)]
    while todo:
        i, j = todo.pop()
        if i > j:
            continue
        found = passage(i, j)
        if not found:
            for k, to in longest(i, j):
                if passage(k, to):
                    todo += [(k, to), (i, k - 1), (to + 1, j)]
                    break
            continue
        wide = i + np.flatnonzero(lost[i:j] > CUT)
        for k in wide[np.argsort(-lost[wide], kind="stable")].tolist():
            if passage(i, k) and passage(k + 1, j):
                todo += [(i, k), (k + 1, j)]
                break
        else:
            out.append(found)
    return out


def pair_passages(paths: list[list[tuple[int, int, int]]], mine: np.ndarray, other: np.ndarray) -> set[tuple[int, int, int, int, int]]:
    """The passages of the chains of two documents, the longest chains first; a chain whose words, and those beside it, passages
    found before hold already adds nothing."""
    found: set[tuple[int, int, int, int, int]] = set()
    held = np.zeros(len(mine), bool)
    for path in sorted(paths, key=lambda p: -sum(n for *_, n in p)):
        if held[max(0, path[0][0] - SEED) : path[-1][0] + path[-1][2] + SEED].all():
            continue
        for x in align(path, mine, other):
            found.add(x)
            held[x[0] : x[0] + x[1]] = True
    return found


def through_first(link: np.ndarray) -> np.ndarray:
    """Links in order of document and place, those of a document to its own first place of a seed led on to where that
    is linked to."""
    doc = np.cumsum(np.r_[True, link["doc"][1:] != link["doc"][:-1]]) << 40 if len(link) else np.zeros(0, np.int64)
    again = np.flatnonzero((link["doc"] == link["of"]) & (link["pos"] != link["of_pos"]))
    line, wanted = doc + link["pos"], doc[again] + link["of_pos"][again]
    at = np.minimum(np.searchsorted(line, wanted), len(line) - 1)
    there = line[at] == wanted
    for c in ("of", "of_pos"):
        link[c][again[there]] = link[c][at[there]]
    return link


def window_keys(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys): of links in order of document and place, those at which a window of shared seeds begins, without a
    gap, that isn't on one diagonal of another document; and a hash of the window's seeds and their distances."""
    n = len(link)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, pos = link["doc"], link["pos"]
    same_doc = doc[1:] == doc[:-1]
    on = np.r_[False, same_doc & (np.diff(pos) <= WINDOW)]
    run = np.cumsum(~on) - 1
    last = np.flatnonzero(np.r_[~on[1:], True])[run]
    line = (np.cumsum(np.r_[True, ~same_doc]) << 40) + pos
    stop = np.searchsorted(line, line + REACH, side="right") - 1
    diagonal = pos - link["of_pos"]
    turns = np.cumsum(np.r_[False, (link["of"][1:] != link["of"][:-1]) | (diagonal[1:] != diagonal[:-1])])
    wanted = (pos[last] >= pos + REACH - (WINDOW - 1)) & ((turns[stop] != turns) | (link["of"] == doc))
    at = np.flatnonzero(wanted)
    # Sums over the seeds after the first of each window, each with its distance from the one before.
    inner = mix(link["h"] ^ (np.diff(pos, prepend=0).astype(np.uint64) << np.uint64(_HASH_BITS)))
    up, down = powers(_STEP, n), powers(pow(_STEP, -1, 1 << 64), n)
    sums = np.r_[np.uint64(0), np.cumsum(inner * up)]
    return at, mix((sums[stop[at] + 1] - sums[at + 1]) * down[at] + mix(link["h"][at]))


_STEP = 0x9E3779B97F4A7C15
_ROW = "kind int, part long, doc long, of long, n long, data binary"
#: Kinds of rows. COPY: doc has the text of `of`, of n words. TEXT: doc is the first of its chunk with the text of hash `of`. SEEDS:
#: a bucket's seeds. LINKS: shared seeds of the documents of a part. PAIR: the chains of doc with `of`. WINDOW_KEY: doc has a
#: window of key `of` at n, and at the places in data. SAME: doc has at n a window that the document `of` has at part.
COPY, TEXT, SEEDS, LINKS, PAIR, WINDOW_KEY, SAME = range(7)
#: Marks a bucket's entry of a chunk's last document with a seed, which others are linked to; 0 and 1 mark a first one, alone or followed.
LAST = 2


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(size, kind, np.int32)
    types = {"kind": pa.int32(), "data": pa.binary()}
    names = [x.split()[0] for x in _ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[x], types.get(x, pa.int64())) if x in columns else pa.nulls(size, types.get(x, pa.int64())) for x in names], names)


def _by_part(kind: int, link: np.ndarray, part: np.ndarray, flags: np.ndarray | None = None) -> pa.RecordBatch:
    """Links in a packed block for each part."""
    order = np.lexsort((link["pos"], link["doc"], part))
    used, n = np.unique(part, return_counts=True)
    end = np.cumsum(n)
    data = [packed(link[order[e - z : e]], None if flags is None else flags[order[e - z : e]]) for e, z in zip(end, n, strict=True)]
    return _rows(kind, len(used), part=used, data=data)


def _blocks_of(batches: Iterator[pa.RecordBatch], kind: int, close) -> Iterator[pa.RecordBatch]:
    """Rows of other kinds as they are; for the blocks of each part of a kind, which come one after the other, close(blocks)."""
    held: list[bytes] = []
    now = None
    for batch in batches:
        kinds, parts = batch.column("kind").to_numpy(), batch.column("part").to_numpy(zero_copy_only=False)
        if (kinds != kind).any():
            yield batch.filter(pa.array(kinds != kind))
        for i in np.flatnonzero(kinds == kind):
            if parts[i] != now and held:
                yield from close(held)
                held = []
            now = parts[i]
            held.append(batch.column("data")[int(i)].as_py())
    if held:
        yield from close(held)


def _chained(link: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes]]:
    """(doc, of, chains) of the links of n words between documents."""
    link = link[np.lexsort((link["pos"], link["of"], link["doc"]))]
    cut = np.r_[True, (np.diff(link["doc"]) != 0) | (np.diff(link["of"]) != 0)] if len(link) else np.zeros(0, bool)
    begin = np.flatnonzero(cut)
    stop = np.r_[begin[1:], len(link)]
    worth = ((stop - begin) * n >= HELD) & (link["pos"][stop - 1] + n - link["pos"][begin] >= SPAN) if len(link) else []
    for a, b in zip(begin[worth].tolist(), stop[worth].tolist(), strict=True):
        paths = candidates(link["pos"][a:b], link["of_pos"][a:b], n)
        if paths:
            flat = [len(paths), *map(len, paths), *(v for p in paths for x in p for v in x)]
            yield int(link["doc"][a]), int(link["of"][a]), np.array(flat, np.int64).tobytes()


def _paths(data: bytes) -> list[list[tuple[int, int, int]]]:
    flat = np.frombuffer(data, np.int64)
    sizes, rows = flat[1 : 1 + flat[0]], flat[1 + flat[0] :].reshape(-1, 3).tolist()
    ends = np.cumsum(sizes)
    return [[tuple(x) for x in rows[e - z : e]] for e, z in zip(ends, sizes, strict=True)]


def shared_seeds(docs: DataFrame) -> DataFrame:
    """A written table of rows (see COPY and on) of docs (doc_id, text): copies, chained pairs, and window keys.

    A task links what its chunk of texts shares and sends on one entry a seed, in a block for each bucket of hashes; equal
    texts of a chunk count once. So a seed that very many documents hold gives few entries to its bucket. Blocks of links
    then meet by document, as many for each as it has seeds."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(64, int(chars / 6 * 2 / (WINDOW + 1) / BUCKET))

    def part_of(x: np.ndarray) -> np.ndarray:
        return (mix(x.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def _links(first: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        """Links to first holders, and, marked, to those next before."""
        both = np.concatenate([first, near])
        return _by_part(LINKS, both, part_of(both["doc"]), np.repeat(np.uint8([0, 1]), [len(first), len(near)]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b, texts in text_chunks(batch.column(0)):
                order = a + np.lexsort((ids[a:b], keys[a:b]))  # of equal texts the least doc_id gives the seeds
                new = np.r_[True, np.diff(keys[order]) != 0]
                first = order[new]
                entry, n_words = seeds([texts[i - a] for i in first], ids[first])
                text = np.cumsum(new) - 1
                copy = ~new & (ids[order] != ids[first][text]) & (n_words[text] >= MIN_WORDS)
                at = order[copy]
                yield _rows(COPY, len(at), part=ids[at], doc=ids[at], of=ids[first][text[copy]], n=n_words[text[copy]])
                whole = n_words >= MIN_WORDS
                yield _rows(TEXT, int(whole.sum()), part=ids[first][whole], doc=ids[first][whole], of=keys[first][whole], n=n_words[whole])
                found, followed, followers = firsts_and_followers(entry)
                lasts, _, near = lasts_and_neighbours(entry)
                # Within its bucket an entry keeps 48 bits of its hash.
                found = entry[np.r_[found, lasts]]
                yield _by_part(SEEDS, found, part_of(found["h"]), np.r_[followed.astype(np.uint8), np.full(len(lasts), LAST)])
                yield _links(followers, near)

    def close_bucket(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        both = [unpacked(x, True) for x in held]
        every, flag = np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
        entry, marks = every[flag != LAST], flag[flag != LAST] > 0
        found, followed, followers = firsts_and_followers(entry)
        # A chunk's first is next to the last of a chunk before, or to its first.
        _, rows, near = lasts_and_neighbours(every)
        # A seed that one chunk alone has is shared if it was followed there.
        yield _links(np.concatenate([entry[found[followed | marks[found]]], followers]), near[flag[rows] != LAST])

    def close_part(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        both = [unpacked(x, True) for x in held]
        link, flag = np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
        near, link = link[flag > 0], link[flag == 0]
        link = through_first(link[np.lexsort((link["pos"], link["doc"]))])
        pairs = list(_chained(np.concatenate([link[link["doc"] != link["of"]], near]), SEED))
        doc, of, data = zip(*pairs, strict=True) if pairs else ((), (), ())
        yield _rows(PAIR, len(pairs), doc=np.array(doc, np.int64), of=np.array(of, np.int64), data=list(data))
        # Windows: each key's first document in the part goes on, in one row, the others are linked to it.
        at, key = window_keys(link)
        order = np.lexsort((at, key))  # at is in order of document and place
        at, key = at[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        mine = link[at]
        of = mine[new][np.cumsum(new) - 1]
        other = of["doc"] != mine["doc"]
        first, again = np.flatnonzero(new), mine["pos"][~other & ~new]
        more = np.bincount((np.cumsum(new) - 1)[~other & ~new], minlength=len(first))
        places = {int(k): again[e - n : e].tobytes() for k, e, n in zip(np.flatnonzero(more), np.cumsum(more)[more > 0], more[more > 0], strict=True)}
        yield _rows(WINDOW_KEY, len(first), doc=mine["doc"][first], of=key[first].view(np.int64), n=mine["pos"][first], data=[places.get(k) for k in range(len(first))])
        yield _rows(SAME, int(other.sum()), doc=mine["doc"][other], n=mine["pos"][other], of=of["doc"][other], part=of["pos"][other])

    rows = docs.where("doc_id IS NOT NULL").select("text", F.col("doc_id").cast("long"), F.xxhash64("text"))
    dealt = rows.mapInArrow(blocks, _ROW).repartition("kind", "part").sortWithinPartitions("kind", "part")
    linked = dealt.mapInArrow(lambda x: _blocks_of(x, SEEDS, close_bucket), _ROW).repartition("kind", "part").sortWithinPartitions("kind", "part")
    return materialize(linked.mapInArrow(lambda x: _blocks_of(x, LINKS, close_part), _ROW), "substring-seeds")


def _window_pairs(table: DataFrame) -> DataFrame:
    """The chains of documents with equal windows: doc, of, data. Each key's first document by id gets the others' links."""

    def to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, pos = None, 0, 0  # of the first of the key so far
        for batch in batches:
            of, ids, at = (batch.column(c).to_numpy() for c in ("of", "doc", "n"))
            data = batch.column("data")
            new = np.r_[key is None or of[0] != key, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
            group = np.cumsum(new)  # 0: the key goes on from the batch before
            firsts, places = np.r_[doc, ids[new]], np.r_[pos, at[new]]
            if len(of):
                key, doc, pos = of[-1], firsts[group[-1]], places[group[-1]]
            other = ids != firsts[group]
            row = np.flatnonzero(other & data.is_valid().to_numpy(zero_copy_only=False))
            more = [np.frombuffer(data[int(i)].as_py(), np.int64) for i in row]
            row = np.r_[np.flatnonzero(other), np.repeat(row, [len(x) for x in more])]
            ids, group, at = ids[row], group[row], np.concatenate([at[other], *more])
            yield _rows(SAME, len(row), doc=ids, n=at, of=firsts[group], part=places[group])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros(0, LINK)
        for batch in both_of(batches, [None]):
            link = np.zeros(0 if batch is None else batch.num_rows, LINK)
            if batch is not None:
                for name, c in (("doc", "doc"), ("pos", "n"), ("of", "of"), ("of_pos", "part")):
                    link[name] = batch.column(c).to_numpy()
            link = np.concatenate([tail, link])
            change = np.flatnonzero((np.diff(link["doc"]) != 0) | (np.diff(link["of"]) != 0))
            to = len(link) if batch is None else int(change[-1]) + 1 if len(change) else 0
            tail = link[to:]
            pairs = list(_chained(link[:to], WHOLE))
            doc, of, data = zip(*pairs, strict=True) if pairs else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(of, pa.int64()), pa.array(data, pa.binary())], ["doc", "of", "data"])

    keys = table.where(f"kind = {WINDOW_KEY}").select("of", "doc", "n", "data").repartition("of").sortWithinPartitions("of", "doc", "n")
    same = table.where(f"kind = {SAME}").union(keys.mapInArrow(to_first, _ROW)).select("doc", "n", "of", "part")
    return same.repartition("doc", "of").sortWithinPartitions("doc", "of", "n").mapInArrow(chained, "doc long, of long, data binary")


def _copies(table: DataFrame) -> DataFrame:
    """Whole texts that a document before has too: doc, of, n. The first of each chunk is a copy of the first of all."""
    texts = table.where(f"kind = {TEXT}").select("doc", F.col("of").alias("text_key"), "n")
    least = texts.groupBy("text_key").agg(F.min("doc").alias("of"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return table.where(f"kind = {COPY}").select("doc", "of", "n").union(texts.join(least, "text_key").where("doc > of").select("doc", "of", "n"))


def _aligned(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages of chained pairs (doc, of, data)."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    wanted = materialize(pairs.select(F.col("doc").alias("id")).union(pairs.select("of")).distinct(), "substring-wanted")
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("doc"), F.col("text").alias("mine")), "doc")
    both = both.join(texts.select(F.col("id").alias("of"), F.col("text").alias("other")), "of").select("doc", "of", "data", "mine", "other")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64).to_pydict()
                known: dict[str, np.ndarray] = {}
                out = []
                for doc, of, data, mine, other in zip(*part.values(), strict=True):
                    for t in (mine, other):
                        if t not in known:
                            known[t] = Words([t]).words()
                    out += [(doc, x, n, of, *rest) for x, n, *rest in pair_passages(_paths(data), known[mine], known[other])]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(7)], ["doc_id", "start", "n_words", "of_doc_id", "of_start", "of_n_words", "matched"])

    return both.mapInArrow(aligned, "doc_id long, start long, n_words long, of_doc_id long, of_start long, of_n_words long, matched long")


def passages(docs: DataFrame) -> DataFrame:
    """Passages of docs (doc_id, text) that documents with lower doc_ids have too: doc_id, start, n_words, of_doc_id, of_start,
    of_n_words, matched (words in order). Places are in words, cut at ASCII white space; A-Z match a-z.

    A passage has MIN_WORDS words or more and IDENTITY of them in common, or WHOLE equal words. It links a document to one that has it before,
    and that to another or to none, so a passage in n documents gives about n rows, which connect them. A text that another document
    has whole is one passage of its words, and links to that document alone.

    Null and short texts have no passage, and what a document repeats within itself is none. A null doc_id takes no part. Rows
    that repeat a doc_id are one document. An empty table gives no row. Other columns are ignored.
    """
    table = shared_seeds(docs)
    copies = materialize(_copies(table), "substring-copies")
    pairs = table.where(f"kind = {PAIR}").select("doc", "of", "data").union(_window_pairs(table))
    pairs = materialize(pairs.join(copies.select("doc"), "doc", "left_anti"), "substring-chains")
    zero = F.lit(0).cast("long")
    whole = copies.select("doc", zero, "n", "of", zero, "n", "n")
    return materialize(_aligned(docs, pairs).union(whole).distinct(), "substring-passages")


def without_passages(docs: DataFrame) -> DataFrame:
    """docs without the passages that documents with lower doc_ids have; what stays keeps its white space. n_chars, if
    there, is the new length. A document of which no word stays goes; one without passages isn't changed. Nulls, repeated
    rows and empty tables: see passages; rows that repeat a doc_id are all cut alike. Other columns, whatever their names,
    are kept."""
    name = f"spans_{uuid.uuid4().hex}"
    spans = passages(docs).groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words")).alias(name))
    joined = docs.alias("d").join(spans.alias("s"), F.expr("d.doc_id = s.doc_id"), "left").select("d.*", f"s.{name}")
    names, at = docs.columns, docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, alive = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for i, spans in enumerate(batch.columns[-1].to_pylist()):
                if spans and texts[i] is not None:
                    tokens = _WORD.findall(texts[i].encode())
                    keep = np.ones(len(tokens), bool)
                    for s in spans:
                        keep[s["start"] : s["start"] + s["n_words"]] = False
                    texts[i] = b"".join(t for t, k in zip(tokens, keep, strict=True) if k).decode()
                    alive[i] = keep.any()
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.column(at).type)
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in texts], batch.column(length).type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(alive))

    return joined.mapInArrow(cut, docs.schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The passages of all documents. Nulls, repeated rows and empty tables: see passages."""
    return passages(documents(spark, sf_dir).select("doc_id", "text"))
