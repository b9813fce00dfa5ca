"""Conversation repair, the Merkle manifest and SimHash components against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import manifest, queries, repair, simhash
from tests.compare import SF
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CHATS = "conv_id bigint, turn bigint, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# Conversation repair


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(c, t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest repair of sorted rows (turn, role, text) by exhaustive search over states, with whole audits and texts."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = "".join(WORD.findall(text))
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    names = {"u": "user", "a": "assistant"}

    def go(state, x):
        return {"es": "s", "eu": "u", "su": "u", "ua": "a", "au": "u"}.get(state + x)

    def closed(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, text) in list(ways.items()):
                for x in "ua":
                    if to := go(state, x):
                        new = (cost + 3, audit + "I", text + [names[x] + ":"])
                        if to not in ways or new[:2] < ways[to][:2]:
                            ways[to] = new
        return ways

    ways = {"e": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def offer(state, new):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, lines) in closed(ways).items():
            offer(state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            fine = 3 * (fault == "truncated")
            if to := go(state, role[:1]):
                offer(to, (cost + fine, audit + "K", lines + [f"{role}:{text}"]))
            for x in "ua":
                if to := go(state, x):
                    offer(to, (cost + 3 + fine, audit + "R", lines + [f"{names[x]}:{text}"]))
        ways = after
    ways = closed(ways)
    cost, audit, lines = min((ways[x] for x in "ea" if x in ways), key=lambda w: w[:2])
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, "\n".join(lines),
    )


def by_conversation(rows):
    of = defaultdict(list)
    for c, t, role, text in rows:
        of[c].append((t, role, text))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in of.items()}


def odd_chats(n=160):
    rng = random.Random(11)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello.", "what", "Yes!", "", " \t", None, "No?", f"say {t}.", "end. \n", "ünï", "Line.\u2028", "x\x85", "two\nlines. \x0b"])
            rows.append((c, rng.choice([t, t, t + 3, None]), role, text))
    return rows + rows[:7] + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]


@pytest.mark.parametrize("segment", [2, 3, 256])
def test_repair_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = odd_chats()
    df = spark.createDataFrame(rows, CHATS).withColumns({"pid": F.lit("x"), "segment": F.lit(1), "fault": F.lit("y"), "c": F.lit(2)})
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(df).collect()}
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: brute_repair(x) for c, x in by_conversation(clean).items()}
    assert got == want
    assert all(any(x in w[6] for w in want.values()) for x in "KRDI")
    one_line = {c for c in want if not any("\n" in (x or "") for k, _, _, x in rows if k == c)}
    assert len(one_line) > 20 and all(re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in want[c][7].split("\n"))) for c in one_line)


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(1, rng.choice([t, None]), rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["a.", f"b{t}.", f"c{t}"])) for t in range(2000)]
    (r,) = repair.repaired(spark.createDataFrame(rows, CHATS)).collect()
    assert tuple(r)[1:] == brute_repair(by_conversation(rows)[1])


def test_op11_equals_brute_force(spark, tmp_path):
    rows = odd_chats(300) + [(c, 0, "user", "All rows go.") for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    spark.createDataFrame(rows, CHATS).withColumn("audit", F.lit("z")).write.parquet(f"{tmp_path}/conversations.parquet")
    after = by_conversation(brute_damage(rows))
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == {c: (*(w := brute_repair(after.get(c, [])))[:7], sha(w[7])) for c in {r[0] for r in rows}}
    assert any(c not in after for c in got)


def test_repair_of_no_rows(spark):
    assert repair.repaired(spark.createDataFrame([], CHATS)).count() == 0


# Merkle manifest


def brute_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) -> sorted result rows."""

    def leaf(i, text, lang, source, n):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))

    def tree(level):
        """(root, of each leaf the siblings (left, right) by level)"""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, i in enumerate(at):
                run = i // 8 * 8
                paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
                at[k] = i // 8
            level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        return level[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in langs}
    trees = {x: tree([leaf(*r) for r in by[x]]) for x in langs}
    root, upper = tree([trees[x][0] for x in langs]) if langs else (None, [])
    out = []
    for x, above in zip(langs, upper):
        for r, own in zip(by[x], trees[x][1]):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            folded = leaf(r[0], text, *r[2:])
            for a, b in own + above:
                folded = sha(a + folded + b)
            out.append((r[0], leaf(*r), trees[x][0], root, sha("".join(a + b for a, b in own + above)), folded, folded == root))
    return sorted(out, key=str)


def many_rows(n=700):
    rng = random.Random(3)
    rows = [(rng.randrange(10 * n), rng.choice(["Some Text", "", None, f"Ünï {i}", "low"]), rng.choice(["en", "en", "en", "de", None, "-", "", "=x", f"l{i % 40}"]), rng.choice(["web", None, "1:2"]), rng.choice([None, i])) for i in range(n)]
    return rows + rows[:20] + [(None, "T", "en", None, None), (None, None, None, None, None), (None, "T", "en", None, None)]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_equals_brute_force(spark, monkeypatch, tmp_path, depth):
    whole = manifest.manifest
    monkeypatch.setattr(manifest, "manifest", lambda *a: whole(*a, depth=depth))
    rows = many_rows()
    df = spark.createDataFrame(rows, fixtures.SCHEMA).withColumns({"tree": F.lit("x"), "rank": F.lit(1), "digest": F.lit("y"), "pid": F.lit(2), "size": F.lit(3)})
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)
    assert got == brute_manifest(rows) and {g[-1] for g in got} == {True, False}


def test_manifest_of_few_rows(spark, tmp_path):
    for k, rows in enumerate(([], [(1, "A", None, None, None)], [(1, "A", "en", "s", 1), (3, None, "de", "s", 1)], [(i, "X", "en", None, i) for i in range(9)])):
        spark.createDataFrame(rows, fixtures.SCHEMA).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert sorted(map(tuple, queries.QUERIES["op12_merkle_manifest"](spark, f"{tmp_path}/{k}").collect()), key=str) == brute_manifest(rows)


def test_levels_and_siblings_of_a_block():
    leaves = manifest.matrix([sha(str(i)) for i in range(4096)])
    block = manifest.levels(leaves, 4)
    assert [len(x) for x in block] == [4096, 512, 64, 8, 1]
    root = block[-1].tobytes().decode()
    assert all(manifest.fold(leaves[i].tobytes(), manifest.siblings(block, i)) == root for i in (0, 7, 8, 63, 2049, 4095))
    assert manifest.fold(b"x" * 64, manifest.siblings(block, 5)) != root


# SimHash


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, radius=4):
    """fps (id, fingerprint) -> id -> least reachable id, nulls last."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, f"{x:016x}", least.get(root(k))) for k, (i, x) in enumerate(fps)), key=str)


def test_fingerprint_equals_brute_force(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "one two three", "a b c d", "A b C d e", "ÄÖ é ünï  x y z", "x " * 50, fixtures.prose(4, 500)]
    texts += [" ".join(rng.choices(["x", "Yy", "zzz", "w\tv"], k=rng.randint(1, 60))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def clustered(rng, n):
    """Distinct fingerprints: clusters around few centres, chains of near ones, and far ones."""
    out = set()
    for _ in range(n // 20):
        x = rng.getrandbits(64)
        for _ in range(16):
            out.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
        out.update(rng.getrandbits(64) for _ in range(4))
    return sorted(out | {0, 1, (1 << 64) - 1})


@pytest.mark.parametrize("n,part,tile,hot", [(400, 4096, 256, False), (1500, 64, 8, False), (1500, 16, 4, False), (900, 16, 4, True), (600, 2, 1, False)])
def test_links_connect_what_brute_force_connects(spark, n, part, tile, hot):
    rng = random.Random(n + part)
    fps = clustered(rng, n)
    if hot:  # most fingerprints agree in most of their bits: full buckets
        fps = sorted(set(fps[:100]) | {x & 0xFFFF for x in fps} | {x & 0xFFF << 40 for x in fps})
    nodes = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    got = [(r.a, r.b) for r in simhash.links(nodes, part=part, tile=tile).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in got)
    parent = {int(np.uint64(x).astype(np.int64)): int(np.uint64(x).astype(np.int64)) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[root(a)] = root(b)
    mine = defaultdict(set)
    for x in parent:
        mine[root(x)].add(x & (1 << 64) - 1)
    theirs = defaultdict(set)
    for i, _, c in brute_components([(x, x) for x in fps]):
        theirs[c].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_blocks_hold_the_radius():
    for n in (1, 4096, 4097, 10**6, 10**8, 10**10, 10**12):
        blocks, chosen, bits = simhash.blocks_for(n)
        assert blocks - chosen == simhash.RADIUS and blocks * bits <= 64
        assert bits == 64 // blocks or n <= 4096 * 2 ** (chosen * bits)
    assert simhash.blocks_for(4096)[2] == 0 and simhash.blocks_for(10**6)[:2] == (5, 1)


def test_op13_equals_brute_force(spark, tmp_path):
    rows = fixtures.rows() + [(None, fixtures.prose(7, 90), "en", "s1", None), (None, None, None, None, None), (60, "x " * 3, None, None, None)]
    rng = random.Random(9)
    base = fixtures.prose(77, 400).split()
    for k in range(30):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "other"
        rows.append((100 + k, " ".join(words), "en", "s", None))
    df = spark.createDataFrame(rows, fixtures.SCHEMA).select("*", *(F.lit("x" if t == "string" else 1).alias(c) for c, t in (x.split() for x in fixtures.EXTRA.split(", "))))
    df.withColumn("fp", F.lit(1)).withColumn("component", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_simhash_dedup"](spark, str(tmp_path)).collect()
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert sum(c == 100 for *_, c in want) > 10
    spark.createDataFrame([], fixtures.SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op13_simhash_dedup"](spark, f"{tmp_path}/none").count() == 0


def test_op13_on_the_tables(spark):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.QUERIES["op13_simhash_dedup"](spark, SF).collect()), key=str)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs])
