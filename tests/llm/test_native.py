import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat, fingerprints, mixing, quality
from lattica.llm.common import words
from tests.compare import SF
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_cut_at_ascii_white_space_only(spark):
    got = {r.doc_id: r.w for r in fixtures.documents(spark).select("doc_id", words(F.col("text")).alias("w")).collect()}
    assert all(got[i] == WORD.findall(t or "") for i, t, *_ in fixtures.rows())


def test_quality_statistics_equal_brute_force(spark):
    got = quality.judge(fixtures.documents(spark, extra=True)).collect()
    texts = {i: t or "" for i, t, *_ in fixtures.rows()}
    assert len(got) == len(fixtures.rows())
    for r in got:
        x = texts[r.doc_id]
        w = WORD.findall(x)
        lines = [line for line in x.split("\n") if WORD.search(line)]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in x)
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.judge(fixtures.empty(spark)).count() == 0


def em(patterns, rounds):
    """The estimates by numpy."""
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    prior, good, bad = 0.85, np.full(v.shape[1], 0.98), np.full(v.shape[1], 0.5)

    def post():
        g = np.log(prior) + np.where(v == 1, np.log(good), np.where(v == -1, np.log(1 - good), 0)).sum(1)
        b = np.log(1 - prior) + np.where(v == 1, np.log(1 - bad), np.where(v == -1, np.log(bad), 0)).sum(1)
        return 1 / (1 + np.exp(b - g))

    for _ in range(rounds):
        w = n * post()
        prior = np.clip((1 + w.sum()) / (2 + n.sum()), 0.02, 0.999)
        good = np.clip([(1 + w[c == 1].sum()) / (2 + w[c != 0].sum()) for c in v.T], 0.97, 0.999)
        rest = n - w
        bad = np.array([min(0.999, max(0.02, 1 - g + 0.02, (1 + rest[c == -1].sum()) / (2 + rest[c != 0].sum()))) for c, g in zip(v.T, good)])
    return prior, good, bad, post()


def test_estimates_equal_numpy(spark):
    patterns = [([1, 1, 1], 700), ([1, 1, 0], 50), ([-1, -1, 1], 40), ([-1, 1, -1], 30), ([0, -1, -1], 20), ([1, -1, 1], 9)]
    df = spark.createDataFrame(patterns, "votes array<int>, n bigint")
    p = quality.estimate(df, 3, 15).first().p
    prior, good, bad, post = em(patterns, 15)
    assert np.allclose([p.prior, *p.good, *p.bad], [prior, *good, *bad])
    got = df.crossJoin(quality.estimate(df, 3, 15)).select("votes", F.expr(quality.posterior_sql("votes", "p")).alias("q")).collect()
    assert np.allclose(sorted(r.q for r in got), sorted(post))


def test_estimates_learn_accuracies_without_the_floor(spark):
    rng = np.random.default_rng(6)
    prior, good, bad, silent = 0.7, [0.95, 0.85, 0.9, 0.75, 0.8], [0.9, 0.7, 0.8, 0.6, 0.85], 0.2
    counts = Counter()
    for quality_of in rng.random(30_000) < prior:
        right = rng.random(5) < (good if quality_of else bad)
        vote = np.where(right == quality_of, 1, -1)
        counts[tuple(np.where(rng.random(5) < silent, 0, vote).tolist())] += 1
    df = spark.createDataFrame([(list(k), n) for k, n in counts.items()], "votes array<int>, n bigint")
    p = quality.estimate(df, 5, 60, floor=0.5).first().p
    assert abs(p.prior - prior) < 0.03 and np.abs(np.array(p.good) - good).max() < 0.03 and np.abs(np.array(p.bad) - bad).max() < 0.05


def test_quality_follows_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(docs).join(labels, "doc_id").select("kept", "base_failed", labels["quality"].alias("y")).collect()
    good, bad = [r for r in rows if r.y == 1], [r for r in rows if r.y == 0]
    assert sum(r.kept for r in good) >= 0.99 * sum(not r.base_failed for r in good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = (left - sum(3 * sizes[s] for s in full)) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= set(over)


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = fixtures.documents(spark, extra=True)
    got = mixing.mix(docs, n_shards=4).collect()
    size = Counter()
    for _, t, _, s, _ in fixtures.rows():
        size[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(size))
    taken = Counter()
    for r in got:
        t = sum(p.len for p in r.pieces)
        assert t <= 3 * r.size and r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        taken[r.source] += t
        per = Counter()
        for p in r.pieces:
            assert 0 <= p.start and p.start + p.len <= r.size and 0 <= p.shard < 4
            per[p.epoch] += p.len
        assert all(n <= r.size for n in per.values())
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * size[s], 40), (s, taken[s], t)
    again = mixing.mix(docs, n_shards=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(fixtures.empty(spark)).count() == 0


def test_shards_of_the_tree_draw_exact_quotas(spark):
    sizes = spark.createDataFrame([("a", 5000), ("b", 90_000), (None, 300), ("c", 0)], "source string, size bigint")
    targets = mixing.source_targets(sizes)
    bounds = {r.ix: r.bounds for r in mixing.shard_bounds(targets, 8, 3).collect()}
    quota = {r.ix: r.quota for r in targets.collect()}
    drawn = np.array([np.diff(bounds[i], prepend=0) for i in sorted(bounds)])
    assert (drawn >= 0).all() and {i: b[-1] for i, b in bounds.items()} == quota
    assert np.ptp(drawn.sum(0)) <= 3


def test_mixed_documents_hold_the_words_of_the_mix(spark):
    docs = fixtures.documents(spark, extra=True)
    total = sum(sum(p.len for p in r.pieces) for r in mixing.mix(docs).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = {i: t or "" for i, t, *_ in fixtures.rows()}
    rows = out.select("doc_id", "text", "n_chars").collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == total
    assert all(r.text in texts[r.doc_id] and r.n_chars == len(r.text) for r in rows)


def test_mixed_documents_come_by_shard_and_in_order_of_place(spark, tmp_path):
    docs = fixtures.documents(spark).where("doc_id < 24").dropDuplicates(["doc_id"])
    texts = {r.doc_id: WORD.findall(r.text) for r in docs.collect()}
    want = []
    for r in mixing.mix(docs).collect():
        runs = []
        for p in sorted(r.pieces, key=lambda p: (p.shard, p.epoch, p.start)):
            if runs and runs[-1][0] == p.shard and runs[-1][2] == p.epoch and runs[-1][3] + runs[-1][4] == p.start:
                runs[-1][4] += p.len
            else:
                runs.append([p.shard, p.place, p.epoch, p.start, p.len, r.doc_id])
        want += runs
    want = [(i, texts[i][a : a + n]) for _, _, _, a, n, i in sorted(want)]
    got = [(r.doc_id, WORD.findall(r.text)) for r in mixing.mixed_documents(docs).collect()]
    assert len({i for i, _ in got}) > 5 and got == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op3_source_mixing(spark, str(tmp_path)).collect()
    assert all(sum(r.taken_by_shard) == r.taken for r in rows)
    shards = np.array([r.taken_by_shard for r in rows]).sum(0)
    assert len(shards) == 16 and (shards > 0).all()


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "<|end|>", "\\<|", "<\\|turn|>", "<<|||>", "\\\\|", "a<|says|>b\\|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r.u == r.t and "<|" not in r.e for r in rows)


def conversations():
    out = []
    for c in range(6):
        for t in range(2 + 3 * c):
            role = "system" if t == 0 and c % 2 else "user" if t % 2 else "assistant"
            out.append((c, t, role, fixtures.prose(100 * c + t, 20 + 15 * (t % 5))))
    out += [(9, 0, "user", None), (9, 1, "assistant", "<|end|> \\| <|turn|>user<|says|>"), (9, 1, "assistant", "tie"), (10, None, None, "x<"), (10, 1, "assistant", "|y"), (None, 0, "assistant", "alone")]
    out += [(11, 0, "assistant", fixtures.prose(1, 3000)), (11, 1, "assistant", "after"), (12, 0, "user", "r"), (12, 0, "user", "r")]
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_chat_windows_read_back(spark, block):
    chats = spark.createDataFrame(conversations(), "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit("clash")).withColumn("tokens", F.lit(1))
    formatted = chat.windows(chats, budget=200, block=block)
    read = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, text in conversations():
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(read) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in read[c].turns] == [(r, x) for _, r, x in turns]
        assert read[c].loss == "".join(x for _, r, x in turns if r == "assistant")
    rows = formatted.collect()
    assert all(r.over_budget == (r.n_tokens > 200) for r in rows)
    # A window is over budget only for one long turn (or system turn and it).
    assert all(not r.over_budget or max(t.len for t in r.turns) > 200 for r in rows)
    systems = [r for r in rows if r.conv_id in (1, 3, 5)]
    assert all(r.turns[0].kind in ("system", "new") and "<|turn|>system" in r.text for r in systems)
    assert chat.read_back(chat.windows(chats.limit(0))).count() == 0


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches_estimate(spark):
    docs = fixtures.documents(spark, extra=True)
    got = fingerprints.fingerprints(docs).collect()
    texts = {i: t for i, t, *_ in fixtures.rows()}
    for r in got:
        exact = len(shingles(texts[r.doc_id]))
        assert abs(r.n_distinct - exact) <= (0 if exact < fingerprints.K else 0.25 * exact)
    one = docs.where("doc_id = 39").select(F.split("text", " ").alias("w"))
    cut = one.select(F.array_join(F.slice("w", 1, 6000), " ").alias("a"), F.array_join(F.slice("w", 3001, 6000), " ").alias("b"))
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    row = cut.select(fingerprints.resemblance(a, b).alias("j"), fingerprints.containment(a, b).alias("c"), (fingerprints.decoded(fingerprints.encoded(a)) == a).alias("same"), fingerprints.distinct_count(fingerprints.merge(a, b)).alias("n")).first()
    assert abs(row.j - 1 / 3) < 0.12 and abs(row.c - 0.5) < 0.15 and row.same and abs(row.n - 9000) < 1800
    parts = docs.where("doc_id < 24").select(F.col("source"), fingerprints.sketch(F.col("text")).alias("sketch"))
    merged = {r.source: r.sketch for r in fingerprints.merged(parts, "source").collect()}
    whole = docs.where("doc_id < 24").groupBy("source").agg(F.array_sort(F.collect_list(F.col("text"))).alias("t")).collect()
    for r in whole:
        hashes = spark.createDataFrame([(t,) for t in r.t], "text string").select(F.explode(fingerprints.shingle_hashes(F.col("text"))).alias("h")).distinct().orderBy("h").limit(fingerprints.K)
        assert merged[r.source] == [x.h for x in hashes.collect()]


def test_edited_texts_and_neighbours(spark, tmp_path):
    fixtures.documents(spark, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in fingerprints.op6_fingerprints(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
    # Every row counts: document 20 is there twice, and its first row is followed by the same text.
    line = sorted(((i, t or "") for i, t, *_ in fixtures.rows()), key=lambda x: -x[0])
    assert {i: len(x) for i, x in got.items()} == Counter(i for i, _ in line)
    for k, (i, own) in enumerate(line):
        other = line[(k + 1) % len(line)][1]
        m = len(own) // 3
        edited = own[: len(own) - m] + other[:m]
        (row,) = (r for r in got[i] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest())
        assert row.n_chars == len(own)
        for have, x, y in ((row.near_edited, own, edited), (row.near_next, own, other)):
            a, b = shingles(x), shingles(y)
            assert abs(have - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
    assert got[36][0].fingerprint == got[37][0].fingerprint
    (tmp_path / "none").mkdir()
    fixtures.empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprints.op6_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_word_units_of_letters_and_symbols_need_no_whole_encoding():
    """Their pieces are the model's alone, and have the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lattica.llm.tokens import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    made, whole = Encoder(path, "word"), Tokenizer.from_file(path)
    texts = ["it's 'start ##'s '''ll I'M x'd'd a1b2 innttion&&& 3rd", "épa### ÀÉ!! µª-º «a» a²'s don't", "<|ENDOFTEXT|>"]
    plain = [t for text in texts for t in text.split() if not set(t) & set("«»²")]

    class Counted:
        def __init__(self):
            self.n = 0

        def encode(self, *args, **options):
            self.n += 1
            return whole.encode(*args, **options)

    made.cache.tokenizer = counted = Counted()
    for t in plain:
        assert np.frombuffer(made.encode([t])[0], made.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert not counted.n
    for t in texts:
        assert np.frombuffer(made.encode([t])[0], made.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_full_stop_after_a_letter_that_is_none_when_normalised():
    import public_tokenizers
    from tokenizers import Tokenizer

    from lattica.llm.tokens import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    made, whole = Encoder(path, "word"), Tokenizer.from_file(path)
    for t in ("TARİHİ. İ,", "क़.", "שׁ,", "ŉ."):
        assert np.frombuffer(made.encode([t])[0], made.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_shard_expands_its_rules_once():
    """Not all symbols anew at each level of the rules."""
    from lattica.llm.token_output import Shard, pack_shard

    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50, 128_000)
    shard = Shard(pack_shard([1, 2], ids, np.array([64_000, 64_000]), 1000))
    seen, levels = [], shard._by_level
    shard._by_level = lambda symbols: seen.append(len(symbols)) or levels(symbols)
    assert len(shard.rules) < len(shard.symbols) and (shard.expand(shard.symbols) == ids).all()
    assert seen == [len(shard.rules)]
    assert (shard.document(1) == ids[64_000:]).all()


def test_search_selects_a_zero_once():
    """The zero behind a key's high bits is the next one of the word, mostly."""
    from lattica.llm import elias_fano

    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 30, 20_000).astype(np.uint64))
    made = elias_fano.EliasFano.build(keys, 1 << 30)
    asked = np.concatenate([keys, rng.integers(0, 1 << 30, 20_000).astype(np.uint64), np.arange(3, dtype=np.uint64)])
    looked, select = [], elias_fano._in_word
    elias_fano._in_word = lambda word, k: looked.append(len(word)) or select(word, k)
    try:
        found = made.find(asked)
    finally:
        elias_fano._in_word = select
    want = np.searchsorted(keys, asked)
    held = keys[np.minimum(want, len(keys) - 1)] == asked
    assert (found == np.where(held, want, -1)).all()
    assert sum(looked) < 1.5 * len(asked)


def test_buckets_are_searched_in_parts(monkeypatch):
    """A bucket's lower probabilities are looked up so many n-grams at a time, with equal results."""
    from lattica.llm import lm

    class Found:
        sizes = []

        def find(self, contexts, words, n):
            self.sizes.append(len(words))
            return None, -(contexts + words).astype(float) / 100, None

        shards, before = {}, [0]

    class Grams:
        levels, n_words = [Found(), Found()], 50

    word = np.arange(45, dtype=np.uint64)
    monkeypatch.setattr(lm, "FOUND", 10)
    Grams.levels[-1].n = 45
    _, below = lm._below(Grams(), np.arange(45, dtype=np.uint64), word, 0, 45)
    assert max(Found.sizes) <= 10 and np.allclose(below, 10.0 ** (-word.astype(float) / 100))
