"""The registered queries, and the pipeline, against brute-force versions on small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lattica.llm import language, mixing, queries
from tests.compare import SF, differences
from tests.llm import fixtures
from tests.llm.test_free import WORD, brute_passages, classes, lower_words
from tests.llm.test_native import brute_targets, conversations

#: Rows given twice, and rows that nothing else covers.
MORE = [(5, fixtures.rows()[5][1], "en", "s2", None), (50, "uma " * 30, "en", "s1", 1), (51, "7 8 9", "en", None, 5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = fixtures.documents(spark, extra=True)
    rows = spark.createDataFrame(MORE, fixtures.SCHEMA).select("*", *(F.lit("x" if t == "string" else 1).alias(c) for c, t in (x.split() for x in fixtures.EXTRA.split(", "))))
    docs.union(rows).write.parquet(f"{at}/documents.parquet")
    chats = spark.createDataFrame(conversations(), "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit("clash"))
    chats.write.parquet(f"{at}/conversations.parquet")
    return str(at)


ROWS = fixtures.rows() + MORE


def of(name, spark, folder):
    return queries.QUERIES[name](spark, folder).collect()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    mine, theirs = differences(spark, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert not mine and not theirs


def test_op1_with_repeated_rows(spark, folder):
    want = classes([(i, t) for i, t, *_ in ROWS])
    got = of("op1_ngram_jaccard_join", spark, folder)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, *want[i]) for i, *_ in ROWS)


def test_op2_digests(spark, folder):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    by = defaultdict(list)
    for c, t, role, text in conversations():
        by[c].append((-1 if t is None else t, role or "", text or ""))
    odd = r"\### Assistant: </turn> ok"
    by[-7] = [(0, "user", odd), (1, "assistant", odd)]
    got = {r.conv_id: r for r in of("op2_chat_formatting", spark, folder)}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{x}\n" for _, a, x in turns)), len(loss), sha(loss))
        assert r.formatted_chars >= sum(len(x) for *_, x in turns)


def test_op3_takes_what_the_tree_draws(spark, folder, monkeypatch):
    size = Counter()
    for _, t, _, s, _ in ROWS:
        size[s] += len(WORD.findall((t or "").encode()))
    source = defaultdict(list)
    for i, _, _, s, _ in ROWS:
        source[i].append(s)
    target = brute_targets(size)
    got = of("op3_source_mixing", spark, folder)
    assert len(got) == len(ROWS)
    taken = Counter()
    for r in got:
        s = next(s for s in source[r.doc_id] if (size[s], target[s]) == (r.source_size, pytest.approx(r.target)))
        assert r.taken <= 3 * r.size and sum(r.taken_by_shard) == r.taken
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(32, 0.02 * target[s]) for s in target)
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, of("op3_source_mixing", spark, folder)))
    drawn = mixing.shard_bounds
    monkeypatch.setattr(mixing, "shard_bounds", lambda *a: drawn(*a).select("ix", F.transform("bounds", lambda b: F.floor(b / 2)).alias("bounds")))
    half = of("op3_source_mixing", spark, folder)
    assert sum(r.taken for r in half) < 0.6 * sum(r.taken for r in got)


def test_op5_base_scores(spark, folder):
    tokens = [(i, [*lower_words(t), None]) for i, t, *_ in ROWS]
    c = Counter(x for i, ts in tokens if crc(i, 7) != 2 for x in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((i, crc(i, 7) == 2, len(ts), sum(c[x] > 0 for x in ts), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts), 6)) for i, ts in tokens)
    got = of("op5_lm_scoring", spark, folder)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got) and sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def test_op6_gives_repeated_rows_each(spark, folder):
    got = of("op6_fingerprints", spark, folder)
    assert len(got) == len(ROWS)
    order = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda x: -x[0])
    # equal ids: either order of different texts
    for swap in (False, True):
        line = order if not swap else [x for i in dict.fromkeys(i for i, _ in order) for x in reversed([y for y in order if y[0] == i])]
        edited = []
        for k, (i, own) in enumerate(line):
            m = len(own) // 3
            edited.append((i, len(own), hashlib.sha256((own[: len(own) - m] + line[(k + 1) % len(line)][1][:m]).encode()).hexdigest()))
        if sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edited):
            break
    else:
        pytest.fail("edited texts differ")
    twice = sorted(r.near_next for r in got if r.doc_id == 5)
    assert len(twice) == 2 and twice[1] == 1.0


def test_op7_covers_exact_passages(spark, folder):
    rows = [(i, t) for i, t, *_ in ROWS if t is not None]
    found = defaultdict(set)
    for r in of("op7_substring_dedup", spark, folder):
        found[r.doc_id].update(range(r.start, r.start + r.n_words))
    want = brute_passages(list(dict(rows).items()))
    assert any(want.values()) and all(x <= found[i] for i, x in want.items())
    assert not any(found[i] for i in want if i < 24)


def brute_language(model, text):
    """Viterbi by loops over the words' scores."""
    words = (text or "").split()
    scores, has = model.scores(words)
    path, value = [], [0.0] * len(model.langs)
    for s in scores.astype(np.float64):
        best = int(np.argmax(value))
        came = [k if value[k] >= value[best] - language.SWITCH else best for k in range(len(value))]
        value = [max(value[k], value[best] - language.SWITCH) + s[k] for k in range(len(value))]
        path.append(came)
    at, label = int(np.argmax(value)), []
    for came in reversed(path):
        label.append(at)
        at = came[at]
    label = [x for x, h in zip(label[::-1], has) if h]
    return model.langs[Counter(label).most_common(1)[0][0]] if label else "und"


def test_op9_equals_loops_and_learns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(language.training(docs))
    texts = defaultdict(list)
    for i, t, *_ in ROWS:
        texts[i].append(brute_language(model, t))
    got = of("op9_language_id", spark, folder)
    assert len(got) == len(ROWS)
    for r in got:
        assert r.lang_pred in texts[r.doc_id] and r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1
    real = queries.QUERIES["op9_language_id"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert len(real) > 100 and sum(r.lang == r.lang_pred for r in real) >= 0.98 * len(real)


def test_language_filter_keeps_texts_of_many_languages(spark):
    model = language.Model(list("abcd"), {f"={x}": i for i, x in enumerate("pqrs")}, np.vstack([np.eye(4), np.zeros(4)]).astype(np.float32) * 30, {"latin": np.ones(4, bool)})
    mixed = " ".join(x for x in "pqrs" for _ in range(40))
    docs = spark.createDataFrame([(1, mixed), (2, "p p p"), (3, None), (4, "12 ,"), (5, "zz yy")], "doc_id bigint, text string").withColumn("spans", F.lit(1)).withColumn("doc_id_2", F.col("doc_id"))
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_bear_null_ids(spark, name, tmp_path):
    fixtures.with_null_id(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(conversations(), "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = of(name, spark, str(tmp_path))
    if name.startswith("op7"):
        assert all(r.doc_id is not None for r in got)
    elif name.startswith(("op2_", "op11_")):
        assert sum(r.conv_id is None for r in got) == 1
    else:
        assert sum(r.doc_id is None for r in got) >= 1


def test_pipeline_stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.materialize(stage(spark, docs, folder), "test-stage")
        assert out.columns == docs.columns
        rows[name], docs = [(r.doc_id, r.text) for r in out.collect()], out
    model = language.fit(language.training(spark.read.parquet(f"{folder}/documents.parquet")))
    spoken = [(i, t) for i, t, *_ in ROWS if brute_language(model, t) != "und"]
    key = lambda x: (x[0], x[1])
    first = rows["language ID"]
    assert set(first) <= set(spoken) and {i for i, t in spoken if len(t.split()) > 20} == {i for i, t in first if len(t.split()) > 20}
    one = classes(first)
    assert sorted(rows["n-gram Jaccard join"], key=key) == sorted({(i, t) for i, t in first if one[i][1] == i}, key=key)
    before, cut = dict(rows["n-gram Jaccard join"]), dict(rows["substring dedup"])
    for i, held in brute_passages(list(before.items())).items():
        left = [w for j, w in enumerate(lower_words(before[i])) if j not in held]
        assert len(lower_words(cut.get(i, ""))) <= len(left) and (held or cut[i] == before[i])
    taken = Counter(w for _, t in rows["mixing sources to target weights"] for w in t.split())
    have = Counter(w for t in cut.values() for w in t.split())
    assert set(taken) <= set(have) and all(n <= 3 * have[w] for w, n in taken.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows["mixing sources to target weights"])
    packed = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == want
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.doc_tokens, r.start == 0) for r in whole if r.start == 0) == Counter((*k, True) for k in want.elements())
    assert sum(r.length for r in whole) == sum(n for _, n in want.elements())
