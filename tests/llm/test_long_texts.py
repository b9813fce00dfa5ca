"""Every operator, and the pipeline, with one text that is far longer than all others together."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from lattica.llm import queries
from tests.llm import fixtures
from tests.llm.test_structure import brute_fingerprint, brute_manifest

N = 250_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    stems = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(5000)]
    long = " ".join(rng.choices(stems, k=N))
    other = long[: len(long) // 2] + " and then it ends."
    rows = [r for r in fixtures.rows() if r[0] < 36] + [(100, long, "en", "s0", None), (101, other, "en", "s1", None)]
    at = tmp_path_factory.mktemp("long")
    spark.createDataFrame(rows, fixtures.SCHEMA).write.parquet(f"{at}/documents.parquet")
    chats = [(1, 0, "user", "Hi."), (1, 1, "assistant", long + "."), (2, 0, "assistant", long)] + [(3, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at), rows, chats


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_bear_very_long_texts(spark, folder, name):
    at, rows, chats = folder
    got = queries.QUERIES[name](spark, at).collect()
    ids = {r[0] for r in rows}
    n = int(name[2:].split("_")[0])
    if n in (2, 11):
        assert {r.conv_id for r in got} == {c for c, *_ in chats} | ({-7} if n == 2 else set())
        assert n == 2 or next(r for r in got if r.conv_id == 3).gaps > 0
    elif n == 7:
        assert sum(r.n_words for r in got if r.doc_id == 101) >= 0.99 * (N // 2)
    elif n == 10:
        assert sum(r.length for r in got if r.doc_id == 100) > N and {r.doc_id for r in got} == ids
    else:
        assert {r.doc_id for r in got} == ids and len(got) == len(rows)
    by = {r.doc_id: r for r in got if n not in (2, 11)}
    if n == 1:
        assert by[100].n_shingles == N - 4 and by[101].component_id == 101
    elif n == 12:
        assert sorted(map(tuple, got), key=str) == brute_manifest(rows)
    elif n == 13:
        assert by[100].fingerprint == f"{brute_fingerprint(rows[-2][1]):016x}"
    elif n == 8:
        starts = sorted((r.start, r.n_tokens) for r in got)
        assert all(a + b == c for (a, b), (c, _) in zip(starts, starts[1:]))
    elif n == 4:
        assert by[100].n_words == N


def test_pipeline_bears_very_long_texts(spark, folder):
    at, rows, _ = folder
    found = defaultdict(int)
    for r in corpus_pipeline.run(spark, at).collect():
        found[r.doc_id] += r.length
    assert found[100] > N / 4
