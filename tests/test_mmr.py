"""MMR against an independent greedy loop over generated lists."""
import numpy as np
import pytest

from driftrank.operators.mmr import mmr_select


def greedy(scores, vectors, lam, k):
    """One list, one pick at a time, in plain Python."""
    lo, hi = min(scores), max(scores)
    rel = [(s - lo) / (hi - lo) if hi > lo else 1.0 for s in scores]

    def cos(a, b):
        na, nb = np.sqrt(a @ a), np.sqrt(b @ b)
        return float(a @ b / (na * nb)) if na and nb else 0.0
    picked, sim = [], [0.0] * len(scores)
    while len(picked) < min(k, len(scores)):
        best = max((i for i in range(len(scores)) if i not in picked), key=lambda i: (lam * rel[i] - (1 - lam) * sim[i], -i))
        picked.append(best)
        sim = [max(s, cos(v, vectors[best])) for s, v in zip(sim, vectors)]
    return picked


@pytest.mark.parametrize("lam", [0.0, 0.25, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("n, k", [(1, 1), (1, 4), (2, 5), (9, 4), (30, 10)])
def test_equals_greedy_loop(lam, n, k):
    rng = np.random.default_rng(n * 100 + k)
    for _ in range(5):
        scores = np.sort(rng.random((1, n)))[:, ::-1]
        vectors = rng.normal(size=(1, n, 3))
        assert mmr_select(scores, vectors, lam, k)[0].tolist() == greedy(scores[0].tolist(), vectors[0], lam, k)


def test_zero_vectors_and_equal_scores():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1, 7, 2))
    vectors[0, 2] = vectors[0, 5] = 0.0
    scores = np.full((1, 7), 0.37)
    for lam in (0.1, 0.9):
        assert mmr_select(scores, vectors, lam, 7)[0].tolist() == greedy([0.37] * 7, vectors[0], lam, 7)


def test_batch_equals_single():
    rng = np.random.default_rng(0)
    s = rng.random((6, 12))
    v = rng.normal(size=(6, 12, 8)).astype(np.float32)
    batch = mmr_select(s, v, .7, 5)
    for b in range(6):
        assert batch[b].tolist() == mmr_select(s[b:b + 1], v[b:b + 1], .7, 5)[0].tolist()


def test_more_lists_than_are_reranked_at_a_time(spark):
    from driftrank.operators.mmr import LISTS, mmr_rerank
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(30, 4)).astype(np.float32)
    n = 2 * LISTS + 3
    picks = [rng.choice(30, size=5 + u % 2, replace=False) for u in range(n)]
    rows = [(u, r + 1, int(i), 1.0 - 0.1 * r) for u, p in enumerate(picks) for r, i in enumerate(p)]
    cands = spark.createDataFrame(rows, "user_idx int, rank int, item_idx int, score double")
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_idx int, features array<float>")
    got = {}
    for r in mmr_rerank(cands.coalesce(1), index, 0.5, 3).collect():
        got.setdefault(r.user_idx, {})[r["rank"]] = r.item_idx
    for u, p in enumerate(picks):
        want = greedy([1.0 - 0.1 * r for r in range(len(p))], vectors[p].astype(np.float64), 0.5, 3)
        assert [got[u][r] for r in (1, 2, 3)] == [int(p[w]) for w in want]
