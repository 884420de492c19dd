"""Property tests on the numpy kernels (no Spark needed)."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from driftrank.operators.knn import topk_rows
from driftrank.operators.mmr import mmr_select
from driftrank.operators.state import apply_summary, debounce_fold, segment_summary

times = st.lists(st.integers(min_value=0, max_value=5000), min_size=1, max_size=60).map(
    lambda xs: np.sort(np.asarray(xs, dtype=float)))


@given(times, st.sampled_from([1.0, 50.0, 300.0]))
@settings(max_examples=200, deadline=None)
def test_debounce_gaps_and_maximality(ts, window):
    acc = debounce_fold(ts, window)
    kept = ts[acc]
    assert acc[0]
    assert np.all(np.diff(kept) >= window)
    # every rejected event is within the window of the last accepted before it
    last = None
    for t, a in zip(ts, acc):
        if a:
            last = t
        else:
            assert t - last < window


# epoch seconds with runs of equal times at the edge of short windows
edges = st.lists(st.integers(min_value=0, max_value=14), min_size=1, max_size=40).map(
    lambda xs: 1_700_000_000 + np.sort(np.asarray(xs, dtype=float)) / 10)


@given(edges, st.sampled_from([0.1, 0.3, 0.7]))
@settings(max_examples=400, deadline=None)
def test_debounce_equals_the_plain_fold(ts, window):
    last, want = None, []
    for t in ts.tolist():
        ok = last is None or t - last >= window
        want.append(ok)
        last = t if ok else last
    assert debounce_fold(ts, window).tolist() == want


@given(times, st.integers(min_value=1, max_value=59))
@settings(max_examples=200, deadline=None)
def test_debounce_split_composes(ts, cut):
    cut = min(cut, len(ts) - 1)
    if cut == 0:
        return
    a, b = ts[:cut], ts[cut:]
    head, last = segment_summary(a, 300.0)
    anchor = apply_summary(head, last, 300.0, -np.inf)
    whole = ts[debounce_fold(ts, 300.0)].tolist()
    kept_a = a[debounce_fold(a, 300.0)].tolist()
    # a prefix's decisions do not depend on what follows ...
    assert whole[:len(kept_a)] == kept_a
    # ... and the summary's outgoing anchor continues the fold exactly
    assert b[debounce_fold(b, 300.0, anchor)].tolist() == whole[len(kept_a):]


@given(st.integers(min_value=1, max_value=12), st.integers(min_value=1, max_value=12),
       st.floats(min_value=0.0, max_value=1.0), st.integers(min_value=0, max_value=10 ** 6))
@settings(max_examples=100, deadline=None)
def test_mmr_is_a_permutation_prefix(n, k, lam, seed):
    rng = np.random.default_rng(seed)
    scores = rng.random((3, n))
    vecs = rng.normal(size=(3, n, 4))
    out = mmr_select(scores, vecs, lam, k)
    assert out.shape == (3, min(k, n))
    for row in out:
        assert len(set(row.tolist())) == len(row) and row.min() >= 0 and row.max() < n
    if lam == 1.0:
        assert out[:, 0].tolist() == np.argmax(scores, axis=1).tolist()


@given(st.integers(min_value=1, max_value=30), st.integers(min_value=1, max_value=10),
       st.integers(min_value=0, max_value=10 ** 6))
@settings(max_examples=100, deadline=None)
def test_topk_rows_matches_sort(ni, k, seed):
    rng = np.random.default_rng(seed)
    scores = np.round(rng.random((4, ni)), 1)  # many ties
    ids = rng.permutation(ni) + 100
    rows, cols, _ = topk_rows(scores, ids, k, lambda r, c: scores[r, c])
    for r in range(4):
        want = sorted(range(ni), key=lambda c: (-scores[r, c], ids[c]))[:k]
        assert cols[rows == r].tolist() == want
