import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from maplift.llm.common import slices, text_bytes
from maplift.llm.ngram_join import signatures
from maplift.llm.substring_dedup import edges_of, sliding
from maplift.llm.wordhash import ngrams, shingle_sets, words_of
from tests.llm.data import words

TEXT = st.text(alphabet=st.sampled_from("aAbBé　 \t\n\x00.5"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = words_of(*text_bytes(pa.array(texts, pa.string())))
    seen = {}
    for i, t in enumerate(texts):
        expect = words(t)
        got = w.hash[w.first[i]: w.first[i + 1]].tolist()
        assert len(got) == len(expect)
        for a, b in zip(expect, got):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 9))
def test_ngrams_are_equal_when_their_words_are(ids, n):
    h = np.array(ids, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = ngrams(h, n)
    runs = [tuple(ids[i: i + n]) for i in range(len(ids) - n + 1)]
    assert len(got) == len(runs)
    assert len({*got.tolist()}) == len({*runs}) == len({*zip(runs, got.tolist())})


@given(st.lists(TEXT, min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_shingle_sets_have_the_sizes_of_sets(texts):
    sets = shingle_sets(words_of(*text_bytes(pa.array(texts, pa.string()))), 3)
    for t, s in zip(texts, sets):
        w = words(t)
        expect = {tuple(w[i: i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()}
        assert len(s) == len(expect)


def test_slices_cover_a_batch_in_order():
    batch = pa.record_batch([pa.array(range(50)), pa.array(["x" * (i * 7 % 40) for i in range(50)])], names=["i", "text"])
    parts = list(slices(batch.slice(3, 40), limit=60))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(3, 43))
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 60 for p in parts)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 160), st.integers(0, 30), st.integers(0, 30), st.sampled_from([(90, 100), (80, 100), (1, 2)]), st.integers(0, 10**6))
def test_similar_sets_share_a_signature(common, only_a, only_b, t, seed):
    num, den = t
    rng = np.random.default_rng(seed)
    u = rng.integers(0, 1 << 63, common + only_a + only_b, dtype=np.uint64)
    a, b = np.sort(u[: common + only_a]), np.sort(np.concatenate([u[:common], u[common + only_a:]]))
    if den * common >= num * (common + only_a + only_b):
        assert set(signatures(a, num, den).tolist()) & set(signatures(b, num, den).tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_minimum(values, n):
    x = np.array(values)
    if len(x) >= n:
        assert sliding(x, n, np.minimum).tolist() == [min(values[i: i + n]) for i in range(len(values) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=4), st.sampled_from([4, 6, 10]))
def test_every_window_holds_an_edge_and_equal_windows_the_same(texts, window):
    w = words_of(*text_bytes(pa.array([" ".join(t) for t in texts])), "space", False)
    doc, at, edge = edges_of(w, window)
    k, seen = window // 2 + 1, {}
    for d, t in enumerate(texts):
        mine = {int(p): int(e) for p, e, o in zip(at, edge, doc) if o == d}
        for i in range(len(t) - window + 1):
            inside = [(p - i, e) for p, e in mine.items() if i <= p <= i + window - k]
            assert inside
            low = min(e for _, e in inside)
            assert seen.setdefault(tuple(t[i: i + window]), low) == low
