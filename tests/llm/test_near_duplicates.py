import hashlib
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from maplift.llm import line_dedup, linking
from maplift.llm.common import SLICE_BYTES, slot_filter, staged
from maplift.llm.line_dedup import without_similar_lines
from maplift.llm.ngram_join import ngram_jaccard_join, without_near_duplicates
from maplift.llm.sketch import any_near, pairs_near, sketch
from maplift.llm.spotsigs import edited_likeness, fingerprints, from_text, likeness, similar_documents
from maplift.llm.substring_dedup import without_repeated_passages
from tests.llm.data import SCHEMA, awkward, empty, make_texts, words
from maplift.llm.toxicity import PIECE, gram_slots


def groups(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, n):
    w = words(text)
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def linked(sets, num, den):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 50)])
def test_ngram_join_equals_all_pairs(spark, n, num):
    rows, df = awkward(spark)
    got = ngram_jaccard_join(df, n, num, 100).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t, n))) for i, t in rows)
    plain = {i: shingles(t, n) for i, t in rows if i is not None and i < len(rows) - 4}
    last = rows[-7:]
    # ids with several rows: every text of the id counts for its links
    sets = {(i, k): shingles(t, n) for k, (i, t) in enumerate(rows) if i is not None}
    label = groups(sets, linked(sets, num, 100))
    low = defaultdict(lambda: 10**9)
    for (i, k), g in label.items():
        low[g] = min(low[g], i)
    expect = Counter((i, low[label[i, k]]) for (i, k) in sets)
    assert Counter((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == expect
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert plain and last


def test_ngram_join_of_a_large_group_of_copies(spark):
    texts = make_texts(seed=9, groups=1, per=150, size=40, vocab=60) + ["alone in the end"] * 40
    sets = {i: shingles(t, 3) for i, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in
           ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 80, 100).collect()}
    assert got == groups(sets, linked(sets, 80, 100))


def test_one_of_each_group_stays_with_all_columns(spark):
    rows, df = awkward(spark)
    got = without_near_duplicates(df, 5, 80, 100)
    assert got.dtypes == df.dtypes
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    sets = {(i, k): shingles(t, 5) for k, (i, t) in enumerate(rows) if i is not None}
    label = groups(sets, linked(sets, 80, 100))
    low = defaultdict(lambda: 10**9)
    for (i, k), g in label.items():
        low[g] = min(low[g], i)
    gone = {i for (i, k), g in label.items() if low[g] != i}
    assert {i for i, _ in kept if i is not None} == {i for i, _ in rows if i is not None} - gone
    assert kept[None, None] == 1 and max(kept.values()) == 1
    assert got.where("doc_id is not null").select("lang", "`a.b`").distinct().count() == 1


def lines_left(rows, num, den):
    pos = [(i, k, frozenset(words(x))) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n"))]
    first = {}
    for i, k, s in sorted(pos, key=lambda p: p[:2]):
        if s:
            first.setdefault(s, (i, k))
    order = sorted(first.items(), key=lambda x: x[1])
    matched = {s for s, p in order if any(q < p and den * len(s & o) >= num * len(s | o) for o, q in order)}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for k, x in enumerate(lines) if i is None or not words(x)
                or (frozenset(words(x)) not in matched and first[frozenset(words(x))] == (i, k))]
        out[i, len(lines), len(lines) - len(keep), None if t is None else "\n".join(keep)] += 1
    return out


@pytest.mark.parametrize("num", [80, 50])
def test_line_dedup_equals_all_pairs(spark, num):
    texts = make_texts(groups=8, per=5, size=30, vocab=60)
    rows, df = awkward(spark, texts + ["a\na\n\nb", "a b\nb  a", "w1 w2 w3 w4\nw1 w2 w3 w4 w5\nw5 w4 w3 w2 w1"])
    got = without_similar_lines(df, num, 100)
    assert got.columns == df.columns + ["n_lines", "n_removed"]
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()) == lines_left(rows, num, 100)


def crowded_lines():
    """Groups of 24 variants of a line; some documents hold a variant and a longer variant of it."""
    rng, texts = random.Random(11), []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(20)]
        for v in range(24):
            line = list(base)
            line[rng.randrange(20)] = f"g{g}v{v}"
            texts.append(" ".join(line))
        longer = base + [f"g{g}x{i}" for i in range(4)]
        texts += [" ".join(base) + "\n" + " ".join(longer), " ".join(longer + ["more"]) + "\n\n" + " ".join(base[1:])]
        texts.append(" ".join(f"t{i}" for i in range(9)) + f" unique{g} " + " ".join(f"t{i}" for i in range(9, 12)))
    return texts


@pytest.mark.parametrize("partners,reach", [(1, 2), (1, 4096), (8, 4096)])
def test_line_dedup_of_crowded_words_within_documents(spark, monkeypatch, partners, reach):
    monkeypatch.setattr(line_dedup, "PARTNERS", partners)
    monkeypatch.setattr(line_dedup, "PARTNER_REACH", reach)
    rows = list(enumerate(crowded_lines()))
    rows += [(len(rows), "p q r s t u v w x y"), (len(rows), "p q r s t u v w x y z")]  # one position, neither is later
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = without_similar_lines(df, 80, 100).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == lines_left(rows, 80, 100)


def test_line_dedup_of_words_on_many_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEY_ROWS", 16)
    monkeypatch.setattr(line_dedup, "PARTNERS", 1)
    held = []
    first = line_dedup._first_partners
    monkeypatch.setattr(line_dedup, "_first_partners", lambda posts, num, den: held.append(
        max(r["count"] for r in posts.groupBy("key").count().collect())) or first(posts, num, den))
    rng = random.Random(4)
    texts = [" ".join(["Ticket", *(f"u{i}x{j}" for j in range(rng.choice([1, 1, 2, 3]))), "was closed by the team of",
                       *rng.sample(["north", "south", "east", "west"], 2)]) for i in range(300)]
    rows = [(i, "\n".join(texts[3 * i: 3 * i + 3])) for i in range(100)] + list(enumerate(crowded_lines(), 100))
    got = without_similar_lines(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == lines_left(rows, 80, 100)
    assert max(held) <= 4 * 16


def test_words_above_16_bits_keep_their_order(spark):
    df = spark.createDataFrame([(i, "often " * 50_000 + "more " * (50_000 + 20_000 * (i > 0))) for i in range(4)], "doc_id long, text string")
    counts = line_dedup.word_counts(df)
    often, more = (int(counts[line_dedup.slot_of(line_dedup.words_of(
        *line_dedup.text_bytes(line_dedup.pa.array([w]))).hash)[0]]) for w in ("often", "more"))
    assert often < more < 65535


def test_count_codes_rise_with_the_counts():
    n = np.unique(np.concatenate([np.arange(70_000), np.geomspace(70_000, 2**62, 5_000).astype(np.int64)]))
    codes = line_dedup.count_codes(n).astype(np.int64)
    assert (np.diff(codes) >= 0).all() and codes[-1] < 65535
    assert (codes[: 1 << 15] == n[: 1 << 15]).all()
    far = n[1:] > n[:-1] * 1.002
    assert (np.diff(codes)[far] > 0).all()


def passages_left(rows, window):
    seen = defaultdict(lambda: 10**9)
    for i, t in rows:
        w = words(t, lower=False)
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k: k + window])
            seen[key] = min(seen[key], i)
    out = Counter()
    for i, t in rows:
        w = words(t, lower=False)
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and seen[tuple(w[k: k + window])] < i
                for j in range(window)}
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("window", [6, 20])
def test_substring_dedup_equals_all_windows(spark, window):
    loops = ["la " * 50, "x y " * 30 + "la " * 25, "x y " * 20]
    rows, df = awkward(spark, make_texts(groups=8) + loops)
    got = without_repeated_passages(df, window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == passages_left(rows, window)


def test_spotsigs_links_and_likeness(spark):
    texts = [t.replace("Word1 ", "the ").replace("Word2 ", "of ").replace("Word3 ", "is ")
             for t in make_texts(groups=8, vocab=30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    sets = {i: frozenset(from_text(f).tolist()) for i, f in prints.items()}
    assert {r.doc_id: r.group for r in similar_documents(df, 80, 100).collect()} == groups(sets, linked(sets, 80, 100))
    for a, b in [(i, j) for i in range(len(texts)) for j in range(i)]:
        assert texts[a] != texts[b] or prints[a] == prints[b]
    assert sum(bool(s) for s in sets.values()) > 40


def test_edited_likeness_follows_the_next_document(spark):
    texts = make_texts(groups=5)
    ids = [7 * i - 20 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t or None, "x") for i, t in zip(ids, texts)], "doc_id long, text string, h string")
    got = {r.doc_id: r for r in edited_likeness(df.repartition(5)).collect()}
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(zip(ids, texts)):
        after, r, n = texts[(k + 1) % len(texts)], got[i], len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == likeness(from_text(r.fingerprint), from_text(r.edited_fingerprint))
        assert r.near_next == likeness(from_text(r.fingerprint), from_text(got[ids[(k + 1) % len(ids)]].fingerprint))
    rows, odd = awkward(spark, ["only this text", "a", "b"])
    assert edited_likeness(odd).count() == len(rows)


def test_empty_tables(spark):
    none = empty(spark)
    assert ngram_jaccard_join(none).count() == 0
    assert without_near_duplicates(none).count() == 0
    assert without_similar_lines(none).count() == 0
    assert without_repeated_passages(none).count() == 0
    assert edited_likeness(none).count() == 0
    assert similar_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r.n_shingles, r.component_id) for r in ngram_jaccard_join(blank).collect()} == {(0, 1), (0, 2)}
    assert without_repeated_passages(blank).where("n_words = 0 and n_removed = 0 and text = ''").count() == 2
    assert SCHEMA


def test_first_positions_of_classes_with_any_id(spark):
    ends = [-(1 << 63), -(1 << 63) + 1, -1, 0, 1, (1 << 63) - 1]
    rows = [(d, n, bytes([i // 2]), i // 2) for i, d in enumerate(ends) for n in (0, 7, (1 << 31) - 1)]
    lines = spark.createDataFrame(rows + [(5, 1, b"alone", 9)], "doc_id long, line int, node binary, h long")
    got = {(bytes(r.node), r.h, r.d0, r.l0) for r in line_dedup.classes_of_several(lines).collect()}
    assert got == {(bytes([i]), i, ends[2 * i], 0) for i in range(3)}


def test_prefix_words_are_dealt_to_bounded_tasks_and_sorted_there(spark, monkeypatch):
    """Tasks grow with the words; Spark neither sorts all postings nor moves them for each copy of a line."""
    monkeypatch.setattr(line_dedup, "PARTNER_ROWS", 64)
    seen, first = [], line_dedup._first_partners
    monkeypatch.setattr(line_dedup, "_first_partners", lambda posts, num, den: seen.append(posts) or first(posts, num, den))
    texts = crowded_lines() * 3
    got = without_similar_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80, 100).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == lines_left(list(enumerate(texts)), 80, 100)
    posts, = seen
    assert posts.groupBy("key", "h").count().where("count > 1").isEmpty()
    assert posts.rdd.getNumPartitions() >= posts.count() // 64
    assert "Sort" not in first(posts, 80, 100)._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_repeated_ids_apply_to_their_own_lines_in_one_batch(spark):
    rows = [(1, "a b c\nd e f"), (1, "x y z"), (1, None), (2, "d e f\nx y z\n\na b c\nq r s"), (3, ""), (None, "a b c")]
    got = without_similar_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 80, 100).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == lines_left(rows, 80, 100)


def test_working_memory_of_texts_is_bounded():
    """A worker handles texts in slices whose temporaries stay small, however large its batch."""
    text = " ".join(f"Word{i % 997} is, here" + "\n" * (i % 9 == 0) for i in range(2_000))
    batch = line_dedup.pa.record_batch([line_dedup.pa.array([text] * 64)], names=["text"])
    assert batch.nbytes > 2 << 20
    peaks = []
    for limit, work in ((SLICE_BYTES, lambda b: line_dedup.line_sets(line_dedup.words_of(*line_dedup.text_bytes(b.column(0))))),
                        (PIECE, lambda b: gram_slots(b.column(0).to_pylist()))):
        tracemalloc.start()
        for b in line_dedup.slices(batch, limit=limit):
            work(b)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 20 << 20, peaks


@pytest.mark.parametrize("num", [95, 80, 50, 20])
def test_sketches_rule_out_no_similar_pair(num):
    rng = np.random.default_rng(num)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = []
    for n in (1, 2, 5, 63, 64, 65, 127, 129, 400, 513, 1025):
        for part in (1.0, 0.97, 0.9, 0.8, 0.6, 0.5, 0.25):
            own = rng.integers(0, 1 << 63, int(n * (1 - part) / 2)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[: max(1, int(n * part))], own])))
    s, size, groups_ = [sketch(u) for u in sets], np.array([len(u) for u in sets]), np.arange(len(sets))
    i, j = np.triu_indices(len(sets), 1)
    similar = np.array([100 * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)])
    near = pairs_near([s[a] for a in i], size[i], [s[b] for b in j], size[j], num, 100)
    assert similar.any() and near[similar].all()
    some = np.zeros(len(sets), bool)
    some[i[near]] = some[j[near]] = True
    left, right = any_near(s, size, groups_, s, size, groups_, num, 100)
    assert (left == some).all() and (right == some).all()
    assert not any(x.any() for x in any_near(s, size, 0 * groups_, s, size, 0 * groups_, num, 100))
    far = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (500, 510, 520, 1000, 1030)]
    assert num < 80 or not any_near([sketch(u) for u in far], np.array([len(u) for u in far]), np.arange(5),
                                    [sketch(u) for u in far], np.array([len(u) for u in far]), np.arange(5), num, 100)[0].any()


def test_texts_that_only_share_a_passage_are_not_moved(spark, monkeypatch):
    """Documents with a common phrase share signatures; their texts are neither dealt to tasks nor compared."""
    rng, moved, checked = random.Random(8), [], linking.checked
    monkeypatch.setattr(linking, "checked", lambda rows, *rest: moved.append(
        {bytes(r.node) for r in rows.select("node").collect()}) or checked(rows, *rest))
    phrases = [" ".join(f"p{k}x{i}" for i in range(7)) for k in range(3)]
    texts = []
    for i in range(400):
        own = [f"u{rng.randrange(10**6)}" for _ in range(90 + rng.randrange(20))]
        own[rng.randrange(80)] = phrases[i % 3]
        texts.append(" ".join(own))
    copies = {}
    for k in range(5):  # copies of five of them with two words changed
        own = texts[40 * k].split(" ")
        own[2], own[-3] = "other", "words"
        copies[len(texts)] = 40 * k
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(df, 5, 80, 100).collect()}
    sets = {i: shingles(t, 5) for i, t in enumerate(texts)}
    assert got == groups(sets, linked(sets, 80, 100)) and {i: got[i] for i in copies} == copies
    assert len(set().union(*moved)) <= 2 * len(copies)


def test_staged_tables_and_filters_leave_no_shuffle_files(spark):
    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if "shuffle_" in f}
    before, deadline = left(), time.time() + 20
    rows = spark.range(1000).selectExpr("id % 100 as key").groupBy("key").count()
    kept, bits = staged(rows, "freed"), slot_filter(rows, "key")
    while left() - before and time.time() < deadline:  # files go in the background
        time.sleep(0.2)
    assert not left() - before
    assert bits and kept.count() == 100
