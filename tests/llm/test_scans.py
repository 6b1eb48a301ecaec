"""Operators that read each text by itself: decontamination, personal data, classifiers, packing, chat format."""
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maplift.llm import chat_format, decontaminate, pii, toxicity
from maplift.llm import queries as Q
from maplift.llm.chat_format import escape, formatted, head, parse, prefix_target_examples, read_back, rendered, unescape
from maplift.llm.labelled import held_out
from maplift.llm.packing import best_fit_decreasing, cuts, encoding, packed, pieces, plan, reduce_by_dominance, sequences, token_ids
from maplift.llm.quality import fit_quality
from maplift.llm.registry import LLM_ORACLE
from maplift.llm.toxicity import fit_toxicity, scored, without_toxic
from tests.llm.data import LOWER, awkward, empty

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ decontamination
def hits_by_hand(text, items, window):
    find = re.compile("[0-9a-z\x80-\U0010ffff]+").findall
    w = find((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        v = find((t or "").translate(LOWER))
        n = min(window, len(v))
        grams = {tuple(v[k: k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if i is not None and tuple(w[k: k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), sorted(hit), sorted(found)


ITEMS = [(1, "The Question, of five-words HERE and more"), (2, "short one"), (3, None), (None, "never"), (12, ""), (2, "other text"),
         (13, "a a a a a a")]
TEXTS = ["So: the question of five words here and more!", "no match", "a short ONE is other-text", "never", "a a a a a a a",
         "é the question of five  words\nhere", "", "shortone short-one"]


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_decontamination_equals_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    rows, df = awkward(spark, TEXTS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.benchmark_hits(df, items, window=4).collect()
    expect = Counter()
    for i, t in rows:
        n, hit, found = hits_by_hand(t, ITEMS, 4)
        expect[i, n, tuple(hit), tuple(found)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(h.word for h in r.hits), tuple(r["items"])) for r in got) == expect
    text = dict(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < len(TEXTS):
            w = re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text[r.doc_id] or "")
            assert [text[r.doc_id][h.start: h.end] for h in r.hits] == [w[h.word] for h in r.hits]
    kept = decontaminate.without_contaminated(df, items, window=4)
    assert kept.dtypes == df.dtypes
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        (i, t) for i, t in rows if not hits_by_hand(t, ITEMS, 4)[2])


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows, df = awkward(spark, TEXTS)
    assert decontaminate.benchmark_hits(empty(spark), items).count() == 0
    none = decontaminate.benchmark_hits(df, items.where("false"))
    assert none.count() == none.where("size(hits) = 0").count() == len(rows)


# ------------------------------------------------------------------ personal data
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_hand(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B9", "@", ".", "-", "+", "1", "22", "255", "256", "10.0.0.7", " ", "(", ")", "é", "\n", "4111 1111",
                                 "4111111111111111", "+1 (555) 010-2345", "x@y.z", "0", "%", "_"]), max_size=25))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == base_by_hand(text)


def test_long_runs_take_linear_time():
    text = "1" * 200_000 + "." + "a" * 200_000 + "@" + "+" + "(" * 200_000
    assert pii.base_spans(text) == []


def test_crf_adds_other_spellings_and_leaves_plain_text_alone(spark):
    texts = ["ring (555) 010-8812 at night", "to zoe (at) example.net, soon", "gate 172[.]20[.]1[.]9 shut",
             "in 1999 there were 12-14 of them (see 3)", "key 9f8e7d6c5b4a on 2020-01-02 at 10:45", "ann@example.org 10.0.0.1",
             "première fois 20% à 12h30", "", None]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    said = {i: [(s.kind, texts[i][s.start: s.end]) for s in r.spans] for i, r in got.items()}
    assert said[0] == [("phone", "(555) 010-8812")]
    assert said[1] == [("email", "zoe (at) example.net")]
    assert said[2] == [("ip", "172[.]20[.]1[.]9")]
    assert said[5] == [("email", "ann@example.org"), ("ip", "10.0.0.1")]
    assert not any(said[i] for i in (3, 4, 6, 7, 8))
    for r in got.values():
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert pii.personal_data(empty(spark)).count() == 0


def test_viterbi_finds_the_best_sequence():
    rng, k = np.random.default_rng(1), len(pii.LABELS)
    model = pii.Crf({}, rng.normal(size=(k, k)), rng.normal(size=k))
    e, size = rng.normal(size=(6, 4, k)), np.array([1, 2, 3, 4, 4, 2])
    got = model.viterbi(e, size)
    import itertools
    for r in range(6):
        def value(seq):
            return model.first[seq[0]] + sum(e[r, i, s] for i, s in enumerate(seq)) + sum(model.step[a, b] for a, b in zip(seq, seq[1:]))
        best = max(itertools.product(range(k), repeat=int(size[r])), key=value)
        assert tuple(got[r, : size[r]].tolist()) == best


# ------------------------------------------------------------------ classifiers
@pytest.mark.parametrize("key,label,least", [("op3_toxicity", "toxic", 0.93), ("op9_quality", "quality", 0.97)])
def test_classifiers_on_held_out_labels(spark, key, label, least):
    got = Q.LLM_QUERIES[key](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in test]) >= least


def test_classifiers_take_awkward_rows(spark):
    rows, df = awkward(spark, ["good text here", "bad idiot text"] * 20)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 7), (6, 0)], "doc_id long, toxic int")
    model = fit_toxicity(df, labels)
    got = scored(df, model)
    assert got.count() == len(rows) and got.where("score < 0 or score > 1 or score is null").count() == 0
    kept = without_toxic(df, labels)
    assert kept.dtypes == df.dtypes
    assert {r.text for r in kept.where("doc_id < 40").collect()} == {"good text here"}
    assert without_toxic(empty(spark), labels).count() == 0
    nothing = labels.where("toxic = 0")
    assert scored(df, fit_toxicity(df, nothing)).where("score > 0.001").count() == 0
    assert scored(df, fit_quality(df, nothing, "toxic")).where("score < 0.999").count() == 0
    assert df.select(held_out().alias("h")).where("h is null").count() == 0


def test_gram_slots_do_not_depend_on_the_pieces(monkeypatch):
    texts = ["some words, and MORE of them " * 9, "", "x", "últimas palabras!"]
    whole = [set(s[d == i].tolist()) for d, s in [toxicity.gram_slots(texts)] for i in range(4)]
    monkeypatch.setattr(toxicity, "PIECE", 17)
    parts = [set(s[d == i].tolist()) for d, s in [toxicity.gram_slots(texts)] for i in range(4)]
    assert whole == parts == [set(toxicity.gram_slots([t])[1].tolist()) for t in texts]


# ------------------------------------------------------------------ packing
def least_bins(items, cap):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins)}.values():
            if bins[b] + items[i] <= cap:
                bins[b] += items[i]
                place(i + 1, bins)
                bins[b] -= items[i]
        place(i + 1, [*bins, items[i]])
    place(0, [])
    return best[0]


@settings(max_examples=250, deadline=None)
@given(st.integers(4, 22), st.lists(st.integers(1, 22), min_size=1, max_size=9))
def test_dominance_keeps_an_optimal_packing(cap, items):
    items = sorted((x for x in items if x <= cap), reverse=True)
    count = np.bincount(items, minlength=cap + 1) if items else np.zeros(cap + 1, np.int64)
    fixed, rest = reduce_by_dominance(count, cap)
    left = [x for x in range(cap, 0, -1) for _ in range(rest[x])]
    assert sum(n for _, n in fixed) + least_bins(left, cap) == least_bins(items, cap)


@settings(max_examples=80, deadline=None)
@given(st.integers(3, 40), st.lists(st.integers(0, 500), min_size=1, max_size=41), st.booleans())
def test_plans_use_every_piece_once(cap, counts, reduce):
    count = np.zeros(cap + 1, np.int64)
    count[1:][: len(counts)] = counts[:cap]
    patterns = plan(count, cap) if reduce else best_fit_decreasing(count, cap)
    used = np.zeros_like(count)
    for content, n in patterns:
        assert sum(length * c for length, c in content) <= cap
        for length, c in content:
            used[length] += c * n
    assert (used == count).all()


def test_plan_of_a_large_table_is_small():
    rng = np.random.default_rng(5)
    count = np.append(0, rng.integers(0, 10**9, 1024))
    patterns = plan(count)
    total = int((count * np.arange(1025)).sum())
    assert len(patterns) < 10_000
    assert sum(n for _, n in patterns) < 1.3 * (total // 1024 + 1)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\ta1é!'sdm<|endoftext|>", max_size=60))
def test_ids_equal_those_of_the_tokenizers_library(text):
    with open(BPE, "rb") as f:
        enc = encoding(zlib.compress(f.read()))
    assert enc.encode_to_numpy(text, disallowed_special=()).tolist() == reference_tokenizer().encode(text, add_special_tokens=False).ids


def reference_tokenizer(cache=[]):
    if not cache:
        cache.append(Tokenizer.from_file(BPE))
        cache[0].encode_special_tokens = True
    return cache[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "a", " ", "  ", "\n", "é", "1", "!"]), max_size=12).map("".join))
def test_added_tokens_in_a_text_have_the_ids_of_the_library(text):
    with open(BPE, "rb") as f:
        enc = encoding(zlib.compress(f.read()))
    assert token_ids(enc, text).tolist() == [*Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids, 2]


def test_pieces_of_a_text_with_an_added_token(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    assert [r.ids for r in pieces(df, BPE, with_ids=True).collect()] == [[64, 50256, 65, 2]]


def test_pieces_of_very_long_blank_runs(spark):
    texts = [" " * 2_000_000, "a" + "\n" * 2_000_000, " \n" * 1_000_000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in pieces(df, BPE, with_ids=True).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).extend(r.ids)
    library = Tokenizer.from_file(BPE)
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_packing_round_trip(spark):
    rows, df = awkward(spark, ["word " * n for n in (0, 1, 5, 9, 20, 40, 63, 64, 65, 130)] + [f"some text {i}" for i in range(60)])
    got = packed(df, BPE, capacity=64)
    pieces = got.collect()
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    total = sum(p.length for p in pieces)
    assert len(by_seq) <= -(-total // 64) + 3
    tok = reference_tokenizer()
    expect = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        at = cuts(len(ids), 64)
        assert at[-1] == len(ids) and all(b - a == 64 for a, b in zip(at[1:-1], at[2:]))
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            expect[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == expect
    full = {r.sequence_id: r.ids for r in sequences(df, got, BPE, 64).collect()}
    for s, seq in by_seq.items():
        for p in seq:
            assert zlib.crc32(np.array(full[s][p.offset: p.offset + p.length], "<u4").tobytes()) == p.ids_crc32
    assert packed(empty(spark), BPE).count() == 0


# ------------------------------------------------------------------ chat format
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[TURN ", "\\", "a", "]", "\n", "é", "<", "/s>", "[", "<<SYS>>"]), max_size=12))
def test_escaping_is_reversible_and_hides_control_strings(parts):
    text = "".join(parts)
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in ("<s>", "</s>", "[TURN ", "[INST]", "[/INST]"))
    said = [(text, text), ("assistant", "x" + text)]
    assert parse("<s>" + "".join(head(r) + escape(t) + "</s>" for r, t in said)) == said


def test_chat_examples_have_context_and_one_trainable_reply(spark, monkeypatch):
    turns = [(1, 0, "system", "be [INST]"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "yo \\ </s>"), (1, 3, "user", None),
             (1, 4, "assistant", ""), (1, 5, "assistant", "again"), (1, 6, "user", "bye"), (2, 0, "user", "alone"), (None, 1, None, "z"),
             (None, None, "assistant", "first"), (3, 1, "b", "t"), (3, 1, "a", "t"), (3, 1, "a", "t")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, example string")
    out = prefix_target_examples(df)
    full = {(r.conv_id, r.target_turn): r for r in rendered(out).collect()}
    assert set(full) == {(1, 2), (1, 4), (1, 5), (None, None)} - {(None, None)} or (None, None) not in full
    one = full[1, 5]
    assert parse(one.text) == [("system", "be [INST]"), ("user", "hi </s>"), ("assistant", "yo \\ </s>"), ("user", ""), ("assistant", ""),
                               ("assistant", "again")]
    assert [unescape(full[1, t].text[full[1, t].loss_start: full[1, t].loss_end]) for t in (2, 4, 5)] == ["yo \\ </s>", "", "again"]
    got = {r.conv_id: r for r in read_back(formatted(df)).collect()}
    for conv in (1, 2, None, 3):
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        r = got[conv]
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{m[2]}\n{m[3]}\n" for m in mine).encode()).hexdigest()
        loss = "".join(m[3] for m in mine if m[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert read_back(formatted(df.where("false"))).count() == 0


def sizes_by_sql(turns):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    return {r[0]: r[1:] for r in con.execute(
        f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({LLM_ORACLE['op5_chat_format']}) "
        "WHERE conv_id <> -7").fetchall()}


@pytest.mark.parametrize("run_chars", [1, 30, 100, 1 << 20])
def test_sizes_of_long_runs_equal_the_sql(spark, monkeypatch, run_chars):
    monkeypatch.setattr(chat_format, "RUN_CHARS", run_chars)
    turns = [(1, 0, "user", "u" * 50), (1, 1, "user", "v" * 40), (1, 2, "system", "w"), (1, 3, "assistant", "short"),
             (1, 4, "user", "x" * 60), (1, 5, "assistant", "y" * 70), (1, 6, "user", "z" * 30), (1, 7, "user", "end"),
             (2, 0, "user", "alone" * 20), (3, 0, "assistant", "reply"), (4, 0, "user", "a"), (4, 1, "user", "</s>" * 9),
             (5, 0, "user", "q" * 2_000_000), (5, 1, "assistant", "ok")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = prefix_target_examples(df)
    assert {r[0]: tuple(r[1:]) for r in read_back(out).collect()} == sizes_by_sql(turns)
    full = {(r.conv_id, r.target_turn): r.text for r in rendered(out).collect()}
    assert set(full) == {(1, 3), (1, 5), (3, 0), (5, 1)}
    assert all(parse(x) == [(r, t) for c, k, r, t in turns if c == conv and k <= turn] for (conv, turn), x in full.items())


@pytest.mark.parametrize("run_chars", [1, 60, 1 << 18])
def test_written_examples_hold_their_whole_context(spark, monkeypatch, run_chars):
    monkeypatch.setattr(chat_format, "RUN_CHARS", run_chars)
    monkeypatch.setattr(chat_format, "EXAMPLES", 2)
    turns = [(c, t, ("assistant" if t % 2 else "user"), f"{c}:{t} </s>") for c in (1, 2, None) for t in range(9)]
    df = spark.createDataFrame([*turns, (3, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    rows = formatted(df).collect()
    for conv in (1, 2, None):
        said = [(r, x) for c, _, r, x in turns if c == conv]
        for i in range(5):
            parts = sorted((r for r in rows if (r.conv_id, r.example) == (conv, i)), key=lambda r: r.part)
            assert [r.part for r in parts] == list(range(len(parts))) and (len(parts) > 1) == (run_chars < 1 << 18 and i > 0 or run_chars == 1)
            assert [r.context_chars for r in parts] == [sum(len(p.text) for p in parts[:k]) for k in range(len(parts))]
            assert parse("".join(r.text for r in parts)) == said[: 2 * i + 2]
            assert [r.loss_start is None for r in parts] == [True] * (len(parts) - 1) + [i == 4] and {r.last for r in parts} == {i == 4}
            if i < 4:
                assert unescape(parts[-1].text[parts[-1].loss_start: parts[-1].loss_end]) == said[2 * i + 1][1]
    assert {r.conv_id: r.formatted_chars for r in read_back(formatted(df)).collect()} == {
        c: sum(len(r.text) for r in rows if r.conv_id == c) for c in (1, 2, 3, None)}


def test_pyarrow_is_used_with_offsets():
    col = pa.array(["zz", "ab (at) cd.ef x", "1.2.3.4"]).slice(1, 2)
    assert [f[0] for f in pii.find_in(col, pii.Tagger(pii.trained_crf()))] == [[], [("ip", 0, 7)]]
