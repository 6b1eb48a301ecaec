"""Cross-tokenizer alignment against a plain walk over every document's tokens."""
import hashlib
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maplift.llm import alignment, bytebpe
from maplift.llm.alignment import cross_tokenizer_alignment, opened_pairs, packed_pairs
from maplift.llm.bytebpe import ByteBpe
from tests.llm.data import awkward, empty, make_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world, it's <|endoftext|> here </s> <s>", "tabs\tand\n\nbreaks \n end ", "中文字符 और हिंदी 😀😀", "a▁b", "▁", " lead",
         "x" * 300, " " * 40, "\n" * 7 + "x", "don't can't WON'T 12345 67.89", "same words same words same words", "é" * 30, "0", " ", "a b"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def by_hand(libraries, texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), by single tokens and sets."""
    a, b = libraries
    letters = bytebpe.byte_letters()
    name = {i: t for t, i in a.get_vocab().items()}

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    links, groups_of, sizes = [], [], []
    for text in texts:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta, tb = [bytes(letters[c] for c in name[i]) for i in ia], [bytes_b(i) for i in ib]
        said = b" " + (text or "").encode()
        if not text or b"".join(ta) != said or b"".join(tb) != said:
            links.append(Counter()), groups_of.append([]), sizes.append((0, 0))
            continue

        def ends(tokens):
            return [sum(map(len, tokens[: k + 1])) for k in range(len(tokens))] if len(tokens) < 500 else list(
                __import__("itertools").accumulate(map(len, tokens)))
        ea, eb = ends(ta), ends(tb)
        shared = sorted(set(ea) & set(eb))
        groups, lo = [], 0
        for hi in shared:
            groups.append(([i for i, e in zip(ia, ea) if lo < e <= hi], [i for i, e in zip(ib, eb) if lo < e <= hi]))
            lo = hi
        links.append(Counter((x, y) for u, v in groups for x in u for y in v))
        groups_of.append(groups)
        sizes.append((len(ia), len(ib)))
    count = Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for c, groups, size in zip(links, groups_of, sizes):
        said = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out.append((*size, len(groups), sum(c.values()), sum(k for p, k in c.items() if count[p] == most[p[0]]),
                    sum(k * count[p] for p, k in c.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head, memo, pairs, small", [(1 << 20, 1 << 17, 1 << 21, 64), (40, 3, 50, 1), (0, 1, 1, 64)])
def test_alignment_equals_a_plain_walk(spark, libraries, monkeypatch, head, memo, pairs, small):
    for name, value in (("HEAD", head), ("MEMO", memo), ("PAIRS", pairs), ("SMALL_GROUP", small)):
        monkeypatch.setattr(alignment, name, value)
    rows, df = awkward(spark, TEXTS + [t for t in make_texts(groups=3, per=4) if len(t) < 3000])
    expect = Counter((i, *r) for (i, _), r in zip(rows, by_hand(libraries, [t for _, t in rows])))
    got = cross_tokenizer_alignment(df, A, B)
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect()) == expect


def test_documents_without_tokens(spark):
    got = cross_tokenizer_alignment(spark.createDataFrame([(1, None), (2, ""), (3, "a▁b"), (None, "ok")], "doc_id long, text string"), A, B)
    said = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert said[1] == said[2] == said[3] == (0, 0, 0, 0, 0, 0, "")
    assert said[None][:4] == (1, 1, 1, 1)
    assert cross_tokenizer_alignment(empty(spark), A, B).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from([" ", "\n", "\t", "a", "B1", "'s", "<|endoftext|>", "é", "中", " the", "\r\n", "\x1f", " "]),
                                       max_size=40).map("".join), st.booleans())
def test_ids_equal_the_library(text, special):
    fast = _encoders(special)
    assert fast.encode(text).tolist() == fast.library.encode(text, add_special_tokens=False).ids


_KNOWN = {}


def _encoders(special):
    if special not in _KNOWN:
        with open(A, "rb") as f:
            _KNOWN[special] = ByteBpe(f.read(), special)
    return _KNOWN[special]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000 + "x", "a" + " \n" * 1_000_000, " " * 1_200_000 + "x<|endoftext|>" + "\t" * 1_100_000])
def test_very_long_blank_runs(text):
    for special in (False, True):
        library = Tokenizer.from_file(A)
        library.encode_special_tokens = not special
        assert _encoders(special).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(0, 2**40), st.integers(1, 2**33), min_size=1))
def test_packed_pairs_round_trip(pairs):
    import numpy as np
    codes = np.array(sorted(pairs), np.int64)
    times = np.array([pairs[c] for c in codes.tolist()], np.int64)
    row, code, back = opened_pairs([0, len(codes)], [None, packed_pairs(codes, times)[0]], [None, packed_pairs(codes, times)[1]])
    assert row.tolist() == [1] * len(codes) and code.tolist() == codes.tolist() and back.tolist() == times.tolist()
