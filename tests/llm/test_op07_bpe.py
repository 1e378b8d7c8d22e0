import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import op07_bpe as B

P = B.BpeParams()
pytestmark = pytest.mark.skipif(not os.path.exists(P.vocabulary), reason="no vocabulary")
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.vocabulary, "rb"))}
    np.seterr(over="ignore")
    return B.Bpe(ranks, P), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "  a", "a" * 3000, "aaa" * 7, "don't we'll I'd", "日本語 テスト 🙂🙂", "<|endoftext|>", "x\n\n \t y  ", "1234 56", "hello world " * 500, "ÉÉÉ é", "'S 's", " a\x00b"]


def test_equals_the_public_library(both):
    bpe, public = both
    ids, off = bpe.encode(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [public.encode_ordinary(t) for t in TEXTS]
    assert bpe.decode(ids, off) == TEXTS


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_random_texts(both, texts):
    bpe, public = both
    ids, off = bpe.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [public.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids, off) == texts


def one(w, ranks):
    """Merging one pair at a time: the leftmost of the least rank."""
    x = [bytes([c]) for c in w.encode()]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(x, x[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[t] for t in x]
        i = best[1]
        x[i : i + 2] = [x[i] + x[i + 1]]


@pytest.mark.parametrize("tokens", [(b"ab", b"aa", b"aab", b"bc", b"aaaa", b"abc"), (b"abab", b"abc", b"cab", b"aba", b"ab", b"ca", b"aaa", b"aa"), (b"aaaa", b"bab", b"aa", b"ab", b"ba")])
def test_rank_after_rank(tokens):
    """With vocabularies of the letters a, b, c; in the last two, merges make pairs of lower ranks."""
    ranks = {bytes([i]): i for i in range(256)}
    for t in tokens:
        ranks[t] = len(ranks)
    bpe = B.Bpe(ranks, P)
    r = np.random.default_rng(0)
    words = ["".join(r.choice(list("abc"), n)) for n in r.integers(1, 14, 300)] + ["a" * n for n in range(1, 20)] + ["ab" * 9, "aab" * 9]
    want = [one(w, ranks) for w in words]
    with np.errstate(over="ignore"):
        ids, off = bpe.encode_words(words)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
        assert [bpe._one(w.encode()).tolist() for w in words] == [bpe.encode_words([w])[0].tolist() for w in words] == want


def test_what_is_known_changes_nothing(both):
    known = B.Known()
    for most in (1 << 20, 3):
        bpe = B.Bpe({t: i for i, t in enumerate(both[0].tokens) if t}, B.BpeParams(most_words=most))
        for k in (1, 2, 1):
            ids, off = bpe.encode(TEXTS[k:], known)
            assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [both[1].encode_ordinary(t) for t in TEXTS[k:]]


def test_table(spark, docs, both):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3]), (99, "long text " * 40_000)]
    x = docs(rows).withColumnRenamed("source", "token_ids").withColumnRenamed("n_chars", "N_Tokens")
    y = B.encode(x, B.BpeParams(portion_bytes=5000))
    assert y.columns == [*x.columns, "_token_ids", "_n_tokens"]
    got = B.decode(y, "_token_ids", "back").collect()
    want = {t: both[1].encode_ordinary(t) for t in dict(rows).values() if t is not None}
    assert len(got) == len(rows)
    for r in got:
        assert r.text == r.back and r._token_ids == want.get(r.text) and r._n_tokens == (None if r.text is None else len(want[r.text]))
    assert B.encode(docs([])).count() == 0


def test_bad_ids(both):
    with pytest.raises(ValueError):
        both[0].decode(np.array([60_000]), np.array([0, 1]))
    assert both[0].decode(np.array([int(both[0].of_byte[0xFF])]), np.array([0, 1])) == ["�"]
