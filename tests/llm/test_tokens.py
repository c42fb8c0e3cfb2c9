import random
from itertools import product

import pytest
import tiktoken

from tessella.llm import tokens as T

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(T.TOKENIZERS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.load().ranks, special_tokens={})


@pytest.mark.parametrize("alphabet", ["abc", "aab1", "ab ", "é中a", "a\n \t1b!", "it's ", "12", "'sab", "!?-", "  \n", "ththe", " a", "!a'l", "①½Ⅷ1a", "\x1c\x1f a1", "👩‍💻 a_ _"])
def test_stream_equals_library(alphabet, library):
    v, rng = T.load(), random.Random(alphabet)
    for _ in range(25):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 1500)))
        expected = library.encode_ordinary(s)
        assert T.encode(s, v) == expected
        for block in (16, 64, 300):
            assert T.encode(s, v, block) == expected


def test_tokens_leave_early(library):
    v = T.load()
    run = T.RunEncoder(v, 1000)
    text = b"abcde" * 4000
    ids = run.feed(text)
    assert len(run.data) <= 1000 + v.lookahead, "memory is bounded"
    assert len(ids) > 1000 and ids + run.finish() == library._core_bpe.encode_single_piece(text)


def test_every_token_is_its_own_encoding():
    v = T.load()
    assert all(len(v.halves(t)) == 2 for t in v.ranks if len(t) > 1)


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_is_sufficient(seed):
    """Small merge lists: what stands before the lookahead is the same whatever follows, for every text over the alphabet."""
    rng = random.Random(seed)
    known = [b"a", b"b"]
    while len(known) < 7:
        t = rng.choice(known) + rng.choice(known)
        if t not in known and len(t) < 5:
            known.append(t)
    v = T.Vocabulary({t: i for i, t in enumerate(known)})
    ends = {}
    for n in range(1, 12):
        for w in map(bytes, product(b"ab", repeat=n)):
            at, out = 0, []
            for t in v._merged(w, len(known) + 1):
                at += len(t)
                out.append(at)
            ends[w] = out
    for w, e in ends.items():
        for more in range(1, 12 - len(w)):
            for x in map(bytes, product(b"ab", repeat=more)):
                keep = len(w) - v.lookahead
                assert [k for k in e if k <= keep] == [k for k in ends[w + x] if k <= keep]


def test_lookahead_is_needed():
    v = T.Vocabulary({t: i for i, t in enumerate([b"a", b"b", b"c", b"bc", b"ab"])})
    assert v._merged(b"ab", 9) == [b"ab"] and v._merged(b"abc", 9) == [b"a", b"bc"] and 1 < v.lookahead <= 4


@pytest.mark.parametrize("n", [399, 400, 5000])
def test_long_pieces_merge_alike(n, library):
    rng, v = random.Random(n), T.load()
    for alphabet in (b"a", b"ab", b"the ", b"0123456789", bytes(range(256))):
        piece = bytes(rng.choice(alphabet) for _ in range(n))
        assert v.merge(piece) == library._core_bpe.encode_single_piece(piece)


def test_decoding_is_exact():
    v = T.load()
    for s in ("", "héllo 中文 👩‍💻", "x̲ÿ ①② ½ Ⅷ", "<|endoftext|> is text", " \n\t"):
        assert "".join(T.decode_stream(T.encode(s, v), v)) == s


def test_corpus(spark, library):
    df = spark.createDataFrame([(1, "a b", 7), (2, "", 7), (3, None, 7), (4, "  ", 7), (1, "a b", 7), (5, "<|endoftext|>", 7), (6, "x" * 200_000, 7)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in T.encode_corpus(df).collect()}
    assert got[2] == got[3] == []
    assert got[1] == library.encode_ordinary("a b") and got[4] == library.encode_ordinary("  ")
    assert got[5] == library.encode_ordinary("<|endoftext|>") and 50256 not in got[5]
    assert got[6] == library.encode_ordinary("x" * 200_000)
    assert T.encode_corpus(df.limit(0)).count() == 0
    text = {r.doc_id: r.text for r in T.decode_corpus(T.encode_corpus(df)).collect()}
    assert text == {1: "a b", 2: "", 3: "", 4: "  ", 5: "<|endoftext|>", 6: "x" * 200_000}
