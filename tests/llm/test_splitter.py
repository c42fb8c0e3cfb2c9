import random
import re

import pytest

from tessella.llm import splitter as S

SCHEMA = "tbl string, rec_id string, source string, content string, piece string"


def test_pieces_keep_every_promise():
    rng = random.Random(2)
    for _ in range(600):
        unit = rng.choice(["ab ", "a b\n", "word. ", "x", "ab\n\nc d. e", "日本。", "# h\ntext\n\n", "\t\r\n"])
        text = "".join(rng.choice(unit) if rng.random() < 0.5 else unit for _ in range(rng.randint(0, 300)))
        limit, overlap = rng.randint(1, 40), rng.randint(0, 12)
        cut = S.pieces(text, limit, overlap)
        assert cut[0][0] == 0 and cut[-1][1] == len(text)
        for (a, b), (c, d) in zip(cut, cut[1:]):
            assert a <= c <= b < d
        assert all(S.size(text[a:b]) <= limit for a, b in cut)
        assert len(cut) == 1 or S.size(text) > limit


@pytest.mark.parametrize("overlap", [0, 13, 64, 300, 511, 512, 9999])
def test_paragraphs_that_fit_stay_whole(overlap):
    """The overlap gives way to a paragraph that fits the limit, below and above half of the limit alike."""
    text = "\n\n".join(" ".join(f"{p}w{j:03}" for j in range(331)) for p in "abc")  # 331 words, 496 tokens
    cut = S.pieces(text, 512, overlap)
    assert [b for _, b in cut[:-1]] == [m.end() for m in re.finditer("\n\n", text)]
    if overlap >= 13:
        assert all(9 <= S.size(text[c:b]) <= 16 for (_, b), (c, _) in zip(cut, cut[1:])), "as much overlap as fits"


@pytest.mark.parametrize("limit, overlap", [(100, 10), (100, 49), (100, 51), (100, 80), (100, 99), (512, 64)])
def test_overlap_is_as_asked(limit, overlap):
    """Words of ordinary length: above half of the limit as below it."""
    rng = random.Random(limit + overlap)
    text = " ".join("x" * rng.randint(1, 12) for _ in range(3000))
    cut = S.pieces(text, limit, overlap)
    assert all(max(0, overlap - 7) <= S.size(text[c:b]) <= overlap for (_, b), (c, _) in zip(cut, cut[1:-1]))
    run = "y" * 50_000
    cut = S.pieces(run, limit, overlap)
    assert all(S.size(run[c:b]) == overlap for (_, b), (c, _) in zip(cut, cut[1:]))


def test_natural_boundaries_and_overlap():
    text = "\n\n".join(" ".join(f"p{i}w{j}" for j in range(20)) + "." for i in range(10))
    cut = S.pieces(text, 110, 10)
    assert all(text[b - 1] == "\n" for _, b in cut[:-1]), "cut between paragraphs"
    assert all(9 <= S.size(text[c:b]) <= 10 for (_, b), (c, _) in zip(cut, cut[1:])), "ten tokens of overlap"


def test_table(spark):
    long = "word " * 2000
    data = [("records", "1", "a", long, "x"), ("records", "1", "a", long, "x"), ("records", "2", "none", long, "x"), ("chunks", "3", "a", None, "x"), ("chunks", "4", "a", "", "x"), ("chunks", "5", "a", "short", "x"), ("chunks", "6", None, long, "x"), ("records", "7", "a", "y" * 100_000, "x"), ("records", "8", "unknown", long, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    limits = spark.createDataFrame([("a", 512, 64), ("none", None, 0), ("a", 600, None)], "source string, max_chunk_tokens bigint, chunk_overlap_tokens bigint")
    out = S.split_oversized(df, limits)
    got = out.collect()
    assert {(r.tbl, r.rec_id) for r in got} == {("records", "1"), ("records", "7")}
    assert len(got) == len({(r.tbl, r.rec_id, r.piece_no) for r in got})
    for r in got:
        assert S.size(r.piece) <= 512 and r.piece == (long if r.rec_id == "1" else "y" * 100_000)[r.start_pos:r.end_pos]
    assert S.split_oversized(df.limit(0), limits).count() == 0 and S.split_oversized(df, limits.limit(0)).count() == 0
