import random

import pytest
from pyspark.sql import functions as F

from tessella.operators.chunking import MOST_CHARS, chunk_documents, split_text, word_windows
from tessella.schema import DOCUMENT


def test_worked_examples():
    assert split_text("a b c. d e f. g h", 3, 1) == ["a b c", "c. d e f", "f. g h"]
    assert split_text("a b c. d e f. g h", 3, 0) == ["a b c", "d e f", "g h"]
    with pytest.raises(ValueError):
        split_text("a", 3, 3)


def test_no_word_is_lost():
    rng = random.Random(4)
    for _ in range(200):
        sep = rng.choice(["\n\n", "\n", "\t", ". ", " "])
        text = sep.join(f"w{i}" for i in range(rng.randint(30, 400)))
        pieces = split_text(text, 20, rng.randint(0, 10))
        assert len(pieces) > 1 and set(" ".join(pieces).replace(".", " ").split()) == set(text.replace(".", " ").split())
        assert all(len(p) <= MOST_CHARS for p in pieces)


def test_without_separators():
    pieces = split_text("x" * 9000, 512, 64)
    assert "".join(pieces) == "x" * 9000 and max(map(len, pieces)) == MOST_CHARS


def test_documents(spark):
    long = "word " * 600
    docs = spark.createDataFrame([("d:1", "slack", long, "t", {}), ("d2", "bookmark", long, "t", {}), ("d3", "slack", "short", None, {}), ("d4", "slack", None, "t", {}), ("d5", "slack", "", "t", {}), ("d6", None, "x", "t", {})], DOCUMENT)
    got = chunk_documents(docs, 512, 64).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.id for r in sorted(by["d:1"], key=lambda r: r.chunk_idx)] == ["d:1:0", "d:1:1"]
    assert {k: len(v) for k, v in by.items()} == {"d:1": 2, "d2": 1, "d3": 1, "d4": 1, "d5": 1, "d6": 1}
    assert by["d2"][0].content == long and by["d4"][0].content is None
    assert by["d:1"][0].metadata["chunk_idx"].kind == "int"
    assert chunk_documents(docs.limit(0)).count() == 0


def test_windows(spark):
    df = spark.createDataFrame([("a b c d e",), ("",), (None,)], "x string").select(word_windows(F.col("x"), 3, 1).alias("w"))
    assert [r.w for r in df.collect()] == [["a b c", "c d e", "e"], None, None]
