import random

import numpy as np
import pytest

from tessella.llm import leaks as L


def brute(docs, items):
    grams = {}
    for i, p in items:
        w = L.words(p)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k:k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.words(t)
        for k in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[k:k + 12]), ())}
    return out


@pytest.mark.parametrize("shipped", [L.SHIPPED_WORDS, 0])
def test_equals_brute_force(spark, monkeypatch, shipped):
    monkeypatch.setattr(L, "SHIPPED_WORDS", shipped)
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "Beta", "é1", "x_y", "delta", "42", "omega"])
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(40)] + [(900, None), (901, ""), (902, "one two")]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        if d % 2:
            p = rng.choice(items[:40])[1].split()
            k = rng.randrange(len(p))
            at = rng.randint(0, len(w))
            w[at:at] = p[k:k + rng.randint(8, 20)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(700, None), (701, ""), (702, " "), docs[1], (703, "word " * 100_000)]
    d = spark.createDataFrame([(*x, 1, "b") for x in docs], "doc_id bigint, text string, item int, bucket string")
    i = spark.createDataFrame([(*x, "w") for x in items + items[:2]], "item_id bigint, passage string, window string")
    got = L.leaked_items(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) == len({r[:2] for r in got})
    text, passage = dict(docs), dict(items)
    assert all(r.n_windows == len(L.windows_of(L.words(text[r.doc_id])) & L.windows_of(L.words(passage[r.item_id]))) for r in got)
    assert L.leaked_items(d.limit(0), i).count() == 0
    assert L.leaked_items(d, i.limit(0)).count() == 0


def test_words():
    assert L.words("It's A_B x²") == ["it", "s", "a", "b", "x²"]
    assert L.words(None) == []


@pytest.mark.parametrize("shipped", [L.SHIPPED_WORDS, 0])
def test_words_are_compared_not_hashes(spark, monkeypatch, shipped):
    """With one hash for all words every window is a candidate, and none but the right ones comes out."""
    monkeypatch.setattr(L, "SHIPPED_WORDS", shipped)
    monkeypatch.setattr(L, "window_minima", lambda h, least, width: np.zeros(len(h) - least + 1, np.uint64))
    words = [f"w{i}" for i in range(30)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words))), (3, " ".join(words[5:17]))], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[:11] + ["x"] + words[12:]))], "item_id bigint, passage string")
    assert {tuple(r) for r in L.leaked_items(d, i).collect()} == {(1, 7, 19), (1, 8, 7), (3, 7, 1)}


def test_size_classes():
    assert [L.size_class(n) for n in (1, 2, 3, 4, 5, 1024, 1025)] == [0, 1, 2, 2, 3, 10, 11]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_ids(spark, kind):
    p = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, p)], "d bigint, text string").selectExpr(f"cast(d as {kind}) as doc_id", "text")
    i = spark.createDataFrame([(2, p)], "i bigint, passage string").selectExpr(f"cast(i as {kind}) as item_id", "passage")
    assert [tuple(map(str, r)) for r in L.leaked_items(d, i).collect()] == [("1", "2", "1")]
