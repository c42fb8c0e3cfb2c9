import random
from itertools import combinations

import numpy as np
import pytest

from tessella.llm import neardup as N

SCHEMA = "tbl string, rec_id string, content string, cls string, variant int"


def brute(items, threshold=0.75, least=30):
    sets = {}
    for tbl, i, c in items:
        s = N.tokens(c)
        if len(s) >= least:
            sets[tbl, i] = s
    out = set()
    for (ta, a), (tb, b) in combinations(sorted(sets), 2):
        if ta == tb and len(sets[ta, a] & sets[tb, b]) / len(sets[ta, a] | sets[tb, b]) > threshold:
            out.add((ta, min(a, b), max(a, b)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.sample(vocabulary, rng.randint(30, 120)) for _ in range(n // 4)]
    out = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, len(w) // 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rng.shuffle(w)
        out.append((rng.choice(["records", "chunks"]), f"id{k}", " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    items = corpus(seed)
    items += [("records", f"copy{k}", items[0][2].upper() + "\n") for k in range(5)]  # a group of copies
    items += items[:3]  # repeated rows
    items += [("records", "null", None), ("records", "empty", ""), ("chunks", "blank", " \t\n"), ("records", "long", " ".join(f"x{i}" for i in range(20000)))]
    df = spark.createDataFrame([(*x, "clash", 1) for x in items], SCHEMA)
    assert {tuple(r) for r in N.similar_pairs(df).collect()} == brute(items)


@pytest.mark.parametrize("block", [5, 10_000])
def test_large_classes_and_variants_keep_every_pair(spark, monkeypatch, block):
    """One behaviour on both sides of a block's size: equal sets, and different near copies that share variants."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "LOOKED_AT", 1)
    words = [f"z{i}" for i in range(50)]
    items = [("records", f"c{k:03}", " ".join(words[k:] + words[:k])) for k in range(12)]  # one set, twelve texts
    items += [("records", f"n{k:03}", " ".join(words) + f" more{k}") for k in range(40)]
    items += [("chunks", f"c{k:03}", " ".join(words)) for k in range(3)] + [("records", "far", " ".join(words).replace("z", "y"))]
    df = spark.createDataFrame([(*x, "c", 1) for x in items], SCHEMA)
    got = [tuple(r) for r in N.similar_pairs(df).collect()]
    assert set(got) == brute(items) and len(got) == len(set(got))
    assert N._spread(N.token_sets(df)).isEmpty() == (block > 100)


def test_colliding_classes_are_told_apart(spark, monkeypatch):
    items = corpus(4, 30)
    df = spark.createDataFrame([(*x, "c", 1) for x in items], SCHEMA)
    sets = N.token_sets(df)
    monkeypatch.setattr(N, "token_sets", lambda *_: sets.withColumn("cls", sets.cls % 7))
    apart = {r.set_key: r.cls for r in sets.withColumn("cls", sets.cls % 7).collect()}
    keys = {(r.tbl, r.rec_id): r.set_key for r in sets.collect()}
    seen = {tuple(r) for r in N.similar_pairs(df).collect()}
    # Only pairs whose own classes collide can be missed: a class is not joined with itself.
    assert brute(items) - seen <= {p for p in brute(items) if apart[keys[p[0], p[1]]] == apart[keys[p[0], p[2]]]} and seen <= brute(items)


def test_many_distinct_near_copies(spark, monkeypatch):
    """1,000 different texts around one template, dealt out in blocks: a link of each to the others, without a task that has all."""
    monkeypatch.setattr(N, "BLOCK", 100)
    monkeypatch.setattr(N, "LOOKED_AT", 8)
    base = [f"z{i}" for i in range(200)]
    df = spark.range(1000).selectExpr("'records' AS tbl", "lpad(id, 5, '0') AS rec_id", f"concat('{' '.join(base)} own', id) AS content")
    sets = N.token_sets(df)
    assert N._spread(sets).count() >= 60
    assert N._candidates(sets).count() == 1000 * 999 // 2


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.similar_pairs(df).count() == 0
    assert N.near_duplicate_groups(df).count() == 0


def test_groups_are_components(spark):
    chain = [("chunks", f"chain{k:02}", " ".join(f"q{i}" for i in range(8 * k, 8 * k + 100))) for k in range(40)]  # neighbours are linked
    items = corpus(3, 40) + [("records", f"copy{k}", " ".join(f"z{i}" for i in range(50))) for k in range(4)] + chain
    df = spark.createDataFrame([(*x, "c", 1) for x in items], SCHEMA)
    got = {(r.tbl, r.rec_id): r for r in N.near_duplicate_groups(df).collect()}
    parent = {k: k for k in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for t, a, b in brute(items):
        x, y = sorted((root((t, a)), root((t, b))))
        parent[y] = x
    assert {k: r.group_id for k, r in got.items()} == {k: root(k)[1] for k in got}
    assert {got["records", f"copy{k}"].copies for k in range(4)} == {4} and got["records", "copy3"].class_id == "copy0"
    assert got["chunks", "chain39"].group_id == "chain00" and got["chunks", "chain05"].links == 2


def test_parity():
    h = np.unique(np.random.default_rng(1).integers(0, 2**64, 200, dtype=np.uint64))
    # Every token that only one set has turns one bit at most.
    a, b = h[:150], h[10:]
    apart = np.unpackbits(np.frombuffer(N.parity(a), np.uint8) ^ np.frombuffer(N.parity(b), np.uint8)).sum()
    assert apart <= len(np.setxor1d(a, b))


def test_pigeonhole():
    """Signatures that differ in 23 of 72 positions, however placed, share a variant."""
    rng = random.Random(3)
    for _ in range(300):
        apart = set(rng.sample(range(N.SEGMENTS * N.WIDTH), 2 * N.SEGMENTS - 1))
        assert any(sum(k * N.WIDTH + i in apart for i in range(N.WIDTH)) <= 1 for k in range(N.SEGMENTS))


def test_one_wildcard_variants_match():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 2**64, 100, dtype=np.uint64)
    v = N.variants([s, s, rng.integers(0, 2**64, 100, dtype=np.uint64)])
    assert (v[0] == v[1]).all() and not set(v[0]) & set(v[2])
