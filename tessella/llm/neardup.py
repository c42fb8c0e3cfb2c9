"""Records that share most of their tokens.

A content's tokens are a set; sets that are equal form a class, and only one
row per class goes on.  A class has a signature of MinHash positions, cut into
few segments: 12 segments of 6 positions, so that two signatures that differ in
23 positions at most have, by the pigeonhole principle, a segment where they
differ in one position at most.  A segment is indexed once per position, with
that position as wildcard (a deletion variant): two segments that differ in one
position (or none) share such a variant.  Equal variants are joined, and every
candidate pair is verified on the tokens themselves.

Beyond 23 differing positions a segment with one difference is likely but not
certain: a pair at similarity s is missed with probability
(1 - s^w - w s^(w-1) (1 - s))^n, 1e-4 at 0.75, 1e-6 at 0.8, none at 1.

A variant that many classes have is joined in blocks: its classes are dealt to
blocks by hash and every pair of blocks is a key of its own, so no task gets all
of them.  Which variants are dealt out is estimated from a sample of classes; the
estimate decides about the spread of the work, never about the result.

Nulls, and contents of fewer than `least` different tokens, have no partner and
no class of their own.  Repeated ids count once if their contents are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize, remove, spread

THRESHOLD, LEAST = 0.75, 30
SEGMENTS, WIDTH = 12, 6
#: Bits of a set's parity bitmap.  Every bit in which two differ stands for a token that only one set has.
PARITY_BITS = 256
#: Classes of a variant in one block, and one of how many classes is looked at to find the variants that need blocks.
BLOCK, LOOKED_AT = 1000, 64


def tokens(text: str | None) -> set[str]:
    """Maximal runs of characters other than space, tab, CR and LF, lower-cased, as a set."""
    if not text:
        return set()
    out = set(text.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "))
    out.discard("")
    return out


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(self) < 200_000:
            self[w] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and addends of the MinHash positions."""
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def variants(sets: list[np.ndarray], segments: int = SEGMENTS, width: int = WIDTH) -> np.ndarray:
    """(len(sets), segments * width) hashes: one for each segment and wildcard."""
    n = segments * width
    mul, add = _permutations(n)
    ends = np.cumsum([len(s) for s in sets])
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    flat = _mix(np.concatenate(sets))
    sig = np.empty((n, len(sets)), np.uint64)
    for k in range(n):
        x = flat * mul[k]
        x ^= x >> np.uint64(32)
        x = x * mul[k] + add[k]
        sig[k] = np.minimum.reduceat(x, starts)
    # Each value, mixed with its position; a segment's hash without a position is the segment's sum less that value.
    val = _mix(sig + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95))
    seg = val.reshape(segments, width, -1)
    left = seg.sum(axis=1, keepdims=True, dtype=np.uint64) - seg
    tag = np.arange(n, dtype=np.uint64).reshape(segments, width, 1)
    return _mix(left ^ _mix(tag + np.uint64(77))).reshape(n, -1).T


def parity(h: np.ndarray) -> bytes:
    bits = np.bincount((h >> np.uint64(3)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def token_sets(df: DataFrame, least: int = LEAST) -> DataFrame:
    """(tbl, rec_id, cls, set_key, size, parity, tokens) of the rows of `df` (tbl, rec_id, content) with `least` tokens or more.

    tokens are the set in order, by line ends; set_key is a 128-bit hash of table and set, equal for rows with one set,
    and cls its first half: classes whose cls collides share index entries and are told apart afterwards."""
    def run(batches):
        known = _Hashes()
        for b in batches:
            at, keys, sizes, bits, joined = [], [], [], [], []
            tbls = b.column(0).to_pylist()
            for i, t in enumerate(b.column(2)):
                ws = tokens(t.as_py())
                if len(ws) < least:
                    continue
                text = "\n".join(sorted(ws))
                h = np.array([known[w] for w in ws], np.uint64)
                at.append(i), sizes.append(len(ws)), bits.append(parity(h)), joined.append(text)
                keys.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"), seed=xxhash.xxh32_intdigest(str(tbls[i]).encode())))
            take = pa.array(at, pa.int64())
            cls = np.frombuffer(b"".join(keys), "<i8")[::2] if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cls), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(joined, pa.string())], ["tbl", "rec_id", "cls", "set_key", "size", "parity", "tokens"])

    return spread(df.select("tbl", "rec_id", "content")).where(F.length("content") >= 2 * least - 1).mapInArrow(run, "tbl string, rec_id string, cls bigint, set_key binary, size int, parity binary, tokens string")


_SEEN = 1_000_000


def _index(sets: DataFrame) -> DataFrame:
    """(variant, cls); copies within a task are indexed once, copies of several tasks are removed where they meet."""
    def run(batches):
        seen: set[bytes] = set()
        known = _Hashes()
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                new = [i for i, c in enumerate(part.column(3).to_pylist()) if c not in seen and not (len(seen) < _SEEN and seen.add(c))]
                if not new:
                    continue
                part = part.take(pa.array(new, pa.int64()))
                cls = part.column(0).to_numpy()
                # Tables don't mix: a class's variants are salted by its table.
                salt = np.array([xxhash.xxh64_intdigest(str(x).encode()) for x in part.column(1).to_pylist()], np.uint64)
                v = _mix(variants([np.array([known[w] for w in x.split("\n")], np.uint64) for x in part.column(2).to_pylist()]) ^ salt[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(v.ravel().view(np.int64)), pa.array(np.repeat(cls, v.shape[1]))], ["variant", "cls"])

    return sets.select("cls", "tbl", "tokens", "set_key").mapInArrow(run, "variant bigint, cls bigint")


def _same(a: set, b: set, threshold: float) -> bool:
    both = len(a & b)
    return both / (len(a) + len(b) - both) > threshold


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, ta, tb) whose token sets' similarity is above `threshold`."""
    def run(batches):
        for b in batches:
            keep = [_same(set(x.split("\n")), set(y.split("\n")), threshold) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _possible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, na, nb, pa, pb) that sizes and parities don't rule out: the tokens that only one set has are
    fewer than (1 - t) / (1 + t) of all, and at least as many as the differing parity bits."""
    limit = (1 - threshold) / (1 + threshold)

    def run(batches):
        for b in batches:
            na, nb = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
            grid = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(len(b), -1) for k in (4, 5)] if len(b) else None
            apart = np.bitwise_count(grid[0] ^ grid[1]).sum(axis=1, dtype=np.int64) if grid else na
            keep = np.maximum(apart, np.abs(na - nb)) < limit * (na + nb)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a bigint, b bigint")


#: Most bits of the table that tells which sets are asked for (16 MB): beyond, more sets are shuffled that are not.
MOST_BITS = 1 << 27


def _among(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of `sets` whose cls is in a pair (a, b), and a few others: those that share its bit in a table of bits, which
    has 16 bits for each and is broadcast."""
    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    bits = min(MOST_BITS, 1 << max(10, (16 * asked.count()).bit_length()))
    at = F.col("cls").bitwiseAND(F.lit(bits - 1))
    words = np.zeros(bits // 64, np.int64)
    # As many rows as the table has words, at most.
    for r in asked.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(cls & 63 AS INT))")).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    shipped = sets.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words = shipped.value.view(np.uint64)
        for b in batches:
            cls = b.column(0).to_numpy()
            at = (cls & (bits - 1)).astype(np.uint64)
            yield b.filter(pa.array(words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1))

    return sets.select("cls", "set_key", "tbl", "tokens").mapInArrow(run, "cls bigint, set_key binary, tbl string, tokens string")


def _spread(sets: DataFrame) -> DataFrame:
    """(variant, blocks) of the variants that seem to have more than `BLOCK` classes: as many blocks as give each about that many."""
    some = _index(sets.where(F.pmod(F.xxhash64("cls"), F.lit(LOOKED_AT)) == 0)).groupBy("variant").agg(F.approx_count_distinct("cls").alias("n"))
    return some.where(F.col("n") * LOOKED_AT > BLOCK).select("variant", F.ceil(F.col("n") * LOOKED_AT / BLOCK).cast("int").alias("blocks"))


def _candidates(sets: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of classes with a variant in common."""
    index, spread = _index(sets), materialize(_spread(sets))
    if spread.isEmpty():
        keyed = index.select("variant", "cls", F.lit(0).cast("byte").alias("side"))
    else:
        # Row `mine` of the grid of blocks: a class meets its own block once and every other block once.
        mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
        wide = index.join(spread, "variant", "left").withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        side = F.when(F.col("mine") == F.col("other"), 0).otherwise(F.when(F.col("mine") < F.col("other"), 1).otherwise(2)).cast("byte")
        keyed = wide.select(F.when(F.col("blocks").isNull(), F.col("variant")).otherwise(F.xxhash64("variant", low, high)).alias("variant"), "cls", side.alias("side"))
    keyed = keyed.repartition("variant").dropDuplicates(["variant", "cls", "side"])
    one, two = keyed.toDF("variant", "a", "sa"), keyed.toDF("variant", "b", "sb")
    return one.join(two, "variant").where("a < b and (sa = 0 and sb = 0 or sa <> sb and sa > 0 and sb > 0)").select("a", "b").distinct()


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (a, b), a < b: set_keys of unequal sets of one table whose similarity is above `threshold`."""
    # Of sets whose cls collides every combination is looked at, here and on the tokens.
    light = sets.select("cls", "size", "parity").distinct()
    one, two = light.toDF("a", "na", "pa"), light.toDF("b", "nb", "pb")
    possible = materialize(_possible(_candidates(sets).join(one, "a").join(two, "b"), threshold).distinct())
    whole = _among(sets, possible).groupBy("cls", "set_key", "tbl").agg(F.max("tokens").alias("tokens"))
    pairs = possible.join(whole.toDF("a", "ka", "tbl", "ta"), "a").join(whole.toDF("b", "kb", "tbl", "tb"), ["b", "tbl"])
    found = _verified(pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "ta", "tb"), threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_pairs(df: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: every pair of different ids of one table above the threshold.

    A group of n copies has n (n - 1) / 2 pairs, which is the result asked for; `near_duplicate_groups` says the same
    with a row per id.  Pairs of a large class are made in blocks, as those of a variant are."""
    sets = materialize(token_sets(df, least))
    links = similar_sets(sets, threshold)
    members = sets.select(F.col("set_key").alias("k"), "tbl", "rec_id").distinct()
    across = links.join(members.toDF("a", "tbl", "x"), "a").join(members.select("k", "rec_id").toDF("b", "y"), "b").select("tbl", "x", "y")
    # Members of a class meet in blocks of about BLOCK, counted exactly.
    blocks = members.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "k").withColumn("mine", F.pmod(F.xxhash64("rec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = dealt.select("k", F.col("mine").alias("i"), F.col("other").alias("j"), "tbl", F.col("rec_id").alias("x"))
    right = dealt.select("k", F.col("other").alias("i"), F.col("mine").alias("j"), F.col("rec_id").alias("y"))
    equal = left.join(right, ["k", "i", "j"]).where("x < y").select("tbl", "x", "y")
    pairs = across.unionByName(equal).where("x <> y")
    return pairs.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(tbl, rec_id, class_id, group_id, copies, links): the least id of the row's class (one set of tokens) and of its
    connected component of links between classes, the number of ids in its class and of classes it is linked with.

    Labels move along links and jump to their label's label until none moves; each round lowers some label, so it ends."""
    sets = materialize(token_sets(df, least))
    members = sets.select("set_key", "tbl", "rec_id").distinct()
    named = materialize(members.groupBy("set_key").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("copies")))
    names = named.select("set_key", "class_id")
    found = similar_sets(sets, threshold).join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    tbl = members.select("set_key", "tbl").distinct()
    links = materialize(found.join(tbl.withColumnRenamed("set_key", "a"), "a").select("tbl", "x", "y").distinct())
    both = links.select("tbl", F.col("x").alias("cls"), F.col("y").alias("other")).union(links.select("tbl", F.col("y").alias("cls"), F.col("x").alias("other")))
    label, old = both.select("tbl", "cls", F.col("cls").alias("label")).distinct(), None
    while True:
        near = both.join(label.withColumnRenamed("cls", "other"), ["tbl", "other"]).groupBy("tbl", "cls").agg(F.min("label").alias("near"))
        step = label.join(near, ["tbl", "cls"]).select("tbl", "cls", F.least("label", "near").alias("new"), "label")
        # Jump: a label is itself a class, whose label is as good.
        jump = step.select("tbl", F.col("cls").alias("new"), F.col("new").alias("far"))
        moved = materialize(step.join(jump, ["tbl", "new"], "left").select("tbl", "cls", F.least("new", F.coalesce("far", "new")).alias("next"), "label"))
        if old is not None:
            remove(old)
        label, old = moved.select("tbl", "cls", F.col("next").alias("label")), moved
        if moved.where("next <> label").isEmpty():
            break
    degree = both.groupBy("tbl", "cls").agg(F.count("*").alias("links"))
    rows = members.join(named, "set_key").select("tbl", "rec_id", "class_id", "copies")
    rows = rows.join(degree.withColumnRenamed("cls", "class_id"), ["tbl", "class_id"], "left").join(label.withColumnRenamed("cls", "class_id"), ["tbl", "class_id"], "left")
    return rows.select("tbl", "rec_id", "class_id", F.coalesce("label", "class_id").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
