import functools
import random
from datetime import datetime
from decimal import Decimal

import pytest

from tessella.llm import conversations as C

SCHEMA = "channel_id string, ts string, thread_ts string, text string, reply_count bigint, subtype string, user_id string, scraped_at timestamp, root string, at string"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def row(ch, ts, th=None, text="hello", n=0, sub=None, user="u", at=T0):
    return (ch, ts, th, text, n, sub, user, at, "clash", "clash")


def brute(rows):
    last = {}
    for r in rows:
        if r[0] is None or r[1] in (None, "", "x"):
            continue
        key = r[0], Decimal(r[1])
        if key not in last or (last[key][7] or datetime.min) < (r[7] or datetime.min):
            last[key] = r
    convs = {}
    for (ch, ts), r in last.items():
        root = Decimal(r[2]) if r[2] else ts if (r[4] or 0) > 0 else None
        if root is not None:
            convs.setdefault((ch, root), {})[ts] = r
    out = set()
    for (ch, root), ms in convs.items():
        left = sorted(t for t, r in ms.items() if r[5] not in C.SYSTEM_SUBTYPES and (r[3] or "").strip())
        if root in ms and ms[root][5] not in C.SYSTEM_SUBTYPES and (ms[root][4] or 0) <= len(ms) - 1 and len(left) >= 2:
            out |= {(ch, f"{root:.6f}", k, f"{t:.6f}") for k, t in enumerate(left, 1)}
    return out


ROWS = [
    row("a", "1.5", n=2), row("a", "2.000000", "1.500000"), row("a", "3", "1.5"), row("a", "3.000000", "1.5", "later", at=T1),
    row("a", "2.5", "1.5", "  "), row("a", "2.6", "1.5", sub="tombstone"),
    row("b", "1.5", n=5), row("b", "2", "1.5"),  # replies missing
    row("b", "9", "8"), row("b", "10", "8"),  # root missing
    row("c", "1", n=1, sub="bot_message"), row("c", "2", "1"),  # root by the system
    row("d", "1", n=1), row("d", "2", "1", None),  # nothing left but the root
    row("e", None, "1"), row(None, "1", n=1), row("e", "x", "1"), row("e", "", "1"), row("e", "5", None, n=None), row("e", "6", ""),
    row("f", "20000", n=1, user="s"), *(row("f", str(20000 + 7200 * k), "20000", f"m{k}", user="bot" if k % 2 else "s") for k in range(1, 30)),  # several slices
    row("h", "1", None, " ", n=2), row("h", "2", "1"), row("h", "3", "1"),
    row("g", "5", "5", n=None), row("g", "4", "5", " "), row("g", "6", "5"), row("g", "6", "5"),
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [tuple(r) for r in C.conversations(df).select("channel_id", "root_ts", "pos", "ts").collect()]
    assert set(got) == brute(ROWS) and len(got) == len(set(got))
    assert {r.channel_id: r.verdict for r in C.verdicts(C.automaton(C.keyed(df))).where("channel_id in ('b', 'c', 'd')").collect() if r.root in (Decimal("1.5"), Decimal(1))} == {"b": "replies missing", "c": "root by the system", "d": "empty"}
    assert {tuple(r) for r in C.conversations(df, texts=False).collect()} == brute(ROWS)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_reads_as_single_steps_do(spark, small_ranges):
    """The verdicts of the query against the automaton stepped over each whole conversation, its rows in several ranges."""
    many = [row("z", str(k), "1", f"m{k}") for k in range(2, 900)] + [row("z", "1", n=898)]
    rows = C.keyed(spark.createDataFrame(ROWS + many, SCHEMA))
    convs = {}
    for r in sorted(rows.collect(), key=lambda r: r["at"]):
        c = convs.setdefault((r.channel_id, r.root), [("absent", 0), 0, 0])
        letter = C.LETTERS[r.letter]
        c[0] = C.step(c[0], letter)
        c[1] += letter.endswith("reply")
        c[2] = max(c[2], 0 if letter.endswith("reply") else r.declared)
    done = C.automaton(rows)
    assert done.where("state is not null and channel_id = 'z'").count() > 1, "a long conversation lies in several ranges"
    assert {(r.channel_id, r.root): r.verdict for r in C.verdicts(done).collect()} == {k: C.verdict(*v) for k, v in convs.items()}
    assert [r.pos for r in C.conversations(spark.createDataFrame(ROWS + many, SCHEMA)).where("channel_id = 'z'").orderBy(C._number("ts")).collect()] == list(range(1, 900))


@pytest.mark.parametrize("seed", range(20))
def test_states_compose(seed):
    rng = random.Random(seed)
    letters = [rng.choice(C.LETTERS) for _ in range(rng.randint(0, 12))]
    k = rng.randint(0, len(letters))
    fold = lambda xs: functools.reduce(C.step, xs, ("absent", 0))
    assert C.composed(fold(letters[:k]), fold(letters[k:])) == fold(letters)
    run = functools.reduce(lambda r, x: C.read(r, C.LETTERS.index(x), 3), letters, C.Run())
    assert C.STATES[run.state] == fold(letters) and run.replies == sum(x.endswith("reply") for x in letters)


def test_roles_and_latest_text(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    users = spark.createDataFrame([("bot", True), ("bot", True), ("s", None), (None, None)], "id string, is_bot boolean")
    got = {(r.channel_id, r.ts): r for r in C.conversations(df, users).collect()}
    assert got["f", "20000.000000"].role == "starter" and got["f", "27200.000000"].role == "bot" and got["f", "34400.000000"].role == "starter"
    assert got["a", "3.000000"].text == "later"


def test_empty(spark):
    assert C.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
