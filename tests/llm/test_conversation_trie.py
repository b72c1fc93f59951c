import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from nimbora.llm import conversation_trie as trie

ROOT = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest())
    own = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in own.items()}
    built = {}
    for c in own:
        base, h = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    out, totals = [], {}
    for path in sorted(nodes, key=len, reverse=True):
        n = len(nodes[path])
        leaves = sum(totals[k][0] for k in kids[path]) or 1
        saved = sum(totals[k][1] for k in kids[path]) + ((n - 1) * len(path[-1][1].encode()) if path else 0)
        totals[path] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in nodes[path] if built[c] == path)))
        out.append((min(nodes[path]), len(path), min(nodes[path[:-1]]) if path else None, n, len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def compared(df, **how):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in trie.conversation_trie(df, **how).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(rows), key=repr)
    return got


def some_rows(seed=1, convs=120):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "bé", "ccc"]), "x") for c in range(-20, convs) if c % 7 for t in range(r.choice([0, 1, 2, 3, 5, 9, 12]))]


@pytest.mark.parametrize("most", [1, 7, 40, 10**6])
def test_all_sizes_of_groups_give_one_trie(spark, most):
    compared(spark.createDataFrame(some_rows(), SCHEMA).repartition(3), most_turns=most)


def test_odd_conversations(spark):
    rows = [
        (1, 0, "u", "hi", "x"), (1, 0, "u", "hi", "x"), (1, None, None, None, None), (2, 1, None, "text", "x"), (2, 1, "u", None, "x"), (None, 1, "u", "lost", "x"), (None, None, None, None, None),
        (5, 3, "", "", ""), (6, 1, "u", "ü" * 40_000, "x"), (7, 1, "u", "ü" * 40_000, "x"), (10**15, 1, "u", "far", "x"), (-3, 1, "u", "neg", "x"), (9, 5, "a:", "b", "x"), (11, 5, "a", ":b", "x"), (13, 1, "one", "", "y"),
    ]
    compared(spark.createDataFrame(rows, SCHEMA).repartition(4))
    compared(spark.createDataFrame(rows, SCHEMA), most_turns=1)


def test_no_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "t", "x")], SCHEMA)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    conv = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)
    (root,) = compared(spark.createDataFrame([(conv, 1, "u", "t", "x")], SCHEMA))
    assert root == (conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())


def test_equal_and_long_conversations(spark):
    """A third of all conversations are equal, and two long ones part late; both pass the limit of a trie."""
    rows = [(5 * c, t, "u", f"turn {t}", "x") for c in range(60) for t in range(6)]
    rows += [(5 * c, t, "u", f"turn {t}" if t < 4 else f"{c} {t}", "x") for c in range(60, 180) for t in range(6)]
    rows += [(5 * c, t, "u", f"long {t if t < 300 else t * c}", "x") for c in (200, 201, 202) for t in range(320)]
    compared(spark.createDataFrame(rows, SCHEMA).repartition(5), most_turns=50)
    compared(spark.createDataFrame(rows, SCHEMA).repartition(5), most_turns=500)


def test_query_equals_sql(spark):
    got = trie.op13_conversation_prefix_trie(spark, ROOT)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{ROOT}/conversations.parquet'")
    want = con.execute(trie.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
