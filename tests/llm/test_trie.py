import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from filmroll.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, d int, kind string"


def brute(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    members, children = defaultdict(list), defaultdict(set)
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h]
        made[c] = (*first, *mine[h:])
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
            if d:
                children[made[c][:d - 1]].add(made[c][:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(made[c]) == len(n)))).encode()).hexdigest()) for n, m in members.items()), key=str)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, turns):
    return spark.createDataFrame([(*t, 7, "x") for t in turns], SCHEMA).repartition(3)


def made(seed, convs, most):
    rnd = random.Random(seed)
    out = []
    for c in rnd.sample(range(-150, 500), convs):
        like = rnd.randrange(4)
        for t in range(rnd.randint(1, most)):
            out.append((c, t, rnd.choice(["user", "assistant"]) if like == 0 else "user", f"turn {t} of {like}" if like else rnd.choice(["", "é" * 3, "x"])))
    return out


@pytest.mark.parametrize("limit, held", [(1000, 1000), (2, 3), (5, 1)])
def test_against_brute_force(spark, limit, held):
    """With small limits nearly every node is heavy or a cut, and queues spill at every message."""
    turns = made(limit, 60, 12)
    assert got(trie.prefix_trie(frame(spark, turns), limit, held)) == brute(turns)


def test_a_long_conversation_and_one_with_many_copies(spark):
    turns = [(1, t, "user", f"{t % 7}") for t in range(700)] + [(c, 0, "user", "hello") for c in range(101, 400)]
    assert got(trie.prefix_trie(frame(spark, turns), 20, 10)) == brute(turns)


def test_nulls_ties_and_repeats(spark):
    turns = [(5, None, None, None), (5, 1, "a", "b"), (5, 1, "a", "b"), (5, 1, "a", "a"), (None, 0, "x", "y"), (6, 0, "", None), (7, None, "ab", "c"),
             (8, None, "a", "bc"), (0, 3, "user", ""), (0, 2, "user", "long " * 30_000), (-3, 0, "user", "minus"), (300, 0, "user", "x")]
    assert got(trie.prefix_trie(frame(spark, turns))) == brute(turns)


def test_empty_table(spark):
    assert got(trie.prefix_trie(frame(spark, []))) == []
    assert got(trie.prefix_trie(frame(spark, [(None, 1, "a", "b")]))) == []


def test_messages_come_in_order_from_memory_and_disk(tmp_path):
    rnd, box, want = random.Random(3), trie.Outbox(tmp_path, 4), defaultdict(list)
    for _ in range(500):
        row = tuple(rnd.randrange(4) for _ in range(3)) + tuple(rnd.randrange(9) for _ in range(3))
        want[row[:3]].append(row[3:])
        box.put(row)
    for place in sorted(want):
        assert sorted(box.take(place)) == sorted(want[place])
    assert not list(tmp_path.iterdir()) and not list(box.take((9, 9, 9)))


def test_query(spark):
    turns = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_prefix_trie(spark, "/root/testdata/sf0.001")) == brute(turns)
