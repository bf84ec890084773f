import random
import re

import numpy as np
import pytest
import xxhash

from filmroll.llm import graph, simhash

SCHEMA = "doc_id long, text string, fp string, anchor int"


def brute_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(v >> j & 1 for v in h) > len(h))


def roots(prints):
    """prints {key: fp} -> {key: smallest key reachable}"""
    keys, up = sorted(prints), {k: k for k in prints}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: top(k) for k in keys}


@pytest.mark.parametrize("text", ["", " \t", "a", "A b", "x y z w", "É À b c d e", "a\x0bb\x1cc d e f g", "w " * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_anchors_meet_for_all_pairs_within_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for d in range(5):
        y = x ^ np.array([sum(1 << int(b) for b in rng.choice(64, d, replace=False)) for _ in x], np.uint64)
        sides = []
        for side in (x, y):
            keys, rows = simhash.anchors(side)
            sides.append([set(keys[rows == i].tolist()) for i in range(len(x))])
        assert all(a & b for a, b in zip(*sides))


@pytest.mark.parametrize("run", [simhash.RUN, 3])
def test_links_are_those_of_all_pairs(spark, run):
    rng = random.Random(run)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {i: rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for i in range(250)}
    signed = {i: v - 2**64 if v >= 2**63 else v for i, v in prints.items()}
    df = spark.createDataFrame([(v,) for v in {*signed.values()}], "fp long")
    root = {r.node: r.root for r in graph.components(simhash.links(df, run=run)).collect()}
    want = roots({v: v % 2**64 for v in signed.values()})
    for a in want:
        assert root.get(a, a) == want[a]


def test_query_rows(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:200 + i] if i % 2 else [*base[:50], f"x{i}", *base[50:]])) for i in range(20)]
    rows += [(40, None), (41, ""), (42, "\n"), (5, rows[5][1]), (None, "lonely words here today"), (None, ""), (50, "Same Words Here Now"), (51, "same words here now")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = simhash.near_dedup(df).collect()
    assert len(got) == len(rows)
    key = {}
    for i, (d, t) in enumerate(rows):
        key[(2**62 if d is None else d, i)] = brute_print(t)
    want = roots(key)
    expect = sorted(((None if k[0] == 2**62 else k[0], f"{v:016x}", None if want[k][0] == 2**62 else want[k][0]) for k, v in key.items()), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == expect
    assert simhash.near_dedup(df.where("false")).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (1000, 1001)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001 + i: 1000 for i in range(300)}
