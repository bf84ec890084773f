import hashlib
import random

import pytest

from filmroll.llm import repeats

SCHEMA = "doc_id long, text string, place long, spans string"
LENGTH = repeats.LENGTH


def brute(rows):
    """rows (doc_id, text), each document once, in order -> doc_id, bytes, removed, spans, digest."""
    seen, out = set(), []
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - LENGTH + 1):
            w = raw[s:s + LENGTH]
            if w in seen:
                gone[s:s + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, shard=repeats.SHARD):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in repeats.digests(repeats.remove_repeats(df, shard)).collect()), key=str)


@pytest.mark.parametrize("shard", [repeats.SHARD, 1])
def test_against_all_strings(spark, shard):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rnd.randint(10, 60))) for _ in range(12)]
    rows = []
    for d in range(120):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 50))) for _ in range(rnd.randint(0, 6))]
        text = rnd.choice(["", " ", "\n"]).join(parts)
        rows.append((d * 3 % 127, text))
    rows += [(200, rows[5][1]), (201, rows[5][1] + "!"), (202, "x" + rows[6][1]), (203, "ab" * 400), (204, "b" + "ab" * 300), (205, "a" * 500), (206, "z" * 99),
             (207, "z" * 100), (208, "z" * 101), (209, None), (210, ""), (211, "\0" * 150 + "\x01" * 150), (212, "\0" * 120)]
    rows.sort()
    assert found(spark, rows, shard) == brute(rows)


def test_ids_that_are_null_or_shared(spark):
    a, b = "".join(map(str, range(90))), "".join(map(str, range(300, 400)))
    got = {(r[0], r[1], r[2]) for r in found(spark, [(None, a), (5, a), (5, a)])}
    assert got == {(5, len(a), 0), (None, len(a), len(a))}
    total = sum(r[2] for r in found(spark, [(7, b), (7, b + "!")]))
    assert total == len(b)


def test_empty_table_and_long_text(spark):
    assert found(spark, []) == []
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long), (2, long[1_048_000:1_049_000] + long[5:2000])]
    assert found(spark, rows) == brute(rows)
