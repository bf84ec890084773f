import hashlib
import re

import pytest

from filmroll.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, n int, keep_id string"
BIG = 2**63


def found(spark, rows, support):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in exact_dedup.exact_dedup(df, support).drop("text_hash").collect()), key=str)


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), BIG if d is None else d, d))
    out = []
    for d, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[key], key=lambda x: x[:2])[2]
        out.append((d, keep, len(groups[key]), d == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_against_grouping(spark, support):
    rows = [(i, "hot  copy" if i % 3 == 0 else "hot copy\t") for i in range(90)] + [(100 + i, f"a{i // 2} b") for i in range(40)]
    rows += [(200, "é x"), (201, "éx"), (202, None), (203, ""), (204, " \n"), (None, "hot copy"), (None, "alone"), (7, "again"), (7, "again"), (6, "again")]
    rows += [(300, "long " * 50_000), (301, "long" * 50_000)]
    assert found(spark, rows, support) == brute(rows)


def test_empty_table(spark):
    assert found(spark, [], 0.001) == []


def test_every_frequent_digest_is_a_candidate(spark):
    rows = exact_dedup.digests(spark.createDataFrame([(i, "hot" if i % 4 == 0 else str(i)) for i in range(400)], "doc_id long, text string"))
    hot = rows.where("doc_id = 0").first()["digest"]
    candidates = [r["digest"] for r in exact_dedup.frequent_digests(rows, 0.1).collect()]
    assert hot in candidates and len(candidates) <= 10
