import itertools
import random

import pytest

from filmroll.llm import exact_dedup, simhash, similar
from filmroll.llm.common import without

SCHEMA = "doc_id long, text string, fp string, kind int, text_hash string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def dropped(spark, rows):
    return {(r.doc_id, r.keep_id) for r in similar.near_copies(frame(spark, rows)).collect()}


def text(seed, n=200):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def edited(words, *places):
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_similar_texts_go_and_others_stay(spark):
    a, b = text(1), text(2)
    rows = [(5, " ".join(a)), (3, edited(a, 50)), (9, edited(a, 20, 120)), (7, edited(a, *range(0, 200, 20))), (1, " ".join(b)), (2, " ".join(text(3))), (4, None), (6, ""), (8, " \n")]
    assert dropped(spark, rows) == {(5, 3), (9, 3)}


def test_what_the_smallest_is_unlike_is_compared_too(spark):
    """1 is a candidate with all others but similar to none; 2 and 3 are similar."""
    a = text(4, 300)
    turned = [w for i in range(0, 300, 2) for w in (a[i + 1], a[i])]
    assert similar.word_prints(" ".join(a)) == similar.word_prints(" ".join(turned))
    rows = [(1, " ".join(turned)), (2, " ".join(a)), (3, edited(a, 150)), (10, " ".join(text(5)))]
    assert dropped(spark, rows) == {(3, 2)}


def test_ties_repeats_and_nulls(spark):
    a = text(6)
    rows = [(None, " ".join(a)), (2, edited(a, 3)), (2, edited(a, 4)), (2, edited(a, 4)), (11, "one two three"), (12, "ONE two\tthree"), (13, "one two")]
    got = dropped(spark, rows)
    assert (None, 2) in got and (2, 2) in got and (12, 11) in got and len(got) == 3
    left = without(frame(spark, rows), similar.near_copies(frame(spark, rows)))
    assert sorted(r.doc_id for r in left.collect() if r.doc_id == 2) in ([2], [2, 2])


def test_empty_table(spark):
    assert dropped(spark, []) == set()


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return without(docs, exact_dedup.exact_dedup(docs).where("not kept"))


def test_recall_against_all_pairs(spark, documents):
    rows = {r.doc_id: r.text or "" for r in documents.collect()}
    # near copies of every tenth document beside those of the table: one word in sixty changed
    rnd = random.Random(7)
    for d in sorted(rows)[::10]:
        words = rows[d].split()
        if len(words) >= 60:
            rows[d + 1_000_000] = " ".join(f"changed{rnd.randrange(999)}" if rnd.random() < 1 / 60 else w for w in words)
    sets = {d: frozenset(similar.shingles(t).tolist()) for d, t in rows.items()}
    near = {(a, b) for a, b in itertools.combinations(sorted(rows), 2)
            if sets[a] and sets[b] and 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(near) >= 40
    got = {d for d, _ in dropped(spark, list(rows.items()))}
    caught = sum(a in got or b in got for a, b in near) / len(near)
    assert caught >= 0.9, caught
    assert got <= {d for p in near for d in p}  # nothing else goes


def test_unlike_texts_with_equal_fingerprints_are_not_compared_in_pairs(spark, monkeypatch):
    """60 texts of the same words in other orders, of which two have a near copy: comparisons grow with the texts, not their pairs."""
    words, compared = text(8), []
    similar_pairs = similar._similar

    def counted(pairs, *more):
        compared.append(pairs.count())
        return similar_pairs(pairs, *more)

    monkeypatch.setattr(similar, "_similar", counted)
    rows = [(i, random.Random(i).sample(words, len(words))) for i in range(60)]
    rows += [(100 + i, edited(rows[i][1], 90).split()) for i in (7, 31)]
    assert len({similar.word_prints(" ".join(w))[0] for _, w in rows[:60]}) == 1
    assert dropped(spark, [(i, " ".join(w)) for i, w in rows]) == {(107, 7), (131, 31)}
    assert sum(compared) < 3 * len(rows)


def test_marks_of_similar_texts_are_near():
    rnd, apart = random.Random(9), []
    for seed in range(300):
        words = text(seed, rnd.randrange(12, 400))
        a, b = similar.shingles(" ".join(words)), similar.shingles(edited(words, *rnd.sample(range(len(words)), max(1, len(words) // 50))))
        x, y, z = similar.mark(a, similar.WIDE), similar.mark(b, similar.WIDE), similar.mark(similar.shingles(" ".join(text(seed + 1000))), similar.WIDE)
        bits = lambda u, v, n: sum(int(p ^ q).bit_count() for p, q in zip(u[:n], v[:n]))
        assert (similar.mark(a)[0] == x[0]) and bits(x, z, similar.WIDE) > similar.WIDE_BITS
        if similar.jaccard(a, b) >= similar.LEAST:
            apart.append((bits(x, y, 1) <= similar.MARK_BITS, bits(x, y, similar.WIDE) <= similar.WIDE_BITS))
    assert len(apart) > 200 and all(p and q for p, q in apart)


@pytest.mark.parametrize("run", [512, 3])
def test_links_by_id_and_marks_are_all_found(spark, run):
    rnd = random.Random(10)
    rows = []
    for base in (rnd.getrandbits(64) for _ in range(6)):
        for _ in range(8):
            fp, mark = base, [rnd.getrandbits(64) for _ in range(2)] if rnd.random() < 0.3 else [base, base]
            for _ in range(rnd.randrange(4)):
                fp ^= 1 << rnd.randrange(64)
            rows.append((fp, len(rows), *(mark if rnd.random() < 0.9 else [0, 0])))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([tuple(map(signed, r)) for r in rows], "fp long, id long, mark0 long, mark1 long")
    near = lambda a, b: not any(a[2:]) or not any(b[2:]) or (a[2] ^ b[2]).bit_count() + (a[3] ^ b[3]).bit_count() <= 20
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if (a[0] ^ b[0]).bit_count() <= 4 and near(a, b)}
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.links(df, run=run, stars=False, mark_bits=20).collect()}
    assert {p for p in got if p[0] != p[1]} == want and len(want) > 50
