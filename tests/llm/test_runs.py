import hashlib
import random
import zlib

import pytest

from filmroll.llm import queries, runs

SCHEMA = "doc_id long, text string, runs string, kept int"


def brute(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, 2 * q) and not any(w[i:i + n - p] == w[i + p:i + n] for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc, text):
    w, h = (text or "").encode().split(), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def want(doc, text):
    w = looped(doc, text)
    found = brute(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("least", [2, 3, 6, 12])
def test_against_brute_force(least):
    rnd = random.Random(least)
    for _ in range(700):
        n, k = rnd.randint(0, 90), rnd.choice([1, 2, 2, 3, 5])
        w = [rnd.choice("abcdefgh"[:k]) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            if n > 4:
                a = rnd.randrange(n - 2)
                p = rnd.randint(1, max(1, (n - a) // 2))
                for i in range(a, a + rnd.randint(p, n - a)):
                    w[i] = w[a + (i - a) % p]
        (size, found, _), = runs.find([" ".join(w).encode()], least)
        assert (size, found) == (n, brute(w, least)), w


def test_words_with_structure():
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    for w in (fib[-1], thue, "a" * 1000, "ab" * 300 + "a", "a" * 40 + "b" + "a" * 40, "abcabcabcabcab" * 9):
        (_, found, _), = runs.find([" ".join(w).encode()])
        assert found == brute(list(w))


def test_a_grammar_derives_its_text():
    rnd = random.Random(1)
    for _ in range(100):
        seqs = [[rnd.randrange(3) for _ in range(rnd.randint(1, 40))] for _ in range(rnd.randint(1, 3))]
        g = runs.Grammar(seqs, 3)
        pairs = len(g.rules)

        def said(x):
            return [x] if x < 3 else said(g.rules[x - 3][0]) + said(g.rules[x - 3][1])

        assert [sum(map(said, s), []) for s in g.left] == seqs
        assert len(set(g.rules[:pairs])) == pairs
        assert [said(r) for r in g.rooted()] == seqs


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in runs.digests(runs.periodic_runs(runs.with_loops(df))).collect()), key=str)


def test_whole_texts(spark):
    loop = "one two three four five six seven "
    rows = [(1, loop * 5), (2, None), (3, ""), (4, " \n\t "), (None, loop * 3), (5, f"x {loop * 2}y"), (5, f"x {loop * 2}y"), (5, "other"), (6, "a\x0ba \x0c a\r\na\x85a　a"),
            (7, "la " * 5000), (8, " ".join(str(i % 3001) for i in range(9000)))]
    rows += [(i, " ".join(f"w{(j * j + i) % 97}" for j in range(i * 3))) for i in range(20, 120)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    assert got(spark, rows) == sorted((want(*r) for r in rows), key=str)


def test_runs_and_kept_text(spark):
    r, = runs.periodic_runs(spark.createDataFrame([(9, "start " + "a b c " * 6 + "end")], "doc_id long, text string")).collect()
    assert (r.n_words, [tuple(x) for x in r.runs], r.kept) == (20, [(1, 18, 3)], "start a b c end")


def test_empty_table(spark):
    assert got(spark, []) == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 3000]
    found = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == 200
    for row in rows:
        assert found[row[0]] == want(*row)
