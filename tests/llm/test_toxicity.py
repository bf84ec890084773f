import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from filmroll.llm import toxicity

DOCS = "doc_id long, text string, score string, toxic int"
LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["grumbler", "wretchling", "snorkfool", "dimwort"]


def brute(a, b):
    total = 0.0
    for i in combinations(range(len(a)), toxicity.ORDER):
        for j in combinations(range(len(b)), toxicity.ORDER):
            if all(a[x] == b[y] != 0 for x, y in zip(i, j)):
                total += toxicity.DECAY ** (i[-1] - i[0] + j[-1] - j[0] + 2)
    return total


def test_kernel_and_the_letters_it_needs():
    rnd = random.Random(1)
    names = ["abcab", "dcba", "aabbccdd"]
    z = toxicity.Landmarks(names)
    words = [bytes(rnd.choice([0, 1, 2, 3, 4]) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    got = z(words)
    for i, w in enumerate(words):
        for j, code in enumerate(z.codes):
            assert abs(got[i, j] - min(1, brute(w, code) / z.own[j]) ** 2) < 1e-9
            assert abs(toxicity.kernel(toxicity.padded([w]), code)[0] - brute(w, code)) < 1e-9


def corpus(n=400):
    rnd = random.Random(2)
    syllables = [a + b for a in "bdfglmnprst" for b in ("an", "el", "io", "ur")]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        sentences = [[word() for _ in range(rnd.randint(3, 9))] for _ in range(rnd.randint(2, 8))]
        toxic = int(rnd.random() < 0.3)
        for _ in range(3 if toxic else 0):
            s = rnd.choice(sentences)
            s.insert(rnd.randrange(len(s) + 1), rnd.choice(INSULTS))
        docs.append((i, ". ".join(" ".join(s) for s in sentences) + ".", "x", 1))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_documents_gaps_and_odd_rows(spark):
    docs, labels = corpus()
    extra = [(900, None, "x", 1), (901, "", "x", 1), (902, "a g.r.u.m.b.l.e.r and a s-n-o-r-k-f-o-o-l and d i m w o r t", "x", 1), (None, docs[0][1], "x", 1),
             (903, "banel " * 100_000, "x", 1), (904, "xx", "x", 1), (904, "xx", "x", 1), (905, "wrettchling dimmwort grumbbler", "x", 1)]
    labels += [(None, 1, 1), (5000, 1, 1), (3, 1, None), (0, 0, labels[0][2])]
    d, t = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels, LABELS)
    rows = toxicity.toxicity(d, t).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in rows)
    truth = {i: x for i, _, x in labels[:400]}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    score = {r.doc_id: r.score for r in rows}
    assert score[902] > 0.9 and score[905] > 0.5 and max(score[900], score[901], score[903], score[904]) < 0.3
    assert score[None] == score[0] and not [r for r in rows if r.doc_id is None][0].held_out
    flags = {r.doc_id: r.h for r in d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    import zlib
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in flags.items())
    # labels of held-out documents change nothing
    turned = spark.createDataFrame([(i, q, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, q, x in labels[:400]], LABELS)
    again = {r.doc_id: r.score for r in toxicity.toxicity(d, turned).collect() if r.doc_id is not None}
    assert all(abs(again[i] - score[i]) < 0.05 for i in again)


def test_without_labels_of_both_kinds(spark):
    docs, labels = corpus(40)
    d = spark.createDataFrame(docs, DOCS)
    for kept, want in ((labels[:0], 0.0), ([(i, 1, 1) for i in range(40)], 1.0)):
        t = spark.createDataFrame(kept, LABELS)
        assert {r.score for r in toxicity.toxicity(d, t).collect()} == {want}
        assert toxicity.clean(d, toxicity.fit(d, t)).count() == (40 if want < toxicity.THRESHOLD else 0)
    assert toxicity.toxicity(d.where("false"), spark.createDataFrame(labels, LABELS)).count() == 0


def test_labels_of_other_documents_change_nothing(spark):
    docs, labels = corpus()
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    more = t.union(spark.range(10_000, 50_000).selectExpr("id", "1L", "cast(id % 2 as long)"))
    (few, share), (many, same) = toxicity.sample(d, t, 60), toxicity.sample(d, more, 60)
    drawn = sorted(tuple(r) for r in few.collect())
    assert len(drawn) == 120 and sorted(tuple(r) for r in many.collect()) == drawn and same == share
