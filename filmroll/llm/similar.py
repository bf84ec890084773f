"""Near copies by similarity: a pair of texts whose sets of five-word shingles have a Jaccard index of 0.8 or more.

Shingle fingerprints of such pairs differ in up to 13 of 64 bits, which no covering of few anchors reaches. So candidates come
from fingerprints of words, of which an edit changes one where it changes five shingles: SEEDS SimHashes of the distinct
words, each weighted by 1 + ln of its count, compared by anchor points as in `simhash` at 4 bits. A pair that is close under
any of them is a candidate, and is kept only by its exact Jaccard index.

By these alone unlike texts of one language come near each other, and at size most texts hang together. So each text has a mark
too: 64 min-hashes of its shingles, one bit of each. Marks of similar texts differ in 6.4 bits or fewer on average, and by
chance one of some ten thousand such pairs in more than 16; those of unlike texts differ in 32. Fingerprints are linked only where
the marks differ in at most 16 bits, or one of them stands for several texts.

1. Candidates are joined to components as stars, so copies of a text cost their number, not their pairs. Every member is
   compared with the smallest of its component, and the similar ones are dropped for it.
2. The smallest of what is left of a component is compared with the others left, and so on: a round costs the rows that are left.
3. Once a round takes off less than a quarter (many texts that are candidates of each other, few of them similar) the rest is
   compared pair by pair, those pairs whose marks of 512 bits are near too, and of every component of similar pairs the smallest stays.

So every dropped document is linked by similar candidate pairs to one that is kept, and of each candidate pair that is similar at
least one is dropped. "Smallest" is by doc_id, then by text hash; a null doc_id counts as larger than any other.

Defined cases: texts without words (null or empty ones too) are similar to nothing and stay; fewer words than five make one
shingle; rows that repeat id and text are one document here, and stay or go together; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import returning, stored, texts
from filmroll.llm.graph import components
from filmroll.llm.simhash import SLICE, THRESHOLD, links
from filmroll.session import attach

SHINGLE, LEAST = 5, 0.8
#: Fingerprints of each text. Of 48 similar pairs on sf0.1 one finds 35, two 42, three 46 and four all; each takes its share of the
#: disk, of which four took 5.2 times the input at 30 GB.
SEEDS = 3
LAST = 2**63 - 1
#: Longs of a mark, and the bits in which marks of linked texts may differ: a text's own, and those of texts compared pair by pair.
#: Of pairs with an index of 0.8 one in 10,000 and one in 70,000 differ in more.
MARK, MARK_BITS = 1, 16
WIDE, WIDE_BITS = 8, 82
TURNS = np.random.default_rng(5).integers(0, 2**63, 64 * WIDE, np.uint64) * np.uint64(2) + np.uint64(1)
#: A round with the smallest of each component has to take off this share of what is left, or the rest is compared pair by pair.
WORTH = 0.25


def word_prints(text: str, seeds: int = SEEDS) -> list[int]:
    """SimHashes of the weighted words of a whole text; none without words."""
    counts = Counter(text.encode("utf-8", "surrogatepass").lower().split())
    if not counts:
        return []
    h = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
    weight = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))).astype(np.float32)
    out = []
    for seed in range(seeds):
        x = (h ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(29)
        above = np.zeros(64, np.float64)
        for at in range(0, len(x), SLICE):
            bits = np.unpackbits(x[at:at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            above += weight[at:at + SLICE] @ bits.astype(np.float32)
        out.append(int.from_bytes(np.packbits(2 * above > weight.sum(dtype=np.float64), bitorder="little").tobytes(), "little"))
    return out


def mark(of: np.ndarray, words: int = 1) -> np.ndarray:
    """One bit of each of 64 * `words` min-hashes of distinct shingles: bits that differ in half the share that isn't common."""
    if not len(of):
        return np.zeros(words, np.uint64)
    turns = TURNS[:64 * words, None]
    low, at, row = np.full(len(turns), 2**64 - 1, np.uint64), np.zeros(len(turns), np.uint64), np.arange(len(turns))
    for k in range(0, len(of), 1024):
        part = of[k:k + 1024]
        turned = part[None, :] * turns
        first = turned.argmin(axis=1)
        least = turned[row, first]
        less = least <= low
        low[less], at[less] = least[less], part[first[less]]
    bit = np.arange(64, dtype=np.uint64)
    return (((at.reshape(words, 64) >> bit) & np.uint64(1)) << bit).sum(axis=1, dtype=np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a whole text, as sorted hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + size])) for i in range(n)), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.array(word_prints(t.as_py()), np.uint64).view(np.int64).tolist() for t in b.column("text")]
        marks = np.fromiter((mark(shingles(t.as_py()), MARK)[0] for t in b.column("text")), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(found, pa.list_(pa.int64())), pa.array(marks)],
                                         ["doc_id", "text_hash", "prints", "mark"])


_WIDE = "doc {}" + "".join(f", mark{k} bigint" for k in range(WIDE))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = np.array([mark(shingles(t.as_py()), WIDE) for t in b.column("text")], np.uint64).reshape(-1, WIDE).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc"), *[pa.array(m) for m in marks.T]], ["doc", *[f"mark{k}" for k in range(WIDE)]])


def _alike(least: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which rows have two similar texts. Neighbouring rows often share the first."""
        last, known = None, None
        for b in batches:
            keep = []
            for a, t in zip(b.column("a_text"), b.column("b_text")):
                a = a.as_py()
                if a != last:
                    last, known = a, shingles(a)
                keep.append(jaccard(known, shingles(t.as_py())) >= least)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return task


def _node(kind: Column | int, value: str, hash_: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(kind.cast("int").alias("kind"), F.col(value).alias("value"), (F.col(hash_) if isinstance(hash_, str) else hash_).alias("hash"))


def _similar(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of documents those whose texts are similar."""
    a, b = (rows.select(F.col("doc").alias(n), F.col("text").alias(f"{n}_text")) for n in "ab")
    return pairs.join(b, "b").join(a, "a").mapInArrow(returning(_alike(least)), pairs.select("a", "b").schema)


def _candidates(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between fingerprints as stars, and the rows of `prints` whose fingerprint has one or is shared. One seed after the other,
    so that only one's replicas are on disk at a time."""
    own = F.when(F.min("mark") == F.max("mark"), F.min("mark")).otherwise(0)
    shared = stored(prints.groupBy("seed", "fp").agg(F.count("*").alias("n"), own.alias("mark")), "distinct")
    near = functools.reduce(DataFrame.union, [
        stored(links(shared.where(F.col("seed") == k).select("fp", "mark"), THRESHOLD, mark_bits=MARK_BITS), "near") for k in range(SEEDS)])
    ends = near.select(F.col("u").alias("fp")).union(near.select("v")).union(shared.where("n > 1").select("fp")).distinct()
    return near, stored(prints.join(ends, "fp", "left_semi"), "linked")


def _pairs(prints: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents with linked fingerprints whose wide marks are near."""
    marks = rows.join(prints.select("doc").distinct(), "doc", "left_semi").mapInArrow(returning(_wide), _WIDE.format(rows.schema["doc"].dataType.simpleString()))
    known = stored(marks.withColumn("id", F.xxhash64("doc.value", "doc.hash")), "wide")
    near = stored(links(prints.join(known, "doc").drop("doc", "mark", "seed"), THRESHOLD, stars=False, mark_bits=WIDE_BITS), "near")
    pairs = near.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    x, y = (known.select(F.col("id").alias(c), F.col("doc").alias(d)) for c, d in ("ux", "vy"))
    return pairs.join(x, "u").join(y, "v").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash) of the documents to drop, and the doc_id of the one that is kept for each."""
    t = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    found = stored(t.mapInArrow(returning(_prints), "doc_id bigint, text_hash bigint, prints array<bigint>, mark bigint"), "word-prints")
    known = found.where(F.size("prints") > 0).select(F.coalesce("doc_id", F.lit(LAST)).alias("value"), "text_hash", "prints", "mark")
    prints = known.select(_node(0, "value", "text_hash").alias("doc"), F.posexplode("prints").alias("seed", "fp"), "mark").distinct()
    rows = t.select(F.coalesce("doc_id", F.lit(LAST)).alias("value"), "text_hash", "text").select(_node(0, "value", "text_hash").alias("doc"), "text")

    def told(pairs: DataFrame) -> DataFrame:
        whole = lambda c: F.when(F.col(c) != LAST, F.col(c))
        return pairs.select(whole("b.value").alias("doc_id"), F.col("b.hash").alias("text_hash"), whole("a.value").alias("keep_id"))

    # components of candidates
    near, of = _candidates(prints)
    fp = lambda c: _node(1, c, F.lit(0).cast("bigint"))
    edges = near.select(fp("u").alias("u"), fp("v").alias("v")).union(of.select("doc", fp("fp")))
    member = stored(components(edges).where("node.kind = 0 AND root.kind = 0").select(F.col("root").alias("a"), F.col("node").alias("b")), "members")
    in_some = member.select(F.col("b").alias("doc")).union(member.select("a")).distinct()
    some = stored(attach(rows, in_some, ["doc"], "left_semi", "in-some").dropDuplicates(["doc"]), "candidates")
    # the smallest of what is left of each component, while that takes off enough
    left, left_n, dropped = member.select(F.col("a").alias("root"), "a", "b"), None, []
    while True:
        gone = stored(_similar(left.select("a", "b"), some, least), "similar")
        dropped.append(gone)
        left = left.join(gone.select("b"), "b", "left_anti")
        least_ = left.groupBy("root").agg(F.min("b").alias("a"))
        left = stored(left.select("root", "b").join(least_, "root").select("root", "a", "b").where("a != b"), "left")
        before, left_n = left_n, left.count()
        if not left_n or before is not None and left_n > (1 - WORTH) * before:
            break
    first = functools.reduce(DataFrame.union, dropped)
    if not left_n:
        return told(first)

    # the rest of them pair by pair
    last = left.select(F.col("b").alias("doc")).union(left.select("a")).distinct()
    rest = stored(prints.join(last, "doc", "left_semi"), "rest")
    again = stored(_similar(_pairs(rest, some), some, least), "again")
    second = components(again.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("root").alias("a"), F.col("node").alias("b"))
    return told(first.union(second))
