"""Toxicity scores by a subsequence string kernel, a support vector machine and Nystrom landmarks.

Kernel. K(s, t) counts the subsequences of ORDER letters that two strings share, each weighted by DECAY to the
power of the stretch it spans in both. Letters match, whatever stands between them is a gap: a landmark still
shares its subsequences with a word into which characters were inserted. Signs, digits and the spaces between single
letters take no room at all. The kernel of a sentence is the sum over its words of K
squared. (Sums and products of kernels are kernels.)

Landmarks. Words are counted in toxic and other labelled documents, once for each word they follow, so that copies
of a document don't count again and again. Of the strings within the words most tied to toxic documents, those
that cover most of them and fewest others become landmarks; the commonest other words join them as background.
K_mm^(-1/2) maps the kernel with the landmarks into the machine's space.

Machine. A linear machine with squared hinge loss is trained on labelled sentences: all of other documents, and of
toxic ones those that stand out most, and all that the last round's machine finds toxic. Its decision on a sentence is a sum over
words plus a constant, so every distinct word is judged once and kept. The highest decision of a
document's sentences, and the sum of those above zero, go through a logistic curve fitted on the training documents.

Bound: all of this learns from at most TRAIN_DOCS documents of each label, those with the smallest md5 of (seed,
doc_id) among the documents at hand; labels of other ids don't count. Labels, lang, source and doc_id are no
input of a score. Documents of labels whose crc32(doc_id) mod 4 is 2 are never learned from.

Defined cases: a null or empty text has one empty sentence; a label that is null doesn't count, of several for one document the
highest does; without both labels to learn from every score is the share of toxic labels (0 without any);
repeated rows each get a row; a null id is not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import returning, stored, texts

HELD_OUT = 2
DECAY = 0.8
ORDER = 4
LANDMARKS = 40
BACKGROUND = 16
#: Most words tied to toxic documents within which landmarks are sought.
CANDIDATES = 1000
#: A landmark's words follow at least so many different words in toxic documents, in all and for each of them.
LEAST_SEEN = 4
LEAST_SHARE = 0.02
#: How much rarer, against its share in toxic documents, a landmark has to be in others.
TIED = 8.0
LONGEST = 12
TRAIN_DOCS = 1000
ROUNDS = 4
RIDGE = 1e-5
SEED = 11
THRESHOLD = 0.3
#: A stretch longer than this is judged in windows that overlap by half.
WINDOW = 20
#: A sentence longer than this many words is judged in pieces.
SENTENCE = 16
#: Words kept by a worker between batches: a bound on memory only.
KEPT = 80_000
SLICE = 1 << 20
_CHAR = rb"(?:[\x21-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2})"
#: Letters set apart by spaces are one word with gaps.
APART = re.compile(rb"(?<![^\x20\x09-\x0D])" + _CHAR + rb"(?:[\x20\x09]{1,3}" + _CHAR + rb"){3,}(?![^\x20\x09-\x0D])")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


class Alphabet(dict):
    """Lower-case letters of the landmarks as characters 1, 2, ...; other letters as 0, which matches nothing; signs and
    digits fall away."""

    def __init__(self, landmarks: list[str]):
        super().__init__({ord(c): i + 1 for i, c in enumerate(sorted({c for z in landmarks for c in z})[:62])})

    def __missing__(self, code: int) -> int | None:
        self[code] = found = 0 if chr(code).isalpha() else None
        return found

    def __call__(self, word: str) -> bytes:
        return word.lower().translate(self).encode("latin-1").strip(b"\0")


def padded(words: list[bytes]) -> np.ndarray:
    width = max([1, *map(len, words)])
    return np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)


def kernel(words: np.ndarray, landmark: bytes, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """K of each row of `words` (zero-padded) with one landmark. held[p][j]: the weight of all ways to match p letters
    within the landmark's first j and the row so far, both stretches counted up to where we are."""
    n, t = len(words), len(landmark)
    held = np.zeros((order, t + 1, n))
    held[0] = 1.0
    total = np.zeros(n)
    letters = np.frombuffer(landmark, np.uint8)[:, None]
    for column in words.T:
        same = (column[None, :] == letters) & (letters != 0)
        ends = held[:, :t] * same * (decay * decay)  # one letter more, and it is the last of both so far
        total += ends[order - 1].sum(axis=0)
        held[1:] *= decay
        run = np.zeros((order - 1, n))
        for j in range(t):
            run = decay * run + ends[:-1, j]
            held[1:, j + 1] += run
    return total


def letters_shared(words: np.ndarray, of: np.ndarray, tables: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row with landmark `of` that row. tables[z][c]: the places of
    letter c in landmark z, as bits."""
    full = (1 << sizes[of]) - 1
    row = full.copy()
    for column in words.T:
        both = row & tables[of, column]
        row = ((row + both) | (row - both)) & full
    return sizes[of] - np.bitwise_count(row).astype(np.int64)


class Landmarks:
    """Kernel of words with all landmarks, each scaled by its own with itself and at most 1, so that letters which
    match again and again in a long word don't add up."""

    def __init__(self, names: list[str]):
        self.names, self.alphabet = names, Alphabet(names)
        self.codes = [z.lower().translate(self.alphabet).encode("latin-1") for z in names]
        self.tables = np.zeros((len(names), 256), np.int64)
        for i, z in enumerate(self.codes):
            for j, c in enumerate(z):
                if c:
                    self.tables[i, c] |= 1 << j
        self.sizes = np.array([len(z) for z in self.codes], np.int64)
        self.masks = np.array([sum({1 << c for c in z if c}) for z in self.codes], np.uint64)
        # the fewest different letters that ORDER of a landmark's letters can have
        self.least = np.array([self._least(z) for z in self.codes])
        self.own = np.array([kernel(padded([z]), z)[0] for z in self.codes])

    @staticmethod
    def _least(code: bytes) -> int:
        got, least = 0, 0
        for n in sorted((code.count(c) for c in {*code} - {0}), reverse=True):
            if got < ORDER:
                got, least = got + n, least + 1
        return least

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """(words, landmarks): zero wherever fewer than ORDER letters in order are shared, without computing it."""
        out = np.zeros((len(words), len(self.codes)))
        bits = np.uint64(1) << np.arange(256, dtype=np.uint64).clip(max=63)
        for at in range(0, len(words), 4096):
            some = padded(words[at:at + 4096])
            mask = np.bitwise_or.reduce(np.where(some > 0, bits[some], np.uint64(0)), axis=1)
            w, z = np.nonzero(np.bitwise_count(mask[:, None] & self.masks[None, :]) >= self.least[None, :])
            if len(w):
                enough = letters_shared(some[w], z, self.tables, self.sizes) >= ORDER
                w, z = w[enough], z[enough]
            for i in np.unique(z):
                mine = w[z == i]
                out[at + mine, i] = np.minimum(1, kernel(some[mine], self.codes[i]) / self.own[i]) ** 2
        return out

    def windows(self, word: bytes) -> list[bytes]:
        if len(word) <= WINDOW:
            return [word]
        return [word[a:a + WINDOW] for a in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


class Judge:
    """Decisions of the machine on words, kept, and on the sentences of whole texts."""

    def __init__(self, names: list[str], weights: np.ndarray, constant: float):
        self.landmarks, self.weights, self.constant = Landmarks(names), weights, constant
        self.kept: dict[bytes, complex] = {b"": 0j}
        self.before: dict[bytes, complex] = {}
        self.forms: dict[bytes, float] = {}

    def _learn(self, words: list[bytes]) -> None:
        """A word's part of its sentence's decision, with 1j where it ends the sentence."""
        alphabet = self.landmarks.alphabet
        forms = [alphabet(w.decode()) for w in words]
        new = [f for f in {*forms}.difference(self.forms) if len(f) - f.count(0) >= ORDER]
        cut = [(f, part) for f in new for part in self.landmarks.windows(f)]
        for (f, _), d in zip(cut, self.landmarks([part for _, part in cut]) @ self.weights if cut else ()):
            self.forms[f] = max(self.forms.get(f, -np.inf), float(d))
        for w, f in zip(words, forms):
            self.kept[w] = self.forms.get(f, 0.0) + (1j if w[-1:] in (b".", b"!", b"?") else 0)

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """What the decisions on each text's sentences say of it."""
        if len(self.kept) > KEPT:  # the last KEPT or so stay at hand, and what is used again moves on
            self.kept, self.before, self.forms = {b"": 0j}, self.kept, {}
        words = [t.split() for t in texts]
        apart = [APART.findall(t) for t in texts]
        new = set().union(*words, *apart).difference(self.kept)
        self.kept.update((w, self.before[w]) for w in new.intersection(self.before))
        self._learn(list(new.difference(self.kept)))
        out = np.zeros((len(texts), 3))
        for i, (ws, spaced) in enumerate(zip(words, apart)):
            v = np.fromiter(map(self.kept.__getitem__, ws or [b""]), np.complex128)
            first = np.concatenate(([0], np.flatnonzero(v.imag[:-1]) + 1))
            at = np.arange(len(v)) - np.repeat(first, np.diff(np.concatenate((first, [len(v)]))))
            sums = np.add.reduceat(v.real, np.flatnonzero(at % SENTENCE == 0))
            sums = np.concatenate((sums, [self.kept[s].real for s in spaced])) + self.constant
            out[i] = _evidence(sums, np.zeros(1, np.int64))
        return out


def choose(tied: list[tuple[str, int]], common: list[tuple[str, int]], least: float, most: int = LANDMARKS) -> list[str]:
    """Strings within `tied` words (word, times seen) that cover most of what isn't covered yet and few `common`."""
    within: dict[str, set[int]] = {}
    for i, (w, _) in enumerate(tied):
        for a in range(len(w)):
            for b in range(a + ORDER, min(len(w), a + LONGEST) + 1):
                within.setdefault(w[a:b], set()).add(i)
    weight = np.array([n for _, n in tied], float)
    spoilt: dict[str, float] = {}
    for w, n in common:
        for piece in {w[a:b] for a in range(len(w)) for b in range(a + ORDER, min(len(w), a + LONGEST) + 1)}:
            if piece in within:
                spoilt[piece] = spoilt.get(piece, 0.0) + n
    left, chosen = np.ones(len(tied), bool), []
    worth = lambda p, covered: (spoilt.get(p, 0.0) - covered) * (1 - 0.5 ** (len(p) - ORDER + 1))  # noqa: E731  short ones are vague
    queue = [(worth(p, float(sum(weight[i] for i in at))), -len(p), p) for p, at in within.items()]
    heapq.heapify(queue)
    while queue and len(chosen) < most:
        loss, size, piece = heapq.heappop(queue)
        now = worth(piece, float(sum(weight[i] for i in within[piece] if left[i])))
        if now > loss:  # something chosen since covers part of it
            heapq.heappush(queue, (now, size, piece))
            continue
        if -now < least:
            break
        chosen.append(piece)
        left[list(within[piece])] = False
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and constant of the linear machine with squared hinge loss, by Newton steps."""
    full = np.hstack((x, np.ones((len(x), 1))))
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-9
    theta = np.zeros(full.shape[1])

    def loss(th):
        short = np.maximum(0, 1 - y * (full @ th))
        return (weight * short * short).sum() + (penalty * th * th).sum()

    for _ in range(50):
        inside = y * (full @ theta) < 1
        a, w = full[inside], weight[inside]
        step = np.linalg.solve(a.T @ (a * w[:, None]) + np.diag(penalty), a.T @ (w * y[inside]))
        move, size = step - theta, 1.0
        while size > 1e-4 and loss(theta + size * move) > loss(theta):
            size /= 2
        theta = theta + size * move
        if np.abs(size * move).max() < 1e-9:
            break
    return theta


def _evidence(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text's sentences (decisions, first sentence of each text): the highest, and all above zero together."""
    return np.stack((np.maximum.reduceat(sums, starts).clip(-1, 2), np.log1p(np.add.reduceat(np.maximum(0, sums), starts)),
                     np.ones(len(starts))), axis=1)


def _curve(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The logistic curve over evidence, with Platt's softened targets so that it stays finite."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (weight * (target - p)))
        beta = beta + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """The model, trained in one task on its bounded sample."""
    found, share = sample(docs, labels, train_docs)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((d, t.encode(), toxic == 1) for b in batches for d, t, toxic in zip(b["doc_id"], b["text"], b["toxic"]))
        yield pd.DataFrame({"model": [pickle.dumps(train([(t, toxic) for _, t, toxic in rows], share))]})

    row = found.repartition(1).mapInPandas(task, "model binary").first()
    return train([], share) if row is None else pickle.loads(row["model"])


def _sentences(text: bytes) -> list[list[bytes]]:
    out, now = [], []
    for w in text.split():
        now.append(w)
        if w[-1:] in (b".", b"!", b"?") or len(now) == SENTENCE:
            out.append(now)
            now = []
    return [*out, now] if now or not out else out


def sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[DataFrame, float]:
    """The training texts with their labels, and the share of toxic ones among the documents' labels that may be learned
    from. Ids are drawn from labels that have a document; of several rows with one id the largest text counts."""
    there = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    known = (labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("doc_id"))))
    known = stored(known.join(there, "doc_id", "left_semi"), "known")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id")))
    drawn = [known.where(F.col("toxic") == t).orderBy(key).limit(train_docs) for t in (1, 0)]
    found = texts(docs).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return found, sizes.get(1, 0) / max(1, sum(sizes.values()))


def _seen(docs: list[tuple[bytes, bool]]) -> list[tuple[str, int, int]]:
    """Of each word's letters, the different words they follow in toxic and in other documents."""
    number: dict[str, int] = {}
    pairs: tuple[list, list] = ([], [])
    for text, toxic in docs:
        words = ["".join(filter(str.isalpha, w)) for w in text.decode().lower().split()]
        ids = np.array([0] + [number.setdefault(w, len(number) + 1) for w in words if w], np.int64)
        pairs[not toxic].append(np.unique(ids[1:] << 32 | ids[:-1]))
    count = [np.bincount(np.unique(np.concatenate(p)) >> 32, minlength=len(number) + 1) for p in pairs]
    return [(w, int(count[0][i]), int(count[1][i])) for w, i in number.items() if ORDER <= len(w) <= 2 * WINDOW]


def train(docs: list[tuple[bytes, bool]], share: float) -> dict:
    """Landmarks, weights, constant, curve and share of toxic labels."""
    toxic = np.array([t for _, t in docs], bool)
    constant = {"names": [], "weights": np.zeros(0), "constant": 0.0, "curve": np.zeros(3), "share": share}
    if not len(toxic) or toxic.all() or not toxic.any():
        return constant
    seen, ratio = _seen(docs), TIED * toxic.sum() / (~toxic).sum()
    tied = sorted(((w, a) for w, a, b in seen if a >= 2 and a > ratio * b), key=lambda x: (-x[1], x[0]))[:CANDIDATES]
    common = sorted(((w, b) for w, _, b in seen if b), key=lambda x: (-x[1], x[0]))
    names = choose(tied, common, least=max(LEAST_SEEN, LEAST_SHARE * toxic.sum()))
    if not names:
        return constant
    own = {*names}
    names += [w for w in dict.fromkeys(w[:LONGEST] for w, _ in common) if w not in own][:BACKGROUND]

    z = Landmarks(names)
    across = np.stack([kernel(padded(z.codes), c) for c in z.codes], axis=1)
    gram = (across / np.outer(z.own, z.own)) ** 2  # of the scaled landmarks
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T

    number: dict[bytes, int] = {}
    words, of, owner = [], [], []  # of each word its number and its sentence, of each sentence its document
    for i, (text, _) in enumerate(docs):
        for sentence in _sentences(text) + [[m] for m in APART.findall(text)]:
            words += [number.setdefault(w, len(number)) for w in sentence]
            of += [len(owner)] * len(sentence)
            owner.append(i)
    forms = [z.alphabet(w.decode()) for w in number]
    parts = [(i, p) for i, f in enumerate(forms) if len(f) - f.count(0) >= ORDER for p in z.windows(f)]
    best: dict[int, np.ndarray] = {}
    for at in range(0, len(parts), 50_000):
        some = parts[at:at + 50_000]
        vectors_ = z([p for _, p in some])
        for j in np.flatnonzero(vectors_.any(axis=1)):
            i = some[j][0]
            if i not in best or vectors_[j].sum() > best[i].sum():  # of a long word, the window most like a landmark
                best[i] = vectors_[j].copy()
    row = np.full(len(number) + 1, -1, np.int64)
    row[list(best)] = np.arange(len(best))
    words, of, owner = np.array(words, np.int64), np.array(of, np.int64), np.array(owner, np.int64)
    x = np.zeros((len(owner), len(names)))
    if best:
        some = np.flatnonzero(row[words] >= 0)
        np.add.at(x, of[some], np.stack(list(best.values()))[row[words[some]]])
    mapped, bad = x @ root, toxic[owner]
    decision = x[:, :len(own)].sum(axis=1)
    ends = np.concatenate((np.flatnonzero(np.diff(owner)), [len(owner) - 1]))
    starts = np.concatenate(([0], ends[:-1] + 1))
    theta = None
    for _ in range(ROUNDS):
        best = np.maximum.reduceat(decision, starts)
        stands_out = decision >= np.repeat(best, ends - starts + 1)
        pick = np.flatnonzero(bad & (stands_out | ((decision > 0) if theta is not None else False)))
        use = np.concatenate((pick, np.flatnonzero(~bad)))
        y = np.where(bad[use], 1.0, -1.0)
        weight = np.where(bad[use], 0.5 / len(pick), 0.5 / max(1, (~bad).sum()))
        theta = _machine(mapped[use], y, weight)
        decision = mapped @ theta[:-1] + theta[-1]
    weight = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum()) * len(toxic)
    curve = _curve(_evidence(decision, starts), toxic, weight)
    return {"names": names, "weights": root @ theta[:-1], "constant": float(theta[-1]), "curve": curve, "share": share}


def _probability(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -40, 40)))


def _score(model: dict):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model["names"], model["weights"], model["constant"]) if model["names"] else None
        for b in batches:
            texts, found, held = [], [], 0

            def flush():
                if judge is None:
                    found.append(np.full(len(texts), model["share"]))
                else:
                    found.append(_probability(judge.evidence(texts) @ model["curve"]))

            for t in b.column("text"):
                texts.append(t.as_py().encode())
                held += len(texts[-1])
                if held > SLICE:
                    flush()
                    texts, held = [], 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(found))], ["doc_id", "score"])
    return task


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    rows = texts(docs).mapInArrow(_score(model), "doc_id bigint, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted toxic."""
    def judged(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(model["names"], model["weights"], model["constant"]) if model["names"] else None
        for column in columns:
            if judge is None:
                yield pd.Series(np.full(len(column), model["share"]))
                continue
            found, raw, held = [np.zeros(0)], [], 0
            for text in column:
                raw.append(text.encode())
                held += len(raw[-1])
                if held > SLICE:
                    found.append(_probability(judge.evidence(raw) @ model["curve"]))
                    raw, held = [], 0
            if raw:
                found.append(_probability(judge.evidence(raw) @ model["curve"]))
            yield pd.Series(np.concatenate(found))

    return docs.where(F.pandas_udf(returning(judged), "double")(F.coalesce("text", F.lit(""))) < THRESHOLD)
