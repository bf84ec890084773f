"""BPE encoding and decoding of whole texts with a public vocabulary, by tree concatenation.

The vocabulary lower-cases, drops white space and marks word ends, so nothing it does reaches over a space or
U+0009-U+000D: texts are cut there into stretches, and each distinct one is encoded once per batch: plain Latin ones word by
word by the library's model alone, since nothing else of it changes them but case, the others by the whole library.

A text of more than `long` characters, or with a stretch of more than `leaf` bytes, is encoded in parts, one row each, dealt
out over all tasks, whose encodings are joined in a tree:

* A long text is cut in halves at any character, within words too (but not within a special token's string), until the
  parts are short. Where two neighbours meet within a stretch, windows around the join are encoded again. They start and
  end where a letter or digit is followed by another kind of character, which is the start of a word whatever
  comes before or after, and grow until their first token is the left side's there and their last one the right side's.
* A long stretch is first cut as the library's normalizer and pre-tokenizer cut it. What they leave longer than `leaf` symbols
  is one unsplit word, and a merge could in principle reach over all of it. Its halves, cut again until they are short,
  are joined by windows of the last k tokens left of a join and the first k right of it; k doubles until both sides agree.

Agreement is exact, not a guess: a sequence of BPE tokens is the encoding of its word if and only if each two neighbours
are the encoding of theirs, because the first merge that crosses a boundary would also cross it if only the two tokens
beside it were there. All pairs left of the window's first token come from the left side's encoding, all pairs in the
window from the window's, all pairs right of its last token from the right side's.

Defined cases: a null or empty text, or one of white space, has no tokens and decodes to the empty text; strings of
special tokens in a text become special tokens, as in the library; repeated rows each get a row; null ids stay
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import returning, stored, texts

#: Bytes of a stretch, or symbols of unsplit text, that one call encodes.
LEAF = 1024
#: Characters of a text that one row encodes.
LONG = 16_384
WORD_END = "</w>"
#: Stretches whose characters are settled: no normal form but their own, lower case one character for one.
PLAIN = re.compile(r"(?!.*<\|)[\x21-\x7e\u00a1-\u012f]+")
#: The pre-tokenizer's pattern, a fixed value of the vocabulary file.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same, over a list of stretches.
WORDS_OF = regex.compile(r"\n|" + WORD.pattern)
#: White space that texts are cut at, a fixed value.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on, in order.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SYMBOLS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_OWN)))}


class Limits(NamedTuple):
    """Bounds on a worker's memory, not on what is encoded: stretches and words kept between batches (twice as many are held, and at
    least those of a slice), and the text bytes worked on at a time."""
    kept: int = 60_000
    words: int = 100_000
    slice: int = 4 << 20


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Side:
    """A part of a text: its ids, and the stretches it starts and ends with, if it does, with their numbers of tokens; `whole`:
    it is one stretch."""
    ids: bytes
    head: str
    head_n: int
    tail: str
    tail_n: int
    whole: bool

    @classmethod
    def each(cls, coder: Coder, texts_: list[str]) -> list[Side]:
        out = []
        for text, (ids, _) in zip(texts_, coder.encode([t.encode().split() for t in texts_])):
            tail = text[1 + max(text.rfind(c) for c in SPACE):]
            head = text[:min((at for c in SPACE if (at := text.find(c)) >= 0), default=len(text))]
            n, m = (len(coder.ids[x.encode()]) // 4 if x else 0 for x in (head, tail))
            out.append(cls(ids, head, n, tail, m, len(head) == len(text)))
        return out


class Coder:
    """The vocabulary of one file, with encoders for whole stretches and for parts of unsplit text."""

    _loaded: dict[str, Coder] = {}

    @classmethod
    def of(cls, path: str, limits: Limits = Limits()) -> Coder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        cls._loaded[path].limits = limits
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        cut = spec["pre_tokenizer"].get("pretokenizers", [{}])[0]
        if (model.get("end_of_word_suffix"), cut.get("behavior"), cut.get("pattern", {}).get("Regex")) != (WORD_END, "Removed", WORD.pattern):
            raise ValueError("a vocabulary with word ends, whose pre-tokenizer drops white space, is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.final = self.tokenizer.model
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # without a decoder tokens are joined by spaces
        size = self.tokenizer.get_vocab_size()
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)] if spec.get("decoder") is None else None
        self.small = "<u2" if size <= 1 << 16 else "<u4"
        self.limits = Limits()
        self.ids: dict[bytes, bytes] = {}
        self.said: dict[bytes, bytes] = {}
        self.before: dict[bytes, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.words_before: dict[str, tuple[bytes, bytes]] = {}

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """Ids and decoded text of one plain word in lower case."""
        found = self.words_before.get(word)
        if found is None:
            tokens = self.final.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(SYMBOLS))
            found = _bytes([t.id for t in tokens]), " ".join([t.value for t in tokens]).encode()
        self.words[word] = found
        return found

    def _encode_new(self, stretches: list[bytes]) -> None:
        """Plain stretches are cut here as the library would cut them, and encoded by its model word by word; all
        others go through the whole library."""
        text = [s.decode() for s in stretches]
        other = [s for s in text if PLAIN.fullmatch(s) is None]
        if other:
            refused = set(other)
            text = [s for s in text if s not in refused]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            for s, i, d in zip(other, ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False)):
                self.ids[s.encode()], self.said[s.encode()] = _bytes(i), d.encode()
        found, at, known = [], 0, self.words
        for w in WORDS_OF.findall("\n".join(text).lower() + "\n" if text else ""):
            if w != "\n":
                found.append(known.get(w) or self._word(w))
                continue
            s = text[at].encode()
            at += 1
            if len(found) == 1:
                self.ids[s], self.said[s] = found[0]
            else:
                self.ids[s], self.said[s] = b"".join([f[0] for f in found]), b" ".join([f[1] for f in found])
            found = []

    def encode(self, words: list[list[bytes]]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of documents cut at white space."""
        if len(self.ids) > self.limits.kept:  # the last so many stay at hand, and what is used again moves on
            self.before = {s: (i, self.said[s]) for s, i in self.ids.items()}
            self.ids, self.said = {}, {}
        if len(self.words) > self.limits.words:
            self.words, self.words_before = {}, self.words
        new = set().union(*words).difference(self.ids)
        for s in new.intersection(self.before):
            self.ids[s], self.said[s] = self.before[s]
        new.difference_update(self.before)
        if new:
            self._encode_new(list(new))
        ids, said = self.ids.__getitem__, self.said.__getitem__
        out = []
        for ws in words:
            told = b" ".join(map(said, ws))
            if b"  " in told or told[:1] == b" " or told[-1:] == b" ":  # some stretch has no tokens
                told = b" ".join(filter(None, map(said, ws)))
            out.append((b"".join(map(ids, ws)), told))
        return out

    def decoded(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.tokens is not None:
            return b" ".join(map(self.tokens.__getitem__, numbers))
        return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()

    def pieces(self, stretch: str) -> list[tuple[list[int] | None, str | None]]:
        """A long stretch as the library cuts it: ids of what is short, symbols of what is long."""
        out = []
        for at, part in enumerate(self.special.split(stretch) if self.special else [stretch]):
            if at % 2:
                out.append(([self.tokenizer.token_to_id(part)], None))
            elif part:
                if self.tokenizer.normalizer is not None:
                    part = self.tokenizer.normalizer.normalize_str(part)
                out += [(None, symbols) for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def part(self, symbols: str, final: bool) -> list[int]:
        """Ids of a run of symbols: at the end of a word, or within one."""
        return [t.id for t in (self.final if final else self.inner).tokenize(symbols)]

    def text(self, ids: list[int]) -> str:
        return "".join(map(self.tokenizer.id_to_token, ids))

    def join(self, left: list[int], right: list[int], final: bool) -> list[int]:
        """The encoding of two neighbours' text from theirs; `final`: a word ends with `right`."""
        k = 1
        while True:
            all_left, all_right = k >= len(left), k >= len(right)
            symbols = self.text(left[-k:]) + self.text(right[:k])
            at_end = all_right and final
            window = self.part(symbols.removesuffix(WORD_END) if at_end else symbols, at_end)
            if (all_left or window[0] == left[-k]) and (all_right or window[-1] == right[k - 1]):
                return left[:-k] + window + right[k:]
            k *= 2

    def tree(self, parts: list[list[int]], final: bool) -> list[int]:
        if len(parts) == 1:
            return parts[0]
        mid = len(parts) // 2
        return self.join(self.tree(parts[:mid], False), self.tree(parts[mid:], final), final)


    def edges(self, raw: str) -> tuple[list[int], dict[int, int], dict[int, int]]:
        """Ids of a stretch; and where a token starts, or ends, at a place that is a word's start whatever is around it: how
        many tokens follow, or come before."""
        found = self.tokenizer.encode(raw, add_special_tokens=False)
        starts, ends = {}, {}
        for k, (a, b) in enumerate(found.offsets):
            if a and _bounds(raw[a - 1], raw[a]):
                starts[a] = len(found.ids) - k
            if b < len(raw) and _bounds(raw[b - 1], raw[b]):
                ends[b] = k + 1
        return found.ids, starts, ends

    def joined(self, left: str, right: str) -> bytes:
        """Ids of a stretch from those of its two sides."""
        ids, starts, _ = self.edges(left)
        more, _, ends = self.edges(right)
        before, after = [*sorted(starts, reverse=True), 0], [*sorted(ends), len(right)]
        k = 1
        while True:
            a, b = before[min(k, len(before)) - 1], after[min(k, len(after)) - 1]
            window = self.tokenizer.encode(left[a:] + right[:b], add_special_tokens=False)
            n, m = starts.get(a, len(ids)), ends.get(b, len(more))
            first = not a or (window.ids and window.ids[0] == ids[-n] and window.offsets[0][0] == 0)
            last = b == len(right) or (window.ids and window.ids[-1] == more[m - 1] and window.offsets[-1][1] == len(left) - a + b)
            if first and last:
                return _bytes(ids[:len(ids) - n] + window.ids + more[m:])
            k *= 2

    def beside(self, left: Side, right: Side) -> Side:
        """Two neighbouring parts of a text as one."""
        ids, middle = left.ids + right.ids, left.tail_n + right.head_n
        if left.tail and right.head:
            again = self.joined(left.tail, right.head)
            ids = left.ids[:len(left.ids) - 4 * left.tail_n] + again + right.ids[4 * right.head_n:]
            middle = len(again) // 4
        head = (left.head + right.head, middle) if left.whole else (left.head, left.head_n)
        tail = (left.tail + right.tail, middle) if right.whole else (right.tail, right.tail_n)
        return Side(ids, *head, *tail, left.whole and right.whole)

    def text_tree(self, parts: list[Side]) -> Side:
        if len(parts) == 1:
            return parts[0]
        mid = len(parts) // 2
        return self.beside(self.text_tree(parts[:mid]), self.text_tree(parts[mid:]))

    def cut(self, text: str, long: int) -> list[str]:
        """Halved until short enough, outside of special tokens' strings."""
        if len(text) <= long:
            return [text]
        mid = len(text) // 2
        for found in self.special.finditer(text, max(0, mid - 64), mid + 64) if self.special else ():
            if found.start() < mid < found.end():
                mid = found.start() or found.end()
        return [text] if mid in (0, len(text)) else self.cut(text[:mid], long) + self.cut(text[mid:], long)


def _bounds(left: str, right: str) -> bool:
    """Whether a word starts between two characters, whatever is around them."""
    kind, other = unicodedata.category(left)[0], unicodedata.category(right)[0]
    return kind in "LN" and other in "NPS" or kind == "N" and other == "L"


def halves(symbols: str, leaf: int) -> list[str]:
    """Halved until short enough."""
    if len(symbols) <= leaf:
        return [symbols]
    mid = len(symbols) // 2
    return halves(symbols[:mid], leaf) + halves(symbols[mid:], leaf)


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


#: What is told of an encoded text: its ids and decoded text, or their digests.
WHOLE = ("ids binary, decoded string", pa.schema([("ids", pa.binary()), ("decoded", pa.string())]), lambda ids, said: (ids, said.decode()))
DIGESTS = ("n_tokens bigint, ids_sha256 string, decoded_sha256 string",
           pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
           lambda ids, said: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said).hexdigest()))
_ENDS = ["head", "head_n", "tail", "tail_n", "whole"]
_PARTS = "doc_id bigint, row string, part int, leaf int, leaves int, done binary, symbols string"
_PART_FIELDS = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("part", pa.int32()), ("leaf", pa.int32()), ("leaves", pa.int32()),
                          ("done", pa.binary()), ("symbols", pa.string())])


def _parts_of(coder: Coder, doc: int | None, stretches: list[bytes], leaf: int) -> list[tuple]:
    """Rows of a text with a long stretch: ready ids, and parts of unsplit words."""
    row, rows, ready = uuid.uuid4().hex, [], []

    def flush():
        rows.append((doc, row, len({r[2] for r in rows}), 0, 1, b"".join(ready), None))
        ready.clear()

    for s in stretches:
        if len(s) <= leaf:
            ready.append(coder.encode([[s]])[0][0])
            continue
        for ids, symbols in coder.pieces(s.decode()):
            if ids is None and len(symbols) <= leaf:
                ids = coder.part(symbols, True)
            if ids is not None:
                ready.append(_bytes(ids))
                continue
            flush()
            cut, part = halves(symbols, leaf), len({r[2] for r in rows})
            rows += [(doc, row, part, i, len(cut), None, t) for i, t in enumerate(cut)]
    flush()
    return rows


def _first(path: str, leaf: int, out: tuple, limits: Limits):
    """Encodes texts, and cuts those with a long stretch."""
    _, fields, told = out
    schema = pa.schema([*_PART_FIELDS, *fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, limits)

        def batch(docs, words, others):
            rows = [(d, *[None] * (len(_PART_FIELDS) - 1), *told(*f)) for d, f in zip(docs, coder.encode(words))]
            rows += [(*r, *[None] * len(fields)) for r in others]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            docs, words, others, held = [], [], [], 0
            for d, t in zip(b.column("doc_id"), b.column("text")):
                doc, raw = d.as_py(), t.as_py().encode()
                stretches = raw.split()
                held += len(raw)
                if len(raw) > leaf and max(map(len, stretches), default=0) > leaf:
                    others += _parts_of(coder, doc, stretches, leaf)
                else:
                    docs.append(doc)
                    words.append(stretches)
                if held > limits.slice:
                    yield batch(docs, words, others)
                    docs, words, others, held = [], [], [], 0
            if docs or others:
                yield batch(docs, words, others)
    return task


def _cut_texts(path: str, long: int):
    """The parts of long texts. A row is named by what is in it, so a task that is run again names it the same; rows that repeat
    share their parts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path)
        for b in batches:
            for d, t in zip(b.column("doc_id"), b.column("text")):
                text = t.as_py()
                cut, row = coder.cut(text, long), hashlib.blake2b(f"{d.as_py()} {text}".encode(), digest_size=16).hexdigest()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d.as_py()] * len(cut), pa.int64()), "row": [row] * len(cut),
                                                  "part": pa.array(range(len(cut)), pa.int32()), "text": pa.array(cut, pa.string())})
    return task


def _encode_texts(path: str, limits: Limits):
    """Ids of each part, and the stretches at its ends, which its neighbours' may go on with."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder.of(path, limits)
        for b in batches:
            group = b["text"].str.len().cumsum() // limits.slice
            for _, part in b.groupby(group):
                found = Side.each(coder, part["text"].tolist())
                yield part[["doc_id", "row", "part"]].assign(
                    ids=[np.frombuffer(f.ids, "<u4").astype(coder.small).tobytes() for f in found],
                    **{c: [getattr(f, c) for f in found] for c in _ENDS}).astype({"doc_id": "Int64"})
    return task


def _join_texts(path: str, out: tuple):
    _, fields, told = out

    def task(group: pd.DataFrame) -> pd.DataFrame:
        coder, copies = Coder.of(path), int((group["part"] == 0).sum())
        group = group.drop_duplicates("part").sort_values("part")
        sides = [Side(np.frombuffer(i, coder.small).astype("<u4").tobytes(), *ends) for i, ends in zip(group["ids"], group[_ENDS].itertuples(index=False, name=None))]
        one = _row(coder, group, coder.text_tree(sides).ids, fields, told)
        return one.loc[one.index.repeat(copies)]
    return task


def _row(coder: Coder, group: pd.DataFrame, ids: bytes, fields: pa.Schema, told) -> pd.DataFrame:
    return group.head(1).assign(**{f.name: [v] for f, v in zip(fields, told(ids, coder.decoded(ids)))})[["doc_id", *fields.names]].astype({"doc_id": "Int64"})


def _encode_leaves(path: str):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder.of(path)
        for b in batches:
            b["done"] = [_bytes(coder.part(symbols, leaf == leaves - 1)) for symbols, leaf, leaves in zip(b["symbols"], b["leaf"], b["leaves"])]
            yield b[["doc_id", "row", "part", "leaf", "done"]].astype({"doc_id": "Int64"})
    return task


def _join_leaves(path: str):
    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("leaf")
        ids = Coder.of(path).tree([np.frombuffer(x, "<u4").tolist() for x in group["done"]], True)
        return group.head(1).assign(done=[_bytes(ids)])[["row", "doc_id", "part", "done"]].astype({"doc_id": "Int64"})
    return task


def _whole(path: str, out: tuple):
    _, fields, told = out

    def task(group: pd.DataFrame) -> pd.DataFrame:
        return _row(Coder.of(path), group, b"".join(group.sort_values("part")["done"]), fields, told)
    return task


def _encoded(docs: DataFrame, path: str | None, leaf: int, long: int, limits: Limits, out: tuple) -> DataFrame:
    path, columns, t = path or default_path(), out[1].names, texts(docs)
    # no stretch of more than `leaf` bytes has as few characters as this
    cut = (F.char_length("text") > long) & ~F.col("text").rlike(f"[^\\x20\\x09-\\x0D]{{{leaf // 4 + 1},}}")
    first = stored(t.where(~cut).mapInArrow(returning(_first(path, leaf, out, limits)), f"{_PARTS}, {out[0]}"), "encoded")
    parts = first.where("row is not null")
    leaves = parts.where("done is null").repartition("row", "part", "leaf").mapInPandas(
        _encode_leaves(path), "doc_id bigint, row string, part int, leaf int, done binary")
    joined = leaves.groupBy("row", "part").applyInPandas(_join_leaves(path), "row string, doc_id bigint, part int, done binary")
    ready = parts.where("done is not null").select("row", "doc_id", "part", "done")
    whole = ready.union(joined).groupBy("row").applyInPandas(_whole(path, out), f"doc_id bigint, {out[0]}")
    sides = (t.where(cut).mapInArrow(_cut_texts(path, long), "doc_id bigint, row string, part int, text string").repartition("row", "part")
             .mapInPandas(returning(_encode_texts(path, limits)), "doc_id bigint, row string, part int, ids binary, head string, head_n int, tail string, tail_n int, whole boolean"))
    texts_ = stored(sides, "sides").groupBy("row").applyInPandas(_join_texts(path, out), f"doc_id bigint, {out[0]}")
    return first.where("row is null").select("doc_id", *columns).union(whole).union(texts_)


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, long: int = LONG, limits: Limits = Limits()) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text of every row of `docs`."""
    return _encoded(docs, path, leaf, long, limits, WHOLE)


def digests(docs: DataFrame, path: str | None = None, leaf: int = LEAF, long: int = LONG, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row of `docs`, made where the ids are."""
    return _encoded(docs, path, leaf, long, limits, DIGESTS)
