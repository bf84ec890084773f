import hashlib
import random

import numpy as np
import pytest

from filmroll.llm import bpe

SCHEMA = "doc_id long, text string, ids string, row int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_path())


def want(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, leaf=bpe.LEAF, long=bpe.LONG):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    found = sorted((tuple(r) for r in bpe.digests(df, leaf=leaf, long=long).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert found == sorted(((r.doc_id, len(r.ids) // 4, sha(r.ids), sha(r.decoded.encode())) for r in bpe.encode(df, leaf=leaf, long=long).collect()), key=str)
    return found


def test_joins_are_exact(library):
    coder, rnd = bpe.Coder.of(bpe.default_path()), random.Random(2)
    for _ in range(400):
        s = "".join(rnd.choice(rnd.choice(["ab", "the", "ing", "aàé", "-.!", "日本", "'sre"])) for _ in range(rnd.randint(10, 200)))
        ids = []
        for ready, symbols in coder.pieces(s):
            cut = bpe.halves(symbols, rnd.choice([1, 2, 7, 30])) if symbols else []
            ids += ready or coder.tree([coder.part(c, i == len(cut) - 1) for i, c in enumerate(cut)], True)
        assert ids == library.encode(s, add_special_tokens=False).ids


def test_every_plain_character_beside_others(library):
    coder = bpe.Coder.of(bpe.default_path())
    texts = [f"{a}{chr(i)}{b}" for i in range(1, 0x180) for a in ("", "a", ".", "1", "é") for b in ("", "B", "!", "2")]
    texts += [f"x'{y} {y}" for y in "S T RE VE M LL D s t re ve m ll d z".split()]
    for t, (ids, said), e in zip(texts, coder.encode([t.encode().split() for t in texts]), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert said.decode() == library.decode(e.ids, skip_special_tokens=False), t


def test_texts_cut_anywhere(library):
    """Words, contractions, marks that compose, special tokens and white space at every cut."""
    coder, rnd = bpe.Coder.of(bpe.default_path()), random.Random(4)
    bits = ["ab", "the", "ing", " ", " ", "\n", "'s", "'re", "!'", "...", "e\u0301", "\u0301", "é", "日本", "12", "<|endoftext|>", "<|", "|>", "A", "Σ", "İ", "ſ", "\u00a0", "\x85", "가", "\u11a8"]
    for _ in range(1500):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(2, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        parts = coder.cut(text, rnd.choice([1, 3, 10]))
        assert "".join(parts) == text
        ids = coder.text_tree(bpe.Side.each(coder, parts)).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text


def test_given_documents_are_joined(spark, library, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = [t for _, t in rows if len(t) > bpe.LONG]
    coder = bpe.Coder.of(bpe.default_path())
    assert long
    joins, joined = [], coder.joined
    monkeypatch.setattr(coder, "joined", lambda a, b: joins.append((a, b)) or joined(a, b))
    for t in long:
        parts = coder.cut(t, bpe.LONG)
        ids = coder.text_tree(bpe.Side.each(coder, parts)).ids
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert joins  # words were cut, and their sides joined by windows
    assert got(spark, rows) == want(library, rows)


@pytest.mark.parametrize("leaf, long", [(bpe.LEAF, bpe.LONG), (16, 40)])
def test_whole_texts(spark, library, leaf, long):
    rnd = random.Random(leaf)
    unsplit = "".join(rnd.choice("abcdefghijkl") for _ in range(5000))
    rows = [(1, unsplit), (2, f"a {unsplit}<|endoftext|>{unsplit[::-1]} b"), (3, "<|startoftext|>x y"), (4, None), (5, ""), (6, " \n"), (7, "ΑΣ İ é ́x"),
            (None, "nobody"), (8, "twice"), (8, "twice"), (13, "words and more " * 9), (13, "words and more " * 9), (None, "words and more " * 9), (9, "!" * 3000 + "é" * 3000), (10, "Word " * 30_000), (11, "日本語" * 900), (12, "a b\x85c　d\x1ce")]
    assert got(spark, rows, leaf, long) == want(library, rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_other_vocabularies_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))
