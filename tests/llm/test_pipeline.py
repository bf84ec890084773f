import re

import pytest

import corpus_pipeline
from filmroll.llm import bpe, similar

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, "  ".join(words)), (3, " ".join([*words[:299], "x"])), (4, "other words"), (5, None), (6, ""), (7, "other words"), (None, "other words")]
    docs = spark.createDataFrame([(d, t, "en", "src1", 5, "__id__") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __id__ string")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        seen.append(sorted((r.doc_id for r in out.collect()), key=str))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        docs = out
    assert seen[0] == sorted((d for d, _ in rows), key=str)
    assert seen[1] == [2, 3, 4, 5]  # of equal texts the longest, then the smallest id
    assert seen[2] == [2, 4, 5]  # 2 and 3 share 295 of their 297 shingles


def test_run_against_plain_code(spark):
    """From the documents that the first stage keeps on, every stage by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, toxic), (_, copies), (_, near), (_, mixed), _ = corpus_pipeline.STAGES
    first = toxic(spark, docs, SF)
    kept = {r.doc_id: r.text for r in first.collect()}
    groups = {}
    for d, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    unique = {min(g)[1] for g in groups.values()}
    second = copies(spark, first, SF)
    assert {r.doc_id for r in second.collect()} == unique
    sets = {d: frozenset(similar.shingles(kept[d] or "").tolist()) for d in unique}
    alike = {(a, b) for a in unique for b in unique if a < b and len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b]))}
    third = near(spark, second, SF)
    stay = {r.doc_id for r in third.collect()}
    assert alike and not any(a in stay and b in stay for a, b in alike)  # none is missed here
    assert all(any(p in alike and (p[0] in stay or p[1] in stay) for p in alike if d in p) for d in unique - stay)
    drawn = [r.doc_id for r in mixed(spark, third, SF).collect()]
    library = bpe.Coder.of(bpe.default_path()).tokenizer
    want = sorted((d, len(library.encode(kept[d] or "", add_special_tokens=False).ids)) for d in drawn)
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == want


@pytest.mark.parametrize("columns", ["doc_id long, text string, lang string, source string, n_chars long"])
def test_empty_table(spark, tmp_path, columns):
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
