import pyarrow.parquet as pq
import pytest

from filmroll.llm import queries, token_cache

TEXTS = [(1, "The cat sat."), (2, None), (3, ""), (4, "<s> x </s> <unk>"), (5, "日本語 é ́x\x00y"), (6, "The cat sat."), (None, "nobody"), (7, " \n\t "),
         (7, " \n\t "), (8, "word " * 6000), (9, "a" * 50_000), (9, "other")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, b"x", 1, 2) for i, t in rows], "doc_id long, text string, digest binary, n_tokens int, version int")


def want(rows, path=None):
    counter = token_cache.Counter(path or token_cache.default_path())
    return sorted(((i, len((t or "").encode()), counter.counts([t or ""])[0]) for i, t in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def held(cache):
    return pq.read_table(cache).num_rows


@pytest.mark.parametrize("broadcasts", [True, False])
def test_counts_are_the_library_s_and_are_kept(spark, monkeypatch, broadcasts):
    cache = token_cache.new_cache(spark)
    if not broadcasts:
        spark.conf.set("spark.filmroll.broadcastBytes", "0")
    try:
        assert got(token_cache.count(frame(spark, TEXTS), cache)) == want(TEXTS)
        distinct = len({t or "" for _, t in TEXTS})
        assert held(cache) == distinct
        more = [*TEXTS, (10, "A text that is new."), (11, "A text that is new.")]
        assert got(token_cache.count(frame(spark, more), cache)) == want(more)
        assert held(cache) == distinct + 1  # only the miss was encoded and added, once
    finally:
        spark.conf.unset("spark.filmroll.broadcastBytes")


def test_stored_counts_are_taken(spark):
    cache, path = token_cache.new_cache(spark), token_cache.default_path()
    token_cache.count(frame(spark, TEXTS[:1]), cache)
    row = spark.read.parquet(cache).first()
    spark.createDataFrame([(row.digest, 77, row.version)], token_cache.CACHE).write.mode("overwrite").partitionBy("version").parquet(other := token_cache.new_cache(spark))
    assert got(token_cache.count(frame(spark, TEXTS[:1]), other)) == [(1, 12, 77)]
    assert row.version == token_cache.version(path)


def test_another_vocabulary_has_its_own_counts(spark):
    import public_tokenizers
    cache, path = token_cache.new_cache(spark), public_tokenizers.path("byte_bpe_50k.json")
    token_cache.count(frame(spark, TEXTS), cache)
    assert got(token_cache.count(frame(spark, TEXTS), cache, path)) == want(TEXTS, path)


def test_a_hot_text_and_repeats_in_the_cache(spark, monkeypatch):
    monkeypatch.setattr(token_cache, "HOT", 10)
    rows = [(i, "the same text") for i in range(60)] + [(i, f"text {i % 40}") for i in range(60, 160)]
    cache = token_cache.new_cache(spark)
    assert got(token_cache.count(frame(spark, rows), cache)) == want(rows)
    spark.read.parquet(cache).write.mode("append").partitionBy("version").parquet(twice := token_cache.new_cache(spark))
    spark.read.parquet(cache).write.mode("append").partitionBy("version").parquet(twice)
    assert got(token_cache.count(frame(spark, rows), twice)) == want(rows)


def test_empty_table(spark):
    assert got(token_cache.count(frame(spark, []), token_cache.new_cache(spark))) == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = queries.op13_token_counts(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got(df) == sorted(((*w, w[2] > 4096) for w in want(rows)), key=str)
