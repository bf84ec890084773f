import pytest
from pyspark.sql import functions as F

from filmroll.sources.versions import Stale, Versions

SCHEMA = "roll string, n int"


def rows(spark, *pairs):
    return spark.createDataFrame([(r, n) for r, n in pairs], SCHEMA)


def held(v, head=None):
    return sorted(tuple(r) for r in v.read("t", SCHEMA, head).collect())


def test_changes_appear_whole(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert held(v) == [] and v.head().version == 0
    v.commit([v.stage(rows(spark, ("a", 1), ("b", 2)), "t", "roll")], v.head(), by="first")
    before = v.head()
    staged = v.stage(rows(spark, ("b", 3), ("c=/x", 4)), "t", "roll")
    assert held(v) == [("a", 1), ("b", 2)]  # staged rows are seen by nobody
    after = v.commit([staged], before)
    assert held(v) == [("a", 1), ("b", 3), ("c=/x", 4)] and after.facts == {"by": "first"}
    assert held(v, before) == [("a", 1), ("b", 2)]  # readers of the version before keep it
    v.commit([v.stage(rows(spark, ("a", 9)), "t", "roll", replaces=False), v.stage(rows(spark), "t", "roll", also=("b",))], v.head())
    assert held(Versions(spark, str(tmp_path / "v"))) == [("a", 1), ("a", 9), ("c=/x", 4)]


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    v.commit([v.stage(rows(spark, ("a", 1)), "t", "roll")], v.head())
    dies = F.when(F.col("n") < 50, F.col("n")).otherwise(F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception):
        v.stage(spark.range(100).select(F.lit("a").alias("roll"), F.col("id").cast("int").alias("n")).withColumn("n", dies), "t", "roll")
    assert held(Versions(spark, str(tmp_path / "v"))) == [("a", 1)]


def test_a_stale_writer_is_refused(spark, tmp_path):
    one, two = Versions(spark, str(tmp_path / "v")), Versions(spark, str(tmp_path / "v"))
    head = two.head()
    one.commit([one.stage(rows(spark, ("a", 1)), "t", "roll")], one.head())
    with pytest.raises(Stale):
        two.commit([two.stage(rows(spark, ("a", 2)), "t", "roll")], head)
    assert held(two) == [("a", 1)]


def test_of_two_at_once_one_is_refused(spark, tmp_path, monkeypatch):
    """Both have seen the same version when they write their manifests."""
    one, two = Versions(spark, str(tmp_path / "v")), Versions(spark, str(tmp_path / "v"))
    start = two.head()
    one.commit([one.stage(rows(spark, ("a", 1)), "t", "roll")], start)
    real, seen = two.head, []
    monkeypatch.setattr(two, "head", lambda: seen.append(1) or (start if len(seen) == 1 else real()))
    with pytest.raises(Stale):
        two.commit([two.stage(rows(spark, ("a", 2)), "t", "roll")], start)
    monkeypatch.undo()
    assert held(one) == held(two) == [("a", 1)]
