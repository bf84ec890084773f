import numpy as np
import pytest
from pyspark.sql import functions as F

from filmroll.operators.quantiles import channel_quantiles, exact_quantiles, order_statistics

PROBS = {"low": 0.001, "mid": 0.5, "high": 0.995, "top": 1.0}


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(11)
    out = {0: rng.normal(0, 1, 1), 1: rng.normal(0, 1, 2), 2: rng.lognormal(0, 4, 700), 3: np.round(rng.normal(0, 2, 900)),
           4: np.full(400, 0.25), 5: np.concatenate([np.full(300, 1e-7), rng.uniform(0.2, 0.2001, 2500)]),
           6: np.array([0.0, -3.5, 1e7, 1e-7, 1e-300] * 20)}
    return {k: v.astype(float) for k, v in out.items()}


@pytest.fixture(scope="module")
def frame(spark, groups):
    return spark.createDataFrame([(k, float(v), float(-v)) for k, vs in groups.items() for v in vs], "g int, v double, w double").repartition(8)


def test_equals_numpy(frame, groups, paths):
    got = {r.g: r for r in exact_quantiles(frame, ["g"], "v", PROBS).collect()}
    for g, v in groups.items():
        assert got[g].n == len(v)
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.percentile(v, p * 100), rel=1e-12, abs=1e-300)


def test_several_columns(frame, groups, paths):
    got = {r.g: r for r in channel_quantiles(frame, ["g"], ["v", "w"], {"q": 0.3}).collect()}
    for g, v in groups.items():
        assert got[g].v_q == pytest.approx(np.percentile(v, 30), rel=1e-12, abs=1e-300)
        assert got[g].w_q == pytest.approx(np.percentile(-v, 30), rel=1e-12, abs=1e-300)


def test_ties_are_counted(frame, groups, paths):
    found = order_statistics(frame, ["g"], "v", lambda n: F.array(F.floor(n / 3).cast("bigint"), F.floor(n / 2).cast("bigint")), ties=True)
    seen = found.collect()
    assert {r.g for r in seen} == set(groups)
    for r in seen:
        s = np.sort(groups[r.g])
        assert (r.value, r.below, r.equal) == (s[r["rank"]], (s < r.value).sum(), (s == r.value).sum())


def test_one_group_holds_most_rows(spark, paths):
    """A hot group is counted, not gathered: same answer, and no task sees its values together."""
    hot = spark.range(60000).select(F.lit(1).alias("g"), (F.xxhash64("id") % 100000 / 7.0).alias("v"))
    cold = spark.range(300).select((F.col("id") % 30 + 2).cast("int").alias("g"), F.col("id").cast("double").alias("v"))
    df = hot.union(cold)
    got = {r.g: r.mid for r in exact_quantiles(df, ["g"], "v", {"mid": 0.5}).collect()}
    want = {r.g: r.mid for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("mid")).collect()}
    assert got == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf"), None])
def test_both_paths_agree_on_bad_values(spark, bad):
    rows = [("a", float(i), -float(i)) for i in range(100)] + [("a", bad, 1.0), ("b", 1.0, 2.0), ("b", 3.0, None), ("c", None, None), ("d", bad, bad)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    found = []
    for small in ("0", "20000"):
        spark.conf.set("spark.filmroll.quantile.smallGroupRows", small)
        found.append(sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                            for r in channel_quantiles(df, ["g"], ["v", "w"], {"q": 0.3, "r": 0.9}).collect()))
    spark.conf.unset("spark.filmroll.quantile.smallGroupRows")
    assert repr(found[0]) == repr(found[1])
    got = {r[0]: r for r in found[0]}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"][2], got["a"][3] is None) == ((0, False) if bad is None else (1, True))
    assert got["c"][1:3] == (0, 0) and got["c"][3] is None
