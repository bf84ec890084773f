import numpy as np

from filmroll.llm import chroma

SCHEMA = "id long, pcm binary, digest string, votes int"


def tune(rng, notes=60):
    freq = np.repeat(440 * 2 ** (rng.integers(-12, 12, notes) / 12), 500)
    return 8000 * np.sin(2 * np.pi * np.cumsum(freq) / chroma.RATE)


def pcm(x):
    return np.round(x).astype("<i2").tobytes()


def search(spark, rows, every=10):
    df = spark.createDataFrame([(i, p, "x", 1) for i, p in rows], SCHEMA)
    return sorted((r.asDict() for r in chroma.search(df, every=every).collect()), key=str)


def test_sums_of_areas_match_the_image():
    rng = np.random.default_rng(3)
    x = tune(rng)
    image, got = chroma.chroma(x), chroma.fingerprint(x)
    shape, y, h, w = chroma.filters()[2]
    for f in (0, 7, len(got) - 1):
        part = image[f:f + w, y:y + h]
        a, b = part[:w // 2].sum(), part[w // 2:].sum()
        level = int(np.digitize(np.log((1 + a) / (1 + b)), chroma.LEVELS))
        assert (int(got[f]) >> 2 * (chroma.FILTERS - 3)) & 3 == level ^ (level >> 1)


def test_aligns_a_cut_and_noisy_recording(spark):
    rng = np.random.default_rng(5)
    a, b = tune(rng), tune(rng)
    later = a[chroma.HOP * 12:] + rng.normal(0, 60, len(a) - chroma.HOP * 12)
    rows = {r["id"]: r for r in search(spark, [(10, pcm(later)), (11, pcm(a)), (12, pcm(a)), (13, pcm(b)), (20, pcm(b))])}
    assert (rows[10]["match_id"], rows[10]["offset"]) == (11, 12) and rows[10]["bit_error"] < 0.1
    assert rows[12]["class_id"] == 11 and rows[12]["match_id"] is None
    assert rows[20]["class_id"] == 13 and rows[20]["n_matches"] == 0


def test_nulls_short_repeats_and_empty_tables(spark):
    x = pcm(tune(np.random.default_rng(1)))
    rows = search(spark, [(None, x), (30, x), (30, x), (31, None), (32, b"\0"), (40, b"")])
    assert len(rows) == 6
    assert {r["class_id"] for r in rows if r["n_frames"]} == {30}
    assert {(r["id"], r["class_id"], r["n_matches"]) for r in rows if not r["n_frames"]} == {(31, 31, None), (32, 31, None), (40, 31, 0)}
    assert search(spark, []) == []


def test_recordings_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.1, float("nan"), None, 3e9]), (2, None), (3, [])], "vec_id long, embedding array<float>")
    assert [len(r.pcm) for r in chroma.recordings(df).orderBy("id").collect()] == [4 * 500 * 2, 0, 0]


def test_recall_against_every_offset(spark):
    """Of all recordings that align with a query within the error allowed, at least nine in ten are found."""
    rng = np.random.default_rng(9)
    tunes = [tune(rng, 40) for _ in range(8)]
    rows = []
    for i in range(160):
        x = tunes[rng.integers(len(tunes))]
        x = x[int(rng.integers(0, 16)) * chroma.HOP:]
        rows.append((i, pcm(x + rng.normal(0, rng.choice([20, 200, 600, 1500]), len(x)))))
    prints = {i: chroma.fingerprint(np.frombuffer(p, "<i2")) for i, p in rows}
    got = {r["id"]: r["n_matches"] for r in search(spark, rows)}
    want = found = 0
    for q in range(0, 160, 10):
        n = 0
        for r in range(160):
            if r != q and not np.array_equal(prints[q], prints[r]):
                a, b = prints[r], prints[q]
                errors = [1.0]
                for offset in range(-len(b), len(a)):
                    x, y = a[max(0, offset):], b[max(0, -offset):]
                    m = min(len(x), len(y))
                    if m >= chroma.LEAST_OVERLAP:
                        errors.append(np.bitwise_count(x[:m] ^ y[:m]).sum() / (32 * m))
                n += min(errors) <= chroma.MOST_ERROR
        want, found = want + n, found + min(n, got[q])
    assert want > 100 and found >= 0.9 * want, (found, want)
