import json

import duckdb
import pytest
from pyspark.sql import functions as F

from filmroll.functions import text
from filmroll.functions.scan import describe_scan, hex_float
from filmroll.operators import rolls, scans, summary
from filmroll.operators.ordering import number_within
from filmroll.operators.pixels import clean_nonfinite, nonfinite_report
from filmroll.session import attach, materialize
from filmroll.sources import profiles as pf
from filmroll.sources.pixels import normalise_samples, read_developed, write_developed
from filmroll.sources.provenance import provenance_record, read_provenance
from filmroll.sources.runlog import log_rows, previous_unfinished
from filmroll.sources.versions import Stale, Versions
from filmroll.sources.scans import edit_history, edit_state, scan_settings


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_attach_both_ways(spark, how, paths):
    big = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(k, f"name {k}") for k in (1, 2, 9)], "k bigint, label string")
    got = sorted(map(tuple, attach(big, small, ["k"], how).collect()), key=str)
    want = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=str)
    assert got == want


def test_stored_tables_know_their_size(spark):
    stored = materialize(spark.range(100).withColumn("s", F.repeat(F.lit("x"), 50)), "t")
    assert 100 * 60 < stored.measured_bytes < 100 * 400 and stored.count() == 100


def test_numbering_across_slices(spark, paths):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), F.xxhash64("id").alias("k"))
    rows = number_within(df, ["g"], ["k"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.g, []).append((r.n, r.k))
    for pairs in by.values():
        pairs.sort()
        assert [n for n, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [k for _, k in pairs] == sorted(k for _, k in pairs)


def test_natural_order(spark):
    names = ["frame_10.tif", "frame_2.tif", "frame_1.tif", "f01", "f1", "f001", "a", "10", "9", "IMG_0138.tif", "IMG_0139.tif", "x99999999999999999999999", "x100000000000000000000000"]
    got = [r.name for r in rolls.natural_order(spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    assert got == ["9", "10", "IMG_0138.tif", "IMG_0139.tif", "a", "f001", "f01", "f1", "frame_1.tif", "frame_2.tif", "frame_10.tif",
                   "x99999999999999999999999", "x100000000000000000000000"]


@pytest.mark.parametrize("value", [0.0, 8.0, 2.8, 0.5, 100.0, 1600.0, 999999.0, 999999.5, 1234567.0, 0.0001, 0.00001234, 1.5, 123456.5, 123457.5, -2.25, 10788850.0])
def test_general_number(spark, value):
    assert spark.range(1).select(text.general_number(F.lit(value)).alias("t")).first().t == f"{value:g}"


@pytest.mark.parametrize("value", [1.25, 1.35, 2.25, 0.05, 1.45, 99.95, 0.0, -1.25, 33.35])
def test_fixed(spark, value):
    assert spark.range(1).select(text.fixed(F.lit(value), 1).alias("t")).first().t == f"{value:.1f}"


def test_log_rounds_as_sql(spark):
    row = dict(roll_id=1, frame_id=1, name="a.tif", error=None, warning=None, seconds=30.05, grade=0.615, exposure=-0.001, linear_scale=None, grade_fitted=True, gain=1.115)
    kinds = "roll_id int, frame_id int, name string, error string, warning string, seconds double, grade double, exposure double, linear_scale double, grade_fitted boolean, gain double"
    rows = spark.createDataFrame([tuple(row.values()), tuple((row | {"linear_scale": 0.8105}).values())], kinds)
    sql = duckdb.sql("SELECT printf('%.1f', round(30.05e0, 1)) || 's', printf('%.2f', round(0.615e0, 2)), printf('%+.2f', round(-0.001e0, 2)), printf('%.2f', round(1.115e0, 2)), 'flat x' || printf('%.3f', round(0.8105e0, 3))").fetchall()[0]
    paper, flat = log_rows(rows, "develop").collect()
    assert (paper.time, paper.grade, paper.exposure, paper.gain, flat.grade) == sql


def test_share_of_bad_pixels_at_a_tie(spark):
    rows = spark.range(800).select(F.lit(1).alias("roll_id"), F.lit(2).alias("frame_id"), F.col("id").alias("y"), F.lit(0).alias("x"), F.when(F.col("id") < 10, float("nan")).otherwise(0.5).alias("r"), F.lit(0.5).alias("g"), F.lit(0.5).alias("b"))
    assert nonfinite_report(clean_nonfinite(rows)).first().message == "1.2% of its pixels aren't valid numbers"


def test_describe_scan(spark):
    row = spark.range(1).select(describe_scan(F.lit(1 / 30), F.lit(8.0), F.lit(100.0)).alias("a"), describe_scan(F.lit(2.5), F.lit(5.6), F.lit(6400.0)).alias("b")).first()
    assert (row.a, row.b) == ("1/30 f/8 ISO100", "2.5s f/5.6 ISO6400")


def test_hex_floats(spark):
    import struct
    values = [2.0, -1.5, 0.0, 1e-40, 3.4e38, float("inf"), 1.7]
    rows = spark.createDataFrame([(i, struct.pack("<f", v).hex()) for i, v in enumerate(values)], "i int, h string")
    for r in rows.select("i", hex_float(F.col("h"), 1).alias("v")).collect():
        assert r.v == struct.unpack("<f", struct.pack("<f", values[r.i]))[0]


def test_names_and_problems(spark):
    df = spark.createDataFrame([("a/b:c", 7, None), (".x", 123, "Gold"), ("  ", 1, "Gold")], "stem string, n int, stock string")
    def out(template):
        name, problem = text.output_name(template, F.col("stem"), F.lit("roll 1"), F.col("n"), F.col("stock"))
        return [tuple(r) for r in df.select(name.alias("a"), problem.alias("b")).collect()]
    assert out("{roll}_{n:02}") == [("roll 1_07", None), ("roll 1_123", None), ("roll 1_01", None)]
    assert out("{stem}{stock}") == [("a-b-c", None), (None, "gives a hidden file"), ("Gold", None)]
    assert out("{stem}")[2] == (None, "renders an empty name")
    for bad in ("", "a/b", "{roll:02}", "{frame}", "{n:3}", "{n!r}", "{stock}", " {stock} ", "{stock}.x", "{n", "n}"):
        with pytest.raises(ValueError):
            out(bad)


def test_samples(spark):
    df = spark.createDataFrame([(255, 0, 51)], "r int, g int, b int")
    assert tuple(normalise_samples(df, "uint8").first()) == (1.0, 0.0, 0.2)
    assert tuple(normalise_samples(df, "float32").first()) == (255.0, 0.0, 51.0)
    with pytest.raises(ValueError):
        normalise_samples(df, "int16")


def test_exif(spark):
    schema = "k int, exif map<string, struct<num:bigint, den:bigint>>"
    full = {"ExposureTime": (1, 30), "FNumber": (8, 1), "ISOSpeedRatings": (100, None)}
    rows = [(1, full), (2, {**full, "ExposureTime": (1, 0)}), (3, {k: v for k, v in full.items() if k != "FNumber"}),
            (4, {"ExposureTime": (1, 30), "FNumber": (8, None), "PhotographicSensitivity": (200, None)}), (5, None), (6, {**full, "ISOSpeedRatings": (0, None)})]
    got = {r.k: r.iso for r in scan_settings(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 100.0, 2: None, 3: None, 4: 200.0, 5: None, 6: None}


def xmp(items, end="99"):
    body = "".join(f'<rdf:li darktable:operation="{op}" darktable:enabled="{on}"' + (f' darktable:multi_priority="{inst}"' if inst else "")
                   + f' darktable:modversion="{v}" darktable:params="{p}"/>' for op, on, inst, v, p in items)
    return f'<x darktable:history_end="{end}"><darktable:history>\n{body}\n</darktable:history></x>'


def test_edit_state(spark):
    params = "00000040" + "0000803f" + "0000c03f"
    items = [("temperature", 1, "0", 3, params), ("filmic", 1, "", 1, "gz"), ("crop", 1, "0", 1, "gz"), ("filmic", 0, "0", 1, "gz"),
             ("exposure", 1, "1", 1, "gz"), ("sigmoid", 1, "0", 1, "gz")]
    by_name = [("temperature", 1, "0", 4, params + "00000000" + "04000000")]
    docs = spark.createDataFrame([(1, xmp(items)), (2, xmp(items, "2")), (3, xmp(by_name)), (4, "<x/>"), (5, None), (6, xmp([("temperature", 1, "0", 3, "zz")]))], "k int, xmp string")
    got = {r.k: (r.wb_kind, r.wb, r.tonal_modules) for r in edit_state(docs).collect()}
    assert got[1] == ("multipliers", [2.0, 1.0, 1.5], ["exposure", "sigmoid"])
    assert got[2] == ("multipliers", [2.0, 1.0, 1.5], ["filmic"])
    assert got[3] == ("camera reference (D65)", None, [])
    assert got[4] == got[5] == (None, None, None)
    assert got[6] == (None, None, [])
    assert edit_history(docs).where("k = 2").count() == 2


def meta(spark, rows):
    return spark.createDataFrame([(0, i, n, *(s or (None, None, None)), kind, wb, mods) for i, (n, s, kind, wb, mods) in enumerate(rows)],
                                 "roll_id int, frame_id int, name string, t double, f double, iso double, wb_kind string, wb array<double>, tonal_modules array<string>")


def test_consistent_roll_flags_nothing(spark):
    same = ("multipliers", [2.0, 1.0, 1.5], [])
    df = meta(spark, [(n, (1 / 30, 8.0, 100.0), *same) for n in "abc"])
    row = scans.scan_report(df).first()
    assert not (row.exposure_inconsistent or row.wb_inconsistent or row.tone_modules_on)
    assert scans.frame_flags(df).count() == 0


def test_mixed_roll(spark, paths):
    scan, other = (1 / 30, 8.0, 100.0), (1 / 60, 8.0, 100.0)
    df = meta(spark, [("a", scan, "multipliers", [2.0, 1.0, 1.5], []), ("b", scan, "multipliers", [2.0, 1.0, 1.5], ["filmic"]), ("c", other, "camera reference (D65)", None, []), ("d", None, None, None, None)])
    row = scans.scan_report(df).first()
    assert row.spread_stops == pytest.approx(1.0) and row.exposure_groups == 2 and row.wb_groups == 2 and row.missing_exif == 1
    assert row.exposure_inconsistent and row.wb_inconsistent
    flags = {r.name: r.flags for r in scans.frame_flags(df).collect()}
    assert set(flags) == {"b", "c", "d"}
    assert flags["c"].startswith("digitized at 1/60 f/8 ISO100, most of the roll at 1/30 f/8 ISO100; exported")


def test_no_exif_at_all_says_nothing(spark):
    df = meta(spark, [(n, None, None, None, None) for n in "ab"])
    assert scans.frame_flags(df).count() == 0


def test_profiles_from_a_folder(spark, tmp_path):
    good = {"white_balance": [0.7, 1, 1.05], "density_scale": [1.1, 1, 0.8], "name": "Gold", "created_at": "2024-05-06T07:08:09+00:00", "tone": {"exposure": 0.2, "contrast": 0.9}}
    files = {"gold.json": json.dumps(good), "cut.json": json.dumps(good)[:30], "list.json": "[1]", "nan.json": json.dumps({**good, "density_scale": [1.1, 1, float("nan")]}),
             "lacking.json": json.dumps({k: v for k, v in good.items() if k != "white_balance"}), "words.json": json.dumps({**good, "white_balance": ["a", 1, 2]}), ".temp.json": "{"}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    got = {r.file: r for r in pf.read_profiles(spark, str(tmp_path)).collect()}
    assert set(got) == {"gold", "cut", "list", "nan", "lacking", "words"}
    assert got["gold"].problem is None and got["gold"].white_balance.b == 1.05 and got["gold"].source == "manual"
    assert "not JSON" in got["cut"].problem and "object" in got["list"].problem
    assert "density_scale" in got["nan"].problem and "no white_balance" in got["lacking"].problem and "white_balance" in got["words"].problem
    assert pf.tone_overrides(pf.read_profiles(spark, str(tmp_path))).collect()[0].contrast == 0.9


def test_provenance_that_is_not_one(spark):
    texts = ["", "not json", "[1]", '{"filmroll": 3}', '{"other": {}}', '{"filmroll": {"output": "flat", "linear_scale": 0.5}}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, description string")
    assert [r.i for r in read_provenance(df).where("record is not null").collect()] == [5]
    keyed = df.select(provenance_record(F.lit('{"mine": {"output": "print"}}'), "mine")["output"].alias("o")).first()
    assert keyed.o == "print"


def test_write_policies(spark, tmp_path):
    def frames(ids, value):
        return spark.createDataFrame([(0, f, 0, 0, value, value, value) for f in ids], "roll_id int, frame_id int, y int, x int, r double, g double, b double")

    path = str(tmp_path / "out")
    def state():
        return {r.frame_id: r.r for r in read_developed(spark, path, frames([], 0.0).schema).collect()}
    write_developed(frames([1, 2], 0.1), path)
    with pytest.raises(Exception):
        write_developed(frames([1], 0.2), path)
    write_developed(frames([2, 3], 0.3), path, "skip-existing")
    assert state() == {1: 0.1, 2: 0.1, 3: 0.3}
    write_developed(frames([2], 0.5), path, "overwrite")
    assert state() == {1: 0.1, 2: 0.5, 3: 0.3}
    dies = frames([1, 2, 3], 0.7).withColumn("r", F.when(F.col("frame_id") < 3, F.col("r")).otherwise(F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception):
        write_developed(dies, path, "overwrite")
    assert state() == {1: 0.1, 2: 0.5, 3: 0.3}  # a write that dies leaves the version before it


def profile_rows(spark, *names):
    whole = [(n, n, (0.7, 1.0, 1.0), (1.1, 1.0, 0.8), "stock", None, None, None, "manual", None, None, None, None) for n in names]
    return spark.createDataFrame(whole, pf.STORED)


def test_profiles_are_changed_by_one_writer_at_a_time(spark, tmp_path):
    path = str(tmp_path / "store")
    pf.save_profiles(profile_rows(spark, "gold", "portra"), path)
    before = Versions(spark, path).head()
    body = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in pf.stored_profiles(spark, path).dtypes if c in pf.BODY)
    changes = spark.sql(f"SELECT name, action, new_name, false AS overwrite, map('notes', 'x') AS fields, {body} FROM VALUES ('gold', 'rename', 'silver'), ('portra', 'edit', NULL), ('none', 'delete', NULL) AS t(name, action, new_name)")
    applied, _ = pf.upsert_profiles(spark, path, changes)
    assert {(r.file, r.outcome) for r in applied.collect()} == {("silver", "renamed"), ("portra", "edited"), ("none", "refused")}
    assert {(r.file, r.notes) for r in pf.stored_profiles(spark, path).collect()} == {("silver", None), ("portra", "x")}
    with pytest.raises(Stale):  # made from the version before
        pf.save_profiles(profile_rows(spark, "gold"), path, before)
    assert pf.stored_profiles(spark, path).count() == 2


def test_profiles_written_as_files(spark, tmp_path):
    files = spark.createDataFrame([("a.json", '{"white_balance": [1, 1, 1], "density_scale": [1, 1, 1]}'), ("b c.json", "{")], "file string, text string")
    pf.write_profiles(files, str(tmp_path / "p"))
    assert {(r.file, r.problem) for r in pf.read_profiles(spark, str(tmp_path / "p")).collect()} == {("a", None), ("b c", "unreadable: not JSON")}


def test_summary_known_roll(spark):
    grades = [1.0, 1.0, 0.95, 0.75, 0.46, 1.0]
    rows = [(0, i, f"f{i}", None, "w; " + f"f{i}: x" if i < 5 else None, 1.0, g, 0.1, None, True) for i, g in enumerate(grades)]
    rows.append((0, 9, "f9", "failed", None, 1.0, 0.1, 0.1, None, True))
    df = spark.createDataFrame(rows, "roll_id int, frame_id int, name string, error string, warning string, seconds double, grade double, exposure double, linear_scale double, grade_fitted boolean")
    row = summary.roll_summary(df).first()
    assert (row.frames, row.developed, row.fitted, row.at_cap) == (7, 6, 6, 3)
    assert row.grade_median == pytest.approx(0.975)
    assert [r.name for r in summary.low_grades(df).collect()] == ["f4"]
    groups = summary.warning_groups(df).orderBy("first_frame", "first_part").collect()
    assert [(g.message, g.frames, g.names) for g in groups] == [("w", 5, "f0, f1, f2, f3 and 1 more"), ("x", 5, "f0, f1, f2, f3 and 1 more")]


def test_unfinished_run_is_named_once(spark):
    runs = spark.createDataFrame([("a", 1, "01", "02"), ("a", 2, "03", None), ("a", 3, "05", "06"), ("a", 4, "07", None), ("b", 5, "01", None)],
                                 "log string, run_id int, started_at string, finished_at string")
    got = {r.run_id: r.unfinished_start for r in previous_unfinished(runs).collect()}
    assert got == {1: None, 2: None, 3: "03", 4: None, 5: None}


def test_folders_that_are_no_rolls(spark):
    rows = [("/in", 3, 0), ("/in/.trash", 4, 0), ("/in/.cache/a", 4, 0), ("/in/a", 2, 1), ("/in/a/out", 0, 5), ("/in/b", 1, 0), ("/in/empty", 0, 0)]
    folders = spark.createDataFrame(rows, "folder string, scans long, positives long")
    to = spark.createDataFrame([("/in/b",), ("/in/b",), ("/elsewhere",)], "folder string")
    assert sorted(r.folder for r in rolls.exclude_destinations(folders, to, "/in").collect()) == ["/in", "/in/a"]
    assert tuple(rolls.skipped_folders(folders, to, "/in").first()) == (1, 1)
    below = spark.createDataFrame([("/home/.scans/in/a", 1, 0)], "folder string, scans long, positives long")
    assert rolls.exclude_destinations(below, to, "/home/.scans/in").count() == 1  # what is above the top doesn't matter


def test_two_rolls_into_one_folder(spark):
    rows = [("/in/a", "a", "/out/Roll", 2), ("/in/b", "b", "/OUT/roll", 1), ("/in/c", "c", "/out/roll", 0), ("/in/d", "d", "/out/d", 3), ("/in/e", "e", None, 3), ("/in/f", "f", None, 3)]
    planned = spark.createDataFrame(rows, "folder string, roll_name string, output_dir string, jobs long")
    assert [tuple(r) for r in rolls.roll_clashes(planned).collect()] == [("/out/roll", 2, "a", "b")]


def test_pixels_are_moved_once(spark):
    """Ranges of orders serve both the numbering of doubled places and the clustering of what is written."""
    from filmroll.catalog.tables import cells

    plan = cells(spark, "/root/testdata/sf0.001", ranged=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning(l_orderkey" in plan


def test_curves_are_made_by_many_tasks(spark):
    from filmroll.catalog.tables import papers

    assert papers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_profile_files_share_folders(spark, tmp_path):
    names = ["a+b.json", "50%.json", "b c.json", "_d.json", "e\u00e9.json", *[f"P{i}.json" for i in range(400)]]
    pf.write_profiles(spark.createDataFrame([(n, "{\n") for n in names], "file string, text string"), f"file:{tmp_path}/p")
    found = list((tmp_path / "p").rglob("file=*"))
    assert len(found) == len(names) and all(f.is_file() for f in found)
    assert sorted(r.file for r in pf.read_profiles(spark, str(tmp_path / "p")).collect()) == sorted(n.removesuffix(".json") for n in names)
    with pytest.raises(FileExistsError):
        pf.write_profiles(spark.createDataFrame([], "file string, text string"), str(tmp_path / "p"))


def test_profile_files_are_listed_by_tasks(spark, tmp_path):
    """Plans that name each file fill the driver's memory."""
    pf.write_profiles(spark.createDataFrame([(f"P{i}.json", "[" if i else "") for i in range(400)], "file string, text string"), str(tmp_path / "p"))
    found = pf.read_profiles(spark, str(tmp_path / "p"))
    assert len(found.inputFiles()) < 100
    assert {r.file: r.problem for r in found.collect()} == {f"P{i}": "unreadable: not JSON" for i in range(400)}  # the empty one too


@pytest.mark.parametrize("glob", ["", "/a/x1.json", "/{a,b c}/x*", "/[!a]*", "/*/deep", "/.*", "/*/x[12].json", r"/a/w\*.json"])
def test_profile_globs_are_those_of_spark(spark, tmp_path, glob):
    for name in ("top.json", "a/x1.json", "a/x2.json", "a/x10.json", "a/.h.json", "a/_h.json", "a/_h=.json", "a/w*.json", "b c/x+1 %41.json", "b c/deep/x1.json", "a/_tmp/y.json", "a/.g/z.json", ".kept/k.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"white_balance": [1, 1, 1], "density_scale": [1, 1, 1], "notes": name}))
    mine = sorted(r.notes for r in pf.read_profiles(spark, f"{tmp_path}{glob}").collect())
    assert mine == sorted(json.loads(r.value)["notes"] for r in spark.read.option("recursiveFileLookup", "true").text(f"{tmp_path}{glob}", wholetext=True).collect())


def test_profile_globs_without_a_match(spark, tmp_path):
    (tmp_path / "b c").mkdir()
    (tmp_path / "b c" / "x+1 %41.json").write_text("{")
    assert [r.file for r in pf.read_profiles(spark, str(tmp_path)).collect()] == ["x+1 %41"]
    assert pf.read_profiles(spark, str(tmp_path / "b c" / "*")).count() == 1
    for none in ("none", "*.json", "b c/y*", "b c/*/y", "none/*"):
        with pytest.raises(FileNotFoundError):
            pf.read_profiles(spark, str(tmp_path / none))


def test_profiles_in_a_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    names = ["a+b.json", "50%.json", "b c.json", "_d.json"]
    pf.write_profiles(spark.createDataFrame([(n, "{") for n in names], "file string, text string"), str(tmp_path / "p"))
    (tmp_path / "p" / "x+1 %41.json").write_text("{")

    def refused(path):
        raise pf.pa.ArrowInvalid(path)

    monkeypatch.setattr(pf, "_opened", refused)
    assert {r.file for r in pf.read_profiles(spark, str(tmp_path / "p")).collect()} == {"a+b", "50%", "b c", "_d", "x+1 %41"}
