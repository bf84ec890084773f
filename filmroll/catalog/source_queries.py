"""Profiles, provenance records and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmroll.catalog.pixel_queries import CURVE_SQL, PROFILE, TONE_SQL, rgb_sql
from filmroll.catalog.registry import query, rounded
from filmroll.catalog.tables import PIXEL_SQL, curve, exif, positives, table, with_sql
from filmroll.plans.develop import frame_tones
from filmroll.session import materialize, shared_path
from filmroll.sources import profiles as pf
from filmroll.sources.pixels import read_developed, write_developed
from filmroll.sources.provenance import provenance_record, with_provenance


def profile_files(spark, sf):
    """A profile file per part: most whole, some cut short, incomplete, negative or not an object."""
    key, size = F.col("p_partkey"), F.col("p_size")
    number = size.cast("string")
    half = F.concat(F.lit("0."), F.lpad(number, 2, "0"))
    balance = F.when(key % 23 == 0, "[0.5, 1, -1]").when(key % 23 == 1, '"none"').otherwise(F.concat(F.lit("["), half, F.lit("1, 1.0, 1.05]")))
    scale = F.when(key % 19 == 0, "").when(key % 19 == 1, ', "density_scale": [1.1, 1.0]').otherwise(', "density_scale": [1.12, 1, 0.78]')
    tone = F.when(size % 3 == 0, F.concat(F.lit(', "tone": {"exposure": '), F.when(size % 2 == 0, "null").otherwise(F.concat(half, F.lit("5"))),
                                           F.lit(', "contrast": '), (size / 20).cast("string"), F.lit("}"))).otherwise("")
    scan = F.when(size % 4 == 0, F.concat(F.lit(', "scan": {"exposure_time": 0.04, "f_number": 8, "iso": '), number, F.lit("}"))).when(
        size % 4 == 1, ', "scan": {"exposure_time": 0.04, "iso": 100}').otherwise("")
    anchor = F.concat(F.lit('{"frame": "/scans/a.tif", "x": '), number, F.lit(', "y": 2, "rgb": [0.1, 0.2, '), half, F.lit('1], "scan": null}'))
    anchors = F.when(size % 5 == 0, F.concat(F.lit(', "anchors": ['), anchor, F.lit(", "), anchor, F.lit("]"))).otherwise("")
    origin = F.when(size % 7 == 0, "").otherwise(', "source": "anchor"')
    text = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "film_stock": "'), "p_brand", F.lit('", "notes": null, "created_at": "2024-05-06T07:08:09+00:00", "white_balance": '),
                    balance, scale, tone, scan, anchors, origin, F.lit("}"))
    text = F.when(key % 17 == 0, F.substring(text, 1, 40)).when(key % 29 == 0, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("P"), key.cast("string"), F.lit(".json")).alias("file"), text.alias("text"))


def _profiles(spark, sf):
    return pf.parse_profiles(profile_files(spark, sf))


PROFILE_SQL = """
WITH pr AS (SELECT *, concat('P', p_partkey) AS file, CAST(concat('0.', lpad(CAST(p_size AS VARCHAR), 2, '0')) AS DOUBLE) AS half,
  CASE WHEN p_partkey % 17 = 0 THEN 'unreadable: not JSON' WHEN p_partkey % 29 = 0 THEN 'unreadable: JSON, but no object'
    WHEN p_partkey % 23 <= 1 THEN 'white_balance: three numbers above zero are needed' WHEN p_partkey % 19 = 0 THEN 'no density_scale given'
    WHEN p_partkey % 19 = 1 THEN 'density_scale: three numbers above zero are needed' END AS problem FROM part),
ok AS (SELECT * FROM pr WHERE problem IS NULL)
"""


SOUND_SQL = PROFILE_SQL + """SELECT file, CASE WHEN problem IS NULL THEN p_name END AS name, CASE WHEN problem IS NULL THEN p_brand END AS film_stock,
  CASE WHEN problem IS NULL THEN round(half + 0.001e0, 6) END AS wb_r, CASE WHEN problem IS NULL THEN 1e0 END AS wb_g, CASE WHEN problem IS NULL THEN 1.05e0 END AS wb_b,
  CASE WHEN problem IS NULL THEN 1.12e0 END AS s_r, CASE WHEN problem IS NULL THEN 1e0 END AS s_g, CASE WHEN problem IS NULL THEN 0.78e0 END AS s_b,
  CASE WHEN problem IS NULL THEN CASE WHEN p_size % 7 = 0 THEN 'manual' ELSE 'anchor' END END AS source, CASE WHEN problem IS NULL THEN '2024-05-06' END AS created, problem FROM pr"""


def _numbers(profiles):
    return rounded(profiles.select(
        "file", "name", "film_stock", *[F.col(f"{v}.{c}").alias(f"{k}_{c}") for k, v in (("wb", "white_balance"), ("s", "density_scale")) for c in "rgb"], "source",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"), "problem"))


@query("src_profiles", SOUND_SQL)
def src_profiles(spark, sf):
    return _numbers(_profiles(spark, sf))


@query("src_profile_files", SOUND_SQL)
def src_profile_files(spark, sf):
    """A file for each profile, written and read back."""
    path = shared_path(spark, "profile-files")
    pf.write_profiles(profile_files(spark, sf), path)
    return _numbers(pf.read_profiles(spark, path))


@query("src_tone_sidecar", PROFILE_SQL + """SELECT file, CASE WHEN tone_problem IS NULL THEN round(half + 0.005e0, 6) END AS exposure, CASE WHEN tone_problem IS NULL THEN p_size / 20e0 END AS contrast, tone_problem
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'tone without finite numbers for exposure and contrast' WHEN p_size > 40 THEN 'tone with a contrast outside (0, 2]' END AS tone_problem FROM ok WHERE p_size % 3 = 0)""")
def src_tone_sidecar(spark, sf):
    return rounded(pf.tone_overrides(_profiles(spark, sf)))


@query("src_scan_sidecar", PROFILE_SQL + """SELECT file, CASE WHEN p_size % 4 = 0 THEN 0.04e0 END AS t, CASE WHEN p_size % 4 = 0 THEN 8e0 END AS f, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS iso,
  CASE WHEN p_size % 4 = 1 THEN 'scan settings that are incomplete' END AS scan_problem FROM ok WHERE p_size % 4 <= 1""")
def src_scan_sidecar(spark, sf):
    return rounded(pf.scan_references(_profiles(spark, sf)))


@query("src_anchors", PROFILE_SQL + """SELECT file, CAST(i AS INTEGER) AS i, '/scans/a.tif' AS frame, p_size AS x, 2 AS y, 0.1e0 AS r, 0.2e0 AS g, round(half + 0.001e0, 6) AS b, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS iso FROM ok, range(2) t(i) WHERE p_size % 5 = 0
UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pr WHERE NOT coalesce(problem IS NULL AND p_size % 5 = 0, false)""")
def src_anchors(spark, sf):
    return rounded(pf.profile_points(_profiles(spark, sf)))


def _changes(spark, sf):
    """A change for every third profile or so, and some for profiles that don't exist."""
    key, size = F.col("p_partkey"), F.col("p_size")
    action = (F.when(size % 5 == 0, "save").when(size % 5 == 1, "rename").when(size % 5 == 2, "edit").otherwise("delete"))
    name = F.when(size % 10 >= 8, F.concat(F.lit("Q"), key.cast("string"))).otherwise(F.concat(F.lit(" p"), key.cast("string")))
    new_name = F.when(size % 2 == 0, F.concat(F.lit("N"), key.cast("string"))).when(size % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("p"), key.cast("string")))
    fields = F.when(action == "edit", F.when(size % 4 == 0, F.create_map(F.lit("name"), F.lit("x"))).otherwise(
        F.create_map(F.lit("notes"), F.lit("edited"), F.lit("film_stock"), F.lit(None).cast("string"))))
    three = F.struct(F.lit(0.9).alias("r"), F.lit(1.0).alias("g"), F.lit(1.1).alias("b"))
    body = {c: F.lit(None).cast(t) for c, t in _profiles(spark, sf).dtypes if c in pf.BODY}
    body |= {"white_balance": three, "density_scale": three, "film_stock": F.lit("new stock"), "source": F.lit("manual")}
    rows = table(spark, sf, "part").where(F.col("p_type") != "LARGE")
    return rows.select(name.alias("name"), action.alias("action"), F.when(action == "rename", new_name).alias("new_name"),
                       (size % 3 == 0).alias("overwrite"), fields.alias("fields"), *[v.alias(c) for c, v in body.items()])


CHANGE_SQL = PROFILE_SQL + """, c AS (SELECT *, CASE p_size % 5 WHEN 0 THEN 'save' WHEN 1 THEN 'rename' WHEN 2 THEN 'edit' ELSE 'delete' END AS action,
    CASE WHEN p_size % 10 >= 8 THEN concat('q', p_partkey) ELSE concat('p', p_partkey) END AS key,
    CASE WHEN p_size % 2 = 0 THEN concat('N', p_partkey) WHEN p_size % 3 = 0 THEN 'same' ELSE concat('p', p_partkey) END AS new_name FROM part WHERE p_type <> 'LARGE'),
j AS (SELECT coalesce(c.key, concat('p', p.p_partkey)) AS key, p.p_partkey IS NOT NULL AS there, p.p_partkey IS NOT NULL AND p.problem IS NULL AS sound, c.action, c.new_name, c.p_size AS csize, p.p_size AS psize, p.p_brand AS brand, p.p_name AS pname, p.half AS half,
    concat('P', p.p_partkey) AS file, count(*) FILTER (WHERE action = 'rename') OVER (PARTITION BY CASE WHEN action = 'rename' THEN lower(c.new_name) END) AS claims
  FROM pr p FULL JOIN c ON c.key = concat('p', p.p_partkey)),
d AS (SELECT *, CASE WHEN action IS NULL THEN NULL WHEN action = 'save' AND there AND csize % 3 <> 0 THEN 'refused: the name is taken'
    WHEN action <> 'save' AND NOT there THEN 'refused: no such profile' WHEN action = 'rename' AND lower(new_name) <> key AND claims > 1 THEN 'refused: the new name is taken'
    WHEN action = 'edit' AND csize % 4 = 0 THEN 'refused, not editable: name' END AS problem FROM j),
k AS (SELECT *, problem IS NULL AND action IS NOT NULL AS done FROM d),
r AS (SELECT CASE WHEN done AND action = 'rename' THEN new_name WHEN there THEN file ELSE upper(left(key, 1)) || substring(key, 2) END AS file,
  CASE WHEN done AND action = 'rename' THEN new_name WHEN done AND action = 'save' THEN CASE WHEN there THEN key ELSE upper(left(key, 1)) || substring(key, 2) END WHEN sound THEN pname END AS name,
  CASE WHEN done AND action = 'save' THEN 0.9e0 WHEN sound THEN round(half + 0.001e0, 6) END AS wb_r, CASE WHEN sound OR (done AND action = 'save') THEN 1e0 END AS wb_g, CASE WHEN done AND action = 'save' THEN 1.1e0 WHEN sound THEN 1.05e0 END AS wb_b,
  CASE WHEN done AND action = 'save' THEN 0.9e0 WHEN sound THEN 1.12e0 END AS s_r, CASE WHEN sound OR (done AND action = 'save') THEN 1e0 END AS s_g, CASE WHEN done AND action = 'save' THEN 1.1e0 WHEN sound THEN 0.78e0 END AS s_b,
  CASE WHEN done AND action = 'save' THEN 'new stock' WHEN done AND action = 'edit' THEN NULL WHEN sound THEN brand END AS film_stock,
  CAST(NULL AS VARCHAR) AS process, CAST(NULL AS VARCHAR) AS scanner, CASE WHEN sound AND NOT (done AND action = 'save') THEN '2024-05-06' END AS created,
  CASE WHEN done AND action = 'save' THEN 'manual' WHEN sound THEN CASE WHEN psize % 7 = 0 THEN 'manual' ELSE 'anchor' END END AS source,
  CASE WHEN done AND action = 'edit' THEN 'edited' END AS notes,
  CASE WHEN sound AND NOT (done AND action = 'save') AND psize % 3 = 0 THEN psize / 20e0 END AS contrast,
  CASE WHEN sound AND NOT (done AND action = 'save') AND psize % 4 <= 1 THEN CASE WHEN psize % 4 = 0 THEN psize * 1e0 ELSE 100e0 END END AS iso,
  CASE WHEN sound AND NOT (done AND action = 'save') AND psize % 5 = 0 THEN 2 END AS points,
  CASE WHEN action IS NULL THEN 'kept' WHEN problem IS NOT NULL THEN 'refused' WHEN action = 'save' AND there THEN 'replaced' WHEN action = 'save' THEN 'saved' WHEN action = 'rename' THEN 'renamed' WHEN action = 'edit' THEN 'edited' ELSE 'deleted' END AS outcome,
  problem, there AS existed FROM k)
"""


def _told(rows, *more):
    """Every column of profiles, in values that SQL can say."""
    return rounded(rows.select(
        "file", "name", *[F.col(f"{v}.{c}").alias(f"{k}_{c}") for k, v in (("wb", "white_balance"), ("s", "density_scale")) for c in "rgb"], "film_stock", "process", "scanner",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"), "source", "notes", F.col("tone.contrast").alias("contrast"), F.col("scan.iso").alias("iso"),
        F.when(F.col("anchors").isNotNull(), F.size("anchors")).alias("points"), *more))


def _upserted(spark, sf):
    """A store of profiles, and the changes made to it."""
    path = shared_path(spark, "profiles")
    pf.save_profiles(_profiles(spark, sf), path)
    applied, _ = pf.upsert_profiles(spark, path, _changes(spark, sf))
    return applied, path


@query("snk_profiles", CHANGE_SQL + "SELECT * FROM r")
def snk_profiles(spark, sf):
    return _told(_upserted(spark, sf)[0], "outcome", "problem", "existed")


@query("snk_profiles_snapshot", CHANGE_SQL + "SELECT * EXCLUDE (outcome, problem, existed) FROM r WHERE outcome <> 'deleted' AND NOT (outcome = 'refused' AND NOT existed)")
def snk_profiles_snapshot(spark, sf):
    """The store's next version, read back."""
    return _told(pf.stored_profiles(spark, _upserted(spark, sf)[1]))


def _tones(spark, sf):
    """Fitted tones; every fifth frame flat, and one in eleven with a scale that isn't a number."""
    fits = frame_tones(positives(spark, sf), curve())
    frame = F.col("frame_id")
    flat = frame % 5 == 4
    return fits.select(
        "roll_id", "frame_id", F.when(flat, "linear").otherwise("paper").alias("mode"), F.when(~flat, F.col("exposure")).alias("exposure"),
        F.when(~flat, F.col("grade")).alias("grade"), F.when(flat, F.when(frame % 11 == 3, F.lit(float("nan"))).otherwise(0.25)).alias("linear_scale"))


def _recorded(spark, sf):
    frames = exif(spark, sf).select("roll_id", "frame_id", *[F.lit(v).alias(k) for k, v in PROFILE.items()],
                                    F.when(F.col("frame_id") % 2 == 0, "Gold 200").otherwise("").alias("film_stock"),
                                    F.when(F.col("frame_id") % 3 == 0, 1.5).otherwise(1.0).alias("gain"))
    return with_provenance(_tones(spark, sf), frames, "1")


RECORD_SQL = with_sql(PIXEL_SQL, CURVE_SQL, TONE_SQL)
BAD_RECORD = "frame_id % 5 = 4 AND frame_id % 11 = 3"


@query("snk_provenance", RECORD_SQL + f"""SELECT roll_id, frame_id, CASE WHEN {BAD_RECORD} THEN NULL WHEN frame_id % 5 = 4 THEN 'flat' ELSE 'print' END AS output,
  CASE WHEN frame_id % 5 <> 4 THEN round(grade, 6) END AS contrast, CASE WHEN NOT ({BAD_RECORD}) AND frame_id % 5 = 4 THEN 0.25e0 END AS linear_scale,
  CASE WHEN NOT ({BAD_RECORD}) AND frame_id % 2 = 0 THEN 'Gold 200' END AS film_stock, CASE WHEN NOT ({BAD_RECORD}) AND frame_id % 3 = 0 THEN 1.5e0 END AS scan_gain,
  CASE WHEN {BAD_RECORD} THEN 'the printing decision isn''t a finite number' END AS problem FROM frame_tone""")
def snk_provenance(spark, sf):
    """Records written and read back."""
    rows = _recorded(spark, sf).withColumn("_r", provenance_record(F.col("description")))
    return rounded(rows.select("roll_id", "frame_id", "_r.output", "_r.contrast", "_r.linear_scale", "_r.film_stock", "_r.scan_gain", "problem"))


@query("fn_json", RECORD_SQL + f"""SELECT roll_id, frame_id, CASE WHEN {BAD_RECORD} THEN NULL ELSE concat('{{"filmroll":{{"output":"', CASE WHEN frame_id % 5 = 4 THEN 'flat' ELSE 'print' END, '","version":"1",',
  CASE WHEN frame_id % 5 = 4 THEN '"linear_scale":0.25' ELSE '"exposure":#,"contrast":#' END, ',"white_balance":[0.73,1.0,1.05],"density_scale":[1.12,1.0,0.78]',
  CASE WHEN frame_id % 2 = 0 THEN ',"film_stock":"Gold 200"' ELSE '' END, CASE WHEN frame_id % 3 = 0 THEN ',"scan_gain":1.5' ELSE '' END, '}}}}') END AS description,
  CASE WHEN frame_id % 5 <> 4 THEN round(exposure, 6) END AS exposure, CASE WHEN frame_id % 5 <> 4 THEN round(grade, 6) END AS contrast FROM frame_tone""")
def fn_json(spark, sf):
    """Every record: its text, with the fitted numbers of a print beside it, since their last digits differ."""
    number = lambda key: F.regexp_extract("description", f'"{key}":([-0-9.E]+)', 1)
    shown = F.regexp_replace("description", r'"(exposure|contrast)":[-0-9.E]+', '"$1":#')
    return rounded(_recorded(spark, sf).select("roll_id", "frame_id", shown.alias("description"), *[
        F.when(number(k) != "", number(k).cast("double")).alias(k) for k in ("exposure", "contrast")]))


@query("snk_frames", with_sql(PIXEL_SQL) + f"SELECT roll_id, frame_id, y, x, {rgb_sql(4)}, 3 AS version FROM positives")
def snk_frames(spark, sf):
    """Positives by roll: half the rolls first, all of them wrong; then written over; the rest are added without touching those."""
    path, rows = shared_path(spark, "developed"), materialize(positives(spark, sf), "positives")
    half = rows.where(F.col("roll_id") % 2 == 0)
    write_developed(half.withColumn("r", F.col("r") + 1.0), path, by=["roll_id"])
    write_developed(half, path, "overwrite", by=["roll_id"])
    head = write_developed(rows, path, "skip-existing", by=["roll_id"])
    return rounded(read_developed(spark, path, rows.schema).select("roll_id", "frame_id", "y", "x", "r", "g", "b"), 4).withColumn("version", F.lit(head.version))
