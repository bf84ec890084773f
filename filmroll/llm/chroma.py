"""Chroma fingerprints of audio columns, and a search that aligns recordings.

A recording (16-bit samples) is cut into overlapping frames; each frame's power spectrum is folded into twelve pitch
classes, smoothed over time and scaled to length one. Over that image of time and pitch class, sixteen filters of six
shapes compare the sums of two areas, each read off the integral image; each answer is cut into four levels, and
their Gray codes are packed into one integer per frame.

Search: the queries are the recordings with an id divisible by `every`, against all recordings. Equal fingerprints
are one class, so a group of copies is searched once. Runs of one integer count as their first. A query and a
recording that share integers vote for the offset between them, in histograms counted before the shuffle; the
offset with most votes (then the least) is checked by the bits that differ over the whole overlap.

Result, one row per recording: id, n_frames, fingerprint_sha256, class_id (smallest id with this fingerprint), and of
queries the closest other class that aligns: match_id, offset (frames the query starts later), votes, bit_error (share of bits),
n_matches. Defined cases: a null or too short recording has no frames, and all those are one class that matches nothing; a null id is no
query and counts as larger than any other; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import stored
from filmroll.session import attach

RATE = 4000
FRAME = 1024
HOP = 256
LOWEST, HIGHEST = 100.0, 1900.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25]) / 3
CLASSES = 12
FILTERS = 16
#: Frames the widest filter looks at.
WIDEST = 16
LEVELS = (-0.12, 0.0, 0.12)
EVERY = 100
LEAST_VOTES = 2
LEAST_OVERLAP = 20
MOST_ERROR = 0.12
LAST = 2**63 - 1


def filters() -> list[tuple[int, int, int, int]]:
    """Shape, first pitch class, height and width of each filter, by rule: shapes in turn, places and widths spread."""
    out = []
    for i in range(FILTERS):
        height = 2 + 2 * (i % 5)
        out.append((i % 6, (5 * i) % (CLASSES - height + 1), height, (4, 8, 12, WIDEST)[i // 4]))
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12), each of length one or zero."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
    fold = np.zeros((len(freq), CLASSES))
    fold[used, np.round(12 * np.log2(freq[used] / 440)).astype(int) % CLASSES] = 1
    image = power @ fold
    image = np.stack([np.convolve(image[:, c], SMOOTH, mode="same")[:len(image)] if len(image) >= len(SMOOTH) else image[:, c] for c in range(CLASSES)], axis=1)
    length = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(length > 1e-3, image / np.maximum(length, 1e-12), 0.0)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One 32-bit integer for each frame that has the widest filter's frames after it."""
    image = chroma(samples, rate)
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, CLASSES + 1))
    whole[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x0, x1, y0, y1):
        return whole[at + x1, y1] - whole[at + x0, y1] - whole[at + x1, y0] + whole[at + x0, y0]

    out = np.zeros(n, np.uint32)
    for shape, y, h, w in filters():
        total = area(0, w, y, y + h)
        if shape == 0:
            part = area(0, w, 0, CLASSES) * h / CLASSES  # more than its share?
            a, b = total, part
        elif shape == 1:
            a = area(0, w, y, y + h // 2)
            b = total - a
        elif shape == 2:
            a = area(0, w // 2, y, y + h)
            b = total - a
        elif shape == 3:
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            b = total - a
        elif shape == 4:
            a = 2 * area(w // 4, w - w // 4, y, y + h)
            b = total
        else:
            a = 2 * area(0, w, y + h // 4, y + h - h // 4)
            b = total
        level = np.digitize(np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0))), LEVELS).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def _fingerprints(rate: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for raw in b.column("pcm"):
                raw = raw.as_py() or b""
                found.append(fingerprint(np.frombuffer(raw[:len(raw) // 2 * 2], "<i2"), rate).view(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.int32()))], ["id", "fingerprint"])
    return task


def fingerprints(recordings: DataFrame, rate: int = RATE) -> DataFrame:
    """`id`, `pcm` -> id, fingerprint (one integer per frame)."""
    return recordings.select(F.col("id").cast("bigint").alias("id"), "pcm").mapInArrow(_fingerprints(rate), "id bigint, fingerprint array<int>")


def _classes(prints: DataFrame) -> DataFrame:
    words = F.array_join("fingerprint", ",")
    return prints.select("id", "fingerprint", F.size("fingerprint").alias("n_frames"), F.unhex(F.sha2(words, 256)).alias("digest"))


def search(recordings: DataFrame, rate: int = RATE, every: int = EVERY) -> DataFrame:
    """One row per recording, as said above."""
    rows = stored(_classes(fingerprints(recordings, rate)), "prints")
    query = F.col("id").isNotNull() & (F.pmod("id", F.lit(every)) == 0)
    classes = stored(rows.groupBy("digest").agg(F.min(F.coalesce("id", F.lit(LAST))).alias("class"), F.max(query.cast("int")).alias("asked"),
                                                F.first("fingerprint").alias("fingerprint")), "classes")
    steps = F.filter(F.transform("fingerprint", lambda v, i: F.when((i == 0) | (v != F.get("fingerprint", i - 1)), F.struct(v.alias("word"), i.alias("at")))),
                     lambda s: s.isNotNull())
    words = classes.select("digest", "asked", F.explode(steps).alias("s")).select("digest", "asked", "s.word", "s.at")
    asked = words.where("asked = 1").select("word", F.col("digest").alias("q"), F.col("at").alias("q_at"))
    votes = (attach(words.select("word", F.col("digest").alias("r"), F.col("at").alias("r_at")), asked, ["word"], label="asked").where("q != r")
             .groupBy("q", "r", (F.col("r_at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= LEAST_VOTES))
    best = votes.groupBy("q", "r").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")).alias("b")).select("q", "r", "b.votes", "b.offset")
    side = lambda d: classes.select(F.col("digest").alias(d), F.col("fingerprint").alias(f"{d}_print"), F.col("class").alias(f"{d}_id"))
    both = best.join(side("q"), "q").join(side("r"), "r")
    start = F.greatest(F.lit(0), F.col("offset"))
    length = F.least(F.size("r_print") - start, F.size("q_print") - (start - F.col("offset")))
    part = lambda c, at: F.slice(c, at + 1, F.greatest(F.lit(0), length))
    wrong = F.aggregate(F.zip_with(part("r_print", start), part("q_print", start - F.col("offset")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    aligned = (both.where(length >= LEAST_OVERLAP).withColumn("bit_error", F.round(wrong / (32 * length), 6)).where(F.col("bit_error") <= MOST_ERROR)
               .groupBy("q").agg(F.min(F.struct("bit_error", (-F.col("votes")).alias("less"), F.col("r_id"), "offset")).alias("m"), F.count("*").alias("n_matches"))
               .select(F.col("q").alias("digest"), F.col("m.r_id").alias("match_id"), F.col("m.offset").alias("offset"), (-F.col("m.less")).alias("votes"),
                       F.col("m.bit_error").alias("bit_error"), "n_matches"))
    of_class = classes.select("digest", F.col("class").alias("class_id")).join(aligned, "digest", "left")
    joined = rows.drop("fingerprint").join(of_class, "digest")
    shown = lambda c: F.when(query, F.col(c)).alias(c)
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return joined.select("id", "n_frames", F.lower(F.hex("digest")).alias("fingerprint_sha256"), known("class_id").alias("class_id"),
                         F.when(query, known("match_id")).alias("match_id"), shown("offset"), shown("votes"), shown("bit_error"),
                         F.when(query, F.coalesce("n_matches", F.lit(0))).alias("n_matches"))


#: Of a recording made of a vector: seconds for each value, and pitches in semitones about the concert pitch.
NOTE = 0.125
SEMITONES = 24


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = int(NOTE * RATE)
    for b in batches:
        for start in range(0, b.num_rows, 64):
            part, out = b.slice(start, 64), []
            for v in part.column("embedding").to_pylist():
                pitch = np.array([0.0 if x is None or x != x else max(-1e6, min(1e6, x)) for x in v or ()])
                steps = np.round(pitch * 4 * SEMITONES) % SEMITONES - SEMITONES // 2
                phase = 2 * np.pi * np.cumsum(np.repeat(440 * 2 ** (steps / 12), size)) / RATE
                out.append(np.round(9000 * (np.sin(phase) + 0.4 * np.sin(2 * phase))).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(out, pa.binary())], ["id", "pcm"])


def recordings(vectors: DataFrame) -> DataFrame:
    """`vec_id`, `embedding` -> id, pcm: each vector played as a tune, one note a value."""
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(_play, "id bigint, pcm binary")
