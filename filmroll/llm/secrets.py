"""Secret scans with a randomness test battery, in DataFrame functions only.

Base spans are the matches of three patterns, leftmost and non-overlapping per kind. The battery adds `random`
spans: runs of at least 20 characters of the usual encodings, with a letter and a digit, that touch no base span. The encoding (hex,
base32, lower-case alphanumeric, base62, base64) is inferred from the characters, and under "each character of it
is drawn evenly" three tests are made: chi-squared over the alphabet, runs above and below its middle, and serial
correlation of neighbours; Fisher's method joins their p-values. Words, paths and counters are not even.

Which runs are not random is a discovery among very many tests, and short runs say little. Benjamini-Hochberg
control is therefore made per stratum of length (powers of two) at the rate of `RATES`, higher where runs are
short; what it doesn't reject is reported. It needs no sorted p-values: they are counted in 1/8 steps of -ln p,
at most `STEPS` per stratum, before the shuffle. Only one threshold per stratum (at most 32) reaches the driver.

Positions are found by one pass that puts marks around the matches, and lengths of what lies between them.
Defined cases: a null or empty text has no spans; U+0001 to U+0003 in a text belong to no span; repeated rows
each get a row; null ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmroll.llm.common import stored, texts

ASSIGN = "((?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
ASSIGN_HEAD = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
LEAST_VALUE = 12
LEAST_RANDOM = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST_RANDOM},}}"
#: Order of kinds at one start.
KINDS = ["assign", "access", "hex", "random"]
#: Rate of false rejections allowed, by the stratum floor(log2(length)); the last holds for longer runs.
RATES = {4: 0.25, 5: 0.15, 6: 0.1, 7: 0.05}
STEPS = 400
#: Alphabets in the order they are tried: pattern, characters in order.
ALPHABETS = {
    "hex": ("[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    "base32": ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "alnum": ("[a-z0-9]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": ("[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
_SPAN = "array<struct<start:int,kind:int,stop:int,body:string>>"


def _spans(kind: str, pattern: str, marked: str = "\u0001$0\u0002", head: str | None = None) -> Column:
    """start, kind, stop (code points, stop exclusive) and matched text of every match of `pattern` in `text`."""
    # marks that the text has itself become a character that no pattern has
    clean = F.translate("text", "\u0001\u0002\u0003", "!!!")
    parts = F.split(F.regexp_replace(clean, pattern, marked), "[\u0001\u0002]", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        stop = acc["at"] + F.length(part) - F.when(part.contains("\u0003"), 1).otherwise(0)
        one = F.struct(acc["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), part.alias("body"))
        return F.struct(stop.alias("at"), (~acc["inside"]).alias("inside"),
                        F.when(acc["inside"], F.array_append(acc["found"], one)).otherwise(acc["found"]).cast(_SPAN).alias("found"))

    found = F.aggregate(parts, start, step, lambda acc: acc["found"])
    return F.when(F.col("text").rlike(head or pattern), found).otherwise(F.array().cast(_SPAN))


def _upper(z: Column) -> Column:
    """P(Z > z) of the normal distribution, within 1e-7 (Abramowitz and Stegun 26.2.17), never zero."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.lit(1e-30), F.when(z < 0, 1 - tail).otherwise(tail))


def _both(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper(F.abs(z)))


def _let(value: Column, use) -> Column:
    """`use(value)`, with `value` computed once per row of a lambda."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + of(v).cast("double"))


def _neighbours(values: Column, of) -> Column:
    n = F.size(values)
    return F.zip_with(F.slice(values, 1, n - 1), F.slice(values, 2, n - 1), of)


def _chi_squared(values: Column, n: Column, m: Column) -> Column:
    squares = _sum(F.array_distinct(values), lambda v: F.pow(F.size(F.filter(values, lambda x: x == v)), 2))
    df, cubed = m - 1, 2 / (9 * (m - 1))  # Wilson and Hilferty: the cube root is close to normal
    return _both((F.pow((m / n * squares - n) / df, 1 / 3) - (1 - cubed)) / F.sqrt(cubed))


def _runs(values: Column, n: Column, m: Column) -> Column:
    above = _sum(values, lambda v: (v >= m / 2).cast("int"))
    changes = _sum(_neighbours(values, lambda x, y: (x >= m / 2) != (y >= m / 2)), lambda b: b.cast("int"))
    twice = 2 * above * (n - above)
    spread = twice * (twice - n) / (n * n * (n - 1))
    return F.when(spread > 0, _both((changes - twice / n) / F.sqrt(spread))).otherwise(F.lit(1e-30))


def _serial(values: Column, n: Column) -> Column:
    def about(mean: Column) -> Column:
        spread = _sum(values, lambda v: (v - mean) * (v - mean))
        product = _sum(_neighbours(values, lambda x, y: (x - mean) * (y - mean)), lambda p: p)
        return F.when(spread > 0, _both((product / spread + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-30))
    return _let(_sum(values, lambda v: v) / n, about)


def surprise(run: Column) -> Column:
    """-ln of Fisher's p-value of a run under its inferred encoding."""
    whole = F.regexp_replace(run, "=+", "")
    name = F.lit("base64")
    for kind, (pattern, _) in reversed(ALPHABETS.items()):
        name = F.when(whole.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(name)
    alphabets = F.create_map(*[F.lit(x) for kind, (_, alphabet) in ALPHABETS.items() for x in (kind, alphabet)])

    def by(kind: Column) -> Column:
        even = F.when(kind == "hex", F.lower(whole)).when(kind == "base64", F.translate(whole, "-_", "+/")).otherwise(whole)
        alphabet = F.element_at(alphabets, kind)
        m = F.length(alphabet).cast("double")
        values = F.transform(F.filter(F.split(even, ""), lambda c: c != ""), lambda c: F.position(c, alphabet) - 1)

        def tests(v: Column) -> Column:
            n = F.size(v).cast("double")
            x = -(F.log(_chi_squared(v, n, m)) + F.log(_runs(v, n, m)) + F.log(_serial(v, n)))
            return _let(x, lambda x: x - F.log(1 + x + x * x / 2))
        return _let(values, tests)
    return _let(name, by)


def _candidates(base: Column) -> Column:
    """Runs that may be random, touch no base span and have a letter and a digit, with stratum and step."""
    def own(s: Column) -> Column:
        mixed = s["body"].rlike("[0-9]") & s["body"].rlike("[A-Za-z]")
        return mixed & ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))

    def judged(s: Column) -> Column:
        step = F.least(F.lit(STEPS - 1), F.floor(8 * surprise(s["body"]))).cast("int")
        return F.struct(s["start"], s["kind"], s["stop"], F.floor(F.log2(s["stop"] - s["start"])).cast("int").alias("stratum"), step.alias("step"))
    return F.transform(F.filter(_spans("random", CANDIDATE), own), judged)


def thresholds(steps: DataFrame) -> dict[int, int]:
    """Of `stratum`, `step` per run: the step from which on runs of a stratum are not random. At most 32 strata."""
    counts = steps.groupBy("stratum", "step").agg(F.count("*").alias("runs"))
    each = Window.partitionBy("stratum")
    up = F.sum("runs").over(each.orderBy(F.desc("step")))
    rate = F.lit(min(RATES.values()))
    for stratum, r in RATES.items():
        rate = F.when(F.col("stratum") == stratum, F.lit(r)).otherwise(rate)
    held = counts.withColumn("up", up).withColumn("all", F.sum("runs").over(each))
    cut = held.where(F.exp(-F.col("step") / 8) <= rate * F.col("up") / F.col("all")).groupBy("stratum").agg(F.min("step").alias("step"))
    return {r["stratum"]: r["step"] for r in cut.collect()}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row of `docs`."""
    t = texts(docs)
    assign = F.filter(_spans("assign", ASSIGN, "\u0001$1\u0003$2\u0002", ASSIGN_HEAD),
                      lambda s: F.length(s["body"]) - F.position(F.lit("\u0003"), s["body"]) >= LEAST_VALUE)
    base = t.select("doc_id", "text", F.array_sort(F.concat(assign, _spans("access", ACCESS), _spans("hex", HEX))).alias("base"))
    judged = stored(base.select("doc_id", F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["stop"])).alias("base"),
                                _candidates(F.col("base")).alias("runs")), "spans")
    cuts = thresholds(judged.select(F.explode("runs").alias("r")).select("r.stratum", "r.step"))
    limit = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]) if cuts else F.create_map(F.lit(-1), F.lit(STEPS))
    random = F.filter("runs", lambda r: r["step"] < F.coalesce(F.try_element_at(limit, r["stratum"]), F.lit(STEPS)))
    kinds = F.array(*map(F.lit, KINDS))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    both = F.array_sort(F.concat("base", F.transform("more", lambda r: F.struct(r["start"], r["kind"], r["stop"]))))
    return (judged.withColumn("more", random)
            .select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                    written(both).alias("spans"), F.size("more").cast("bigint").alias("n_random")))
