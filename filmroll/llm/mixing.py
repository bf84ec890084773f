"""Mixing sources to target weights: hierarchical budgets and seeded epochs, in DataFrame functions only.

Leaves are (domain, lang, source). A budget of tokens flows down the tree: each node shares what it got among its
children by weight, no child gets more than its capacity (its leaves' tokens times `max_epochs`), and what a full
child cannot take goes to its siblings by weight. Because a node never gets more than its children can hold
together, a shortage reaches the level above only after all siblings are full.

With capacities c and weights w the shares are min(c, w * level); the level follows from sorting children by c / w
and prefix sums, so sharing is one window per family of siblings over the small table of nodes.

A leaf with budget b and s tokens gives floor(b / s) whole epochs and then the shortest prefix of one more seeded
epoch that reaches the rest. Documents are ordered by md5(seed, leaf's epoch, doc_id). The prefix is found without
ordering a leaf: tokens per (leaf, bucket of the key) are summed before the shuffle, whole buckets below the cut
are taken, and only the bucket of the cut is ordered. Buckets follow the key's first hex digits, so a hot leaf is
split over 4096 of them.

Defined cases: a null text has no tokens; documents without tokens are never chosen; a null lang or source is
the name 'unknown'; a null doc_id is keyed as 'null'; rows with equal keys (repeated ids) are chosen together; an
empty table gives no rows; a budget above all capacities gives every document `max_epochs` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmroll.llm.common import NO_ID, stored
from filmroll.session import attach

DIGITS = 3
SEED = 17
MAX_EPOCHS = 4
#: Share of all tokens to draw; leaves that are short are repeated, up to MAX_EPOCHS.
FRACTION = 0.5
TREE = ["domain", "lang", "source"]
#: Weight of a node among its siblings, by its name; 1 where nothing is said.
WEIGHTS = {"domain": {"web": 3.0, "books": 2.0, "code": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0},
           "source": {}}
#: A source belongs to the domain at the remainder of its number, `web` where it has none.
DOMAINS = ["web", "web", "books", "code"]


def _domain() -> Column:
    number = F.regexp_extract(F.col("source"), "([0-9]{1,9})$", 1)
    at = F.when(number == "", F.lit(0)).otherwise(F.pmod(number.cast("int"), F.lit(len(DOMAINS))))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), at + 1)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, the leaf's names and the tokens (words between space and U+0009-U+000D) of each row."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("tokens"))
    return base.select("doc_id", _domain().alias("domain"), "lang", "source", "tokens")


def _weight(level: str, weights: dict) -> Column:
    known = weights.get(level, {})
    out = F.lit(1.0)
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def _share(nodes: DataFrame, family: list[str], level: str, weights: dict) -> DataFrame:
    """`given` of the family, shared among its children up to each child's `cap`: adds `got`."""
    order = [F.col("cap") / F.col("w"), F.col(level)]
    before = Window.partitionBy(*family).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*family).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    family_of = Window.partitionBy(*family)
    n = (nodes.withColumn("w", _weight(level, weights))
         .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("ws", F.sum("w").over(after))
         .withColumn("level", F.greatest(F.lit(0.0), (F.col("given") - F.col("full")) / F.col("ws"))))
    # the level is that of the first child not filled by it
    open_at = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"),
                           F.struct(F.col("cap") / F.col("w"), F.col(level), F.col("level")))).over(family_of)
    return (n.withColumn("cut", open_at.getField("level"))
            .withColumn("got", F.when(F.col("cut").isNull(), F.col("cap").cast("double"))
                        .otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("cut"))))
            .drop("w", "full", "ws", "level", "cut"))


def budgets(part: DataFrame, fraction: float = FRACTION, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS,
            budget: int | None = None) -> DataFrame:
    """domain, lang, source, size, got: the tokens each leaf of `leaves()` must give. `budget` None: `fraction` of
    all tokens."""
    size = part.groupBy(*TREE).agg(F.sum("tokens").alias("size")).where("size > 0")
    nodes = size.withColumn("cap", F.col("size") * max_epochs)
    everything = F.sum("size").over(Window.partitionBy("root"))
    given = F.lit(float(budget)) if budget is not None else everything * F.lit(float(fraction))
    top = (nodes.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("size").alias("size"))
           .withColumn("root", F.lit(0)).withColumn("given", given))
    top = _share(top, ["root"], "domain", weights).select("domain", F.col("got").alias("given"))
    mid = nodes.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(top, "domain")
    mid = _share(mid, ["domain"], "lang", weights).select("domain", "lang", F.col("got").alias("given"))
    low = _share(nodes.join(mid, ["domain", "lang"]), ["domain", "lang"], "source", weights)
    return low.select(*TREE, "size", F.round("got").cast("bigint").alias("got"))


def mix(docs: DataFrame, fraction: float = FRACTION, weights: dict = WEIGHTS, seed: int = SEED,
        max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """doc_id, the leaf, tokens and `copies` (how often the document is drawn) of every document drawn."""
    part = stored(leaves(docs), "leaves").where("tokens > 0")
    need = (budgets(part, fraction, weights, max_epochs, budget)
            .withColumn("whole", F.floor(F.col("got") / F.col("size"))).withColumn("left", F.col("got") % F.col("size")))
    rows = (attach(part, need.select(*TREE, "whole", "left"), TREE, label="budgets")
            .withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))))
    rows = rows.withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = rows.where("left > 0").groupBy(*TREE, "bucket", "left").agg(F.sum("tokens").alias("held"))
    run = F.sum("held").over(Window.partitionBy(*TREE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(run, F.lit(0)))
    cut = (sums.where("before < left and before + held >= left")
           .select(*TREE, F.col("bucket").alias("cut"), "before"))
    rows = attach(rows, cut, TREE, "left", label="cuts")
    inside = F.coalesce(F.sum("tokens").over(
        Window.partitionBy(*TREE, "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    own = Window.partitionBy(*TREE, "bucket", "key")
    at_cut = (rows.where(F.col("bucket") == F.col("cut"))
              .withColumn("upto", inside).withColumn("same", F.sum("tokens").over(own))
              .withColumn("extra", (F.col("before") + F.col("upto") - F.col("same") < F.col("left")).cast("int"))
              .drop("upto", "same"))
    others = (rows.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut")))
              .withColumn("extra", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("int")))
    drawn = others.unionByName(at_cut).withColumn("copies", (F.col("whole") + F.col("extra")).cast("bigint"))
    return drawn.where("copies > 0").select("doc_id", *TREE, "tokens", "copies")


def draw(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, each as often as it is drawn. Keys that `mix` draws together stay together."""
    names = {c: f"__{c}__" for c in ("id", "lang", "source", "copies")}
    while {*names.values()} & {*docs.columns}:
        names = {c: f"_{n}" for c, n in names.items()}
    key = [names["id"], names["lang"], names["source"]]
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    keyed = docs.withColumns(dict(zip(key, (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), known("lang"), known("source")))))
    drawn = (mix(docs, **how).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key[0]), F.col("lang").alias(key[1]),
                                     F.col("source").alias(key[2]), F.col("copies").alias(names["copies"])).dropDuplicates(key))
    found = attach(keyed, drawn, key, label="drawn").where(F.regexp_like(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]")))
    return found.withColumn(names["copies"], F.explode(F.sequence(F.lit(1).cast("bigint"), names["copies"]))).select(*[f"`{c}`" for c in docs.columns])


def _case(level: str) -> str:
    known = "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    return f"CASE {level}{known} ELSE 1.0 END" if known else "1.0"


def _shared(name: str, source: str, family: str, level: str) -> str:
    part = f"PARTITION BY {family}" if family else ""
    return f"""
{name}_w AS (SELECT *, {_case(level)}::DOUBLE AS w FROM {source}),
{name}_l AS (SELECT *, greatest(0.0, (given - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lv FROM {name}_w),
{name}_c AS (SELECT *, min(CASE WHEN cap / w > lv THEN struct_pack(a := cap / w, b := {level}, c := lv) END) OVER ({part}) AS cut FROM {name}_l),
{name} AS (SELECT * EXCLUDE (given, w, lv, cut), CASE WHEN cut IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, w * cut.c) END AS got FROM {name}_c)"""


ORACLE = f"""
WITH base AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
    regexp_extract(coalesce(source, 'unknown'), '([0-9]{{1,9}})$', 1) AS num FROM documents),
d AS (SELECT doc_id, lang, source, tokens, {DOMAINS!r}[CASE WHEN num = '' THEN 0 ELSE num::INT % {len(DOMAINS)} END + 1] AS domain FROM base),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS size, (sum(tokens) * {MAX_EPOCHS})::BIGINT AS cap FROM d GROUP BY ALL HAVING sum(tokens) > 0),
dom AS (SELECT domain, sum(cap)::BIGINT AS cap, (SELECT sum(size) FROM leaf) * {FRACTION}::DOUBLE AS given FROM leaf GROUP BY domain),
{_shared("t1", "dom", "", "domain")},
lan AS (SELECT domain, lang, sum(l.cap)::BIGINT AS cap, any_value(got) AS given FROM leaf l JOIN t1 USING (domain) GROUP BY domain, lang),
{_shared("t2", "lan", "domain", "lang")},
sou AS (SELECT l.*, got AS given FROM leaf l JOIN t2 USING (domain, lang)),
{_shared("t3", "sou", "domain, lang", "source")},
need AS (SELECT domain, lang, source, round(got)::BIGINT // size AS whole, round(got)::BIGINT % size AS left_ FROM t3),
rows_ AS (SELECT doc_id, domain, lang, source, tokens, whole, left_, md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key
    FROM d JOIN need USING (domain, lang, source) WHERE tokens > 0),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING)
    - sum(tokens) OVER (PARTITION BY domain, lang, source, key) AS before FROM rows_)
SELECT doc_id, domain, lang, source, tokens, (whole + (before < left_)::INT)::BIGINT AS copies FROM run
WHERE whole + (before < left_)::INT > 0"""
