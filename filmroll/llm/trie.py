"""The prefix trie of conversations, its totals passed upwards by time-forward processing.

A node is a distinct sequence of first turns (role, text); its key is the sum, modulo 2**127 - 1, of the turns' digests
times powers of a fixed multiplier by position. So turns are hashed one by one, and prefixes are running sums over
range-partitioned rows: a conversation of any length spans many tasks, which hand on one sum each.

Totals of a node (members, leaves, saved tokens) come from its children's:

* Shards. A node is heavy if more than `limit` conversations pass through it, limit being the greater of LIMIT and a
  millionth of all rows; so there are at most a million heavy nodes or so. A heavy node is a shard of its own. A light
  child of a heavy node roots a shard, and so does every `limit`-th level below, so a shard is bounded in breadth and depth.
* Within a shard nodes are sorted by Spark, deepest first, and read once. Each takes the messages for it from a priority
  queue in the same order and sends its totals to its parent; queues that outgrow memory spill sorted runs.
* Across shard roots. Totals of shards without shards below are final, and are summed by the node they hang under, so a
  node of many children is combined before the shuffle. The other roots, of bounded number, are one more forward pass.
  Saved tokens are linear in members: a shard below adds its own, and its members times the code points between the two
  roots. With the totals from below, the shards that have some are passed over again.

Defined cases: turns are ordered by turn (null first), then role, then text; a null role or text is empty, and rows that
repeat are turns of their own; rows without a conv_id are left out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import shutil
import struct
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import stored
from filmroll.operators.ordering import number_within
from filmroll.session import attach, store

#: Conversations through a node, or levels of a shard, that one shard may have on small inputs.
LIMIT = 1000
#: Messages held in memory by a queue.
HELD = 200_000
#: Ids joined to one row before they are hashed.
CHUNK = 4096
#: Donated turns, and conversations that share a donor, by the rule of `rebuilt`.
MOST_DONATED, DONOR = 6, 100

PRIME = 2**127 - 1
#: A fixed value below the prime.
STEP = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
NODE = ["d", "k1", "k2"]
SHARD = ["rd", "r1", "r2"]


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size) and their turns (conv_id, d from 1, role, text), where the first few turns of each are
    those of the first conversation of its hundred."""
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = stored(number_within(own, ["conv_id"], ["turn", "role", "text"], "at"), "turns")  # from 1
    counts = own.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = counts.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_DONATED, "donor": F.col("conv_id") - F.col("conv_id") % DONOR})
    convs = convs.join(counts.select(F.col("conv_id").alias("donor"), F.col("own").alias("given")), "donor", "left").withColumn(
        "given", F.least("h", F.coalesce("given", F.lit(0))))
    convs = stored(convs.withColumn("size", F.col("given") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "conversations")
    # a donor gives at most five turns to fewer than two hundred conversations
    first = own.where(F.col("at") <= MOST_DONATED).select(F.col("conv_id").alias("donor"), "at", "role", "text")
    donated = convs.join(first, "donor").where(F.col("at") <= F.col("given")).select("conv_id", F.col("at").alias("d"), "role", "text")
    rest = own.join(convs.drop("own"), "conv_id").where(F.col("at") > F.col("h")).select(
        "conv_id", (F.col("given") + F.col("at") - F.col("h")).alias("d"), "role", "text")
    return convs.select("conv_id", "size"), donated.union(rest)


_SUMS = "conv_id bigint, d bigint, len bigint, cum bigint, s1 bigint, s2 bigint, slice int"
_KEYED = "conv_id bigint, d bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, len bigint, cum bigint"


def _pair(x: int) -> tuple[int, int]:
    return x >> 64, (x & (2**64 - 1)) - 2**63


def _number(a: int, b: int) -> int:
    return (a << 64) + b + 2**63


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a slice's turns, from the conversation's first turn in the slice on."""
    conv, total, cum = None, 0, 0
    for b in batches:
        c = b.to_pydict()
        k1, k2, cums = [], [], []
        for i, d, v, n in zip(c["conv_id"], c["d"], c["value"], c["len"]):
            if i != conv:
                conv, total, cum = i, 0, 0
            total = (total + int.from_bytes(v, "big") * pow(STEP, d, PRIME)) % PRIME if d else total
            cum += n
            a, e = _pair(total)
            k1.append(a)
            k2.append(e)
            cums.append(cum)
        longs = [pa.array(x, pa.int64()) for x in (c["conv_id"], c["d"], c["len"], cums, k1, k2)]
        yield pa.RecordBatch.from_arrays([*longs, pa.array(c["slice"], pa.int32()), pa.array(c["value"], pa.binary())],
                                         ["conv_id", "d", "len", "cum", "s1", "s2", "slice", "value"])


def _keys(carried: dict[int, tuple[int, int, int]]):
    """The whole sums: a slice's first conversation adds what the slices before it have of it."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, out = b.to_pydict(), []
            for i, d, n, cum, a, e, at, v in zip(*(c[x] for x in ("conv_id", "d", "len", "cum", "s1", "s2", "slice", "value"))):
                total = _number(a, e)
                conv, more, longer = carried.get(at, (None, 0, 0))
                if conv == i:
                    total, cum = (total + more) % PRIME, cum + longer
                before = (total - int.from_bytes(v, "big") * pow(STEP, d, PRIME)) % PRIME if d else 0
                out.append((i, d, *_pair(total), *_pair(before), n, cum))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 8,
                                             ["conv_id", "d", "k1", "k2", "p1", "p2", "len", "cum"])
    return task


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows (conv_id, d, key, parent's key, code points of the last text and of all texts, last) of every prefix, the empty
    one included."""
    length = lambda c: F.lpad(F.hex(F.octet_length(c)), 16, "0")
    digest = F.unhex(F.substring(F.sha2(F.encode(F.concat(length("role"), "role", "text"), "UTF-8"), 256), 1, 30))
    values = turns.select("conv_id", F.col("d").cast("bigint").alias("d"), digest.alias("value"), F.char_length("text").cast("bigint").alias("len"))
    values = values.union(convs.select("conv_id", F.lit(0).cast("bigint"), F.lit(b""), F.lit(0).cast("bigint")))
    cut = values.repartitionByRange("conv_id", "d").withColumn("slice", F.spark_partition_id()).sortWithinPartitions("conv_id", "d")
    sums = stored(cut.mapInArrow(_running, _SUMS + ", value binary"), "sums")
    edges = (sums.groupBy("slice").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "d", "s1", "s2", "cum")).alias("last"))
             .orderBy("slice").collect())  # a row for each slice
    carried, conv, total, cum = {}, None, 0, 0
    for e in edges:
        carried[e["slice"]] = (conv, total, cum)
        whole = e["first"] == e["last"]["conv_id"] == conv
        conv, total, cum = e["last"]["conv_id"], (_number(e["last"]["s1"], e["last"]["s2"]) + (total if whole else 0)) % PRIME, e["last"]["cum"] + (cum if whole else 0)
    keyed = sums.mapInArrow(_keys(carried), _KEYED)
    return stored(keyed.join(convs, "conv_id").withColumn("last", F.col("d") == F.col("size")).drop("size"), "prefixes")


class Outbox:
    """Messages by the place of their receiver, smallest first; what outgrows `held` is on disk in sorted runs."""

    ROW = struct.Struct("<6q")
    BLOCK = 4096

    def __init__(self, folder: Path, held: int = HELD):
        self.folder, self.held, self.made = folder, held, 0
        self.new: list[tuple] = []
        self.runs: list[tuple] = []  # (next row, number of the run, rows that follow it)

    def _rows(self, path: Path) -> Iterator[tuple]:
        with path.open("rb") as f:
            while block := f.read(self.ROW.size * self.BLOCK):
                yield from self.ROW.iter_unpack(block)
        path.unlink()

    def put(self, row: tuple) -> None:
        heapq.heappush(self.new, row)
        if len(self.new) > self.held:
            self.made += 1
            path = self.folder / str(self.made)
            path.write_bytes(b"".join(self.ROW.pack(*r) for r in sorted(self.new)))
            self.new = []
            rows = self._rows(path)
            heapq.heappush(self.runs, (next(rows), self.made, rows))

    def take(self, place: tuple) -> Iterator[tuple]:
        """Removes and gives the messages for `place`; receivers come in order, so these are the smallest."""
        n = len(place)
        while True:
            from_run = self.runs and (not self.new or self.runs[0][0] < self.new[0])
            top = self.runs[0][0] if from_run else self.new[0] if self.new else None
            if top is None or top[:n] != place:
                return
            if from_run:
                _, k, rows = self.runs[0]
                following = next(rows, None)
                if following is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, (following, k, rows))
            else:
                heapq.heappop(self.new)
            yield top[n:]


_ITEMS = [*SHARD, *NODE, "kind", "p1", "p2", "len", "members", "children", "leaves", "saved"]
_TOTALS = ", ".join(f"{c} bigint" for c in [*SHARD, *NODE, "n_convs", "n_children", "n_leaves", "saved_tokens"])


def _up(held: int):
    """Nodes of whole shards, deepest first, each behind the messages from shards below: the totals of every node."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Path(tempfile.mkdtemp(prefix="forward-"))  # of this task alone
        try:
            box, shard, members, children, leaves, saved = Outbox(folder, held), None, 0, 0, 0, 0
            for b in batches:
                out = []
                for rd, r1, r2, d, k1, k2, kind, p1, p2, n, m, c, lv, sv in zip(*(b.column(x).to_pylist() for x in _ITEMS)):
                    members, children, leaves, saved = members + m, children + c, leaves + lv, saved + sv
                    if kind == 0:
                        continue  # the node itself follows
                    for m, lv, sv in box.take((-d, k1, k2)):
                        members, children, leaves, saved = members + m, children + 1, leaves + lv, saved + sv
                    leaves += not children
                    saved += (members - 1) * n
                    out.append((rd, r1, r2, d, k1, k2, members, children, leaves, saved))
                    if d > rd:
                        box.put((1 - d, p1, p2, members, leaves, saved))
                    members, children, leaves, saved = 0, 0, 0, 0
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 10,
                                                 [x.split()[0] for x in _TOTALS.split(", ")])
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    return task


_UPPER = [*SHARD, "sd", "s1", "s2", "before", "members", "leaves", "saved", "below", "below_leaves", "below_saved", "below_cut"]
_UPPER_OUT = ", ".join(f"{c} bigint" for c in [*SHARD, "n_convs", "n_leaves", "saved_tokens"])


def _across(held: int):
    """Shard roots with shards below, deepest first: the totals of every root."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Path(tempfile.mkdtemp(prefix="forward-"))  # of this task alone
        try:
            box = Outbox(folder, held)
            for b in batches:
                out = []
                for rd, r1, r2, sd, s1, s2, before, members, leaves, saved, n, lv, sv, cut in zip(*(b.column(x).to_pylist() for x in _UPPER)):
                    members, leaves, saved = members + n, leaves + lv, saved + sv + cut - n * before
                    for n, lv, sv in box.take((-rd, r1, r2)):  # sv is told from the text's start on, like the sums above
                        members, leaves, saved = members + n, leaves + lv, saved + sv - n * before
                    out.append((rd, r1, r2, members, leaves, saved))
                    if sd is not None:
                        box.put((-sd, s1, s2, members, leaves, saved + members * before))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 6,
                                                 [x.split()[0] for x in _UPPER_OUT.split(", ")])
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    return task


def _forward(items: DataFrame, held: int) -> DataFrame:
    cut = items.select(*_ITEMS).repartition(*SHARD)
    return cut.sortWithinPartitions(*SHARD, F.desc("d"), "k1", "k2", "kind").mapInArrow(_up(held), _TOTALS)


def _sharded(nodes: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """`nodes` with the root of their shard (rd, r1, r2), and roots with that of the shard above (sd, s1, s2)."""
    heavy, _ = store(nodes.where((F.col("weight") > limit) | (F.col("d") == 0)).select(*NODE), "heavy")
    heavy_of = attach(rows.where("d > 0").select("conv_id", *NODE), heavy, NODE).groupBy("conv_id").agg(F.max("d").alias("hm"))
    known = nodes.join(heavy_of, "conv_id", "left").withColumn("hm", F.coalesce("hm", F.lit(0)))

    def root(d):
        return F.when(d <= F.col("hm"), d).otherwise(F.greatest(F.col("hm") + 1, d - d % limit))

    known = known.withColumns({"rd": root(F.col("d")), "sd": F.when(root(F.col("d")) == F.col("d"), F.when(F.col("d") > 0, root(F.col("d") - 1)))})
    # a node's smallest member goes through the roots of its shard and of the one above
    path = rows.select("conv_id", F.col("d").alias("rd"), F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    known = known.join(path, ["conv_id", "rd"])
    return known.join(path.toDF("conv_id", "sd", "s1", "s2"), ["conv_id", "sd"], "left").drop("hm")


def totals(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """n_convs, n_children, n_leaves and saved_tokens of all nodes of `_sharded`."""
    zero = F.lit(0).cast("bigint")
    own = nodes.select(*_ITEMS[:6], F.lit(1).alias("kind"), "p1", "p2", "len", F.col("ends").alias("members"),
                       zero.alias("children"), zero.alias("leaves"), zero.alias("saved"))
    above = F.col("sd").isNotNull()
    hung = nodes.where(above).select(F.col("sd").alias("rd"), F.col("s1").alias("r1"), F.col("s2").alias("r2"), (F.col("d") - 1).alias("d"),
                                     F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("d").alias("cd"), F.col("k1").alias("c1"), F.col("k2").alias("c2"))

    def messages(found: DataFrame) -> DataFrame:
        return found.groupBy(*SHARD, *NODE).agg(F.count("*").alias("children"), F.sum("n").alias("members"), F.sum("lv").alias("leaves"), F.sum("sv").alias("saved")).select(
            *_ITEMS[:6], F.lit(0).alias("kind"), zero.alias("p1"), zero.alias("p2"), zero.alias("len"), "members", "children", "leaves", "saved")

    hints = messages(hung.select(*SHARD, *NODE, zero.alias("n"), zero.alias("lv"), zero.alias("sv")))
    local = stored(_forward(own.unionByName(hints), held), "local")

    roots = nodes.where((F.col("rd") == F.col("d"))).select(*SHARD, "sd", "s1", "s2", (F.col("cum") - F.col("len")).alias("before"))
    at_root = local.where(F.col("rd") == F.col("d")).select(*SHARD, F.col("n_convs").alias("members"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    roots = roots.join(at_root, SHARD)
    inner = stored(hints.select(*SHARD).distinct(), "inner")
    leaf = roots.join(inner, SHARD, "left_anti")
    below = leaf.where(above).groupBy("sd", "s1", "s2").agg(
        F.sum("members").alias("below"), F.sum("leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"),
        F.sum(F.col("members") * F.col("before")).alias("below_cut")).withColumnsRenamed(dict(zip(("sd", "s1", "s2"), SHARD)))
    upper = roots.join(inner, SHARD).join(below, SHARD, "left").fillna(0, ["below", "below_leaves", "below_saved", "below_cut"])
    across = stored(upper.select(*_UPPER).repartition(1).sortWithinPartitions(F.desc("rd"), "r1", "r2").mapInArrow(_across(held), _UPPER_OUT), "across")

    ready = leaf.select(*SHARD, F.col("members").alias("n_convs"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")).union(across)
    ready = ready.toDF("cd", "c1", "c2", "n", "lv", "sv")
    full = messages(hung.join(ready, ["cd", "c1", "c2"]).select(*SHARD, *NODE, "n", "lv", "sv"))
    again = _forward(own.join(inner, SHARD, "left_semi").unionByName(full), held)
    return local.join(inner, SHARD, "left_anti").union(again).drop(*SHARD)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node, in order, as texts of up to CHUNK ids."""
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                          ["d", "k1", "k2", "first", "ids"])
    node, ids = None, []
    for b in batches:
        done = []
        for *key, conv in zip(*(b.column(c).to_pylist() for c in (*NODE, "conv_id"))):
            if ids and (key != node or len(ids) == CHUNK):
                done.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = key
            ids.append(conv)
        if done:
            yield out(done)
    if ids:
        yield out([(*node, ids[0], ",".join(map(str, ids)))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, told = None, None
    for b in batches:
        done = []
        for *key, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
            if key != node:
                if node is not None:
                    done.append((*node, told.hexdigest()))
                node, told = key, hashlib.sha256(ids.encode())
            else:
                told.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip((*NODE, "ends_sha256"), zip(*done))))
    if node is not None:
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip((*NODE, "ends_sha256"), (*node, told.hexdigest()))})


def ends(rows: DataFrame) -> DataFrame:
    """The digest of the ids, in order, of the conversations that end at each node. Ids are joined slice by slice first,
    so that only long texts are left for the one task that a digest, whose input is a sequence, must have."""
    cut = rows.where("last").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = cut.mapInArrow(_joined, "d bigint, k1 bigint, k2 bigint, first bigint, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "d bigint, k1 bigint, k2 bigint, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, limit: int = LIMIT, held: int = HELD) -> DataFrame:
    """One row per node of the trie of `turns` (conv_id, d from 1 without gaps, role, text) of `convs` (conv_id, size)."""
    rows = prefixes(convs, turns)
    nodes, facts = store(rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("len").alias("len"), F.min("cum").alias("cum"),
        F.count("*").alias("weight"), F.sum(F.col("last").cast("bigint")).alias("ends")), "nodes", rows=F.sum("weight"))
    nodes = stored(_sharded(nodes, rows, max(limit, (facts["rows"] or 0) // 1_000_000)), "sharded")
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.select("conv_id", *NODE, "p1", "p2").join(parents, ["d", "p1", "p2"], "left")
    told = named.join(totals(nodes, held), NODE).join(ends(rows), NODE, "left")
    return told.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, limit: int = LIMIT, held: int = HELD) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as `rebuilt` makes them."""
    return trie(*rebuilt(turns), limit, held)


ORACLE = f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at FROM conversations WHERE conv_id IS NOT NULL),
byte AS (SELECT conv_id, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)::BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc FROM own GROUP BY conv_id),
conv AS (SELECT c.conv_id, c.crc % {MOST_DONATED} AS h, least(c.crc % {MOST_DONATED}, coalesce(g.n, 0)) AS given, c.conv_id - c.conv_id % {DONOR} AS donor
    FROM byte c LEFT JOIN byte g ON g.conv_id = c.conv_id - c.conv_id % {DONOR}),
turn AS (SELECT c.conv_id, o.at AS d, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.donor AND o.at <= c.given
    UNION ALL SELECT c.conv_id, c.given + o.at - c.h, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.at > c.h),
path AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY d) AS p FROM turn GROUP BY conv_id),
whole AS (SELECT conv_id, coalesce(p, []) AS p FROM conv LEFT JOIN path USING (conv_id)),
pre AS (SELECT conv_id, d, p[1:d] AS node, d = len(p) AS last FROM whole, range(0, (SELECT max(len(p)) + 1 FROM whole)) t(d) WHERE d <= len(p)),
node AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE len(node[d].t) END AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM pre GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
under AS (SELECT n.node[1:t.a] AS top, n.n_convs, n.size, k.n IS NULL AS leaf FROM node n LEFT JOIN kids k USING (node), range(0, (SELECT max(d) + 1 FROM node)) t(a) WHERE t.a <= n.d),
sums AS (SELECT top AS node, count_if(leaf) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved FROM under GROUP BY top)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN q.conv_id END AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved AS saved_tokens, n.ends_sha256
FROM node n JOIN sums s USING (node) LEFT JOIN kids k USING (node) LEFT JOIN node q ON q.node = n.node[1:n.d - 1] AND n.d > 0"""
