"""Tables in a folder that change whole or not at all.

A write goes to a folder of its own and is seen by nobody until one small file, the manifest of the next version, names it:
for every table and key (one partition folder) the writes that hold its rows. So a change to many keys of many tables appears
at once, and a job that dies before its manifest leaves the version before it as it was. Manifests are as long as there are keys.

A writer says which version it started from. If another has made the next one since, or both write it at the same time
and the other's file is older, it is refused (`Stale`), and what it staged is never seen. Writes that no manifest names are left to the
folder's owner to clear.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = "name string, key string, write string, facts string"


class Stale(RuntimeError):
    """Another writer has changed the tables since."""


@dataclass(frozen=True)
class Head:
    """A version: which writes hold each (table, key), and what was noted with it. Version 0 has nothing."""
    version: int = 0
    writes: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Staged:
    name: str
    write: str
    keys: tuple[str, ...]
    replaces: bool
    emptied: tuple[str, ...] = ()


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._head = spark, path.rstrip("/"), Head()
        spark.createDataFrame([], ENTRIES).write.mode("ignore").parquet(f"{self.path}/manifests/version=0")

    def _manifests(self, least: int) -> list:
        """The manifest of the latest version, from `least` on; of two files for one version the older holds."""
        found = self.spark.read.schema(f"{ENTRIES}, version bigint").parquet(f"{self.path}/manifests").where(F.col("version") >= least)
        found = found.withColumn("file", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("named")))
        last = found.agg(F.max("version").alias("version"))
        of = found.join(F.broadcast(last), "version")
        first = of.agg(F.min("file").alias("file"))
        return of.join(F.broadcast(first), "file").select("version", "file.named", "name", "key", "write", "facts").collect()

    def head(self) -> Head:
        rows = self._manifests(max(1, self._head.version))
        if rows:
            writes: dict[tuple[str, str], tuple[str, ...]] = {}
            for r in rows:
                if r["name"] is not None:
                    key = (r["name"], r["key"])
                    writes[key] = (*writes.get(key, ()), r["write"])
            self._head = Head(rows[0]["version"], {k: tuple(sorted(w)) for k, w in writes.items()}, json.loads(rows[0]["facts"]))
        return self._head

    def stage(self, df: DataFrame, name: str, key: str, replaces: bool = True, also: tuple[str, ...] = ()) -> Staged:
        """Write rows of some keys, unseen. They replace those of the same keys (and of the keys `also`), or are added to them."""
        write = uuid.uuid4().hex
        path = f"{self.path}/{name}/write={write}"
        df.withColumn("key", F.col(key).cast("string")).drop(key if key.startswith("_") else "").write.mode("error").partitionBy("key").parquet(path)
        try:
            found = [r[0] for r in self.spark.read.schema("key string").parquet(path).distinct().collect()]  # a name for each folder
        except AnalysisException:
            found = []
        return Staged(name, write, tuple(found), replaces, tuple({*also}.difference(found)))

    def commit(self, staged: list[Staged], expected: Head, **facts) -> Head:
        if self.head().version != expected.version:
            raise Stale(f"version {expected.version} was read, and {self._head.version} is there")
        writes = dict(expected.writes)
        for s in staged:
            for k in s.emptied:
                writes.pop((s.name, k), None)
            for k in s.keys:
                writes[s.name, k] = (s.write,) if s.replaces else (*writes.get((s.name, k), ()), s.write)
        told, version = json.dumps({**expected.facts, **facts}), expected.version + 1
        rows = [(n, k, w, told) for (n, k), ws in writes.items() for w in ws] or [(None, None, None, told)]
        mine = uuid.uuid4().hex
        rows.append((None, None, mine, told))
        self.spark.createDataFrame(rows, ENTRIES).coalesce(1).write.mode("append").parquet(f"{self.path}/manifests/version={version}")
        found = self._manifests(version)
        if found[0]["version"] == version and mine not in {r["write"] for r in found}:
            raise Stale(f"another writer made version {version}")
        return self.head()

    def read(self, name: str, schema: T.StructType | str, head: Head | None = None, keys: set[str] | None = None) -> DataFrame:
        """Rows of a table at a version, of some keys or all. Other writes' folders aren't even listed."""
        head = head or self.head()
        wanted = [f"{self.path}/{name}/write={w}/key={_escaped(k)}" for (n, k), ws in head.writes.items() if n == name and (keys is None or k in keys) for w in ws]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(*wanted)


def _escaped(key: str | None) -> str:
    """A partition folder's name, as Spark writes it."""
    if key is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or ord(c) < 32 else c for c in key)
