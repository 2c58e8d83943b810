"""Tables in versions: one manifest names the files of every table, and is swapped in as the last step of a change.

A table is dealt into buckets by a hash of its first key column and, where it says so, by a column such as the month. A
change rewrites the partitions that its rows fall into and leaves all others as they are. What no
manifest names was never written: a run that is cut leaves the last version whole, and :meth:`Tables.recover` deletes the rest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlake.storage import materialize, release

BUCKET = "__bucket"


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """What tells whether tables have changed: names, sizes and times of their files."""
    found, hadoop = [], spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(hadoop).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))


class Tables:
    """The tables under one folder, which one writer changes at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def _children(self, path: str) -> list[str]:
        fs = self._fs(path)
        if not fs.exists(self._path(path)):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(path)))

    def version(self) -> int:
        """The newest version, 0 before the first change."""
        return max((int(n.removesuffix(".json")) for n in self._children(f"{self.root}/manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "run": None, "stages": []}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/manifests/{version:09d}.json", wholetext=True).collect()))

    def read(self, name: str, version: int | None = None, only: dict[str, list] | None = None) -> DataFrame:
        """One table of a version; ``only`` reads no other partitions than those with these values of its partition columns."""
        entry = self.manifest(version)["tables"][name]
        schema = StructType.fromJson(entry["schema"])
        wanted = [p for p in entry["parts"] if all(p["values"][c] in v for c, v in (only or {}).items())]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*sorted({f"{self.root}/{p['folder']}" for p in wanted}))

    def _dealt(self, rows: DataFrame, entry: dict) -> DataFrame:
        bucket = F.pmod(F.xxhash64(entry["keys"][0]), F.lit(entry["buckets"])).cast("int")
        return rows.withColumn(BUCKET, bucket)

    def create(self, entry_of: dict[str, tuple[DataFrame, list[str], int, str | None]]) -> None:
        """The first version: name to (rows, key columns, buckets, column of a further partition or None)."""
        manifest = {"tables": {}, "run": None, "stages": []}
        for name, (rows, keys, buckets, by) in entry_of.items():
            entry = {"schema": rows.schema.jsonValue(), "keys": keys, "buckets": buckets, "by": by, "parts": []}
            entry["parts"] = self._write(name, rows, entry)
            manifest["tables"][name] = entry
        self._swap(manifest)

    def _write(self, name: str, rows: DataFrame, entry: dict) -> list[dict]:
        """Write rows into new folders, one a partition; the partitions they fall into."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        columns = [BUCKET, *([entry["by"]] if entry["by"] else [])]
        copies = [F.col(c).alias(f"part_{c}") for c in columns]
        # a partition column leaves the files, so copies of them make the folders
        dealt = self._dealt(rows, entry).select(*rows.columns, *copies)
        dealt = dealt.repartition(*[F.col(f"part_{c}") for c in columns])
        dealt.write.partitionBy(*[f"part_{c}" for c in columns]).parquet(f"{self.root}/{folder}")
        parts = []
        for first in self._children(f"{self.root}/{folder}"):
            if not first.startswith("part_"):
                continue
            below = self._children(f"{self.root}/{folder}/{first}") if entry["by"] else [None]
            for second in below:
                if second and not second.startswith("part_"):
                    continue
                values = {x.split("=", 1)[0].removeprefix("part_"): x.split("=", 1)[1] for x in (first, second) if x}
                parts.append({"values": values, "folder": "/".join([folder, first, *([second] if second else [])])})
        return parts

    def change(self, run: str, stage: str, rows: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None) -> None:
        """``rows`` of each table replace or join those of equal keys and the keys in ``gone`` leave: all tables at once, as ``stage`` of ``run``.

        Partitions that none of these keys falls into are neither read nor written.
        """
        manifest, held = self.manifest(), []
        for name in {**rows, **(gone or {})}:
            entry = manifest["tables"][name]
            schema = StructType.fromJson(entry["schema"])
            where = [*entry["keys"], *([entry["by"]] if entry["by"] and entry["by"] not in entry["keys"] else [])]
            new = materialize(rows[name].select(*[F.col(f.name).cast(f.dataType) for f in schema]), name) if name in rows else self.spark.createDataFrame([], schema)
            keys = new.select(*where)
            if gone and name in gone:
                keys = keys.unionByName(gone[name].select(*where))
            keys = materialize(keys.distinct(), name)
            held += [keys, *([new] if name in rows else [])]
            columns = [BUCKET, *([entry["by"]] if entry["by"] else [])]
            # at most buckets times values of the partition column
            touched = {tuple(str(v) for v in r) for r in self._dealt(keys, entry).select(*columns).distinct().collect()}
            old = [p for p in entry["parts"] if tuple(p["values"][c] for c in columns) in touched]
            if old:
                before = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p['folder']}" for p in old])
                new = before.join(keys.select(*entry["keys"]), entry["keys"], "left_anti").select(*schema.names).unionByName(new)
            if touched:
                entry["parts"] = [p for p in entry["parts"] if p not in old] + self._write(name, new, entry)
        stages = manifest["stages"] if manifest["run"] == run else []
        self._swap(manifest | {"run": run, "stages": [*stages, stage]})
        for frame in held:
            release(frame)

    def done(self, run: str) -> list[str]:
        """The stages of a run that are part of the newest version."""
        manifest = self.manifest()
        return manifest["stages"] if manifest["run"] == run else []

    def _swap(self, manifest: dict) -> None:
        """Name a new version: the manifest is written aside and renamed, which a reader sees whole or not at all."""
        number = self.version() + 1
        aside, final = f"{self.root}/manifests/.{uuid.uuid4().hex}", f"{self.root}/manifests/{number:09d}.json"
        fs = self._fs(aside)
        out = fs.create(self._path(aside))
        out.write(bytearray(json.dumps(manifest | {"version": number}).encode()))
        out.close()
        if fs.exists(self._path(final)) or not fs.rename(self._path(aside), self._path(final)):
            raise RuntimeError(f"version {number} was written by another run")

    def recover(self, keep: int | None = None) -> list[str]:
        """Delete folders that no manifest names, and with ``keep`` all but the last ``keep`` versions; what was deleted."""
        newest = self.version()
        gone = []
        for name in self._children(f"{self.root}/manifests"):
            old = name.endswith(".json") and keep is not None and int(name.removesuffix(".json")) <= newest - keep
            if old or not name.endswith(".json"):
                self._fs(self.root).delete(self._path(f"{self.root}/manifests/{name}"), True)
        named = set()
        for name in self._children(f"{self.root}/manifests"):
            for entry in self.manifest(int(name.removesuffix(".json")))["tables"].values():
                named |= {"/".join(p["folder"].split("/")[:3]) for p in entry["parts"]}
        for table in self._children(f"{self.root}/data"):
            for folder in self._children(f"{self.root}/data/{table}"):
                if f"data/{table}/{folder}" not in named:
                    self._fs(self.root).delete(self._path(f"{self.root}/data/{table}/{folder}"), True)
                    gone.append(f"{table}/{folder}")
        return gone
