"""Stores with a writer: a table in a shared folder whose versions replace each other in one step.

A store's rows are dealt into parts by a hash of a key. A put reads the parts that its batch touches, merges, and writes these
parts anew into a folder of their own; a manifest in log/ then names the folder of each part. The manifest of a version is
written aside and renamed without overwriting, so of two writers one wins, and the other merges again on top of it. What a
lost write leaves behind is named by no manifest. A manifest also keeps the last batch of each writer, so a repeated batch
changes nothing. The rename must be atomic, as on HDFS; on a local folder, for tests, Hadoop checks first and then renames.
Columns named __part are not allowed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]
PART = "__part"


@dataclass
class Manifest:
    version: int = 0
    #: part: the folder that holds it
    parts: dict[str, str] = field(default_factory=dict)
    #: writer: its last batch and the version that it made
    writers: dict[str, list[int]] = field(default_factory=dict)


class Store:
    """schema is the rows' (DDL); key deals them into parts: rows that a merge holds against each other must agree on it. Nulls are a key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Column, parts: int = 64) -> None:
        self.spark, self.path, self.schema, self.parts = spark, path.rstrip("/"), schema, parts
        self.part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        self.empty = spark.createDataFrame([], schema)
        if PART in self.empty.columns:
            raise ValueError(f"{PART} is not a column of a store")

    # ---- files ----
    @property
    def _hadoop(self):
        return self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._hadoop[0].Path(f"{self.path}/{name}")

    def _listed(self, name: str) -> dict[str, int]:
        """Names in a folder of the store and when they were changed, in ms."""
        at = self._at(name)
        files = at.getFileSystem(self._hadoop[1])
        return {s.getPath().getName(): s.getModificationTime() for s in files.listStatus(at)} if files.exists(at) else {}

    def _drop(self, name: str) -> None:
        at = self._at(name)
        at.getFileSystem(self._hadoop[1]).delete(at, True)

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._listed("log") if n.endswith(".json") and not n.startswith("."))

    def _commit(self, manifest: Manifest) -> bool:
        """Whether the manifest became its version; false where another writer's did."""
        fs, conf = self._hadoop
        aside = self._at(f"log/.{uuid.uuid4().hex}")
        out = aside.getFileSystem(conf).create(aside, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(aside.getFileSystem(conf).getUri(), conf).rename(aside, self._at(f"log/{manifest.version:012d}.json"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._drop(f"log/{aside.getName()}")
            return False
        return True

    # ---- reading ----
    def manifest(self, version: int | None = None) -> Manifest:
        """That of a version, or the newest one; version 0 is the empty store."""
        if version is None:
            version = (self._versions() or [0])[-1]
        if version == 0:
            return Manifest()
        return Manifest(**json.loads(self.spark.read.text(f"{self.path}/log/{version:012d}.json", wholetext=True).first()[0]))

    def _rows(self, parts: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/{PART}={part}" for part, folder in sorted(parts.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.empty

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version).parts)

    def added(self, version: int, identity: list[str]) -> DataFrame:
        """Rows of a version whose identity the one before it did not hold. Only parts that it wrote are read. Both versions must still be there."""
        new, old = self.manifest(version), self.manifest(version - 1)
        changed = {p: f for p, f in new.parts.items() if old.parts.get(p) != f}
        before = self._rows({p: f for p, f in old.parts.items() if p in changed}).select(*[F.col(c).alias(f"__{c}") for c in identity])
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in identity]
        return self._rows(changed).join(before, same, "left_anti")

    # ---- writing ----
    def _written(self, rows: DataFrame) -> dict[str, str]:
        """rows in a new folder, by part: part to folder."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*self.empty.columns).withColumn(PART, self.part).hint("rebalance", PART)
        dealt.write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        return {n.split("=")[1]: folder for n in self._listed(folder) if n.startswith(f"{PART}=")}

    def put(self, batch: DataFrame, merge: Merge, writer: str, number: int) -> int | None:
        """merge(held, batch) replaces what the parts of the batch hold; the version that this made.

        A writer numbers its batches upwards. The last one again gives the version that it made, an earlier one None; neither changes anything.
        """
        incoming = None
        while True:
            now = self.manifest()
            last, made = now.writers.get(writer, [-1, 0])
            if number <= last:
                return made if number == last else None
            incoming = self._written(batch) if incoming is None else incoming
            touched = {p: f for p, f in now.parts.items() if p in incoming}
            replaced = self._written(merge(self._rows(touched), self._rows(incoming))) if incoming else {}
            if stray := set(replaced) - set(incoming):
                raise ValueError(f"the merge moved rows to parts {sorted(stray)}, which the batch does not touch")
            kept = {p: f for p, f in now.parts.items() if p not in incoming}
            following = Manifest(now.version + 1, kept | replaced, now.writers | {writer: [number, now.version + 1]})
            if self._commit(following):
                for folder in set(incoming.values()):
                    self._drop(folder)
                return following.version

    def clear(self, writer: str, number: int) -> int | None:
        """An empty version, as a batch of a writer."""
        while True:
            now = self.manifest()
            last, made = now.writers.get(writer, [-1, 0])
            if number <= last:
                return made if number == last else None
            if self._commit(Manifest(now.version + 1, {}, now.writers | {writer: [number, now.version + 1]})):
                return now.version + 1

    def sink(self, merge: Merge, writer: str) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: a batch that a restarted stream repeats changes nothing."""
        return lambda batch, number: self.put(batch, merge, writer, number) and None

    def vacuum(self, keep: int = 2, grace_s: float = 86_400) -> int:
        """Drops manifests but the newest `keep`, and folders that these do not name and that are older than the grace, which must exceed the time of a put. How many folders went."""
        versions = self._versions()
        held = {f for v in versions[-keep:] for f in self.manifest(v).parts.values()}
        for v in versions[:-keep]:
            self._drop(f"log/{v:012d}.json")
        old = [n for n, changed in self._listed("data").items() if f"data/{n}" not in held and changed < (time.time() - grace_s) * 1000]
        for n in old:
            self._drop(f"data/{n}")
        return len(old)
