"""Versioned keyed tables (S4, T8): stored vectors and answers that several jobs may write.

A store is a folder

    data/write=<id>/prefix=../   Parquet files of one write, by the first digits of the key
    commits/<version>            one JSON manifest per version

A write is staged in a folder of its own and becomes visible by one rename that creates the
manifest of the next version; the rename fails when another writer was first.  The loser
looks at what has come in between, leaves out the keys that are there by now, and tries
again.  So a killed write leaves a readable store (its staged files belong to no version),
and each key is in a version once.  A manifest names the folders of its version, the rows
and a fingerprint of all (key, row) pairs, which does not depend on their order.

Readers take the latest manifest.  A reader that knows which keys it wants reads only the
prefixes of those keys; files carry a Bloom filter on the key for equality filters.  When a
version has many folders, a write merges them first.  ``vacuum`` deletes what no kept
version names.

Keys are hex strings (MD5).  A null key is refused.  An empty write makes no version, but
the first one does, so that an empty store can be read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of a prefix (256 prefixes), folders of a version before they are merged, tries of a commit.
PREFIX_DIGITS, MERGE_AFTER, TRIES = 2, 16, 20


@dataclass
class Manifest:
    version: int
    folders: list[str]
    rows: int
    fingerprint: str
    schema: str
    tags: list[str] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, folder: str, key: str = "key"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------------ versions
    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("commits")):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path("commits")) if s.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, or of the latest one; None for a folder without any."""
        if version is None:
            found = self.versions()
            if not found:
                return None
            version = found[-1]
        stream = self._fs.open(self._path("commits", f"{version:020}"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, manifest: Manifest) -> bool:
        """Create the manifest of a version in one step; False if the version is there."""
        jvm = self.spark._jvm
        staged = self._path("commits", f"_{uuid.uuid4().hex}")
        target = self._path("commits", f"{manifest.version:020}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs.makeQualified(staged), self._fs.makeQualified(target), options)
            return True
        except Exception as error:
            if not self._fs.exists(target):
                raise RuntimeError(f"cannot write version {manifest.version} of {self.folder}") from error
            self._fs.delete(staged, False)
            return False

    # ------------------------------------------------------------------ reading
    def read(self, prefixes: list[str] | None = None, manifest: Manifest | None = None) -> DataFrame | None:
        """The rows of the latest version, or of the given one; only those of some prefixes if
        named.  None for a folder without a version."""
        manifest = manifest or self.manifest()
        if manifest is None:
            return None
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        if not manifest.folders:
            return self.spark.createDataFrame([], schema)
        stored = self._folders(manifest.folders, schema)
        if prefixes is not None:
            stored = stored.where(F.col("prefix").isin(prefixes))
        return stored.select(*schema.names)

    def _folders(self, names: list[str], schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema.fields, *(T.StructField(c, T.StringType()) for c in ("write", "prefix"))])
        return self.spark.read.schema(whole).option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/{n}" for n in names])

    def prefixes(self, keyed: DataFrame) -> list[str]:
        """Prefixes of the keys of a table: at most 16 ** PREFIX_DIGITS values."""
        return sorted(r[0] for r in keyed.select(F.substring(self.key, 1, PREFIX_DIGITS).alias("p")).distinct().collect() if r[0] is not None)

    def missing(self, keyed: DataFrame) -> DataFrame:
        """Rows of ``keyed`` whose key is not stored."""
        if self.manifest() is None:
            return keyed
        return keyed.join(self.read(self.prefixes(keyed)).select(self.key), self.key, "left_anti")

    # ------------------------------------------------------------------ writing
    def stage(self, rows: DataFrame) -> str:
        """Write rows (one for each key) that no version names yet; gives their folder's name."""
        name = f"write={uuid.uuid4().hex}"
        checked = F.when(F.col(self.key).isNotNull(), F.substring(self.key, 1, PREFIX_DIGITS)).otherwise(F.raise_error(F.lit("a stored row needs a key")))
        keyed = rows.withColumn("prefix", checked).repartition("prefix")
        keyed.write.partitionBy("prefix").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.folder}/data/{name}")
        return name

    def _staged(self, name: str, schema: T.StructType) -> DataFrame:
        return self._folders([name], schema).select(*schema.names)

    def _summary(self, rows: DataFrame) -> tuple[int, int]:
        hashed = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(rows.schema[c].dataType, T.MapType) else F.col(c) for c in sorted(rows.columns)])
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0))).first()
        return n, int(total) % (1 << 64)

    def commit(self, name: str, schema: T.StructType, based_on: int | None, tag: str | None = None, replace: bool = False) -> Manifest:
        """Make staged rows part of the next version.  ``based_on``: the version whose keys they
        were chosen without; keys that have come in since are left out."""
        for _ in range(TRIES):
            now = self.manifest()
            if tag is not None and now is not None and tag in now.tags:
                return now
            if now is not None and not replace and now.version != (based_on or 0):
                fresh = self._staged(name, schema)
                name = self.stage(fresh.join(self.read(manifest=now).select(self.key), self.key, "left_anti"))
                based_on = now.version
            rows, total = self._summary(self._staged(name, schema))
            old = now if now is not None and not replace else Manifest(0, [], 0, f"{0:016x}", schema.json())
            if not rows and now is not None and not replace and tag is None:
                return now
            told = Manifest((now.version if now else 0) + 1, [*old.folders, name] if rows else old.folders, old.rows + rows,
                            f"{(int(old.fingerprint, 16) + total) % (1 << 64):016x}", schema.json(), [*old.tags, tag][-1000:] if tag else old.tags)
            if self._publish(told):
                return told
        raise RuntimeError(f"{self.folder}: other writers were first {TRIES} times")

    def append(self, rows: DataFrame, tag: str | None = None, replace: bool = False, merge_after: int = MERGE_AFTER) -> Manifest:
        """Add rows whose keys the store lacks.  A ``tag`` marks the write: one that is there
        already is not written again.  ``replace`` starts anew."""
        now = self.manifest()
        if tag is not None and now is not None and tag in now.tags:
            return now
        if now is not None and not replace and len(now.folders) >= merge_after:
            now = self.merge()
        return self.commit(self.stage(rows), rows.schema, now.version if now else None, tag, replace)

    def merge(self) -> Manifest:
        """Rewrite the latest version's folders as one."""
        now = self.manifest()
        if now is None or len(now.folders) < 2:
            return now
        name = self.stage(self.read(manifest=now))
        merged = Manifest(now.version + 1, [name], now.rows, now.fingerprint, now.schema, now.tags)
        return merged if self._publish(merged) else self.manifest()  # another write came first: later

    def vacuum(self, keep: int = 1) -> int:
        """Delete older manifests and the folders that no kept version names; no writer may be at work."""
        kept = self.versions()[-keep:]
        named = {f for v in kept for f in self.manifest(v).folders}
        gone = 0
        for status in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            if status.getPath().getName() not in named:
                gone += bool(self._fs.delete(status.getPath(), True))
        for version in self.versions():
            if version not in kept:
                self._fs.delete(self._path("commits", f"{version:020}"), False)
        return gone


def corpus_version(df: DataFrame, *columns: str) -> str:
    """A fingerprint of some columns of a table, whatever the order of its rows: their count
    and the sum of 48 bits of each row's MD5."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(part), F.lit(0))).first()
    return f"{n}-{int(total)}"
