"""A table of Parquet parts with a manifest for each version: replace by key, append, merge, reads as of a version.

Rows lie under ``data/<key>=<value>/v=<write>/``; a write never touches files of another. ``log/<n>`` lists the parts
(key value and write) that version n consists of, and appears in one step, after all of them are written: until then,
and if the job or its driver dies, readers see the version before. Of two writers at once the second one puts its parts
on the first one's list; only where both have replaced the same key value does the later one fail.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a local session without it, in the warehouse."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/foliary-{name}-{uuid.uuid4().hex}"


class ConflictError(Exception):
    """Two writers have replaced the same key value."""


class Files:
    """The few calls of Hadoop's file system that a manifest needs; any store that Spark can write is one."""

    def __init__(self, spark: SparkSession, base: str):
        jvm = spark._jvm
        self.path, self.jvm, self.gateway = jvm.org.apache.hadoop.fs.Path, jvm, spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(base).getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def names(self, pattern: str) -> list[str]:
        found = self.fs.globStatus(self.path(pattern))
        return sorted(s.getPath().toString() for s in found) if found is not None else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """The whole file appears at once, or False where there is one by that name."""
        draft = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(draft))
        stream.write(bytearray(text.encode()))
        stream.close()
        plain = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.context.rename(self.path(draft), self.path(path), plain)
        except Exception as e:
            self.fs.delete(self.path(draft), False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def move(self, path: str, to: str) -> None:
        if self.fs.exists(self.path(path)):
            self.fs.rename(self.path(path), self.path(to))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class VersionedTable:
    """key: the column by which rows are replaced. inner: further columns that parts are divided by. form: parquet, or
    json for files that others read. compression: of the parts, the form's own by default."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | StructType, inner: tuple[str, ...] = (), form: str = "parquet", compression: str | None = None):
        self.spark, self.path, self.key, self.inner, self.form = spark, path.rstrip("/"), key, inner, form
        self.options = {"compression": compression} if compression else {}
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.files = Files(spark, path)

    # ---- versions

    def versions(self) -> list[int]:
        return [int(n.rpartition("/")[2]) for n in self.files.names(f"{self.path}/log/[0-9]*") if not n.endswith(".tmp")]

    def manifest(self, version: int | None = None) -> dict:
        """{"parts": [[folder of the key value, write], ..] in the order they were written, "tags": {writer: its last number}}."""
        known = self.versions()
        if version is None and known:
            version = known[-1]
        if version is None:
            return {"parts": [], "tags": {}, "version": 0}
        if version not in known:
            raise ValueError(f"no version {version} of {self.path}")
        return {**json.loads(self.files.read(f"{self.path}/log/{version:08d}")), "version": version}

    def read(self, version: int | None = None, keys: Iterable | None = None) -> DataFrame:
        """Rows of a version (the newest), with ``v``, the write that a row came with. keys: only these key values are listed."""
        parts = self.manifest(version)["parts"]
        folders = None if keys is None else {self._folder(k) for k in keys}
        paths = [f"{self.path}/data/{k}/v={v}" for k, v in parts if folders is None or k in folders]
        full = StructType([*self.schema.fields, *StructType.fromDDL("v string").fields])
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").format(self.form).load(paths)

    # ---- writes

    def replace(self, df: DataFrame, tag: tuple[str, int] | None = None) -> int:
        """Every key value that df has gets df's rows instead of its own. Returns the version.

        tag: a writer and the number of this write of its. One that isn't above the writer's last changes nothing, so a
        write may be tried again without harm."""
        return self._tagged(df, True, tag)

    def append(self, df: DataFrame, tag: tuple[str, int] | None = None) -> int:
        return self._tagged(df, False, tag)

    def _tagged(self, df: DataFrame, drop: bool, tag: tuple[str, int] | None) -> int:
        now = self.manifest()
        if tag is not None and tag[1] <= now["tags"].get(tag[0], -1):
            return now["version"]
        return self._commit(self._write(df), now["version"], drop=drop, tag=tag)

    def merge(self, df: DataFrame, on: list[str], gone: str | None = None) -> int:
        """df's rows win over those with equal ``on`` columns (the key is one of them); rows where ``gone`` is true are
        deleted. Only key values that df has are read and written. One row for each ``on`` in df."""
        base = self.manifest()["version"]
        touched = [r[0] for r in df.select(self.key).distinct().collect()]  # listed in the manifest anyway
        columns = [f.name for f in self.schema.fields]
        same = on[0] if len(on) == 1 else on
        stay = self.read(base or None, touched).select(columns).join(df.select(on), same, "left_anti").select(columns)
        fresh = df.where(~F.col(gone)) if gone else df
        write = self._write(stay.unionByName(fresh.select(columns)))
        # A key value that lost its last row has no new part, yet its old ones go.
        return self._commit(write, base, drop=True, also={self._folder(k) for k in touched}, strict=True)

    def drop(self, keys: Iterable) -> int:
        return self._commit((uuid.uuid4().hex, []), self.manifest()["version"], drop=True, also={self._folder(k) for k in keys})

    def vacuum(self, keep: int = 1) -> int:
        """Deletes parts that none of the last ``keep`` versions names, and those versions' manifests. Only without writers."""
        known = self.versions()
        named = {tuple(p) for v in known[-keep:] for p in self.manifest(v)["parts"]}
        old = [n for n in self.files.names(f"{self.path}/data/*/v=*") if tuple(n.split("/data/")[-1].split("/v=")) not in named]
        for n in [*old, *(f"{self.path}/log/{v:08d}" for v in known[:-keep])]:
            self.files.delete(n)
        return len(old)

    def _folder(self, value) -> str:
        """The folder's name as Spark writes it."""
        if value is None:
            return f"{self.key}=__HIVE_DEFAULT_PARTITION__"
        return f"{self.key}=" + self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))

    def _write(self, df: DataFrame, write: str | None = None) -> tuple[str, list[str]]:
        """write: one that isn't committed yet, which df adds to."""
        write = write or uuid.uuid4().hex
        df.withColumn("v", F.lit(write)).write.partitionBy(self.key, "v", *self.inner).mode("append").options(**self.options).format(self.form).save(f"{self.path}/data")
        return write, [n.split("/data/")[-1].split("/v=")[0] for n in self.files.names(f"{self.path}/data/*/v={write}")]

    def _commit(self, written: tuple[str, list[str]], base: int, drop: bool, also: set[str] = frozenset(), strict: bool = False, tag: tuple[str, int] | None = None) -> int:
        """Puts the parts of a write on the newest manifest. strict: fails if a touched key value has changed since base."""
        write, folders = written
        touched = {*folders, *also}
        began = {tuple(p) for p in self.manifest(base)["parts"]} if base else set()
        while True:
            now = self.manifest()
            if tag is not None and tag[1] <= now["tags"].get(tag[0], -1):
                return now["version"]  # another attempt at this write has been committed meanwhile
            since = {k for k, v in {tuple(p) for p in now["parts"]} ^ began if k in touched}
            if since and (strict or drop):
                raise ConflictError(f"changed by another writer since version {base}: {sorted(since)[:5]}")
            parts = [p for p in now["parts"] if not (drop and p[0] in touched)] + [[k, write] for k in folders]
            tags = now["tags"] | (dict([tag]) if tag is not None else {})
            version = now["version"] + 1
            if self.files.put_new(f"{self.path}/log/{version:08d}", json.dumps({"parts": parts, "tags": tags})):
                return version
