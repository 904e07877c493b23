"""Tables as lists of files: snapshots, rollback, retention and deletion without copies of what stays.

A table is a folder with data/ (Parquet files that are never changed) and manifests/ (one folder a version, a row a file: its
name, length, rows and a digest of its rows). Spark writes new files into data/; a version is committed by renaming its
manifest into place, after its number has been claimed by a file that only one writer can create. A snapshot is a further
manifest of the same files, a rollback one of an earlier version's, and retention deletes the files that no manifest
names any more. Deletion rewrites the files that hold such rows and refers to all others.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import col
from millrace.sources.writers import content_hash, hadoop

MANIFEST = "version long, ts string, kind string, columns string, file string, length long, rows long, digest string"
STAMP = "%Y%m%dT%H%M%S%f"


def versioned_table(spark: SparkSession, uri: str) -> tuple[VersionedTable, int | None]:
    """The table and version of versioned:path or versioned:path@version."""
    path, _, version = uri.removeprefix("versioned:").partition("@")
    return VersionedTable(spark, path), int(version) if version else None


class ConflictError(RuntimeError):
    """Another writer has committed a version since this one was read."""


class VersionedTable:
    """A table of files under path. Versions are numbered from 1."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # ---- manifests

    def _entries(self, folder: str) -> list[str]:
        fs, p = hadoop(self.spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """The committed versions in order."""
        return sorted(int(n[2:]) for n in self._entries("manifests") if n.startswith("v-"))

    def exists(self) -> bool:
        return bool(self.versions())

    def current(self) -> int:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"{self.path} has no version")
        return versions[-1]

    def manifest(self, *versions: int) -> DataFrame:
        """The manifest rows of versions (all, if none is given); of each version one row without file."""
        names = [f"{self.path}/manifests/v-{v:012d}" for v in versions or self.versions()]
        return self.spark.read.schema(MANIFEST).parquet(*names)

    def history(self) -> DataFrame:
        """(version, ts, kind, files, rows, bytes) of each version."""
        rows = self.manifest().groupBy("version", "ts", "kind")
        return rows.agg(F.count("file").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))

    def _commit(self, files: DataFrame, columns: T.StructType, kind: str, after: int, now: datetime | None) -> int:
        """Commit files (file, length, rows, digest) as the version that follows `after`."""
        version, stamp = after + 1, (now or datetime.now(UTC)).strftime(STAMP)
        head = self.spark.createDataFrame([(None, None, None, None)], "file string, length long, rows long, digest string")
        told = [F.lit(version).cast("long").alias("version"), F.lit(stamp).alias("ts"), F.lit(kind).alias("kind"), F.lit(columns.json()).alias("columns")]
        beside = f"{self.path}/manifests/_{uuid.uuid4().hex}"
        head.union(files.select("file", "length", "rows", "digest")).select(*told, "*").coalesce(1).write.parquet(beside)
        fs, claim = hadoop(self.spark, f"{self.path}/manifests/_claim-{version:012d}")
        source, target = (hadoop(self.spark, p)[1] for p in (beside, f"{self.path}/manifests/v-{version:012d}"))
        if not fs.createNewFile(claim):
            fs.delete(source, True)
            raise ConflictError(f"version {version} of {self.path} is taken; if its writer broke off, recover() frees it")
        if not fs.rename(source, target):
            raise OSError(f"cannot commit version {version} of {self.path}")
        return version

    def _last(self) -> int:
        """The last number taken, by a committed version or by a writer that broke off."""
        names = self._entries("manifests")
        return max([0, *(int(n[2:]) for n in names if n.startswith("v-")), *(int(n[7:]) for n in names if n.startswith("_claim-"))])

    def _write(self, df: DataFrame) -> DataFrame:
        """Write df's rows as new files: their manifest rows."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        there = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        name = F.concat(F.lit(folder + "/"), F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("file")
        kept = there.select(name, F.col("_metadata.file_size").alias("length"), F.struct(*[col(c) for c in df.columns]).alias("r"))
        return kept.groupBy("file", "length").agg(F.count("*").alias("rows"), content_hash(kept.select("r")).alias("digest"))

    def _files(self, version: int) -> DataFrame:
        return self.manifest(version).where("file IS NOT NULL")

    def _columns(self, version: int) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest(version).where("file IS NULL").first()["columns"]))

    # ---- reading and writing

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the current one."""
        version = version or self.current()
        names = [f"{self.path}/{r.file}" for r in self._files(version).select("file").collect()]
        columns = self._columns(version)
        return self.spark.read.schema(columns).parquet(*names) if names else self.spark.createDataFrame([], columns)

    def overwrite(self, df: DataFrame, now: datetime | None = None) -> int:
        """df's rows as a new version, which may be computed from the table itself."""
        return self._commit(self._write(df), df.schema, "overwrite", self._last(), now)

    def append(self, df: DataFrame, now: datetime | None = None) -> int:
        """A version with df's rows beside the current ones, whose files are referred to."""
        version = self.current()
        return self._commit(self._files(version).select("file", "length", "rows", "digest").union(self._write(df)), self._columns(version), "append", version, now)

    def snapshot(self, now: datetime | None = None) -> int:
        """A version of the current files; no data file is written."""
        version = self.current()
        return self._commit(self._files(version), self._columns(version), "snapshot", version, now)

    def rollback(self, version: int, now: datetime | None = None) -> int:
        """A version of the files of an earlier one: the very same files."""
        return self._commit(self._files(version), self._columns(version), f"rollback to {version}", self.current(), now)

    def delete_where(self, condition: Column, now: datetime | None = None) -> int:
        """A version without the rows for which condition is true; the current one if there are none.

        Only files with such rows are rewritten; the scan that finds them leaves out row groups by their statistics.
        """
        version = self.current()
        own = F.coalesce(condition, F.lit(False))
        parts = F.split("_metadata.file_path", "/")
        name = F.concat(F.lit("data/"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1)).alias("file")
        names = [r.file for r in self.read(version).where(condition).select(name).distinct().collect()]
        if not names:
            return version
        columns = self._columns(version)
        old = self._files(version)
        listed = self.spark.createDataFrame([(n,) for n in names], "file string")
        stay = old.join(listed, "file", "left_anti").select("file", "length", "rows", "digest")
        rest = self.spark.read.schema(columns).parquet(*(f"{self.path}/{n}" for n in names)).where(~own)
        made = self._write(rest).where("rows > 0")
        return self._commit(stay.union(made), columns, "delete", version, now)

    def recover(self) -> list[int]:
        """Give back the numbers that writers took and broke off before they committed; call it while no one writes."""
        done = set(self.versions())
        left = [int(n[7:]) for n in self._entries("manifests") if n.startswith("_claim-") and int(n[7:]) not in done]
        left = [v for v in left if v > max(done, default=0)]
        for v in left:
            fs, claim = hadoop(self.spark, f"{self.path}/manifests/_claim-{v:012d}")
            fs.delete(claim, False)
        return left

    # ---- retention

    def expire(self, days: float, now: datetime | None = None) -> tuple[int, int]:
        """Delete versions older than so many days but the current one, then the files that no version names any more:
        (versions deleted, files deleted). Files of a write that has not been committed yet count as unnamed, so expire
        while no one writes."""
        limit = ((now or datetime.now(UTC)) - timedelta(days=days)).strftime(STAMP)
        current = self.current()
        old = [r.version for r in self.manifest().where(F.col("file").isNull() & (F.col("ts") < limit) & (F.col("version") != current)).select("version").collect()]
        for v in old:
            fs, p = hadoop(self.spark, f"{self.path}/manifests/v-{v:012d}")
            fs.delete(p, True)
        return len(old), self._sweep()

    def _sweep(self) -> int:
        """Delete the data files that no manifest names."""
        fs, base = hadoop(self.spark, f"{self.path}/data")
        if not fs.exists(base):
            return 0
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.path}/data").select("path")
        names = listed.select("path", F.concat(F.lit("data/"), F.element_at(F.split("path", "/"), -2), F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("file"))
        named = self.manifest().where("file IS NOT NULL").select("file").distinct()
        unnamed = names.where("file LIKE '%.parquet'").join(named, "file", "left_anti").select("path").collect()
        for r in unnamed:
            fs.delete(hadoop(self.spark, r.path)[1], False)
        return len(unnamed)


def delete_subject_files(table: VersionedTable, user_column: str, user: object, id_column: str, purge: bool = False) -> tuple[int, DataFrame]:
    """(version without a user's rows, ids deleted); rows without a user stay, files without the user keep their names.

    Earlier versions still hold the rows, until they expire; purge lets them expire at once, after the ids are written
    down, so that no file with the user's rows is left.
    """
    before = table.current()
    own = col(user_column).cast("string") == F.lit(str(user))
    kind = dict(table.read(before).dtypes)[user_column]
    alike = isinstance(user, int) and kind in ("int", "bigint") or isinstance(user, str) and kind == "string"
    condition = col(user_column) == F.lit(user) if alike else own  # without a cast it reaches the files' statistics
    ids = table.read(before).where(condition).select(col(id_column).alias("deleted_id"))
    version = table.delete_where(condition)
    if purge:
        from millrace.operators.rows import stable

        ids = stable(ids)
        table.expire(0, datetime.now(UTC) + timedelta(seconds=1))
    return version, ids
