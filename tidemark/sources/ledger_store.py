"""A ledger as versioned snapshots with a keyed merge.

A version is a Parquet folder `versions/<n>`; the file CURRENT names the one that readers see. A merge reads the current version, joins
the changes to it once, writes the next version, and only then replaces CURRENT by an atomic rename: a reader sees the old ledger or the
new one whole, and a writer that dies before the rename leaves nothing but a folder that the next merge overwrites. Changes that
change nothing write no version, so a run can be repeated.

One writer at a time: a merge that finds another version current than the one it read gives up. A version that readers still hold stays
until `prune` removes it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Merged:
    version: int
    inserted: int = 0
    changed: int = 0
    closed: int = 0


class LedgerStore:
    """keys: the columns that name a row, without nulls. outcome: the column whose first value closes a row. `opened` and `closed` are
    the versions in which a row came and was closed."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], outcome: str = "outcome"):
        self.spark, self.folder, self.keys, self.outcome = spark, folder.rstrip("/"), keys, outcome
        self.schema = spark.createDataFrame([], f"{schema}, opened int, closed int").schema
        self.columns = [c for c in self.schema.names if c not in ("opened", "closed")]
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """The current version; 0 before the first merge."""
        at = self._path("CURRENT")
        return int(self.spark.read.text(str(at)).first()[0]) if self._fs.exists(at) else 0

    def _where(self, version: int) -> str:
        return f"{self.folder}/versions/{version:09d}"

    def rows(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return self.spark.read.schema(self.schema).parquet(self._where(version)) if version else self.spark.createDataFrame([], self.schema)

    def merge(self, changes: DataFrame, order: Column | None = None) -> Merged:
        """Insert rows with new keys, and give known ones the values of changes that aren't NULL; a closed row changes no more. Changes
        that share a key count as the last of them by `order` (by all their columns, without)."""
        now = self.version()
        whole = F.struct(*self.columns)
        new = changes.where(" and ".join(f"{k} is not null" for k in self.keys))
        new = new.groupBy(*self.keys).agg((F.max(whole) if order is None else F.max_by(whole, order)).alias("new"))
        old = self.rows(now).select(*self.keys, F.struct(*self.schema.names).alias("old"))
        both = old.join(new, self.keys, "full_outer")
        was_open = F.col("old.closed").isNull()
        value = {c: F.when(F.col("old").isNull(), F.col(f"new.{c}")).when(was_open, F.coalesce(f"new.{c}", f"old.{c}")).otherwise(F.col(f"old.{c}")) for c in self.columns}
        rows = both.select(*[(F.col(c) if c in self.keys else value[c]).alias(c) for c in self.columns], F.coalesce("old.opened", F.lit(now + 1)).cast("int").alias("opened"), F.col("old.closed").alias("_closed"), F.col("old").isNull().alias("_new"), F.struct(*[F.col(f"old.{c}").alias(c) for c in self.columns]).alias("_old"))
        ends = F.col("_closed").isNull() & F.col(self.outcome).isNotNull()
        differs = ~F.col("_new") & ~F.struct(*self.columns).eqNullSafe(F.col("_old"))
        # marks of what happened go with the version, so that the join runs once
        rows = rows.withColumn("closed", F.when(ends, F.lit(now + 1)).otherwise(F.col("_closed")).cast("int")).withColumn("_what", F.when(F.col("_new"), "inserted").when(differs, "changed"))
        target = self._where(now + 1)
        rows.select(*self.schema.names, "_what").write.mode("overwrite").parquet(target)
        counts = self.spark.read.parquet(target).agg(F.count_if(F.col("_what") == "inserted"), F.count_if(F.col("_what") == "changed"), F.count_if(F.col("closed") == now + 1)).first()
        if not counts[0] and not counts[1] and not counts[2]:
            self._fs.delete(self._hadoop.Path(target), True)
            return Merged(now)
        self._switch(now, now + 1)
        return Merged(now + 1, *counts)

    def _switch(self, seen: int, version: int) -> None:
        if self.version() != seen:
            raise RuntimeError("another writer has merged into this ledger")
        draft = self._path(f"CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(f"{version}\n".encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self._hadoop.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path("CURRENT")), options)

    def prune(self, keep: int = 2) -> None:
        """Remove all but the last `keep` versions up to the current one."""
        now = self.version()
        root = self._path("versions")
        for status in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if int(status.getPath().getName()) <= now - keep:
                self._fs.delete(status.getPath(), True)
