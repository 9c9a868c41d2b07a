"""Versions of tables behind one rename, and a table by key whose merges and reads touch only the files that may hold
the keys."""

from __future__ import annotations

import json
import math
import time
import uuid
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.sinks import last_wins


class Conflict(RuntimeError):
    """Another writer has committed the version that was to come next."""


class Folder:
    """A folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.store = self._at().getFileSystem(self._conf)

    def _at(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.store.exists(self._at(name))

    def names(self, name: str = "") -> dict[str, int]:
        """Names in a subfolder, with the times they changed last, in milliseconds."""
        return {s.getPath().getName(): s.getModificationTime() for s in self.store.listStatus(self._at(name))} if self.exists(name) else {}

    def delete(self, name: str) -> None:
        self.store.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> None:
        """In one step, and only if nobody has the new name."""
        context = self._hadoop.FileContext.getFileContext(self._at().toUri(), self._conf)
        self.store.mkdirs(self._at(new).getParent())
        options = self._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = getattr(self._hadoop, "Options$Rename").NONE
        try:
            context.rename(self._at(old), self._at(new), options)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"{self.path}/{new} is there already") from None
            raise


class Versions:
    """Manifests of a folder: version n is the table of rows in ``<folder>/<n>``, complete when it has that name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def last(self) -> int:
        """The newest version, or -1."""
        return max((int(n) for n in self.folder.names() if n.isdigit()), default=-1)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/{version:012d}")

    def commit(self, rows: DataFrame, version: int) -> None:
        """Writes rows as a version; raises Conflict if it is there already, and then changes nothing."""
        name = f".{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.folder.path}/{name}")
        try:
            self.folder.rename(name, f"{version:012d}")
        except Conflict:
            self.folder.delete(name)
            raise

    def forget(self, keep: int) -> None:
        for n in sorted(n for n in self.folder.names() if n.isdigit())[:-keep]:
            self.folder.delete(n)


_ENTRY = "file string, lower string, least string, most string, rows long, schema string"


class KeyedTable:
    """Rows by a unique string key, in files that each hold a range of keys, sorted.

    A manifest lists the files: ``lower`` is where a file's share of all keys begins (null: at the start), ``least`` and
    ``most`` are the keys in it. A merge rewrites the files in whose shares its keys fall, beside the old ones, and becomes
    visible by one rename of its manifest: stopped before, it has changed nothing; two merges at once cannot both commit
    the same version, and the later one starts again. Readers take a manifest whole and open only files that overlap the
    keys they ask for. What the driver holds of it is one bound for each file.

    A null key is refused; of a batch's rows with one key the largest (of all columns, in order) stays.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, rows_per_file: int = 1_000_000) -> None:
        self.spark, self.path, self.key, self.rows_per_file = spark, path.rstrip("/"), key, rows_per_file
        self.versions = Versions(spark, f"{self.path}/manifest")

    # ---- reads

    def entries(self, where: Column | None = None) -> list:
        """The manifest's rows, in order of keys, if they fulfil a condition."""
        at = self.versions.last()
        if at < 0:
            return []
        rows = self.versions.read(at)
        return (rows if where is None else rows.where(where)).orderBy(F.asc_nulls_first("lower")).collect()

    def _rows(self, entries: list) -> DataFrame:
        known = entries or self.entries(F.col("lower").isNull())
        # files of before a column came lack it
        schemas = sorted((T.StructType.fromJson(json.loads(e["schema"])) for e in known), key=len)
        schema = schemas[-1] if schemas else T.StructType([T.StructField(self.key, T.StringType())])
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{e['file']}" for e in entries))

    def read(self) -> DataFrame:
        return self._rows(self.entries())

    def overlapping(self, start: str | None = None, stop: str | None = None) -> list:
        """The entries of files that may hold keys with start <= key < stop."""
        where = F.lit(True)
        if start is not None:
            where = where & (F.col("most") >= start)
        if stop is not None:
            where = where & (F.col("least") < stop)
        return self.entries(where)

    def range(self, start: str | None = None, stop: str | None = None) -> DataFrame:
        rows = self._rows(self.overlapping(start, stop))
        if start is not None:
            rows = rows.where(F.col(self.key) >= start)
        return rows.where(F.col(self.key) < stop) if stop is not None else rows

    def get(self, *keys: str) -> DataFrame:
        """The rows of some keys; their files' pages are found by the filter on the sorted key."""
        asked = self.spark.createDataFrame([(k,) for k in keys], "k string")
        at = self.versions.last()
        if at < 0 or not keys:
            return self._rows([])
        hit = self.versions.read(at).join(F.broadcast(asked), (F.col("least") <= F.col("k")) & (F.col("k") <= F.col("most")), "left_semi")
        return self._rows(hit.orderBy(F.asc_nulls_first("lower")).collect()).where(F.col(self.key).isin(list(keys)))

    # ---- merges

    def _share(self, lowers: list[str]) -> Column:
        """In which file's share a key falls."""

        @F.pandas_udf(T.IntegerType())
        def of(keys: pd.Series) -> pd.Series:
            return keys.map(lambda k: bisect_right(lowers, k))

        return of(F.col(self.key))

    def upsert(self, df: DataFrame, tries: int = 5) -> int:
        """Merges rows; the version that has them."""
        for left in range(tries, 0, -1):
            try:
                return self._merge(df)
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    def _merge(self, df: DataFrame) -> int:
        version = self.versions.last() + 1
        old = self.entries()
        share = self._share([e["lower"] for e in old[1:]])
        work = f"data/{version:012d}-{uuid.uuid4().hex}"
        known = F.when(F.col(self.key).isNull(), F.raise_error(F.lit(f"{self.key} is null"))).otherwise(F.col(self.key).cast("string"))
        rows = df.withColumn(self.key, known)
        others = [c for c in df.columns if c != self.key]
        rows = last_wins(rows.withColumn("_all", F.struct(*others) if others else F.lit(0)), [self.key], "_all").drop("_all")
        rows.withColumn("_share", share).write.parquet(f"{self.path}/{work}/batch")
        batch = self.spark.read.parquet(f"{self.path}/{work}/batch")
        counts = {r["_share"]: r["n"] for r in batch.groupBy("_share").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return version - 1
        touched = [old[i] for i in sorted(counts)] if old else []
        merged = batch
        if touched:
            before = self._rows(touched).withColumn("_share", share)
            merged = before.join(batch.select(self.key), self.key, "left_anti").unionByName(batch, allowMissingColumns=True)
        n = max(len(counts), math.ceil((sum(counts.values()) + sum(e["rows"] for e in touched)) / self.rows_per_file))
        dealt = merged.repartitionByRange(n, "_share", self.key).sortWithinPartitions("_share", self.key)
        dealt.write.option("maxRecordsPerFile", 2 * self.rows_per_file).partitionBy("_share").parquet(f"{self.path}/{work}/rows")
        fresh = self.spark.read.parquet(f"{self.path}/{work}/rows")
        name = F.regexp_extract(F.col("_metadata.file_path"), f"({work}/rows/.*)$", 1)
        found = fresh.groupBy(name.alias("file"), "_share").agg(F.min(self.key).alias("least"), F.max(self.key).alias("most"), F.count("*").alias("rows"))
        lowers = self.spark.createDataFrame([(i, old[i]["lower"] if old else None) for i in counts], "_share int, share_lower string")
        first = F.row_number().over(Window.partitionBy("_share").orderBy("least")) == 1
        schema = fresh.drop("_share").schema.json()
        entries = found.join(lowers, "_share").select("file", F.when(first, F.col("share_lower")).otherwise(F.col("least")).alias("lower"), "least", "most", "rows", F.lit(schema).alias("schema"))
        if old:
            gone = self.spark.createDataFrame([(e["file"],) for e in touched], "file string")
            entries = self.versions.read(version - 1).join(gone, "file", "left_anti").unionByName(entries)
        self.versions.commit(entries, version)
        return version

    def vacuum(self, keep: int = 2, older_than_ms: int = 24 * 3600 * 1000) -> None:
        """Deletes versions but the last ones, and folders of rows that none of those lists and that are older: left by
        merges that were stopped, or merged since."""
        self.versions.forget(keep)
        folder = Folder(self.spark, self.path)
        used = {e["file"].split("/")[1] for v in self.versions.folder.names() if v.isdigit() for e in self.versions.read(int(v)).select("file").collect()}
        for name, changed in folder.names("data").items():
            if name not in used and changed < time.time() * 1000 - older_than_ms:
                folder.delete(f"data/{name}")
