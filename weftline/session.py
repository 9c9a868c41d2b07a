"""Session defaults and the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir (tests, local runs).
DEFAULT_SHARED = "file:///tmp/checkpoints"


def session(name: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the queries expect; on a cluster the rest comes from spark-defaults."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; made Spark's checkpoint folder where it has none. Only a local session
    may leave it unset: elsewhere a machine's own folder is not shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or DEFAULT_SHARED
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in here go when it ends: for writes, whose shuffles nothing reads again."""
    before = spark.conf.get(_CLEAN_KEY, None)
    spark.conf.set(_CLEAN_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_KEY, before) if before else spark.conf.unset(_CLEAN_KEY)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` or ``bucketed`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession, batch_bytes: int = 4 << 20) -> None:
    """Makes Arrow batches go by bytes: ten thousand pages, the default, have no bound. A smaller bound that the session
    brings stays."""
    have = int((spark.conf.get(_BATCH_KEY, None) or "0").rstrip("b"))
    if not 0 < have <= batch_bytes:
        spark.conf.set(_BATCH_KEY, str(batch_bytes))


def dealt(df: DataFrame, *key: str, parts: int = 8) -> DataFrame:
    """Rows dealt by ``key``, ``parts`` partitions for each that they come in, so that what is made of a partition's texts fits
    a task's memory. Groups and windows whose keys include these do not shuffle them again."""
    return df.repartition(parts * df.rdd.getNumPartitions(), *key)


def bucketed(df: DataFrame, key: str | list[str], tag: str, path: str | None = None, n: int | None = None) -> DataFrame:
    """Write dealt by ``key`` (or keys) into as many buckets as shuffles have partitions, and read back: joins and aggregates by
    the key do not shuffle it again. The table's name lives only as long as it takes to read its plan. ``n``: rows lie
    dealt by the key into so many partitions already, or nearly, and become as many buckets."""
    spark = df.sparkSession
    name = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    keys = [key] if isinstance(key, str) else key
    if n is None:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # dealt as the buckets are, so that each bucket is one file
        df = df.repartition(n, *keys)
    with cleaned(spark):
        df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path or f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    return out
