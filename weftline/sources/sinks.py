"""Sinks: tables created if absent, merging upserts, DOT files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def create_table(spark: SparkSession, name: str, ddl: str, location: str | None = None) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet" + (f" LOCATION '{location}'" if location else ""))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: that with the largest ``order``."""
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_r"))
    return rows.select(*keys, "_r.*").select(*df.columns)


def upsert(df: DataFrame, path: str, keys: list[str]) -> None:
    """Merge rows into a Parquet table: cells are unique by key, new ones replace old ones; of new rows with one key the
    largest (of all columns, in order) stays.

    The merged table is written beside the old one and takes its place by two renames. A stop between them leaves the old
    table as ``.old`` alone, which the next call renames back before anything else. For merges that rewrite only what they
    touch, and readers that never see the table missing, see ``keyed.KeyedTable``.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    jvm = spark.sparkContext._jvm
    here, was = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".old"))
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rename(a, b) -> None:
        if not store.rename(a, b):
            raise OSError(f"{a} is not renamed to {b}")

    if not store.exists(here) and store.exists(was):
        rename(was, here)
    df = last_wins(df.withColumn("_all", F.struct(*df.columns)), keys, "_all").drop("_all")
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.new-{uuid.uuid4().hex}")
    if store.exists(here):
        old = spark.read.parquet(path)
        df = old.join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df)
    df.write.parquet(new.toString())
    if store.exists(here):
        store.delete(was, True)
        rename(here, was)
    rename(new, here)
    store.delete(was, True)


def wide_rows(cells: DataFrame, key: str | list[str], qualifier: str, value: str) -> DataFrame:
    """(key, cells): the map view of the long form; of equal qualifiers the smallest value stays. ``key``: a column or several."""
    keys = [key] if isinstance(key, str) else key
    once = cells.groupBy(*keys, qualifier).agg(F.min(value).alias(value))
    return once.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(qualifier, value)))).alias("cells"))


def to_dot(edges: DataFrame, name: str = "G", limit: int = 10_000) -> str:
    """DOT text of (src, dst, weight) edges, labelled and as wide as their weight; for small graphs, at most ``limit`` edges."""
    rows = edges.orderBy("src", "dst").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} edges")
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"  {quote(r['src'])} -> {quote(r['dst'])} [label={r['weight']}, penwidth={r['weight']}];" for r in rows]
    return "\n".join([f"digraph {name} {{", *lines, "}"]) + "\n"


def ranked(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w) - 1).where(F.col(rank) < n)
