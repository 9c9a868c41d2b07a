"""Crawl operators on tables: politeness, URL de-duplication, link sampling, the stride shuffle, retries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import written


def politeness(events: DataFrame, host: str, ts: str, order: str, interval_ms: int = 30_000) -> DataFrame:
    """(host, order, ts, accepted, wait_ms): an event is accepted if its host's last accepted one is more than the
    interval ago, or there is none; wait_ms is 0 for accepted ones, else what is left of the interval.

    Events lie sorted in their host's partition and stream through with one state per host, so that no host's events
    are gathered in memory. Acceptance depends on the last accepted time, so that a host is worked in order, in one task.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(F.col(host).cast("string").alias("host"), F.col(order).cast("long").alias("id"), micros.alias("us")).where("host IS NOT NULL AND us IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0
        for b in batches:
            hosts, us = b.column(0).to_pylist(), b.column(2).to_numpy()
            ok, wait = np.zeros(len(us), bool), np.zeros(len(us), np.int64)
            for i, (h, t) in enumerate(zip(hosts, us.tolist(), strict=True)):
                if h != now or t - last > interval_ms * 1000:
                    now, last, ok[i] = h, t, True
                else:
                    wait[i] = interval_ms - (t - last) // 1000
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(ok), pa.array(wait)], names=["host", "id", "us", "accepted", "wait_ms"])

    return rows.repartition("host").sortWithinPartitions("host", "us", "id").mapInArrow(run, "host string, id bigint, us bigint, accepted boolean, wait_ms bigint")


def first_seen(links: DataFrame, url: str, order: str) -> DataFrame:
    """(url_hash, first): the first occurrence of every URL, by ``order``."""
    return links.groupBy(F.md5(url).alias("url_hash")).agg(F.min(order).alias("first"))


def dedup_ttl(links: DataFrame, key: str, ts: str, order: str, ttl_minutes: int = 60) -> DataFrame:
    """Rows whose key was not seen in the ``ttl_minutes`` before them; cleared at fixed hours, as a cache is: the first
    of each key in each period."""
    period = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (60 * ttl_minutes))
    return links.groupBy(F.md5(F.col(key).cast("string")).alias("url_hash"), period.alias("period")).agg(F.min(order).alias("first"))


def sample_links(links: DataFrame, page: str, link: str, every: int = 10) -> DataFrame:
    """Every tenth link of a page, the first included, in order of the links."""
    w = Window.partitionBy(page).orderBy(link)
    return links.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") % every == 0)


def global_position(df: DataFrame, *order: str) -> DataFrame:
    """Adds pos, the row's place in the order, without a task that sees all rows: ranges are numbered within, and the
    counts of the ranges before are added."""
    n = max(1, df.rdd.getNumPartitions())
    parts = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "positions")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("_part", before.alias("_first"))  # a row per partition
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_at", at).join(first, "_part").withColumn("pos", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def stride_shuffle(links: DataFrame, *order: str, size: int = 100_000, stride: int = 1000) -> DataFrame:
    """Adds emit: buffers of ``size`` links go out as positions 0, stride, 2 stride, ..., then 1, stride + 1, ...; the
    last buffer may be smaller."""
    placed = global_position(links, *order)
    total = links.count()
    batch = F.floor(F.col("pos") / size)
    here = F.least(F.lit(size), F.lit(total) - batch * size)
    i, k = F.col("pos") % size % stride, F.floor(F.col("pos") % size / stride)
    return placed.withColumn("emit", (batch * size + i * F.floor(here / stride) + F.least(i, here % stride) + k).cast("long"))


def due_retries(rejected: DataFrame, now, ts: str = "due_ts") -> DataFrame:
    """Rejected links whose time has come, in order of it."""
    return rejected.where(F.col(ts) <= F.lit(now)).orderBy(ts)
