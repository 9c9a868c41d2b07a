"""The news streams: feeds with a high-water mark, articles, trending words."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.news import articles, high_water, new_items, trend_windows


def ingest_feeds(feeds: DataFrame, pages: DataFrame, sites: DataFrame, out: str, checkpoint: str):
    """Feeds (rss_url, xml, ingest_ts) to news, a folder per batch. A source's mark is stored after its items are
    written, so that a failure repeats a batch instead of losing it."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("rss_url").agg(F.max_by(F.struct("xml", "ingest_ts"), "ingest_ts").alias("f")).select("rss_url", "f.*")
        try:
            old = spark.read.parquet(f"{out}/marks").where(F.col("epoch") < epoch)
            marks = old.groupBy("rss_url").agg(F.max_by("last_link", "epoch").alias("last_link"))
            known = latest.join(marks, "rss_url", "left")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = latest.withColumn("last_link", F.lit(None).cast("string"))
        articles(new_items(known), pages, sites).write.mode("overwrite").parquet(f"{out}/news/epoch={epoch}")
        high_water(known).write.mode("overwrite").parquet(f"{out}/marks/epoch={epoch}")

    return feeds.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trends(scores: DataFrame, late: str = "2 hours", hours: int = 18, every: int = 2) -> DataFrame:
    """(window_start, word, score) over sliding windows of event time, closed ``late`` after their end."""
    return trend_windows(scores.withWatermark("ingest_ts", late), hours=hours, every=every)
