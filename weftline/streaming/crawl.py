"""The crawl's streams: politeness, URL de-duplication, the indexer.

Sources and sinks are any Structured Streaming ones; links are rows (link, ts), pages rows of PAGE. What a batch
operator computes on a table, its stream computes on the same rows in order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.codec import decode_pages
from weftline.functions.html import parse_html
from weftline.functions.lang import is_english
from weftline.functions.urls import host_name, normalize_url
from weftline.operators.graph import resolve_links
from weftline.schemas import PAGE


def link_source(spark: SparkSession, path: str, fmt: str = "json", schema: str = "link string, ts timestamp", **options: str) -> DataFrame:
    """A stream of links. From kafka (with its options) their payload is a line of text, and ts the record's time."""
    if fmt == "kafka":
        got = spark.readStream.format(fmt).options(**options).load()
        return got.select(F.col("value").cast("string").alias("link"), F.col("timestamp").alias("ts"))
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def page_source(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stream of pages (PAGE). From kafka (with its options) their payload is what the page codec wrote."""
    if fmt == "kafka":
        return decode_pages(spark.readStream.format(fmt).options(**options).load())
    return spark.readStream.format(fmt).schema(PAGE).options(**options).load(path)


def gate(links: DataFrame, interval_ms: int = 30_000) -> DataFrame:
    """(host, link, ts, accepted) of (link, ts): the politeness gate, one time of state per host.

    A micro-batch's links of a host are worked in order of time; later batches are taken as later.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "link"], kind="stable")
        ok = []
        for t in rows["ts"].astype("int64") // 1000 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].astype("datetime64[us]").astype("int64"):
            take = last is None or t - last > interval_ms * 1000
            last = int(t) if take else last
            ok.append(take)
        state.update((last,))
        yield rows.assign(accepted=ok)[["host", "link", "ts", "accepted"]]

    keyed = links.select(host_name(F.col("link")).alias("host"), "link", "ts")
    return keyed.groupBy("host").applyInPandasWithState(step, "host string, link string, ts timestamp, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def dedup_recent(links: DataFrame, minutes: int = 60, key: Callable = normalize_url) -> DataFrame:
    """Links whose key came within ``minutes`` before are dropped; state is kept that long."""
    return links.withColumn("url_hash", F.md5(key(F.col("link")))).withWatermark("ts", f"{minutes} minutes").dropDuplicatesWithinWatermark(["url_hash"])


def dedup_global(marks: str) -> Callable[[DataFrame, int], DataFrame]:
    """For foreachBatch: links that no earlier batch marked, marked now under the batch's own folder, so that a batch
    that is run again replaces its marks and gives the same links. It reads all marks; a stream that lives long takes
    ``seen_once``."""

    def run(batch: DataFrame, epoch: int) -> DataFrame:
        spark = batch.sparkSession
        fresh = batch.withColumn("url_hash", F.md5(normalize_url(F.col("link")))).dropDuplicates(["url_hash"])
        try:
            known = spark.read.parquet(marks).where(F.col("epoch") < epoch)
            fresh = fresh.join(known.select("url_hash"), "url_hash", "left_anti")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.select("url_hash", "link").write.mode("overwrite").parquet(f"{marks}/epoch={epoch}")
        return spark.read.parquet(f"{marks}/epoch={epoch}")

    return run


def seen_once(links: DataFrame) -> DataFrame:
    """Links whose normalised URL never came before, over the whole life of the stream, with its url_hash: marks are rows of
    keyed state, spread by the hash, and a batch looks up its own links' marks alone."""
    return links.withColumn("url_hash", F.md5(normalize_url(F.col("link")))).dropDuplicates(["url_hash"])


def topic_filter(links: DataFrame, out: str, checkpoint: str):
    """A stream of links (url_hash, link) without repeats, over all time, written as Parquet; what has come lies in the
    checkpoint's state (RocksDB in a session of ``session``)."""
    once = seen_once(links).select("url_hash", "link")
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fetch_and_parse(accepted: DataFrame, pages: DataFrame) -> DataFrame:
    """PAGE rows of accepted links, looked up in a table of pages (url, html), English ones only."""
    found = accepted.where("accepted").join(pages.select(F.col("url").alias("link"), "html"), "link")
    parsed = found.select(parse_html("link", "html").alias("p")).select("p.*")
    return parsed.where(is_english(F.col("text")))


def frontier(pages: DataFrame, every: int = 10) -> DataFrame:
    """(link) of every tenth link of each page, resolved and normalised; for a micro-batch."""
    anchors = pages.select(F.md5("url").alias("page_id"), "url", F.posexplode("links").alias("at", "a")).select("page_id", "url", "at", F.col("a.link").alias("href"), "a.anchor")
    ordered = resolve_links(anchors).groupBy("page_id").agg(F.array_sort(F.collect_set("link")).alias("ls"))
    picked = F.filter("ls", lambda _, i: i % every == 0)
    return ordered.select(F.explode(picked).alias("link")).select(normalize_url(F.col("link")).alias("link")).distinct()


def crawl(links: DataFrame, pages: DataFrame, out: str, checkpoint: str, interval_ms: int = 30_000):
    """The crawl loop: gate, fetch, parse, language; pages, rejected links and the next frontier go to folders."""
    marks = dedup_global(f"{out}/marks")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            batch.where("NOT accepted").select("link", "ts").write.mode("overwrite").parquet(f"{out}/retry/epoch={epoch}")
            fetch_and_parse(batch, pages).write.mode("overwrite").parquet(f"{out}/pages/epoch={epoch}")
            done = batch.sparkSession.read.schema(PAGE).parquet(f"{out}/pages/epoch={epoch}")
            marks(frontier(done), epoch).write.mode("overwrite").parquet(f"{out}/frontier/epoch={epoch}")
        finally:
            batch.unpersist()

    return gate(links, interval_ms).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_pages(pages: DataFrame, out: str, checkpoint: str, analyze):
    """The indexer: rows without url or text are skipped; the rest go to keys, postings, lengths and out-links (resolved and
    checked), a folder per batch. ``search.read_indexed`` reads them as one index, in which a page's last batch counts."""
    from weftline.operators.search import build_index, page_fields

    fields = ["title", "text", "h1", "h2", "description", "keywords", "anchors"]

    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.where("url IS NOT NULL AND text IS NOT NULL").dropDuplicates(["url"]).persist()
        try:
            index = build_index(page_fields(batch), "doc_key", fields, analyze)
            index.postings.write.mode("overwrite").parquet(f"{out}/postings/epoch={epoch}")
            index.lengths.write.mode("overwrite").parquet(f"{out}/lengths/epoch={epoch}")
            batch.select(F.md5("url").alias("doc_key")).write.mode("overwrite").parquet(f"{out}/keys/epoch={epoch}")
            raw = batch.select(F.md5("url").alias("page_id"), "url", F.posexplode("links").alias("at", "l"))
            links = resolve_links(raw.select("page_id", "url", "at", F.col("l.link").alias("href"), "l.anchor")).withColumnRenamed("page_id", "row_key")
            links.write.mode("overwrite").parquet(f"{out}/out_links/epoch={epoch}")
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_index(spark: SparkSession, path: str, analyzer):
    """The index of pages (PAGE) by the md5 of their URL, over the seven fields of the web search."""
    from weftline.operators.search import WEB_BOOSTS
    from weftline.operators.segments import SegmentedIndex

    return SegmentedIndex(spark, path, "doc_key", list(WEB_BOOSTS), analyzer)


def segment_pages(pages: DataFrame, path: str, checkpoint: str, analyzer):
    """The indexer into one index: a micro-batch is a segment, a page's later row replaces its earlier one, and segments are
    merged as they become many. A batch that is run again is known by its number; empty ones write nothing."""
    from weftline.operators.search import page_fields

    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.where("url IS NOT NULL AND text IS NOT NULL").dropDuplicates(["url"]).persist()
        try:
            if not batch.isEmpty():
                page_index(batch.sparkSession, path, analyzer).add(page_fields(batch), epoch)
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
