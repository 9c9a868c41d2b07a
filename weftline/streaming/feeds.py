"""Feeds as a streaming source, whose offsets are the feeds' marks.

``spark.readStream.format("feeds")`` with the options

* ``urls``: the feeds' URLs, one a line;
* ``marks``: a file in a shared folder for the offset of the stream's last planned batch; it goes with the stream's
  checkpoint, and a new stream takes a new file. Without it a stream that starts again takes the feeds as new;
* ``feedsPerBatch`` (100), ``itemsPerFeed`` (1000): how many feeds a batch asks, in turn, and how many of a feed's new
  items it admits, the oldest first; the rest wait in the feed;
* ``tasks`` (8): over how many tasks a batch's feeds are dealt; ``timeout`` (15): seconds for a request.

gives (rss_url, title, link, pub_date, ingest_ts), pub_date as the feed has it, ingest_ts when the batch was planned.

A feed's mark is the links of its last items (MARKS at most), newest first; new is what stands before the first of them.
An offset has a mark for each feed, so that it grows with their number and not with their items. The driver asks the
feeds only for their links; tasks ask again and give what stands between two offsets, so that a batch that is run again
gives the same items, as far as the feed still has them.

Defined results: items without a link are no items; of items with one link in a feed the newest counts; a feed that
cannot be read or is no XML keeps its mark when a batch is planned, and fails the task, which is tried again, when its
items are to be read; a feed none of whose marked items are left is new as a whole; no URLs give no rows.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weftline.functions.dates import parse_pub_date
from weftline.operators.news import articles, feed_items

MARKS = 10
SCHEMA = "rss_url string, title string, link string, pub_date string, ingest_ts timestamp"


def fetch(url: str, timeout: float) -> str:
    request = urllib.request.Request(url, headers={"User-Agent": "weftline"})
    with urllib.request.urlopen(request, timeout=timeout) as got:
        return got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")


def linked_items(xml: str) -> list[dict]:
    """A feed's items that have links, each link once, newest first."""
    out: dict[str, dict] = {}
    for item in feed_items(xml):
        link = (item["link"] or "").strip()
        if link:
            out.setdefault(link, item | {"link": link})
    return list(out.values())


def _before(links: list[str], mark: str) -> int:
    """How many links are newer than a mark."""
    seen = set(mark.split("\n")) if mark else set()
    return next((i for i, link in enumerate(links) if link in seen), len(links))


def advanced(links: list[str], mark: str, most: int) -> str:
    """The mark after the oldest ``most`` of the links that are newer than ``mark``."""
    fresh = _before(links, mark)
    if not fresh:
        return mark
    at = max(0, fresh - most)
    return "\n".join(links[at : at + MARKS])


def between(items: list[dict], start: str, end: str) -> list[dict]:
    """The items after one mark up to another. Where none of the later mark's items is left, all after the first."""
    links = [i["link"] for i in items]
    stop, first = _before(links, start), _before(links, end)
    return items[first if first < len(links) else 0 : stop]


@dataclass
class Share(InputPartition):
    """A task's feeds: (url, mark before, mark after)."""

    feeds: list[tuple[str, str, str]]
    polled: int


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.urls = sorted(set(options.get("urls", "").split()))
        self.marks = options["marks"]
        self.feeds_per_batch, self.items_per_feed = int(options.get("feedsPerBatch", 100)), int(options.get("itemsPerFeed", 1000))
        self.tasks, self.timeout = int(options.get("tasks", 8)), float(options.get("timeout", 15))
        self.at: dict | None = None  # where the stream has been planned to
        self.turn = 0

    def _store(self):
        from pyarrow import fs

        path = self.marks[5:] if self.marks.startswith("file:") and "://" not in self.marks else self.marks
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def _remember(self, end: dict) -> None:
        self.at = end
        store, path = self._store()
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{path}.part", compression=None) as out:
            out.write(json.dumps(end).encode())
        store.move(f"{path}.part", path)

    def _recalled(self) -> dict:
        """The offset of the last planned batch: a stream that starts again asks for the latest one before it says where it is."""
        store, path = self._store()
        try:
            with store.open_input_file(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return self.initialOffset()

    def _links(self, url: str) -> list[str] | None:
        try:
            return [i["link"] for i in linked_items(fetch(url, self.timeout))]
        except (OSError, ValueError):  # not to be reached, or no URL
            return None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"polled": 0, "marks": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.at is None:
            self.at = self._recalled()
        n = min(self.feeds_per_batch, len(self.urls))
        asked = [self.urls[(self.turn + i) % len(self.urls)] for i in range(n)]
        self.turn = (self.turn + n) % max(len(self.urls), 1)
        marks = dict(self.at["marks"])
        with ThreadPoolExecutor(32) as pool:
            for url, links in zip(asked, pool.map(self._links, asked), strict=True):
                if links:
                    marks[url] = advanced(links, marks.get(url, ""), self.items_per_feed)
        # the same offset where nothing is new: no batch
        return self.at if marks == self.at["marks"] else {"polled": int(time.time() * 1000), "marks": marks}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        self._remember(end)
        moved = [(u, start["marks"].get(u, ""), m) for u, m in end["marks"].items() if start["marks"].get(u, "") != m]
        return [Share(moved[i :: self.tasks], end["polled"]) for i in range(min(self.tasks, len(moved)))]

    def read(self, partition: Share) -> Iterator[tuple]:
        at = dt.datetime.fromtimestamp(partition.polled / 1000, dt.timezone.utc)
        for url, start, end in partition.feeds:
            for item in between(linked_items(fetch(url, self.timeout)), start, end):
                yield url, item["title"], item["link"], item["pub_date"], at


class Feeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:  # noqa: N802
        return FeedReader(self.options)


def feed_source(spark: SparkSession, urls: list[str], marks: str, **options: str) -> DataFrame:
    """A stream of the feeds' new items (SCHEMA)."""
    spark.dataSource.register(Feeds)
    return spark.readStream.format("feeds").options(urls="\n".join(urls), marks=marks, **options).load()


def ingest_items(items: DataFrame, pages: DataFrame, sites: DataFrame, out: str, checkpoint: str, trigger: str = "10 minutes"):
    """Items of feeds to articles, a folder per batch. The marks are the stream's offsets: a batch that fails is run again
    with the same items, and none is passed over."""

    def sink(batch: DataFrame, epoch: int) -> None:
        dated = batch.withColumn("pub_date", parse_pub_date(F.col("pub_date"), F.col("ingest_ts")))
        articles(dated, pages, sites).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return items.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
