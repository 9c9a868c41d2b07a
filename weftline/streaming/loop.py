"""The crawl as one stream that feeds itself: hosts that wait with timers, URLs seen once, links shuffled by strides.

State is keyed and lies in RocksDB (the session's state store provider must be that one, as ``session`` sets it): what a
host's turn or a buffer's row costs does not depend on how much waits behind it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.functions.urls import host_name
from weftline.schemas import PAGE
from weftline.streaming.crawl import fetch_and_parse, frontier, seen_once

LINK = "link string, ts timestamp"


class Polite(StatefulProcessor):
    """One host: its last accepted time and the links that wait, by number. A timer lets the next one out when the interval
    has passed, so that a link is never sent round again."""

    def __init__(self, interval_ms: int) -> None:
        self.interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "last long, first long, next long")
        self.waiting = handle.getMapState("waiting", "n long", "link string, ts timestamp, came long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        now = timerValues.getCurrentProcessingTimeInMs()
        last, first, following = self.turn.get() if self.turn.exists() else (None, 0, 0)
        idle = first == following  # nobody waits, so no timer is set
        for r in rows:
            if first == following and (last is None or now - last > self.interval):
                last = now
                yield Row(host=key[0], link=r["link"], ts=r["ts"], waited_ms=0)
            else:
                self.waiting.updateValue((following,), (r["link"], r["ts"], now))
                following += 1
        if idle and first != following:
            self.handle.registerTimer(last + self.interval + 1)
        self.turn.update((last, first, following))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        now = timerValues.getCurrentProcessingTimeInMs()
        _, first, following = self.turn.get()
        link, ts, came = self.waiting.getValue((first,))
        self.waiting.removeKey((first,))
        self.turn.update((now, first + 1, following))
        if first + 1 != following:
            self.handle.registerTimer(now + self.interval + 1)
        yield Row(host=key[0], link=link, ts=ts, waited_ms=now - came)

    def close(self) -> None:
        pass


def polite(links: DataFrame, interval_ms: int = 30_000) -> DataFrame:
    """(host, link, ts, waited_ms): every link of (link, ts) once, a host's more than the interval apart, by the clock.
    Rows without a link have no host and are dropped."""
    keyed = links.where("link IS NOT NULL").select(host_name(F.col("link")).alias("host"), "link", "ts")
    return keyed.groupBy("host").transformWithState(Polite(interval_ms), "host string, link string, ts timestamp, waited_ms long", "append", "processingTime")


def crawl_loop(spark: SparkSession, links: str, pages: DataFrame, out: str, checkpoint: str, interval_ms: int = 30_000, every: int = 10, trigger: str = "1 second", files_per_batch: int = 1000):
    """The loop: links of the folder ``links`` (JSON of link, ts; seeds lie there at first), each URL once, hosts politely,
    pages looked up, parsed and kept if English; every tenth of their links goes into that folder again. Pages lie in
    ``out/pages``, a folder per batch. A batch that is run again writes its folders anew; links that it has given out
    twice are dropped as seen."""
    source = spark.readStream.schema(LINK).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).json(links)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            if batch.isEmpty():  # the clock makes batches too
                return
            fetch_and_parse(batch.withColumn("accepted", F.lit(True)), pages).write.mode("overwrite").parquet(f"{out}/pages/epoch={epoch}")
            done = batch.sparkSession.read.schema(PAGE).parquet(f"{out}/pages/epoch={epoch}")
            again = frontier(done, every).withColumn("ts", F.current_timestamp()).persist()
            if not again.isEmpty():
                again.write.mode("overwrite").json(f"{links}/epoch={epoch}")
            again.unpersist()
            batch.select("host", "link", "waited_ms").write.mode("overwrite").parquet(f"{out}/visits/epoch={epoch}")
        finally:
            batch.unpersist()

    return polite(seen_once(source).drop("url_hash"), interval_ms).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def in_order(rows: Iterator[Row], order: list[str], first: int, size: int) -> Iterator[list[tuple]]:
    """(link, ts) of a batch's rows in order, nulls first, in lists: one of ``first`` rows, then of ``size`` each, the last
    of what is left. The rows come in any order and wait in Arrow's columns, at a few dozen bytes each."""
    schema = pa.schema([("link", pa.string()), ("ts", pa.timestamp("us"))])
    held = []
    while some := list(itertools.islice(rows, 8192)):
        held.append(pa.record_batch([pa.array([r[c] for r in some], t) for c, t in zip(schema.names, schema.types, strict=True)], schema=schema))
    for part in _parts(pa.Table.from_batches(held, schema), order, first, size):
        yield list(zip(part.column("link").to_pylist(), part.column("ts").to_pylist(), strict=True))


def _parts(whole: pa.Table, order: list[str], first: int, size: int) -> Iterator[pa.Table]:
    at = pc.sort_indices(whole, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
    a, b = 0, first
    while a < len(at):
        yield whole.take(at[a:b])
        a, b = b, b + size


class Strides(StatefulProcessor):
    """One buffer of rows in order. A full one goes out by strides; one that nothing has come to for ``idle_ms`` as it is."""

    def __init__(self, order: list[str], size: int, stride: int, idle_ms: int | None) -> None:
        self.order, self.size, self.stride, self.idle = order, size, stride, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "held long, out long, touched long")
        self.buffer = handle.getMapState("buffer", "n long", "link string, ts timestamp")

    def _out(self, lane: int, rows: list[tuple], out: int) -> Iterator[Row]:
        n = 0
        for i in range(min(self.stride, len(rows))):
            for link, ts in rows[i :: self.stride]:
                yield Row(lane=lane, link=link, ts=ts, emit=out + n)
                n += 1

    def _held(self, held: int) -> list[tuple]:
        got = [self.buffer.getValue((k,)) for k in range(held)]
        self.buffer.clear()
        return got

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        held, out, _ = self.place.get() if self.place.exists() else (0, 0, 0)
        # what the rows at hand fill goes out at once; only what is left waits in state
        for part in in_order(rows, self.order, self.size - held, self.size):
            if held + len(part) == self.size:
                yield from self._out(key[0], (self._held(held) if held else []) + part, out)
                held, out = 0, out + self.size
            else:
                for r in part:
                    self.buffer.updateValue((held,), r)
                    held += 1
        now = 0
        if self.idle is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            if held:
                self.handle.registerTimer(now + self.idle)
        self.place.update((held, out, now))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        held, out, touched = self.place.get()
        if held and expiredTimerInfo.getExpiryTimeInMs() >= touched + self.idle:
            yield from self._out(key[0], self._held(held), out)
            self.place.update((0, out + held, touched))

    def close(self) -> None:
        pass


class StridesInFrames(Strides):
    """The same on frames of (link, ts, none), so that no row is an object of its own: ``ts`` counts microseconds, and is 0
    where there is none."""

    SCHEMA = pa.schema([("link", pa.string()), ("ts", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "held long, out long, touched long")
        self.buffer = handle.getMapState("buffer", "n long", "link string, ts long")

    def _frame(self, lane: int, rows: pa.Table, out: int) -> pd.DataFrame:
        n = rows.num_rows
        went = rows.take(pa.array(np.concatenate([np.arange(i, n, self.stride) for i in range(min(self.stride, n))])))
        ts = went.column("ts")
        return pd.DataFrame({"lane": lane, "link": pd.Series(went.column("link").to_pylist(), dtype=object), "ts": ts.fill_null(0).to_numpy(), "none": ts.is_null().to_numpy(), "emit": np.arange(out, out + n)})

    def _table(self, rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(self.SCHEMA.types)], schema=self.SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held, out, _ = self.place.get() if self.place.exists() else (0, 0, 0)
        came = [pa.record_batch([pa.array(f["link"], pa.string(), from_pandas=True), pa.array(f["ts"].to_numpy("int64"), mask=f["none"].to_numpy("bool"))], schema=self.SCHEMA) for f in rows]
        for part in _parts(pa.Table.from_batches(came, self.SCHEMA), self.order, self.size - held, self.size):
            if held + part.num_rows == self.size:
                yield self._frame(key[0], pa.concat_tables([self._table(self._held(held)), part]) if held else part, out)
                held, out = 0, out + self.size
            else:
                for r in zip(part.column("link").to_pylist(), part.column("ts").to_pylist(), strict=True):
                    self.buffer.updateValue((held,), r)
                    held += 1
        now = 0
        if self.idle is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            if held:
                self.handle.registerTimer(now + self.idle)
        self.place.update((held, out, now))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        held, out, touched = self.place.get()
        if held and expiredTimerInfo.getExpiryTimeInMs() >= touched + self.idle:
            yield self._frame(key[0], self._table(self._held(held)), out)
            self.place.update((0, out + held, touched))


def strides(links: DataFrame, order: list[str] | None = None, size: int = 100_000, stride: int = 1000, idle_ms: int | None = 60_000, lanes: int = 1, lane: Column | None = None) -> DataFrame:
    """(lane, link, ts, emit) of a stream of (link, ts): buffers of ``size`` links in order go out as positions 0, stride,
    2 stride, ..., then 1, stride + 1, ...; ``emit`` numbers a lane's rows. Links are dealt over lanes by hash, or by a
    column of whole numbers, a buffer each; with one lane, and rows that come in order, it is ``operators.crawl.stride_shuffle``. The last buffer leaves
    when nothing has come for ``idle_ms``, or stays (None)."""
    by = F.pmod(F.xxhash64("link"), F.lit(lanes)) if lane is None else lane.cast("long")
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("ts")
    keyed = links.select(by.alias("lane"), "link", micros, F.col("ts").isNull().alias("none"))
    processor = StridesInFrames(order or ["ts", "link"], size, stride, idle_ms)
    out = keyed.groupBy("lane").transformWithStateInPandas(processor, "lane long, link string, ts long, none boolean, emit long", "append", "none" if idle_ms is None else "processingTime")
    return out.select("lane", "link", F.when(~F.col("none"), F.timestamp_micros("ts")).alias("ts"), "emit")
