"""Stream sinks, metrics, and running a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from weftline.session import shared_dir


def publish(df: DataFrame, fmt: str, checkpoint: str, key: str | None = None, value: str = "value", **options: str) -> StreamingQuery:
    """Rows to a sink as (key, value); on a cluster fmt may be kafka with its options, elsewhere json or parquet with a path."""
    cols = [F.col(value).alias("value")] + ([F.col(key).alias("key")] if key else [])
    return df.select(*cols).writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drained(df: DataFrame, tag: str, mode: str = "append", provider: str | None = None) -> DataFrame:
    """A stream's whole result, once its source has no more: written to the shared folder and read back. ``provider``: the
    state store that this stream needs, whatever the session's."""
    if provider:
        conf = df.sparkSession.conf
        before = conf.get(_PROVIDER)
        conf.set(_PROVIDER, provider)
        try:
            return drained(df, tag, mode)
        finally:
            conf.set(_PROVIDER, before)
    folder = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{folder}/out")
    else:  # the last batch has it all
        q = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    finished(q.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def observed(df: DataFrame, name: str, **flags: str) -> DataFrame:
    """The same rows, with counts of all and of those where each flag's expression holds, reported as metrics ``name``."""
    counts = [F.sum(F.when(F.expr(e), 1).otherwise(0)).alias(k) for k, e in flags.items()]
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *counts)


class Meter(StreamingQueryListener):
    """Keeps the latest observed metrics and rates of each running stream."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.latest[str(event.id)] = {}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.latest[str(p.id)] = {"rows_per_second": p.processedRowsPerSecond, **{k: v.asDict() for k, v in (p.observedMetrics or {}).items()}}

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
