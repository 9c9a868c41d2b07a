"""Document frequencies that are kept, not counted again: a delta for each batch of documents, behind manifests.

``<path>/deltas/<name>/`` holds (term, df) of a batch, sorted by term; a manifest lists the deltas in force with their
numbers of documents. Taking documents out is a delta of negative counts. Deltas of about one size are added up into one
as they become many, so that a lookup reads a number of files that grows with the logarithm of the batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.keywords import best_terms, doc_terms, term_df
from weftline.session import written
from weftline.sources.keyed import Conflict, Folder, Versions

FANOUT = 8  # so many deltas of about one size are added up


class TermStats:
    """Statistics of (key, text) documents by the simple analyzer. A key comes once: to replace a document, take the old one
    out and add the new one."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> None:
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text
        self.versions = Versions(spark, f"{self.path}/manifest")

    def deltas(self) -> list:
        """The deltas in force: (name, docs, terms, epoch)."""
        at = self.versions.last()
        return self.versions.read(at).orderBy("name").collect() if at >= 0 else []

    def _write(self, counts: DataFrame, version: int) -> tuple[str, int]:
        name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        counts.where("df <> 0").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/deltas/{name}")
        return name, self._read([name]).count()

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], "term string, df long")
        return self.spark.read.schema("term string, df long").parquet(*(f"{self.path}/deltas/{n}" for n in names))

    def _commit(self, rows: list[tuple], version: int) -> None:
        self.versions.commit(self.spark.createDataFrame(rows, "name string, docs long, terms long, epoch long"), version)

    def add(self, docs: DataFrame, epoch: int = -1, sign: int = 1, fanout: int = FANOUT) -> None:
        """Adds documents, or takes them out (``sign`` -1). ``epoch``: grows from batch to batch; one that has been added, as
        of a batch that a stream runs again, is not added twice."""
        counts, n = None, 0
        while True:
            version, now = self.versions.last() + 1, self.deltas()
            if 0 <= epoch <= max((d["epoch"] for d in now), default=-1):
                return
            if counts is None:
                df = term_df(doc_terms(docs, self.key, self.text)).select("term", (F.col("df") * sign).alias("df"))
                counts, n = self._write(df, version), docs.count() * sign
            try:
                self._commit([tuple(d) for d in now] + [(counts[0], n, counts[1], epoch)], version)
                break
            except Conflict:
                continue
        while self.compact(fanout):
            pass

    def compact(self, fanout: int = FANOUT) -> bool:
        """Adds up ``fanout`` deltas of about one size, the smallest first; whether there were so many."""
        version, now = self.versions.last() + 1, self.deltas()
        tiers: dict[int, list] = {}
        for d in now:
            tiers.setdefault(d["terms"].bit_length() // 2, []).append(d)
        due = next((t for _, t in sorted(tiers.items()) if len(t) >= fanout), [])
        if not due:
            return False
        names = [d["name"] for d in due]
        name, terms = self._write(self._read(names).groupBy("term").agg(F.sum("df").alias("df")), version)
        try:
            self._commit([tuple(d) for d in now if d["name"] not in names] + [(name, sum(d["docs"] for d in due), terms, max(d["epoch"] for d in due))], version)
        except Conflict:
            Folder(self.spark, self.path).delete(f"deltas/{name}")
            return False
        return True

    def n_docs(self) -> int:
        return sum(d["docs"] for d in self.deltas())

    def df(self) -> DataFrame:
        """(term, df) of the documents that are in."""
        return self._read([d["name"] for d in self.deltas()]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def keywords(self, docs: DataFrame, k: int = 5) -> DataFrame:
        """``keywords.interesting_keywords`` of some documents by the statistics of all that are in: (key, rank, keyword,
        score). Only these documents are analysed; a term that is not in counts as of no document."""
        now = self.deltas()
        df = written(self._read([d["name"] for d in now]).groupBy("term").agg(F.sum("df").alias("df")), "df")
        return best_terms(doc_terms(docs, self.key, self.text), df, sum(d["docs"] for d in now), k, self.key)


def stream_keywords(docs: DataFrame, stats: TermStats, out: str, checkpoint: str, k: int = 5):
    """A stream of documents: each micro-batch is added to the statistics, and its documents' keywords by them go to a folder
    of ``out``. A batch that is run again is counted once."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                stats.add(batch, epoch)
                stats.keywords(batch, k).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        finally:
            batch.unpersist()

    return docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
