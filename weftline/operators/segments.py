"""An index that stays one: segments that are added and merged, and retrieval that skips what cannot be among the best.

``<path>/segments/<name>/`` holds a segment's tables:

* ``postings`` (seg, term, field, r, n, max_tf, min_len, rows), dealt by hash over files that are sorted by term: the documents of a segment are dealt by hash
  into ranges of about ``RANGE``, and a row has all postings of a term and field in one range, so that ``max_tf`` and
  ``min_len`` bound what any of them scores;
* ``docs`` (seg, key, field, len, terms, r): what each document holds, and its range;
* ``dead`` (seg, key), ``minus`` (seg, field, term, n), ``stats`` (seg, field, docs, len): the documents of other segments
  that this one replaced, and what they no longer count for; ``stats`` has the segment's own counts too.

A manifest lists the segments that are in force, and readers take one manifest whole. Adding or merging writes a new
segment and then commits the next manifest by one rename. Dead rows are filtered from what a query reads, and dropped by
merges; all counts are exact, so that scores are those of an index built at once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import SIMPLE, Analyzer
from weftline.operators import search
from weftline.session import bucketed, cleaned, dealt, discard, written
from weftline.sources.keyed import Conflict, Folder, Versions

RANGE = 256  # documents of a range, about
FANOUT = 8  # so many segments of about one size are merged
_POSTINGS = "seg string, term string, field string, r long, n long, max_tf long, min_len long, rows array<struct<key:{key},tf:long,len:long,positions:array<int>>>"


@dataclass
class Found:
    """The best documents (key, score), and how many ranges with the query's terms were read for them, of how many."""

    hits: DataFrame
    read: int
    of: int


class SegmentedIndex:
    """``key``: the documents' key column; of a batch's rows with one key the largest stays, and a later batch's documents
    replace those of earlier ones. Documents without a key are left out."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str], analyzer: Analyzer = SIMPLE, per_range: int = RANGE, key_type: str = "string") -> None:
        self.spark, self.path, self.key, self.fields, self.analyzer, self.per_range = spark, path.rstrip("/"), key, fields, analyzer, per_range
        self.versions = Versions(spark, f"{self.path}/manifest")
        self._schemas = {
            "postings": _POSTINGS.format(key=key_type), "docs": f"seg string, key {key_type}, field string, len long, terms array<string>, r long",
            "dead": f"seg string, key {key_type}", "minus": "seg string, field string, term string, n long", "stats": "seg string, field string, docs long, len long",
        }

    # ---- manifests

    def segments(self) -> list:
        """The segments in force: (seg, docs, epoch)."""
        at = self.versions.last()
        return self.versions.read(at).orderBy("seg").collect() if at >= 0 else []

    def _read(self, table: str, segments: list) -> DataFrame:
        """A table of some segments; of what it says of others only what is still in force."""
        if not segments:
            return self.spark.createDataFrame([], self._schemas[table])
        return self.spark.read.schema(self._schemas[table]).parquet(*(f"{self.path}/segments/{s['seg']}/{table}" for s in segments))

    def _live(self, table: str, segments: list) -> DataFrame:
        """Rows of postings' documents or docs that no later segment replaced."""
        dead = self._read("dead", segments).where(F.col("seg").isin([s["seg"] for s in segments]))
        return self._read(table, segments).join(dead, ["seg", "key"], "left_anti")

    def _commit(self, rows: list[tuple], version: int) -> None:
        self.versions.commit(self.spark.createDataFrame(rows, "seg string, docs long, epoch long"), version)

    # ---- writes

    def _write(self, seg: str, docs: DataFrame, rows: DataFrame, gone: DataFrame, now: list, parts: bool = False) -> int:
        """The tables of a new segment, from its docs (key, field, len, terms, r), its postings' rows by (term, field, r), which
        may come in several ``parts``, and the (seg, key) of documents that it replaces in segments of ``now``."""
        folder, named = f"{self.path}/segments/{seg}", F.lit(seg).alias("seg")
        read = lambda table: self.spark.read.schema(self._schemas[table]).parquet(f"{folder}/{table}")
        docs.select(named, "key", "field", F.col("len").cast("long").alias("len"), "terms", F.col("r").cast("long").alias("r")).write.parquet(f"{folder}/docs")
        docs = read("docs")
        # the only shuffle of postings, by hash: ranges would have all of them made twice, to draw their bounds first. A
        # term's rows are spread by range of documents; within a file pages are skipped by term
        order = ["term", "field", "r"]
        whole = rows.select("term", "field", F.col("r").cast("long").alias("r"), "rows").repartition(*order)
        if parts:
            whole = whole.groupBy(*order).agg(F.flatten(F.collect_list("rows")).alias("rows"))
        whole = whole.withColumn("rows", F.sort_array("rows"))
        most, least = F.array_max(F.transform("rows", lambda x: x["tf"])), F.array_min(F.transform("rows", lambda x: x["len"]))
        whole = whole.select(named, *order, F.size("rows").cast("long").alias("n"), most.alias("max_tf"), least.alias("min_len"), "rows")
        with cleaned(self.spark):
            whole.sortWithinPartitions(*order).write.parquet(f"{folder}/postings")
        gone.select("seg", "key").distinct().write.parquet(f"{folder}/dead")
        replaced = self._read("docs", now).join(read("dead"), ["seg", "key"], "left_semi")
        replaced.select("seg", "field", F.explode("terms").alias("term")).groupBy("seg", "field", "term").agg(F.count("*").alias("n")).write.parquet(f"{folder}/minus")
        count = lambda rows, sign: rows.groupBy("seg", "field").agg((sign * F.count("*")).alias("docs"), (sign * F.sum("len")).alias("len"))
        count(docs, 1).unionByName(count(replaced, -1)).coalesce(1).write.parquet(f"{folder}/stats")
        return docs.select("key").distinct().count()

    def _found(self, docs: DataFrame, seg: str) -> DataFrame:
        """(r, key, field, len, posts) of a batch's documents, written in buckets of whole ranges. Texts are dealt by range
        before they are taken apart, so that no postings are shuffled."""
        k = self.key
        ranges = max(1, -(-docs.select(k).distinct().count() // self.per_range))
        rows = dealt(docs.withColumn("r", F.pmod(F.xxhash64(k), F.lit(ranges))), "r")
        n = rows.rdd.getNumPartitions()
        last = rows.groupBy("r", k).agg(F.max(F.struct(*self.fields)).alias("_f")).select("r", k, "_f.*")
        posted = search.postings_of(last, ["r", k], self.fields, self.analyzer)
        found = posted.groupBy("r", F.col(k).alias("key"), "field").agg(F.sum("tf").alias("len"), F.collect_list(F.struct("term", F.col("tf").cast("long").alias("tf"), F.col("positions").cast("array<int>").alias("positions"))).alias("posts"))
        return bucketed(found, "r", "segment-found", f"{self.path}/segments/{seg}/found", n)

    def add(self, docs: DataFrame, epoch: int = -1, merge: bool = True) -> None:
        """Adds a batch of (key, fields). ``epoch``: a number that grows from batch to batch; one that is in the index already,
        as of a batch that a stream runs again, is not added twice. Then merges segments, if it is time."""
        docs = docs.where(F.col(self.key).isNotNull()).select(self.key, *self.fields)
        while True:
            version, now = self.versions.last() + 1, self.segments()
            if 0 <= epoch <= max((s["epoch"] for s in now), default=-1):
                return
            seg = f"{version:012d}-{uuid.uuid4().hex[:8]}"
            found = self._found(docs, seg)
            row = F.struct("key", "tf", "len", "positions")
            rows = found.select("r", "key", "field", "len", F.inline("posts")).groupBy("term", "field", "r").agg(F.collect_list(row).alias("rows"))
            keys = docs.select(F.col(self.key).alias("key")).distinct()
            # documents whose fields are all empty leave nothing, but replace what was there
            gone = self._live("docs", now).select("seg", "key").join(keys, "key", "left_semi")
            n = self._write(seg, found.select("key", "field", "len", F.transform("posts", lambda x: x["term"]).alias("terms"), "r"), rows, gone, now)
            Folder(self.spark, self.path).delete(f"segments/{seg}/found")
            try:
                self._commit([tuple(s) for s in now] + [(seg, n, epoch)], version)
                break
            except Conflict:
                continue
        while merge and self.merge():
            pass

    def merge(self, fanout: int = FANOUT, everything: bool = False) -> bool:
        """Merges ``fanout`` segments of about one size, smallest first, or all of them; whether there was anything to merge.
        Readers go on with the segments of their manifest; if something is committed meanwhile, it gives way and tries
        again another time."""
        version, now = self.versions.last() + 1, self.segments()
        tiers: dict[int, list] = {}
        for s in now:
            tiers.setdefault(max(0, s["docs"]).bit_length() // 3, []).append(s)
        due = now if everything and len(now) > 1 else next((t for _, t in sorted(tiers.items()) if len(t) >= fanout), [])
        if not due:
            return False
        names = {s["seg"] for s in due}
        dead = self._read("dead", now).where(F.col("seg").isin(sorted(names)))
        docs = self._read("docs", due)
        # ranges stay together; they are numbered anew by the documents before them, so that small ones become one
        of = {r["seg"]: r["of"] for r in docs.groupBy("seg").agg((F.max("r") + 1).alias("of")).collect()}
        places, before = [], 0
        for s in due:
            places.append((s["seg"], before, s["docs"], of.get(s["seg"], 1)))
            before += s["docs"]
        placed = F.broadcast(self.spark.createDataFrame(places, "seg string, before long, many long, of long"))
        renumbered = F.expr(f"(before + r * many div of) div {self.per_range}").alias("r")
        gone = written(docs.join(dead, ["seg", "key"], "left_semi").groupBy("seg", "r").agg(F.collect_set("key").alias("gone")), "segment-gone")
        rows = self._read("postings", due).select("seg", "term", "field", "r", "rows").join(gone, ["seg", "r"], "left").join(placed, "seg")
        # most rows hold none of the dead, which is told faster than each element is looked up
        none = F.col("gone").isNull() | ~F.arrays_overlap("gone", "rows.key")
        left = F.when(none, F.col("rows")).otherwise(F.filter("rows", lambda x: ~F.array_contains("gone", x["key"])))
        rows = rows.select("term", "field", renumbered, left.alias("rows")).where("size(rows) > 0")
        docs = docs.join(dead, ["seg", "key"], "left_anti").join(placed, "seg").select("key", "field", "len", "terms", renumbered)
        # what these segments replaced in others stays replaced
        rest = [s for s in now if s["seg"] not in names]
        others = [s["seg"] for s in rest]
        seg = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        n = self._write(seg, docs, rows, self._read("dead", due).where(F.col("seg").isin(others)), rest, parts=True)
        discard(gone)
        try:
            self._commit([tuple(s) for s in rest] + [(seg, n, max(s["epoch"] for s in due))], version)
        except Conflict:
            Folder(self.spark, self.path).delete(f"segments/{seg}")
            return False
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests but the last ones, and segments that none of those lists. Not while batches are added."""
        self.versions.forget(keep)
        used = {r["seg"] for v in self.versions.folder.names() if v.isdigit() for r in self.versions.read(int(v)).collect()}
        folder = Folder(self.spark, self.path)
        for name in folder.names("segments"):
            if name not in used:
                folder.delete(f"segments/{name}")

    # ---- reads

    def view(self) -> search.Index:
        """The index as the searches of ``search`` take it. Their filters on terms reach the scan of the sorted postings."""
        now = self.segments()
        dead = self._read("dead", now).where(F.col("seg").isin([s["seg"] for s in now]))
        rows = self._read("postings", now).select("seg", "term", "field", F.inline("rows")).join(dead, ["seg", "key"], "left_anti")
        lengths = self._live("docs", now).select(F.col("key").alias(self.key), "field", "len")
        return search.Index(self.key, rows.select(F.col("key").alias(self.key), "field", "term", "tf", "positions"), lengths, self._stats(now), self.analyzer)

    def _stats(self, now: list) -> DataFrame:
        rows = self._read("stats", now).where(F.col("seg").isin([s["seg"] for s in now]))
        summed = rows.groupBy("field").agg(F.sum("docs").alias("n_docs"), F.sum("len").alias("len")).where("n_docs > 0")
        return summed.select("field", "n_docs", (F.col("len") / F.col("n_docs")).alias("avg_len"))

    def top_k(self, query: str, boosts: dict[str, float] = search.WEB_BOOSTS, k: int = 10, first: int = 8) -> Found:
        """The k best of ``search.simple_search``, ties by key, from as few ranges as their bounds allow.

        Bounds of all ranges come from the postings' small columns. The ``first`` ranges by bound are scored, which gives a
        score that k documents reach; then those whose bound reaches it."""
        times: dict[str, int] = {}
        for t in search.terms_of(query, self.analyzer):
            times[t] = times.get(t, 0) + 1
        now, boosts = self.segments(), {f: b for f, b in boosts.items() if f in self.fields}
        names = [s["seg"] for s in now]
        asked = F.col("term").isin(sorted(times)) & F.col("field").isin(list(boosts))
        postings = self._read("postings", now).where(asked)
        counts = postings.groupBy("field", "term").agg(F.sum("n").alias("n"))
        less = self._read("minus", now).where(asked & F.col("seg").isin(names)).groupBy("field", "term").agg((-F.sum("n")).alias("n"))
        df = counts.unionByName(less).groupBy("field", "term").agg(F.sum("n").alias("df")).where("df > 0")
        # a row for each field and term of the query
        known = F.broadcast(df.join(self._stats(now), "field").withColumn("times", F.lit(0) + _of(times, "term")))
        s = search._idf(F.col("df")) * F.col("times")
        bound = postings.select("seg", "r", "field", "term", F.col("max_tf").alias("tf"), F.col("min_len").alias("len")).join(known, ["field", "term"])
        per_field = bound.groupBy("seg", "r", "field").agg(F.sum(s * search._tf(F.col("tf"))).alias("s"))
        units = per_field.groupBy("seg", "r").agg(F.max(F.col("s") * search._boost(boosts)).alias("bound")).persist()
        dead = self._read("dead", now).where(F.col("seg").isin(names))

        def scored(some: DataFrame) -> DataFrame:
            rows = postings.join(some.select("seg", "r"), ["seg", "r"], "left_semi").select("seg", "field", "term", F.inline("rows")).drop("positions")
            each = rows.join(dead, ["seg", "key"], "left_anti").join(known, ["field", "term"]).groupBy("key", "field").agg(F.sum(s * search._tf(F.col("tf"))).alias("s"))
            best = each.groupBy("key").agg(F.max(F.col("s") * search._boost(boosts)).alias("score"))
            return search.top_hits(best.select(F.col("key").alias(self.key), "score"), self.key, k)

        try:
            of = units.count()
            least = scored(units.orderBy(F.desc("bound"), "seg", "r").limit(first)).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
            reach = least["least"] * (1 - 1e-9) if least["n"] == k else 0.0  # sums in another order differ in their last digits
            some = self.spark.createDataFrame(units.where(F.col("bound") >= reach).select("seg", "r").collect(), "seg string, r long")
        finally:
            units.unpersist()
        return Found(scored(some), some.count(), of)


def _of(values: dict[str, int], name: str) -> Column:
    out = F.lit(0)
    for k, v in values.items():
        out = F.when(F.col(name) == k, F.lit(v)).otherwise(out)
    return out
