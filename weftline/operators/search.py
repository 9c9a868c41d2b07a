"""Full-text search: an inverted index in tables, BM25, phrases, re-ranking, news decay.

Scores are BM25 with k1 = 1.2 and b = 0.75, statistics over all documents that have the field; ties by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import SIMPLE, Analyzer, simple_tokens, stemmed
from weftline.functions.urls import domain
from weftline.session import dealt, written

K1, B = 1.2, 0.75
# The boosts of the web and the news index.
WEB_BOOSTS = {"text": 5.0, "title": 2.0, "description": 1.0, "keywords": 1.0, "h1": 3.0, "h2": 2.0, "anchors": 2.0}
NEWS_BOOSTS = {"text": 2.0, "title": 1.0}


@dataclass
class Index:
    """postings (key, field, term, tf, positions), lengths (key, field, len), stats (field, n_docs, avg_len), and the
    analyzer that they were made with, which takes queries apart too. ``some``, if there is one, makes the postings of some
    terms from the texts, without those of others."""

    key: str
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    analyzer: Analyzer = SIMPLE
    some: Callable[[list[str]], DataFrame] | None = None

    def only(self, terms: list[str]) -> Index:
        """The index for a query of these terms: where it is no stored one, their postings and all lengths are made once, and
        written."""
        if self.some is None:
            return self
        lengths = written(self.lengths, "query-lengths")
        return Index(self.key, written(self.some(terms), "query-postings"), lengths, _stats(lengths), self.analyzer)

    def cached(self) -> Index:
        return Index(self.key, self.postings.cache(), self.lengths.cache(), self.stats.cache(), self.analyzer)

    def write(self, path: str) -> None:
        """Postings lie by term, so that a query's filter prunes row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark, path: str, key: str, analyzer: Analyzer = SIMPLE) -> Index:
        return Index(key, *(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "stats")), analyzer)


def read_indexed(spark, path: str, key: str = "doc_key") -> Index:
    """The index that the stream's indexer writes batch by batch: of each page the rows of its last batch."""
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    last = read("keys").groupBy(key).agg(F.max("epoch").alias("epoch"))
    postings, lengths = (read(t).join(last, [key, "epoch"], "left_semi").drop("epoch") for t in ("postings", "lengths"))
    return Index(key, postings, lengths, _stats(lengths))


def page_fields(pages: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """The seven text fields of nested pages (PAGE): h2 joined with a space before each; description and keywords
    from the last meta of exactly that name; anchors of (link, anchors) rows, if given, else empty."""
    named = lambda n: F.coalesce(F.try_element_at(F.filter("metas", lambda m: m["name"] == n), F.lit(-1))["content"], F.lit(""))
    h2 = F.aggregate(F.coalesce("h2", F.array().cast("array<string>")), F.lit(""), lambda a, x: F.concat(a, F.lit(" "), x))
    out = pages.select(F.md5("url").alias("doc_key"), "url", "title", "text", "h1", h2.alias("h2"), named("description").alias("description"), named("keywords").alias("keywords"))
    if anchors is None:
        return out.withColumn("anchors", F.lit(""))
    more = anchors.select(F.col("link").alias("url"), "anchors")
    return out.join(more, "url", "left").withColumn("anchors", F.coalesce("anchors", F.lit("")))


def update_fields(index_rows: DataFrame, updates: DataFrame, key: str = "doc_key") -> DataFrame:
    """Partial updates: values of ``updates`` that are not null replace those of the same key."""
    cols = [c for c in updates.columns if c != key]
    new = updates.select(key, *(F.col(c).alias(f"_new_{c}") for c in cols))
    joined = index_rows.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in index_rows.columns))


def _texts(rows: DataFrame, keys: list[str], fields: list[str], analyzer: Analyzer) -> DataFrame:
    each = F.array(*(F.struct(F.lit(f).alias("field"), analyzer.words(F.col(f)).alias("words")) for f in fields))
    return rows.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.*")


def _grouped(places: DataFrame, keys: list[str], analyzer: Analyzer, stems: DataFrame | None = None) -> DataFrame:
    if analyzer.stems:  # one row a word and document before their stems are made
        found = stemmed(places.groupBy(*keys, "field", "word").agg(F.collect_list("pos").alias("at")), stems)
        return found.groupBy(*keys, "field", "term").agg(F.sum(F.size("at")).alias("tf"), F.array_sort(F.flatten(F.collect_list("at"))).alias("positions"))
    return places.groupBy(*keys, "field", F.col("word").alias("term")).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def postings_of(rows: DataFrame, keys: list[str], fields: list[str], analyzer: Analyzer, stems: DataFrame | None = None) -> DataFrame:
    """(keys, field, term, tf, positions) of rows (keys, fields); rows that lie dealt by one of the keys stay where they are,
    unless their words are stemmed."""
    return _grouped(_texts(rows, keys, fields, analyzer).select(*keys, "field", F.inline("words")), keys, analyzer, stems)


def build_index(docs: DataFrame, key: str, fields: list[str], analyze=SIMPLE, stems: DataFrame | None = None) -> Index:
    """``analyze``: an Analyzer, or a Column function from text to an array of terms. Words are stemmed where the analyzer
    says so, through ``stems`` (word, stem) or a table of the corpus's own distinct words."""
    if not isinstance(analyze, Analyzer):
        terms = analyze
        analyze = Analyzer(lambda c: F.transform(terms(c), lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), simple_tokens)
    rows = docs.select(key, *dict.fromkeys(fields))
    lengths = _texts(rows, [key], fields, analyze).select(key, "field", F.size("words").cast("long").alias("len")).where("len > 0").groupBy(key, "field").agg(F.sum("len").alias("len"))

    def some(terms: list[str]) -> DataFrame:
        # a stem begins as its words do
        fine = F.substring("word", 1, 1).isin(sorted({t[:1] for t in terms})) if analyze.stems else F.col("word").isin(sorted(set(terms)))
        return _grouped(_texts(rows, [key], fields, analyze).select(key, "field", F.inline("words")).where(fine), [key], analyze, stems).where(F.col("term").isin(sorted(set(terms))))

    # texts are dealt by key before they are taken apart, so that no postings are shuffled
    return Index(key, postings_of(dealt(rows, key), [key], fields, analyze, stems), lengths, _stats(lengths), analyze, some if stems is None else None)


def _stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def _idf(df: Column) -> Column:
    return F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))


def _tf(tf: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def _boost(boosts: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for f, b in boosts.items():
        out = F.when(F.col("field") == f, F.lit(float(b))).otherwise(out)
    return out


def best_fields(index: Index, terms: list[str], boosts: dict[str, float]) -> DataFrame:
    """(key, score): the best field's sum of its terms' BM25, times its boost. The terms reach the scan as a filter."""
    hits = index.postings.where(F.col("term").isin(sorted(set(terms))) & F.col("field").isin(list(boosts)))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    times = F.lit(0)
    for t in set(terms):
        times = F.when(F.col("term") == t, F.lit(terms.count(t))).otherwise(times)
    # a row for each field and term of the query goes to all tasks, so that a frequent term's postings stay dealt
    full = hits.drop("positions").join(F.broadcast(df.join(index.stats, "field")), ["field", "term"]).join(index.lengths, [index.key, "field"])
    each = full.groupBy(index.key, "field").agg(F.sum(_idf(F.col("df")) * _tf(F.col("tf")) * times).alias("s"))
    return each.groupBy(index.key).agg(F.max(F.col("s") * _boost(boosts)).alias("score"))


def phrase_scores(index: Index, phrases: list[list[tuple[str, int]]], boosts: dict[str, float]) -> DataFrame:
    """(clause, key, score) of every phrase (its terms and their places) and document that holds it in some field: all terms,
    as far from each other as in the phrase."""
    rows = [(c, i - p[0][1], t, len(p)) for c, p in enumerate(phrases) for t, i in p]
    asked = F.broadcast(index.postings.sparkSession.createDataFrame(rows, "clause int, off int, term string, need int"))
    hits = index.postings.where(F.col("term").isin(sorted({t for p in phrases for t, _ in p})) & F.col("field").isin(list(boosts)))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = df.join(asked, "term").join(index.stats, "field").groupBy("clause", "field").agg(F.sum(_idf(F.col("df"))).alias("idf"))
    starts = hits.join(asked, "term").select(index.key, "field", "clause", "need", "off", F.explode("positions").alias("pos"))
    whole = starts.groupBy(index.key, "field", "clause", "need", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("n")).where("n = need")
    freq = whole.groupBy(index.key, "field", "clause").agg(F.count("*").alias("tf"))
    full = freq.join(F.broadcast(idf.join(index.stats, "field")), ["clause", "field"]).join(index.lengths, [index.key, "field"])
    return full.groupBy("clause", index.key).agg(F.max(F.col("idf") * _tf(F.col("tf")) * _boost(boosts)).alias("score"))


def _without(index: Index, hits: DataFrame, phrases: list[list[tuple[str, int]]], boosts: dict[str, float]) -> DataFrame:
    return hits.join(phrase_scores(index, phrases, boosts).select(index.key).distinct(), index.key, "left_anti") if phrases else hits


def terms_of(text: str, analyzer: Analyzer = SIMPLE) -> list[str]:
    """A query's terms, as the analyzer has a text's."""
    return [t for t, _ in analyzer.query(text)]


def _clauses(index: Index, phrases: list[str] | None) -> list[list[tuple[str, int]]]:
    """The phrases that are not blank, as the index has its texts."""
    return [p for p in map(index.analyzer.query, phrases or []) if p]


def simple_search(index: Index, query: str, boosts: dict[str, float] = WEB_BOOSTS, blocked: list[str] | None = None) -> DataFrame:
    """(key, score) of documents with any of the query's terms and none of the blocked phrases."""
    terms, barred = terms_of(query, index.analyzer), _clauses(index, blocked)
    index = index.only([*terms, *(t for p in barred for t, _ in p)])
    return _without(index, best_fields(index, terms, boosts), barred, boosts)


def advanced_search(index: Index, must: list[str], must_not: list[str], should: list[str], boosts: dict[str, float] = WEB_BOOSTS, blocked: list[str] | None = None) -> DataFrame:
    """(key, score): all of the must phrases, none of must_not and blocked; some should phrase where there is no must.
    The score is the sum over matched clauses. Clauses without terms count for nothing."""
    need, may, barred = _clauses(index, must), _clauses(index, should), _clauses(index, [*must_not, *(blocked or [])])
    index = index.only([t for p in need + may + barred for t, _ in p])
    clauses = phrase_scores(index, need + may, boosts)
    found = clauses.groupBy(index.key).agg(F.sum("score").alias("score"), F.sum((F.col("clause") < len(need)).cast("int")).alias("n_must"), F.count("*").alias("n"))
    hits = found.where((F.col("n_must") == len(need)) & (F.col("n") > 0)).select(index.key, "score")
    return _without(index, hits, barred, boosts)


def top_hits(hits: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n best hits with a score above 0, ties by key."""
    return hits.where("score > 0").orderBy(F.desc("score"), F.asc(key)).limit(n)


def rerank(hits: DataFrame, ranks: DataFrame, node: Column, key: str, candidates: int = 1000, n: int = 10) -> DataFrame:
    """The best ``candidates`` re-ranked by score times their node's rank; a rank that is missing or exactly 1 counts as 0."""
    first = top_hits(hits, key, candidates).withColumn("node", node)
    rank = F.when(F.col("rank").isNull() | (F.col("rank") == 1.0), 0.0).otherwise(F.col("rank"))
    return top_hits(first.join(ranks, "node", "left").withColumn("score", F.col("score") * rank).drop("rank", "node"), key, n)


def rerank_by_domain(hits: DataFrame, ranks: DataFrame, url: str = "url", candidates: int = 1000, n: int = 10) -> DataFrame:
    return rerank(hits, ranks, domain(F.col(url)), url, candidates, n)


def decay(ts: Column, now: Column, scale_min: float = 240.0, offset_min: float = 30.0, half: float = 0.5) -> Column:
    """1 within ``offset`` minutes of now, then falling by ``half`` every ``scale`` minutes."""
    minutes = F.abs(F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 60e6
    return F.exp(F.log(F.lit(half)) / scale_min * F.greatest(F.lit(0.0), minutes - offset_min))


def news_search(index: Index, news: DataFrame, query: str, now: Column, ts: str = "pub_date", boosts: dict[str, float] = NEWS_BOOSTS, n: int = 10) -> DataFrame:
    """(key, pub_date, score): the n best news by BM25 times the decay of their age; scores are rounded to six places before
    they are compared."""
    terms = terms_of(query, index.analyzer)
    hits = best_fields(index.only(terms), terms, boosts).join(news.select(index.key, ts), index.key)
    return top_hits(hits.withColumn("score", F.round(F.col("score") * decay(F.col(ts), now), 6)), index.key, n)
