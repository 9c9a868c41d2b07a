"""Keywords: tf-idf per document, roll-ups by domain, relations between keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import simple_terms
from weftline.session import dealt, written
from weftline.sources.sinks import ranked

FREQUENT = 1 << 17  # terms whose df all tasks get, at most


def doc_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): a document's terms, counted. Texts are dealt by key before they are taken apart, so that no terms are
    shuffled."""
    return dealt(docs.select(key, text), key).select(key, F.explode(simple_terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_df(terms: DataFrame) -> DataFrame:
    """(term, df): in how many documents a term stands."""
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(terms: DataFrame, n_docs: int, key: str = "doc_id") -> DataFrame:
    """(key, term, score) by tf * (1 + ln((N + 1) / (df + 1)))."""
    idf = 1 + F.log((F.lit(n_docs) + 1) / (F.col("df") + 1))
    return terms.join(term_df(terms), "term").select(key, "term", (F.col("tf") * idf).alias("score"))


def best_terms(terms: DataFrame, df: DataFrame, n_docs: int, k: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, rank, keyword, score): each document's k of its terms (key, term, tf) of highest tf-idf by df (term, df), ties by
    term, divided by the highest; a term that is not in df is in no document. Scores are rounded to nine places before they
    are compared, so that equal ones tie whatever order they were computed in.

    A score falls as df grows. All tasks get the df of the most frequent terms, which bounds that of the others: terms that
    k of their document outdo at any rate go before the others' df is looked up, so that few rows are shuffled by term."""
    score = lambda d: F.round(F.col("tf") * (1 + F.log((F.lit(n_docs) + 1) / (d + 1))), 9)
    steps = [0, *(1 << i for i in range(1, 62))]
    above = df.agg(*(F.count_if(F.col("df") >= x) for x in steps)).first()
    least = next((x for x, n in zip(steps, above, strict=True) if n <= FREQUENT), steps[-1])
    often = df.where(F.col("df") >= least).select("term", F.col("df").alias("_df"))
    known = terms.join(F.broadcast(often), "term", "left").withColumns({"_most": score(F.coalesce("_df", F.lit(0))), "_least": score(F.coalesce("_df", F.lit(max(least - 1, 0))))})
    by_least = known.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_least"))))
    kth = F.max(F.when(F.col("_at") == k, F.col("_least"))).over(Window.partitionBy(key))
    near = by_least.withColumn("_kth", kth).where("_kth IS NULL OR _most >= _kth").select(key, "term", "tf")
    scored = near.join(df, "term", "left").select(key, "term", score(F.coalesce("df", F.lit(0))).alias("score"))
    top = ranked(scored, [key], [F.desc("score"), F.asc("term")], k)
    best = F.max("score").over(Window.partitionBy(key))
    return top.select(key, "rank", F.col("term").alias("keyword"), (F.col("score") / best).alias("score"))


def interesting_keywords(docs: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rank, keyword, score): ``best_terms`` of documents by their own df, which is counted and written first."""
    df = written(term_df(doc_terms(docs, key, text)), "df")
    return best_terms(doc_terms(docs, key, text), df, docs.count(), k, key)


def keyword_transfer(docs: DataFrame, url: str, text: str = "text", k: int = 5) -> DataFrame:
    """(row_key, url, keyword, score) of all documents in one job."""
    return interesting_keywords(docs, k, url, text).select(F.md5(url).alias("row_key"), F.col(url).alias("url"), "keyword", "score")


def group_keywords(scores: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, rank, keyword, score): scores (group, keyword, score) summed, the k largest, ties by keyword."""
    total = scores.groupBy(group, "keyword").agg(F.sum("score").alias("score"))
    return ranked(total, [group], [F.desc("score"), F.asc("keyword")], k)


def keyword_relations(edges: DataFrame, keywords: DataFrame) -> DataFrame:
    """(from_kw, to_kw, n): over edges (src, dst), each counted once, every keyword of the source with every one of the target."""
    kw = keywords.select("domain", "keyword")
    a = edges.select("src", "dst").join(kw.select(F.col("domain").alias("src"), F.col("keyword").alias("from_kw")), "src")
    b = a.join(kw.select(F.col("domain").alias("dst"), F.col("keyword").alias("to_kw")), "dst")
    return b.groupBy("from_kw", "to_kw").agg(F.count("*").alias("n"))


def keyword_index(keywords: DataFrame) -> DataFrame:
    """(keyword, domains): the domains of each keyword, in order, comma-joined."""
    return keywords.groupBy("keyword").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))
