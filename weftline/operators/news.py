"""News: feeds, articles, trending words."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.dates import parse_pub_date
from weftline.functions.html import element_text
from weftline.operators.keywords import interesting_keywords
from weftline.sources.sinks import ranked

_ITEMS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("title", "link", "pub_date"))]))


def feed_items(xml: str | None) -> list[dict]:
    """Items of a feed: of an item's children the last whose tag contains title, else link, else pubDate; no items for what is no XML."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    out = []
    for i, item in enumerate(root.iter("item")):
        row: dict = {"pos": i, "title": None, "link": None, "pub_date": None}
        for child in item:
            tag = child.tag.rpartition("}")[2]
            for sign, name in (("title", "title"), ("link", "link"), ("pubDate", "pub_date")):
                if sign in tag:
                    row[name] = "".join(child.itertext())
                    break
        out.append(row)
    return out


@F.pandas_udf(_ITEMS)
def parse_feed(xml: pd.Series) -> pd.Series:
    return pd.Series([feed_items(x) for x in xml], dtype=object)


def article_body(attr: str, value: str):
    """A pandas UDF: the text of the first element with attr = value, null if there is none."""

    @F.pandas_udf("string")
    def body(html: pd.Series) -> pd.Series:
        return pd.Series([element_text(h, attr, value) for h in html], dtype=object)

    return body


@F.pandas_udf(T.StringType())
def body_by(html: pd.Series, attr: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([element_text(h, a, v) if a and v else None for h, a, v in zip(html, attr, value, strict=True)], dtype=object)


def new_items(feeds: DataFrame) -> DataFrame:
    """(rss_url, pos, title, link, pub_date, ingest_ts) of (rss_url, xml, last_link, ingest_ts): items before the one seen last."""
    items = feeds.select("rss_url", "last_link", "ingest_ts", F.explode(parse_feed("xml")).alias("i")).select("rss_url", "last_link", "ingest_ts", "i.*")
    seen = items.where(F.col("link") == F.col("last_link")).groupBy("rss_url").agg(F.min("pos").alias("till"))
    fresh = items.join(seen, "rss_url", "left").where(F.col("till").isNull() | (F.col("pos") < F.col("till")))
    return fresh.select("rss_url", "pos", "title", "link", parse_pub_date(F.col("pub_date"), F.col("ingest_ts")).alias("pub_date"), "ingest_ts")


def high_water(feeds: DataFrame) -> DataFrame:
    """(rss_url, last_link): the newest item's link, to be stored once its items are processed."""
    first = F.try_element_at(parse_feed("xml"), F.lit(1))
    return feeds.select("rss_url", F.coalesce(first["link"], F.col("last_link")).alias("last_link"))


def articles(items: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(url, title, text, pub_date, ingest_ts): items whose page (url, html) has the element its site names."""
    rows = items.join(sites.select("rss_url", "attr", "value"), "rss_url").join(pages.select(F.col("url").alias("link"), "html"), "link")
    return rows.select(F.col("link").alias("url"), "title", body_by("html", "attr", "value").alias("text"), "pub_date", "ingest_ts").where("text IS NOT NULL")


def trend_scores(news: DataFrame, stop_words: DataFrame, k: int = 5) -> DataFrame:
    """(url, word, score, ingest_ts): an article's k best keywords that are no stop words."""
    words = interesting_keywords(news, k, "url", "text").withColumnRenamed("keyword", "word")
    return words.join(stop_words.select("word"), "word", "left_anti").join(news.select("url", "ingest_ts"), "url").select("url", "word", "score", "ingest_ts")


def trend_top(scores: DataFrame, now: Column, hours: int = 18, n: int = 10, word: str = "word", score: str = "score", ts: str = "ingest_ts") -> DataFrame:
    """(rank, word, score): the words of the highest sums in the ``hours`` before now, ties by word; ranks from 0."""
    recent = scores.where((F.col(ts) >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) < now))
    sums = recent.groupBy(F.lower(word).alias("word")).agg(F.sum(score).alias("score"))
    top = sums.orderBy(F.desc("score"), F.asc("word")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("word"))) - 1).select("rank", "word", "score")


def trend_windows(scores: DataFrame, word: str = "word", score: str = "score", ts: str = "ingest_ts", hours: int = 18, every: int = 2) -> DataFrame:
    """(window_start, word, score): sums over sliding windows; the same expression runs on a stream."""
    w = F.window(ts, f"{hours} hours", f"{every} hours")
    return scores.groupBy(w.alias("w"), F.lower(word).alias("word")).agg(F.sum(score).alias("score")).select(F.col("w.start").alias("window_start"), "word", "score")


def trend_top_windows(scores: DataFrame, n: int = 10, **names: str) -> DataFrame:
    """(window_start, rank, word, score): the n highest of each window."""
    return ranked(trend_windows(scores, **names), ["window_start"], [F.desc("score"), F.asc("word")], n)
