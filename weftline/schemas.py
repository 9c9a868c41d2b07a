"""The data model: nested pages, graphs, postings, feeds."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _fields(text: str) -> T.StructType:
    """A struct of "name kind, ..." with kinds as above or arrays of them; workers, which have no session, read it too."""
    out = T.StructType()
    for part in text.split(", "):
        name, kind = part.split(" ")
        out.add(name, T.ArrayType(_KINDS[kind[6:-1]]) if kind.startswith("array<") else _KINDS[kind])
    return out


LINK = _fields("link string, anchor string")
META = _fields("name string, content string, charset string, http_equiv string, scheme string")
PAGE = T.StructType([
    *_fields("url string, title string, text string, h1 string, h2 array<string>").fields,
    T.StructField("links", T.ArrayType(LINK)), T.StructField("metas", T.ArrayType(META)),
])
TWEET = _fields("user_name string, text string, urls array<string>, hash_tags array<string>, tweet_id bigint, pub_date string")
SITE = _fields("rss_url string, attr string, value string, last_link string")
EDGE = _fields("src string, dst string, weight int")
RANK = _fields("node string, rank double")
POSTING = _fields("doc_id bigint, field string, term string, tf bigint, positions array<int>")
NEWS = _fields("url string, title string, text string, pub_date timestamp, ingest_ts timestamp")
KEYWORD = _fields("url string, keyword string, score double")
