"""Scans: whole tables, key and time ranges, point reads, word lists, properties, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_range(df: DataFrame, key: Column, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Rows with start <= key < stop; either may be open. On a stored key this reaches the Parquet scan."""
    if start is not None:
        df = df.where(key >= start)
    return df.where(key < stop) if stop is not None else df


def time_range(df: DataFrame, ts: Column, start, end) -> DataFrame:
    """Rows with start <= ts < end."""
    return df.where((ts >= F.lit(start)) & (ts < F.lit(end)))


def point_get(df: DataFrame, key_column: str, key: str) -> DataFrame:
    """The rows of a key, stored under its md5."""
    return df.where(F.col(key_column) == F.md5(F.lit(key)))


def exists(df: DataFrame, known: DataFrame, on: str | list[str], there: bool = True) -> DataFrame:
    """Rows whose key is (or is not) among ``known``."""
    return df.join(known, on, "left_semi" if there else "left_anti")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """A word per line, lower-cased, without empty lines."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def words_per_line(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Space-separated lines as columns; the last column is an array of what is left."""
    parts = F.split(F.trim("value"), " +")
    lead = [F.get(parts, i).alias(n) for i, n in enumerate(names[:-1])]
    return spark.read.text(path).where("trim(value) <> ''").select(*lead, F.slice(parts, len(names), 1 << 30).alias(names[-1]))


def properties(text: str) -> dict[str, str]:
    """A properties file: key=value lines, # and ! comments, backslash escapes of = and :."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        at = next((i for i, c in enumerate(line) if c in "=:" and (not i or line[i - 1] != "\\")), len(line))
        out[line[:at].strip().replace("\\:", ":").replace("\\=", "=")] = line[at + 1 :].strip().replace("\\:", ":").replace("\\=", "=")
    return out


def rss_sites(spark: SparkSession, props: dict[str, str]) -> DataFrame:
    """(rss_url, attr, value, last_link) of Site.i.RssUrl and Site.i.Config = attr/value, for i below numberOfRssSite."""
    rows = []
    for i in range(int(props.get("numberOfRssSite", 0))):
        url, conf = props.get(f"Site.{i}.RssUrl"), props.get(f"Site.{i}.Config")
        if url and conf:
            attr, _, value = conf.partition("/")
            rows.append((url, attr, value, None))
    return spark.createDataFrame(rows, "rss_url string, attr string, value string, last_link string")


def web_responses(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Only text responses, where the table says what they are."""
    return df.where(F.col(content_type).isNull() | F.contains(F.col(content_type), F.lit("text/"))) if content_type in df.columns else df


def log_lines(spark: SparkSession, path: str, patterns: dict[str, str], stream: bool = False) -> DataFrame:
    """(handler, line) for every line and handler whose pattern it matches; as a stream, new lines of a folder."""
    lines = (spark.readStream if stream else spark.read).text(path)
    hits = [F.when(F.col("value").rlike(p), F.lit(h)) for h, p in patterns.items()]
    return lines.select(F.explode(F.array_compact(F.array(*hits))).alias("handler"), F.col("value").alias("line"))
