"""Pages and links as JSON texts: what crosses a message queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.schemas import LINK, PAGE


def encode(page: Column) -> Column:
    """A struct as JSON; null fields are left out."""
    return F.to_json(page)


def decode_pages(messages: DataFrame, value: str = "value") -> DataFrame:
    """PAGE rows of JSON messages. Those that cannot be read, or lack url, title or text, are skipped; a null h1 is
    empty, and missing lists are empty."""
    page = F.from_json(F.col(value).cast("string"), PAGE, {"mode": "PERMISSIVE"})
    rows = messages.select(page.alias("p")).select("p.*").where("url IS NOT NULL AND title IS NOT NULL AND text IS NOT NULL")
    lists = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in PAGE.fields if isinstance(f.dataType, T.ArrayType)}
    return rows.withColumns(lists | {"h1": F.coalesce("h1", F.lit(""))})


def encode_links(links: Column) -> Column:
    return F.to_json(links)


def decode_links(text: Column) -> Column:
    return F.from_json(text, T.ArrayType(LINK))
