"""Sharding by jump consistent hashing, in DataFrame functions only.

A stable key's shard follows from the key and the number of shards alone; there is no ring table, and
going from n to n + 1 shards moves rows only into the new shard (about 1 in n + 1 of them).

Defined results: a null doc_id has a key like any other; a null text has size 1 and crc32 0; repeated rows
each get a slot of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import table

#: The generator of the published algorithm (Lamping and Veach, 2014): key * MULTIPLIER + 1 mod 2^64.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _mul_low(x: Column, y: int) -> Column:
    """x * y mod 2^32 for x, y below 2^32, without leaving the range of a long."""
    low = x.bitwiseAND(_long(0xFFFF)) * _long(y)
    high = F.shiftleft((F.shiftright(x, 16) * _long(y)).bitwiseAND(_long(0xFFFF)), 16)
    return (low + high).bitwiseAND(_long(_LOW))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the generator on a state in two halves of 32 bits."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    a = lo.bitwiseAND(_long(0xFFFF)) * _long(m_lo)
    b = F.shiftright(lo, 16) * _long(m_lo)
    t = a + F.shiftleft(b.bitwiseAND(_long(0xFFFF)), 16) + _long(1)
    carry = F.shiftright(t, 32) + F.shiftright(b, 16)
    return (carry + _mul_low(lo, m_hi) + _mul_low(hi, m_lo)).bitwiseAND(_long(_LOW)), t.bitwiseAND(_long(_LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a 64-bit key.

    A walk has ln(shards) + 0.6 jumps on average and at most ``shards``. Above 64 shards the bound is
    64 + 8 ln(shards), which a key passes with probability below 1e-30; such a key raises an error.
    """
    steps = shards if shards <= 64 else 64 + int(8 * math.log(shards))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_long(_LOW)).alias("lo"),
        _long(-1).alias("b"), _long(0).alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        # the new state is made first, so that j is computed from it once
        return F.when(s["j"] >= shards, s).otherwise(F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), j.alias("j")))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start, step,
        lambda s: F.when(s["j"] >= shards, s["b"].cast("int")).otherwise(F.raise_error(F.lit("jump hash: too few steps")).cast("int")),
    )


def _digest(*cols: Column) -> Column:
    """The md5 in hex of the columns' texts, each behind its length; ``-`` for null."""
    texts = [c.cast("string") for c in cols]
    return F.md5(F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _hex(digest: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(digest, start, n), 16, 10).cast("long")


def stable_key(*cols: Column) -> Column:
    """The first 64 bits of the columns' digest: the same in every engine."""
    d = _digest(*cols)
    return F.shiftleft(_hex(d, 1, 8), 32).bitwiseOR(_hex(d, 9, 8))


def assign(df: DataFrame, key: Column, shards: int, order: list[str], per_bucket: int = 50_000) -> DataFrame:
    """Adds shard, grown_shard and slot (gapless from 0 in each shard, in the order of a digest of ``order``).

    Slots need no task that sees a whole shard: rows are numbered within ranges of the digest of about ``per_bucket``
    rows, and the small table of their counts gives each range its first slot; how many ranges there are does not show.
    Rows that are equal in ``order`` are interchangeable.
    """
    n = df.count()
    buckets = max(1, math.ceil(n / per_bucket / shards))
    placed = df.withColumn("_key", key).withColumn("_h", _hex(_digest(*map(F.col, order)), 1, 15))
    placed = placed.withColumn("shard", jump_hash(F.col("_key"), shards)).withColumn("grown_shard", jump_hash(F.col("_key"), shards + 1))
    # of 60 bits the upper 31, scaled to the number of ranges
    placed = placed.withColumn("_bucket", F.shiftright(F.shiftright("_h", 29) * F.lit(buckets).cast("long"), 31))
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy("_h")
    numbered = placed.withColumn("_at", F.row_number().over(within) - 1)
    return (
        numbered.join(firsts, ["shard", "_bucket"])
        .withColumn("slot", (F.col("_first") + F.col("_at")).cast("long"))
        .drop("_key", "_h", "_bucket", "_first", "_at")
    )


def op9_jump_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = assign(rows, stable_key(F.col("doc_id")), shards, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The walk of both shard counts step by step, the checksum byte by byte over a table of its 256 remainders.
ORACLE = """
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce(list_prepend(n, range(-8, 0)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t FROM range(256) r(n)
), sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32,
    coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') AS name
  FROM documents, remainders
), keyed AS (
  SELECT *, substr(md5(name), 1, 16) AS key,
    substr(md5(name || length(CAST(text_crc32 AS VARCHAR)) || ':' || text_crc32 || length(CAST(size AS VARCHAR)) || ':' || size), 1, 15) AS h
  FROM sized
), walk AS (
  SELECT DISTINCT key, n, CAST(CAST('0x' || key AS UBIGINT) AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM keyed, (VALUES (16), (17)) s(n)
  UNION ALL
  SELECT key, n, k2, j, CAST(floor(CAST(j + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE) / CAST((k2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < n)
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(a.b AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY a.b ORDER BY h) - 1 AS slot, CAST(g.b AS INTEGER) AS grown_shard
FROM keyed JOIN (SELECT key, b FROM walk WHERE n = 16 AND j >= n) a USING (key) JOIN (SELECT key, b FROM walk WHERE n = 17 AND j >= n) g USING (key)
"""
