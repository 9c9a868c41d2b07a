"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A window is ten consecutive words of
an item (all of an item with fewer). The index holds postings (term, document, position) of benchmark terms.
A window's terms are looked up from the rarest (by its count in the index): the rarest term's postings, shifted
by its offset, give candidate starts; the next rarest, shifted likewise, is intersected with them, and a last
join asks for all the other terms at once. What is left are exact phrase matches.

Only places that can lie in a window are indexed: those in a run of at least as many benchmark terms as the
shortest window has words. The runs are found by a hashed term set without misses, a byte per slot, whose size
follows the benchmark's vocabulary within [2^12, 2^20] bytes; false positives only index more.

Defined results: a null or empty text, of a document or an item, has no words; repeated documents and null
doc_ids are rows of their own; items that share an item_id count as one, a null item_id as the text "null"; an
empty benchmark hits nothing; an empty documents table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import table, tagged, written

WORDS = 10
SLOP = 1
#: Benchmark tables of at most so many rows (of some 100 bytes) are broadcast; larger ones are joined by shuffles, whose hot terms Spark splits.
SMALL_ROWS = 1 << 18
_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() is right, and faster, where all characters are ASCII
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BREAKS, -1), "")


def item_terms(items: DataFrame, size: int = WORDS) -> DataFrame:
    """(item, win, need, off, term): the words of every window; win tells windows of different items apart."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    wins = w.select("item", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))).alias("at", "t"))
    # equal windows are looked up once; each has the list of its items elsewhere
    return wins.select("item", F.sha2(F.array_join("t", " "), 256).alias("win"), F.size("t").alias("need"), F.posexplode("t").alias("off", "term"))


def _term_set(terms: DataFrame, n: int) -> tuple[bytes, int]:
    """A byte per slot, 1 if some term hashes there. Collects slots only, 2^20 at most."""
    size = 1 << min(20, max(12, (8 * n).bit_length()))
    slots = terms.select(F.pmod(F.xxhash64("term"), F.lit(size)).cast("int").alias("s")).distinct()
    out = bytearray(size)
    for r in slots.toLocalIterator():
        out[r.s] = 1
    return bytes(out), size


def index(docs: DataFrame, terms: DataFrame, shortest: int, keep: list[str], slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, postings): keep and n_words of every document; (keep[0], pos, term) of the places that can lie in a window,
    or, with ``slop``, in a window whose every word may stand so many places off."""
    n_terms = terms.count()
    held, size = _term_set(terms, n_terms)
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(size)).cast("int") + 1
    here = lambda x: F.substring(F.lit(bytearray(held)), slot(x), F.lit(1)) == F.lit(bytearray(b"\x01"))
    w = docs.select(*keep, words(F.col("text")).alias("w"))
    flags = F.array_join(F.transform("w", lambda x: F.when(here(x), "1").otherwise("0")), "").cast("binary")
    # a generator keeps the optimizer from computing w and f again for each element that looks into them
    w = w.select(*keep, F.explode(F.array(F.struct("w", flags.alias("f")))).alias("x")).select(*keep, "x.w", "x.f")
    ones = F.lit(bytearray(b"1" * max(shortest, 1)))
    good = lambda p: F.substring("f", (p + 1).cast("int"), F.lit(max(shortest, 1))) == ones
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - max(shortest, 1)), good)
    at = lambda x, p: F.struct(p.cast("long").alias("pos"), x.alias("term"))
    # of overlapping starts each gives its first word, the last of them all of its words: every place once
    whole = lambda p: F.transform(F.slice("w", p + 1, max(shortest, 1)), lambda x, j: at(x, p + j))
    runs = F.flatten(F.transform(starts, lambda p: F.when(good(p + 1), F.array(at(F.get("w", p), p))).otherwise(whole(p))))
    able = F.contains("f", ones) if shortest else F.lit(False)
    if slop and shortest:
        w, runs = _loose(w, keep, shortest, slop)
        able = F.lit(True)
    rows = written(w.select(*keep, F.size("w").cast("long").alias("n_words"), F.when(able, runs).alias("runs")), "decon-rows")
    found = rows.select(keep[0], F.inline("runs"))
    return rows.drop("runs"), written(found.join(_sent(terms, n_terms), "term", "left_semi"), "decon-postings")


def _loose(w: DataFrame, keep: list[str], shortest: int, slop: int) -> tuple[DataFrame, Column]:
    """(w, the places indexed): the terms within ``slop`` of a run of ``shortest`` places each of which has a term within
    ``slop``. A near match's window is such a run, which can begin before the text and end behind it, so none is lost."""
    none = lambda k: F.lit(bytearray(b"0" * k))
    each = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(1), F.size("w") + n), f), "").cast("binary")
    bit = lambda c: F.when(c, "1").otherwise("0")
    kept = lambda df, name, c: df.select(*keep, F.explode(F.array(F.struct("w", "f", c.alias(name)))).alias("x")).select(*keep, "x.*")
    some = F.concat(none(2 * slop), "f", none(2 * slop))
    # character i of g is the place i - slop
    w = kept(w, "p", some)
    w = kept(w, "g", each(2 * slop, lambda i: bit(F.substring("p", i, F.lit(2 * slop + 1)) != none(2 * slop + 1))))
    starts = each(2 * slop, lambda i: bit(F.substring("g", i, F.lit(shortest)) == F.lit(bytearray(b"1" * shortest))))
    w = kept(w, "s", F.concat(none(shortest - 1), starts))
    span = shortest + 2 * slop
    inside = lambda i: (F.substring("f", i, F.lit(1)) == F.lit(bytearray(b"1"))) & F.contains(F.substring("s", i, F.lit(span)), F.lit(bytearray(b"1")))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), inside)
    return w, F.transform(at, lambda i: F.struct((i - 1).cast("long").alias("pos"), F.get("w", i - 1).alias("term")))


def phrase_matches(postings: DataFrame, wins: DataFrame, key: str) -> DataFrame:
    """(key, win, start, need) of every occurrence of every window."""
    n = wins.count()
    counts = postings.groupBy("term").agg(F.count("*").alias("cf"))
    # a window with a term that has no postings occurs nowhere
    asked = wins.join(counts, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    by_rarity = Window.partitionBy("win").orderBy("cf", "off")
    asked = asked.withColumn("order", F.row_number().over(by_rarity)).withColumn("least", F.min("cf").over(Window.partitionBy("win")))
    asked = asked.where("least > 0").drop("least")
    asked = written(asked, "decon-asked")
    nth = lambda k: _sent(asked.where(F.col("order") == k).select("win", "need", "off", "term"), n)
    starts = postings.join(nth(1), "term").select(key, "win", "need", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    second = _sent(asked.where("order = 2").select("win", F.col("off").alias("off2"), "term"), n)
    alone = starts.where("need = 1")
    wanted = starts.where("need > 1").join(second, "win").withColumn("pos", F.col("start") + F.col("off2"))
    met = wanted.join(postings, [key, "pos", "term"], "left_semi").select(key, "win", "need", "start")
    rest = _sent(asked.where("order > 2").groupBy("win").agg(F.collect_list(F.struct("off", "term")).alias("rest")), n)
    each = met.where("need > 2").join(rest, "win").select(key, "win", "need", "start", F.explode("rest").alias("r"))
    each = each.select(key, "win", "need", "start", (F.col("start") + F.col("r.off")).alias("pos"), F.col("r.term").alias("term"))
    full = each.join(postings, [key, "pos", "term"], "left_semi").groupBy(key, "win", "need", "start").agg(F.count("*").alias("n")).where("n = need - 2").drop("n")
    out = [key, "win", "start", "need"]
    return alone.select(*out).unionByName(met.where("need = 2").select(*out)).unionByName(full.select(*out))


def proximity_matches(postings: DataFrame, wins: DataFrame, key: str, slop: int) -> DataFrame:
    """(key, win, start): places such that every term of the window stands within ``slop`` of start + its offset. A start may
    lie before the text; what other documents hold does not count. Candidates come from the window's rarest term; the
    next rarest, and then all the others at once, are looked up at the few places where they may stand."""
    counts = postings.groupBy("term").agg(F.count("*").alias("cf"))
    asked = wins.join(counts, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    asked = asked.withColumn("order", F.row_number().over(Window.partitionBy("win").orderBy("cf", "off"))).withColumn("least", F.min("cf").over(Window.partitionBy("win")))
    asked = written(asked.where("least > 0").drop("least"), "decon-asked")
    about = lambda c: F.explode(F.sequence(c - slop, c + slop))
    first = asked.where("order = 1").select("win", "need", "off", "term")
    starts = postings.join(first, "term").select(key, "win", "need", about(F.col("pos") - F.col("off")).alias("start")).distinct()

    def met(starts: DataFrame, terms: DataFrame) -> DataFrame:
        """The terms that stand near their places, each once a start."""
        sought = starts.join(terms.select("win", "off", "term"), "win").select(key, "win", "need", "start", "off", "term", about(F.col("start") + F.col("off")).alias("pos"))
        return sought.join(postings, [key, "pos", "term"], "left_semi").select(key, "win", "need", "start", "off").distinct()

    second = met(starts.where("need > 1"), asked.where("order = 2")).drop("off")
    full = met(second.where("need > 2"), asked.where("order > 2")).groupBy(key, "win", "need", "start").agg(F.count("*").alias("n")).where("n = need - 2")
    return reduce(DataFrame.unionByName, (x.select(key, "win", "start") for x in (starts.where("need = 1"), second.where("need = 2"), full)))


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], size: int = WORDS) -> DataFrame:
    """keep, n_words, n_hit, n_items, item_list (sorted, comma-joined) of every document; ``keep[0]`` tells rows apart."""
    key = keep[0]
    asked = written(item_terms(items, size), "decon-items")
    shortest = asked.agg(F.min("need")).first()[0] or 0
    rows, postings = index(docs, asked.select("term").distinct(), shortest, keep)
    found = written(phrase_matches(postings, asked.drop("item").distinct(), key), "decon-found")
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.select(key, "start", (F.col("start") + F.col("need")).alias("end")).withColumn("till", F.max("end").over(before))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce("till", "start")), F.lit(0))
    hits = ends.groupBy(key).agg(F.sum(new).cast("long").alias("n_hit"))
    pairs = asked.select("win", "item").distinct()
    of = found.select(key, "win").distinct().join(_sent(pairs, pairs.count()), "win").select(key, "item").distinct()
    lists = of.groupBy(key).agg(F.array_sort(F.collect_list("item")).alias("_items"))
    return rows.join(hits, key, "left").join(lists, key, "left").select(
        *keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("_items", ","), F.lit("")).alias("item_list"),
    )


def proximity(docs: DataFrame, items: DataFrame, keep: list[str], slop: int = SLOP, size: int = WORDS) -> DataFrame:
    """keep, n_words, n_near (places at which a near match starts), n_items and item_list (items with near matches) of every
    document; ``keep[0]`` tells rows apart. It is no query: its index of all places that may be near holds 12.9 million
    postings on 0.1 GB of documents, more than the limits of exact matches allow."""
    key = keep[0]
    asked = written(item_terms(items, size), "decon-items")
    shortest = asked.agg(F.min("need")).first()[0] or 0
    rows, postings = index(docs, asked.select("term").distinct(), shortest, keep, slop)
    found = written(proximity_matches(postings, asked.drop("item").distinct(), key, slop), "decon-near")
    near = found.groupBy(key).agg(F.count_distinct("start").alias("n_near"))
    pairs = asked.select("win", "item").distinct()
    of = found.select(key, "win").distinct().join(_sent(pairs, pairs.count()), "win").select(key, "item").distinct()
    lists = of.groupBy(key).agg(F.array_sort(F.collect_list("item")).alias("_items"))
    return rows.join(near, key, "left").join(lists, key, "left").select(
        *keep, "n_words", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("_items", ","), F.lit("")).alias("item_list"),
    )


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"), ["_row", "doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("item_list").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, stable: bool = False) -> DataFrame:
    """The documents in which no window of an item occurs."""
    rows = tagged(docs, "decon-docs", stable)
    bad = contamination(rows, items, ["_row"]).where("n_hit > 0").select("_row")
    return rows.join(bad, "_row", "left_anti").select("_doc.*")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), {WORDS}) AS need, list_slice(w, i, i + {WORDS} - 1) AS t
         FROM b, unnest(range(1, greatest(len(w) - {WORDS} + 1, 1) + 1)) AS u(i) WHERE len(w) > 0),
grams AS (SELECT rid, need, i AS start, list_slice(w, i, i + need - 1) AS t
          FROM d, (SELECT DISTINCT need FROM wins), unnest(range(1, len(w) - need + 2)) AS u(i) WHERE len(w) >= need),
hits AS (SELECT g.rid, g.need, g.start, wins.item FROM grams g JOIN wins USING (need, t)),
places AS (SELECT DISTINCT rid, p FROM hits, unnest(range(start, start + need)) AS u(p)),
n AS (SELECT rid, count(*) AS n_hit FROM places GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)"""
