"""Secret scans by multipart credential linking, in DataFrame functions only.

Regular expressions find parts of credentials: assignments, access identifiers and hex keys (the base kinds,
always reported) and weak candidates: identifiers, mixed tokens and endpoints. An interval join pairs each
identifier with the secrets and endpoints in its scope, the ``SCOPE`` code points on either side of it, and a
weak candidate is reported only if its complement is there:

* a weak identifier, if a secret (of any kind) is in its scope;
* a weak token, if it is in the scope of an identifier (of any kind);
* an endpoint, if it is in the scope of an identifier that has a secret in its scope.

Weak candidates that overlap a base span are not considered, and a part is no complement of one it overlaps.

Positions come from splitting the text at the matches: the lengths of pieces and matches add up to starts, so
no Python sees the text. Texts leave the plan before the first shuffle; what is shuffled is a row per match.
The join meets in bins of ``BIN`` code points, so that a text with many parts gives work in proportion to its
length, and no pair of parts far from each other is formed.

Defined results: a null text is empty; an empty text has no spans; repeated rows and null doc_ids are rows of
their own; an empty table gives no rows; other columns are ignored (working columns start with an underscore).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.llm.common import table, tagged, written

SCOPE = 256
BIN = 1024


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def _names(*words: str) -> str:
    return "(" + "|".join(either_case(w) for w in words) + ")"


_IS = "[\"']?\\x20*[:=]\\x20*[\"']?"

#: (kind, pattern, group whose length counts, least length, whether it must mix digits and both cases).
#: Runs of hex digits and of identifier characters are maximal, so that a least length in the pattern keeps the same matches.
KINDS = [
    ("assign", _names("password", "passwd", "secret", "token", "api_?key") + _IS + "([A-Za-z0-9+/_.=-]+)", 2, 8, False),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16, False),
    ("hex", "[0-9a-f]{32,}", 0, 32, False),
    ("ident", _names("username", "user_?id", "user", "login", "account", "client_?id", "access_?key_?id") + _IS + "([A-Za-z0-9@._-]+)", 2, 3, False),
    ("mixed", "[A-Za-z0-9+/]{20,}={0,2}", 0, 20, True),
    ("endpoint", "(https?://[^\\x20\\x09-\\x0D\"'<>]+|" + _names("host", "endpoint", "server") + _IS + "[A-Za-z0-9._:-]{4,})", 0, 4, False),
]
BASE = 3
IDENTIFIERS, SECRETS, ENDPOINTS = (1, 3), (0, 2, 4), (5,)


def _sized(mixed: bool):
    fit = lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]") if mixed else F.lit(True)
    return lambda x: F.struct(F.char_length(x).alias("len"), fit(x).alias("fit"))


def _matches(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row (keep, kind, i, gap, len, ok) for each match, and one with kind -1 for each row of df (_text)."""
    found = df.select(*keep, "_text", *(F.regexp_extract_all("_text", F.lit(p), 0).alias(f"_m{k}") for k, (_, p, *_) in enumerate(KINDS)))
    some = {k: F.size(f"_m{k}") > 0 for k in range(len(KINDS))}
    none_int = F.array().cast("array<int>")
    lists = []
    for k, (_, p, group, least, mixed) in enumerate(KINDS):
        gaps = F.when(some[k], F.transform(F.split("_text", p, -1), F.char_length)).otherwise(none_int)
        sizes = F.transform(F.regexp_extract_all("_text", F.lit(p), group) if group else F.col(f"_m{k}"), F.char_length)
        lists += [gaps.alias(f"_g{k}"), F.when(some[k], sizes).otherwise(none_int).alias(f"_s{k}")]
        lists.append(F.transform(f"_m{k}", _sized(mixed)).alias(f"_l{k}"))
    found = found.select(*keep, *lists)

    def rows(k: int) -> Column:
        zipped = F.arrays_zip(F.col(f"_g{k}").alias("gap"), F.col(f"_s{k}").alias("size"), F.col(f"_l{k}").alias("m"))
        each = lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["m"]["len"].alias("len"), ((x["size"] >= KINDS[k][3]) & x["m"]["fit"]).alias("ok"))
        return F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), each)

    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("ok")))
    return found.select(*keep, F.explode(F.concat(mark, *(rows(k) for k in range(len(KINDS))))).alias("_r")).select(*keep, "_r.*")


def find_parts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, kind, start, end) of every part; kind -1 marks the row itself. ``keep`` must tell rows apart."""
    rows = _matches(df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")), keep)
    till = Window.partitionBy(*keep, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(till))
    return placed.where("ok").select(*keep, "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _bins(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / BIN), F.floor((hi - 1) / BIN))


def _meet(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of intervals [lo, hi) of one key that overlap, each once: in the later of their first bins."""
    x = a.withColumn("bin", F.explode(_bins(F.col("a_lo"), F.col("a_hi"))))
    y = b.withColumn("bin", F.explode(_bins(F.col("b_lo"), F.col("b_hi"))))
    pairs = x.join(y, [key, "bin"]).where("a_lo < b_hi and b_lo < a_hi")
    return pairs.where(F.col("bin") == F.floor(F.greatest("a_lo", "b_lo") / BIN)).drop("bin")


def _side(df: DataFrame, key: str, s: str, around: int = 0) -> DataFrame:
    return df.select(key, (F.col("start") - around).alias(f"{s}_lo"), (F.col("end") + around).alias(f"{s}_hi"), *(F.col(c).alias(f"{s}_{c}") for c in ("kind", "start", "end")))


def link(parts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(links, reported): pairs (key, a_* identifier, b_* secret or endpoint), and the weak spans that are reported."""
    real = parts.where("kind >= 0")
    base, weak = real.where(F.col("kind") < BASE), real.where(F.col("kind") >= BASE)
    covered = _meet(_side(base, key, "a"), _side(weak, key, "b"), key).select(key, F.col("b_kind").alias("kind"), F.col("b_start").alias("start")).distinct()
    usable = base.unionByName(weak.join(covered, [key, "kind", "start"], "left_anti"))
    ids, others = usable.where(F.col("kind").isin(*IDENTIFIERS)), usable.where(F.col("kind").isin(*SECRETS, *ENDPOINTS))
    links = _meet(_side(ids, key, "a", SCOPE), _side(others, key, "b"), key).where("b_start >= a_end or b_end <= a_start")
    to_secret = links.where(F.col("b_kind").isin(*SECRETS))
    a, b = [[key, *(F.col(f"{s}_{c}").alias(c) for c in ("kind", "start", "end"))] for s in "ab"]
    with_secret = to_secret.select(key, "a_kind", "a_start").distinct()
    ends = links.where(F.col("b_kind").isin(*ENDPOINTS)).join(with_secret, [key, "a_kind", "a_start"], "left_semi")
    said = reduce(DataFrame.unionByName, [to_secret.select(*a), to_secret.select(*b), ends.select(*b)])
    return links, said.where(F.col("kind") >= BASE).distinct()


def spans_of(df: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(links, all reported spans with the -1 marks); ``keep[0]`` must tell rows apart."""
    parts = written(find_parts(df, text, keep), "secret-parts")
    links, said = link(parts, keep[0])
    rest = parts.where(F.col("kind") < BASE)
    # the other kept columns of a weak span come back with its part
    weak = parts.where(F.col("kind") >= BASE).join(said.drop("end"), [keep[0], "kind", "start"], "left_semi")
    return links, rest.unionByName(weak)


def _digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in KINDS))
    text = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def op3_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    links, spans = spans_of(docs, "text", ["_row", "doc_id"])
    n_links = links.groupBy("_row").agg(F.count("*").alias("n_links"))
    lists = spans.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end")))).alias("_s"))
    count = lambda k: F.size(F.filter("_s", lambda x: x["kind"] == k)).cast("long")
    return lists.join(n_links, "_row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_digest(F.filter("_s", lambda x: x["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col("_s")).alias("spans"), F.size(F.filter("_s", lambda x: x["kind"] >= BASE)).cast("long").alias("n_weak"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", stable: bool = False) -> DataFrame:
    """The documents with every reported span replaced by ``mark`` (overlapping or touching spans by one)."""
    rows = tagged(docs, "secret-rows", stable)
    _, spans = spans_of(rows, "text", ["_row"])
    lists = spans.where("kind >= 0").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    # merged[-1] is the open interval; each step extends it or starts the next
    merged = F.aggregate(
        "_s", F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    hit = lists.select("_row", merged.alias("_s"))
    # the pieces between the spans: [0, s1), [e1, s2), ..., [en, end)
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform("_s", lambda x: x["end"]))
    tills = F.concat(F.transform("_s", lambda x: x["start"]), F.array(F.char_length("text").cast("long")))
    joined = rows.join(hit, "_row", "left").withColumn("_p", F.when(F.col("_s").isNotNull(), F.arrays_zip(froms.alias("a"), tills.alias("b"))))
    chars = F.split("text", "")
    text = F.array_join(F.transform("_p", lambda p: F.array_join(F.slice(F.col("_c"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "")), mark)
    # a generator keeps the optimizer from splitting the text again for every piece
    joined = joined.withColumn("_c", F.explode(F.array(F.when(F.col("_p").isNotNull(), chars))))
    return joined.select(F.when(F.col("_p").isNotNull(), F.col("_doc").withField("text", text)).otherwise(F.col("_doc")).alias("_doc")).select("_doc.*")


def _oracle() -> str:
    """The same by DuckDB: starts as sums of lengths, and the links by plain interval conditions."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT rid, {k} AS kind, t, string_split_regex(t, {quote(p)}) AS g, regexp_extract_all(t, {quote(p)}, 0) AS m, regexp_extract_all(t, {quote(p)}, {group}) AS v, {least} AS least, {str(mixed).lower()} AS mixed FROM d"
        for k, (_, p, group, least, mixed) in enumerate(KINDS)
    )
    names = "[" + ", ".join(f"'{k}'" for k, *_ in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
e AS (SELECT rid, kind, least, mixed, i, length(g[i]) AS gap, length(m[i]) AS len, m[i] AS s, length(v[i]) AS size
      FROM k, unnest(range(1, len(m) + 1)) AS u(i)),
p AS (SELECT *, sum(gap + len) OVER (PARTITION BY rid, kind ORDER BY i) AS hi FROM e),
parts AS (SELECT rid, kind, CAST(hi - len AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM p
          WHERE size >= least AND (NOT mixed OR (regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]')))),
usable AS (SELECT * FROM parts w WHERE kind < {BASE} OR NOT EXISTS (
           SELECT 1 FROM parts b WHERE b.rid = w.rid AND b.kind < {BASE} AND b.lo < w.hi AND w.lo < b.hi)),
links AS (SELECT a.rid, a.kind AS ak, a.lo AS alo, a.hi AS ahi, b.kind AS bk, b.lo AS blo, b.hi AS bhi FROM usable a JOIN usable b ON a.rid = b.rid
          WHERE a.kind IN {IDENTIFIERS} AND b.kind IN (0, 2, 4, 5) AND a.lo - {SCOPE} < b.hi AND b.lo < a.hi + {SCOPE} AND (b.lo >= a.hi OR b.hi <= a.lo)),
said AS (SELECT rid, ak AS kind, alo AS lo, ahi AS hi FROM links WHERE bk <> 5
         UNION SELECT rid, bk, blo, bhi FROM links WHERE bk <> 5
         UNION SELECT l.rid, l.bk, l.blo, l.bhi FROM links l WHERE l.bk = 5 AND EXISTS (
               SELECT 1 FROM links s WHERE s.rid = l.rid AND s.ak = l.ak AND s.alo = l.alo AND s.bk <> 5)),
spans AS (SELECT * FROM parts WHERE kind < {BASE} UNION ALL SELECT * FROM said WHERE kind >= {BASE}),
agg AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        count(*) FILTER (kind >= {BASE}) AS n_weak,
        string_agg({names}[kind + 1] || ':' || lo || ':' || hi, ',' ORDER BY lo, kind) FILTER (kind < {BASE}) AS base,
        string_agg({names}[kind + 1] || ':' || lo || ':' || hi, ',' ORDER BY lo, kind) AS spans FROM spans GROUP BY rid),
n AS (SELECT rid, count(*) AS n_links FROM links GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_weak, 0) AS n_weak, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN agg USING (rid) LEFT JOIN n USING (rid)"""


ORACLE = _oracle()
