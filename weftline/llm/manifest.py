"""Merkle manifest of a dataset: a tree of digests for each source, one tree over their roots, and a proof for every row.

Ranks come from histograms of doc_id's digits (``BITS`` bits each): counts are summed from the finest prefix to the
source, and the counts of smaller siblings are added on the way back, so that nothing is sorted as a whole and every
window holds the children of one prefix. A rank's digits in base ``FANOUT`` are the key of its node in the trie; nodes
that share all but their last ``BLOCK`` digits are reduced by one task, longest keys first, and so on upwards. Proofs go
the other way: a block's path to the root comes to the block's rows once and is continued for each.

Defined results: a null field is ``-``; a null source comes first, as does a null doc_id in its source; rows of equal
source and doc_id follow in order of their digests, and equal rows have neighbouring ranks and proofs of their own; a
null doc_id is never tampered with; a single row's digest is its source's root, and a single source's that of the
dataset; without any siblings the proof is the digest of nothing; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded, crc_mod, discard, table, written

FANOUT = 3
BLOCK = 7  # digits of a block: at most FANOUT ** BLOCK nodes meet in a task
BITS = 11  # bits of a digit of doc_id
WIDE = 1 << 16  # different rows of one lowest prefix from which their digests' digits count too
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NULL = -(1 << 62)  # the digit of a null doc_id: below all others


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


# ---- leaves ----------------------------------------------------------------------------------


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, or of one with another text."""
    return F.sha2(F.concat(*(_field(text if text is not None and f == "text" else F.col(f)) for f in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, fake, m): the different rows and how many there are of each. ``grp`` is the source, with ``=``
    before it, or empty; ``fake`` the digest of the tampered row where that is another."""
    changed = (crc_mod(F.col("doc_id"), 2) == 0) & F.col("text").contains("\n")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf()).alias("leaf"),
        F.when(changed, F.unhex(leaf(F.replace("text", F.lit("\n"), F.lit(""))))).alias("fake"),
    )
    return rows.groupBy("grp", "doc_id", "leaf", "fake").agg(F.count(F.lit(1)).alias("m"))


# ---- ranks -----------------------------------------------------------------------------------


def _prefix(k: int) -> Column:
    return F.coalesce(F.shiftright("doc_id", k), F.lit(_NULL))


def ranked(rows: DataFrame, bits: int = BITS, wide: int = WIDE) -> DataFrame:
    """Leaves with ``rank``, their place in their source, and ``n``, the source's rows; one row for each document."""
    shifts = list(range(bits, 64, bits))[::-1]
    names = [f"d{k}" for k in shifts]
    rows = rows.select("*", *(_prefix(k).alias(f"d{k}") for k in shifts))
    last = names[-1]
    many = rows.groupBy("grp", last).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > wide).select("grp", last, F.lit(True).alias("wide"))
    if many.head() is not None:  # so many rows share their doc_ids: go on with the id itself and the digest's digits
        rows = rows.join(many, ["grp", last], "left")
        digits = F.conv(F.substring(F.hex("leaf"), 1, 4), 16, 10).cast("long")
        for name, value in (("id", _prefix(0)), ("h", digits)):
            rows = rows.withColumn(name, F.when(F.col("wide"), value).otherwise(0))
        names += ["id", "h"]
        shared = 1  # the prefixes before them are parts of the id no more
    else:
        shared = 0
    keys = [["grp"]] + [["grp", name] for name in names]
    if shared:
        keys[-2], keys[-1] = ["grp", last, "id"], ["grp", last, "id", "h"]
    up = [rows.groupBy(*dict.fromkeys(["grp", *names])).agg(F.sum("m").alias("n"))]
    for i in range(len(names) - 1, -1, -1):
        up.append(up[-1].groupBy("grp", *names[:i]).agg(F.sum("n").alias("n")))
    up.reverse()
    at = up[0].select("grp", F.lit(0).cast("long").alias("first"), F.col("n").alias("total"))
    for i, name in enumerate(names, 1):
        parent, own = keys[i - 1], keys[i]
        smaller = Window.partitionBy(*parent).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        level = up[i].select(*dict.fromkeys([*parent, *own]), F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("before"))
        at = level.join(at, parent).select(*own, (F.col("first") + F.col("before")).alias("first"), "total")
    own = keys[-1]
    smaller = Window.partitionBy(*own).orderBy("doc_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("m").over(smaller), F.lit(0))).join(at, own)
    start = F.col("first") + F.col("inner")
    # many equal rows become blocks before they become rows
    parts = placed.select("grp", F.col("total").alias("n"), start.alias("start"), "m", "doc_id", "leaf", "fake", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(1 << 12).cast("long"))).alias("part"))
    each = F.explode(F.sequence(F.col("part"), F.least(F.col("m") - 1, F.col("part") + ((1 << 12) - 1))))
    return parts.select("*", each.alias("i")).select("grp", "n", (F.col("start") + F.col("i")).alias("rank"), F.col("leaf").alias("hash"), "doc_id", "fake")


# ---- the trie --------------------------------------------------------------------------------

_NODE = "grp string, n bigint, rank bigint, hash binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, 4096)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


_ARROW_NODE = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("rank", pa.int64()), ("hash", pa.binary())])


def _levels(hashes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of a block, level by level."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def reduce_blocks(nodes: DataFrame, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """The nodes ``block`` levels up, or a group's root where it has fewer."""
    size = fanout**block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (grp, at), rows in itertools.groupby(_rows(batches), key=lambda r: (r[0], r[4])):
                rows = list(rows)
                n = rows[0][1]
                top = _levels([r[3].hex() for r in rows], min(block, height(n, fanout)), fanout)[-1]
                yield grp, -(-n // size), at, bytes.fromhex(top[0])

        yield from _batches(each(), _ARROW_NODE)

    dealt = nodes.select("grp", "n", "rank", "hash", F.expr(f"rank div {size}").alias("block"))
    return dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "rank").mapInArrow(run, _NODE)


_KIN = ("grp", "n", "rank", "hash", "block", "doc_id", "fake", "path", "top")


def _continued(batches: Iterator[pa.RecordBatch], fanout: int, block: int) -> Iterator[tuple]:
    """(row, path, top) of every node. A path holds, for each level upwards, the siblings before and those behind, and
    ``top`` its group's root. A block's own path comes before its nodes, as a row of rank -1."""
    for _, rows in itertools.groupby(_rows(batches), key=lambda r: (r[0], r[4])):
        head = next(rows)
        rows = list(rows)
        levels = _levels([r[3].hex() for r in rows], min(block, height(rows[0][1], fanout)), fanout)
        paths = [head[7]]
        for nodes in reversed(levels[:-1]):
            below = []
            for i in range(len(nodes)):
                a = i - i % fanout
                rest = paths[i // fanout]
                below.append(f"{''.join(nodes[a:i])},{''.join(nodes[i + 1 : a + fanout])}{';' if rest else ''}{rest}")
            paths = below
        for row, path in zip(rows, paths, strict=True):
            yield row, path, head[8]


def _with_paths(nodes: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """Nodes by block, behind the row of their block's path: (grp, rank, path, top) of ``above``."""
    lines = {"doc_id": "bigint", "fake": "binary"}
    own = [F.col(c) if c in nodes.columns else F.lit(None).cast(t).alias(c) for c, t in lines.items()]
    rows = nodes.select("grp", "n", "rank", "hash", F.expr(f"rank div {size}").alias("block"), *own, F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("top"))
    heads = above.select(
        "grp", F.lit(None).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("rank"), F.lit(None).cast("binary").alias("hash"), F.col("rank").alias("block"),
        *(F.lit(None).cast(t).alias(c) for c, t in lines.items()), "path", "top",
    )
    return rows.unionByName(heads).select(*_KIN).repartition("grp", "block").sortWithinPartitions("grp", "block", "rank")


def paths(nodes: DataFrame, above: DataFrame, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """(grp, rank, hash, path, top) of nodes, from those of the nodes ``block`` levels up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.string()), ("rank", pa.int64()), ("hash", pa.binary()), ("path", pa.string()), ("top", pa.binary())])
        yield from _batches(((r[0], r[2], r[3], path, top) for r, path, top in _continued(batches, fanout, block)), schema)

    return _with_paths(nodes, above, fanout**block).mapInArrow(run, "grp string, rank bigint, hash binary, path string, top binary")


def fold(own: str, path: str) -> str:
    """The root from a node's digest and the siblings on its path."""
    for level in path.split(";") if path else []:
        before, behind = level.split(",")
        own = digest(before + own + behind)
    return own


def proved(found: Iterable[tuple]) -> Iterator[tuple]:
    """(doc_id, leaf, subroot, proof_sha256, folded_root) of (row, path, top): every row is folded up its path, with its
    tampered digest where it has one, else with its own."""
    for row, path, top in found:
        own = row[3].hex()
        yield row[5], own, top.hex(), digest(path.translate(_SEPARATORS)), fold(own if row[6] is None else row[6].hex(), path)


def climb(nodes: DataFrame, fanout: int = FANOUT, block: int = BLOCK) -> list[DataFrame]:
    """Tables of nodes, each ``block`` levels above the one before, up to one root a group."""
    most, out = nodes.agg(F.max("n")).head()[0] or 0, [nodes]
    while most > 1:
        out.append(written(reduce_blocks(out[-1], fanout, block), "manifest"))
        most = -(-most // fanout**block)
    return out


def numbered(groups: DataFrame) -> DataFrame:
    """(grp, n, rank, hash) of the groups' roots in order of the groups: ranges of them, counted, and numbered within."""
    rows = groups.select("grp", "hash").repartitionByRange("grp").sortWithinPartitions("grp").select("grp", "hash", F.monotonically_increasing_id().alias("id"))
    rows = written(rows, "manifest-groups")
    part = F.shiftright("id", 33)
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
    firsts = counts.select("part", F.coalesce(F.sum("c").over(ranges), F.lit(0)).alias("first"))
    total = rows.count()
    placed = rows.withColumn("part", part).join(F.broadcast(firsts), "part")
    return placed.select(F.lit("").alias("grp"), F.lit(total).cast("long").alias("n"), (F.col("first") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("rank"), "hash", F.col("grp").alias("name"))


def manifest(docs: DataFrame, fanout: int = FANOUT, block: int = BLOCK, bits: int = BITS, wide: int = WIDE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    classes = written(leaves(docs), "manifest-leaves")
    rows = written(ranked(classes, bits, wide), "manifest-ranks")
    discard(classes)
    trees = climb(rows, fanout, block)
    sources = written(numbered(trees[-1]), "manifest-sources")
    crown = climb(sources, fanout, block)
    top = crown[-1].head()
    if top is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = bytes(top["hash"]).hex()
    above = crown[-1].select("grp", "rank", F.lit("").alias("path"), F.col("hash").alias("top"))
    for nodes in crown[-2::-1]:
        above = paths(nodes, above, fanout, block).select("grp", "rank", "path", "top")
    # a source's root continues its own path above
    above = sources.select("rank", "name", F.col("hash").alias("top")).join(above.select("rank", "path"), "rank").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("rank"), "path", "top")
    for nodes in trees[-2:0:-1]:
        above = paths(nodes, above, fanout, block).select("grp", "rank", "path", "top")
    if len(trees) == 1:  # no source has a second row
        above = above.select("grp", "rank", "path", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])
        yield from _batches(proved(_continued(batches, fanout, block)), schema)

    bounded(docs.sparkSession)
    out = _with_paths(rows, above, fanout**block).mapInArrow(run, "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


_SEPARATORS = {ord(","): None, ord(";"): None}


def op12_radix_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_SQL_FIELDS = " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in FIELDS)
_SQL_FAKE = _SQL_FIELDS.replace("text::VARCHAR", "replace(text, chr(10), '')::VARCHAR")

ORACLE = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, sha256({_SQL_FIELDS}) AS leaf, sha256({_SQL_FAKE}) AS other,
    list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c::BIGINT, x::BIGINT) ELSE xor(c::BIGINT >> 1, 3988292384 * (c::BIGINT & 1)) END) AS crc
  FROM documents
), numbered AS (
  SELECT doc_id, source, leaf, CASE WHEN xor(crc::BIGINT, 4294967295) % 2 = 0 THEN other ELSE leaf END AS fake,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), nodes AS (
  SELECT 0 AS lvl, source, n, idx, leaf AS hash FROM numbered
  UNION ALL
  SELECT lvl + 1, source, (n + {FANOUT - 1}) // {FANOUT}, idx // {FANOUT}, sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE n > 1
  GROUP BY lvl, source, n, idx // {FANOUT}
), runs AS (
  SELECT lvl, source, n, idx // {FANOUT} AS run, list(hash ORDER BY idx) AS hashes FROM nodes WHERE n > 1 GROUP BY ALL
), subroots AS (
  SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, n, idx, subroot AS hash FROM subroots
  UNION ALL
  SELECT lvl + 1, (n + {FANOUT - 1}) // {FANOUT}, idx // {FANOUT}, sha256(string_agg(hash, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, n, idx // {FANOUT}
), top_runs AS (
  SELECT lvl, n, idx // {FANOUT} AS run, list(hash ORDER BY idx) AS hashes FROM tops WHERE n > 1 GROUP BY ALL
), walk AS (
  SELECT doc_id, source, leaf, 0 AS lvl, n, idx, '' AS proof, fake AS own FROM numbered
  UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.lvl + 1, (w.n + {FANOUT - 1}) // {FANOUT}, w.idx // {FANOUT},
    w.proof || array_to_string(r.hashes[1:w.idx % {FANOUT}], '') || array_to_string(r.hashes[w.idx % {FANOUT} + 2:], ''),
    sha256(array_to_string(r.hashes[1:w.idx % {FANOUT}], '') || w.own || array_to_string(r.hashes[w.idx % {FANOUT} + 2:], ''))
  FROM walk w JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.lvl = w.lvl AND r.run = w.idx // {FANOUT} WHERE w.n > 1
), top_walk AS (
  SELECT w.doc_id, w.leaf, s.subroot, 0 AS lvl, s.n, s.idx, w.proof, w.own FROM walk w JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, (w.n + {FANOUT - 1}) // {FANOUT}, w.idx // {FANOUT},
    w.proof || array_to_string(r.hashes[1:w.idx % {FANOUT}], '') || array_to_string(r.hashes[w.idx % {FANOUT} + 2:], ''),
    sha256(array_to_string(r.hashes[1:w.idx % {FANOUT}], '') || w.own || array_to_string(r.hashes[w.idx % {FANOUT} + 2:], ''))
  FROM top_walk w JOIN top_runs r ON r.lvl = w.lvl AND r.run = w.idx // {FANOUT} WHERE w.n > 1
)
SELECT w.doc_id, w.leaf, w.subroot, t.hash AS root, sha256(w.proof) AS proof_sha256, w.own AS folded_root, w.own = t.hash AS verified
FROM top_walk w, tops t WHERE w.n = 1 AND t.n = 1
"""
