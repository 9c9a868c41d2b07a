"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector o is turned by a seeded random rotation; its code is the signs of the turned vector, packed, and
<o, q> is estimated for any q by <code, q'> / <code, o'>, with an error of at most
EPSILON * sqrt((1 - f^2) / f^2 / (dim - 1)) * |q|, f = <code, o'>, but for rare cases (Gao and Long, 2024).
A query is turned once and quantised to QUERY_BITS bits a component, by bit-planes, so that an estimate is a weighted
sum of popcounts of code & plane; what quantising can add is part of the bound.

Vectors are dealt over at most CLUSTERS clusters by the direction of their nearest centre, fitted on a bounded sample
(SAMPLE rows a centre, SAMPLE_BYTES at most), and a cluster's over blocks of some INDEX_ROWS by hash. The index is
written once: for each block a file of codes (packed bits, norm and f of each vector) and one of the original vectors.
Queries are dealt likewise. A vector x of a block, at most r away in direction from the centre c, has
<q, x> <= |q| |x| (<q / |q|, c> + r), so that a block's largest and smallest norms bound what it can give.

Each block of queries is first compared with the centres: the PROBE best estimates from a few blocks of each query's
nearest clusters are computed exactly, and the k-th best of them is the query's threshold. Then it meets the clusters
whose bounds reach a threshold, in jobs of consecutive blocks of TASK_BYTES of codes. A block that no query can use is
not read; in the others every vector whose upper bound reaches the threshold is reranked on the original components
in double precision, read from the files for these vectors alone where they are few, and thresholds rise as better ones
are found. No vector is shuffled; a job hands on no more than a query's best of its blocks. Estimates and bounds are of
unit vectors, whatever the norms. Where directions have no clusters, nothing is skipped, and estimates are as many as pairs.

Equal vectors are one entry of the index: the k + 1 smallest ids of a vector stand for it, which is all that
any result can hold, and equal queries are searched once. So a vector with a third of the rows is no burden.

Defined results: rows whose vec_id is null, or whose vector is null, empty, zero or holds a null or non-finite
component, take no part; vectors meet those of their own dimension; equal (vec_id, vector) rows are one row; a
query's own id is never among its results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded, open_shared, table, work_dir, write_shared, written

EPSILON = 1.9
QUERY_BITS = 4
PROBE = 64
QUERY_ROWS, INDEX_ROWS = 512, 4096
CLUSTERS, SAMPLE, SAMPLE_BYTES, LLOYD = 1024, 64, 64 << 20, 6
PROBE_CLUSTERS, PROBE_BLOCKS = 2, 4  # of each query; of each cluster
TASK_BYTES = 4 << 20
DIMS = 1 << 16
SLACK = 1e-9  # more than bounds lose by rounding
SEED = 20240501
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix: the Q of a Gaussian matrix, signs fixed by R."""
    if (dim, seed) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        _rotations[dim, seed] = q * np.sign(np.diag(r))
    return _rotations[dim, seed]


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms) of rows that are not zero; squares neither overflow nor vanish."""
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / most
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return x / norm, np.minimum(most * norm, np.finfo(float).max)[:, 0]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, norm, f) of the rows of x."""
    unit, norm = units(x)
    turned = unit @ rotation(x.shape[1])
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def _words(bits: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words, padded by zeros."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view(np.uint64)


class Queries:
    """Turned and quantised unit vectors: component i of q is low + step * (sum of 2^j at the j-th plane's bit i)."""

    def __init__(self, queries: np.ndarray) -> None:
        self.unit, self.norm = units(queries)
        turned = self.unit @ rotation(queries.shape[1])
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-300)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [_words(np.packbits(whole >> j & 1, axis=1)) for j in range(QUERY_BITS)]
        self.total = self.low * queries.shape[1] + self.step * whole.sum(axis=1)


def estimates(bits: np.ndarray, f: np.ndarray, queries: Queries, rows: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products of unit vectors, their error bounds), queries by vectors."""
    codes = _words(bits)
    ones = np.bitwise_count(codes).sum(axis=1)
    step = queries.step[rows].astype(np.float32)[:, None]
    est = np.zeros((len(step), len(codes)), np.float32)
    for j, plane in enumerate(queries.planes):
        for w in range(codes.shape[1]):
            est += np.bitwise_count(codes[:, w] & plane[rows, w][:, None]) * np.float32(1 << j)
    est *= 2 * step
    # signs are twice the bits less one
    est += 2 * queries.low[rows].astype(np.float32)[:, None] * ones.astype(np.float32) - queries.total[rows].astype(np.float32)[:, None]
    est *= (1 / (f * np.sqrt(dim))).astype(np.float32)
    spread = np.sqrt(np.maximum(1 - f * f, 0) / max(dim - 1, 1)) / f
    rounding = queries.step[rows][:, None] / np.sqrt(12) / f[None, :]
    return est, (EPSILON * np.hypot(spread[None, :], rounding)).astype(np.float32) + np.float32(1e-6)


# ---- blocks in the shared folder -------------------------------------------------------------


def _load(path: str) -> bytes:
    store, at = open_shared(path)
    with store.open_input_file(at) as f:
        return f.read()


class Block:
    """A block's files: ids of vectors, codes and scalars in one, originals in the other. The first has a head: how many
    vectors, their cluster, how far they are from its centre at most, and their smallest and largest norm."""

    HEAD = 5 * 8

    def __init__(self, folder: str, kind: str, dim: int, number: int) -> None:
        self.dim, self.at = dim, f"{folder}/{kind}-{dim}-{number}"
        store, path = open_shared(f"{self.at}.codes")
        with store.open_input_file(path) as f:
            raw = f.read(self.HEAD)
        self.n, self.cluster = map(int, np.frombuffer(raw, np.int64, 2))
        self.radius, self.least, self.most = np.frombuffer(raw, np.float64, 3, 16)

    def read(self) -> Block:
        raw, n = _load(f"{self.at}.codes"), self.n
        cells = np.frombuffer(raw, np.int64, 2 * n, self.HEAD)
        self.cls, self.first_id = cells[:n], cells[n:]
        scalars = np.frombuffer(raw, np.float64, 2 * n, self.HEAD + 16 * n)
        self.norm, self.f = scalars[:n], scalars[n:]
        self.bits = np.frombuffer(raw[self.HEAD + 32 * n :], np.uint8).reshape(n, -(-self.dim // 8))
        return self

    @staticmethod
    def write(folder: str, kind: str, dim: int, number: int, cluster: int, centre: np.ndarray, cls: np.ndarray, first_id: np.ndarray, v: np.ndarray) -> tuple[float, float, float]:
        """(distance, smallest norm, largest norm)."""
        if not len(cls):  # a number that the hash gave to nobody
            write_shared(f"{folder}/{kind}-{dim}-{number}.codes", np.array([0, cluster], np.int64).tobytes() + np.zeros(3).tobytes())
            return 0.0, 0.0, 0.0
        bits, norm, f = encode(v)
        far = (float(np.linalg.norm(units(v)[0] - centre, axis=1).max()) + SLACK, float(norm.min()), float(norm.max()))
        parts = (np.array([len(cls), cluster], np.int64), np.array(far), cls.astype(np.int64), first_id.astype(np.int64), norm, f, bits)
        write_shared(f"{folder}/{kind}-{dim}-{number}.codes", b"".join(np.ascontiguousarray(p).tobytes() for p in parts))
        write_shared(f"{folder}/{kind}-{dim}-{number}.vectors", np.ascontiguousarray(v, np.float64).tobytes())
        return far

    def vectors(self, rows: np.ndarray | None = None) -> np.ndarray:
        """The originals of some rows, in order; the whole file is read where they are many."""
        store, path = open_shared(f"{self.at}.vectors")
        with store.open_input_file(path) as f:
            if rows is None or 8 * len(rows) > self.n:
                out = np.frombuffer(f.read(), np.float64).reshape(self.n, self.dim)
                return out if rows is None else out[rows]
            size = 8 * self.dim
            return np.frombuffer(b"".join(f.read_at(size, int(r) * size) for r in rows), np.float64).reshape(len(rows), self.dim)


def _exact(queries: np.ndarray, x: Block, qi: np.ndarray, xi: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    rows, at = np.unique(xi, return_inverse=True)
    v, out = x.vectors(rows), np.empty(len(qi))
    for a in range(0, len(qi), step):
        out[a : a + step] = np.einsum("ij,ij->i", queries[qi[a : a + step]], v[at[a : a + step]])
    return out


def _slices(n: int, width: int) -> Iterator[slice]:
    step = max(1, (1 << 22) // max(width, 1))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def probe(q: Block, queries: Queries, x: Block, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, vector rows, estimates): each query's ``most`` best estimates but its own vector's."""
    out = []
    for part in _slices(q.n, x.n):
        rows = np.arange(part.start, part.stop)
        est = estimates(x.bits, x.f, queries, rows, x.dim)[0] * x.norm
        est[q.cls[rows][:, None] == x.cls[None, :]] = -np.inf
        k = min(most, x.n)
        top = np.argpartition(est, x.n - k, axis=1)[:, x.n - k :]
        value = np.take_along_axis(est, top, axis=1)
        i = np.repeat(rows, k)
        fine = value.ravel() > -np.inf
        out.append((i[fine], top.ravel()[fine], value.ravel()[fine]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def rerank(q: Block, vectors: np.ndarray, queries: Queries, x: Block, asked: np.ndarray, threshold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, vector rows, exact scores): of the queries ``asked``, the k + 1 best of the vectors whose upper bounds reach
    their thresholds."""
    out = []
    for part in _slices(len(asked), x.n):
        rows = asked[part]
        est, err = estimates(x.bits, x.f, queries, rows, x.dim)
        least = (threshold[rows] / queries.norm[rows])[:, None]
        qi, xi = np.nonzero(((est + err) * x.norm >= least) & (q.cls[rows][:, None] != x.cls[None, :]))
        qi = rows[qi]
        score = _exact(vectors, x, qi, xi)
        keep = score >= threshold[qi]
        qi, xi, score = qi[keep], xi[keep], score[keep]
        order = np.lexsort((x.first_id[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi, "left") <= k
        out.append((qi[keep], xi[keep], score[keep]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


# ---- clusters of directions ------------------------------------------------------------------


def nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre."""
    half, out = (centres * centres).sum(axis=1) / 2, np.empty(len(unit), np.int64)
    for rows in _slices(len(unit), len(centres)):
        out[rows] = np.argmax(unit[rows] @ centres.T - half, axis=1)
    return out


def fitted(unit: np.ndarray, n: int) -> np.ndarray:
    """At most n centres by Lloyd's iterations, from rows drawn by a seed; those that lose all rows stay where they are."""
    centres = unit[np.sort(np.random.default_rng(SEED).permutation(len(unit))[:n])]
    for _ in range(LLOYD if n > 1 else 1):
        at = nearest(unit, centres)
        count = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, unit)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


_centres: dict[str, np.ndarray] = {}


def centres_of(folder: str, dim: int) -> np.ndarray:
    path = f"{folder}/centres-{dim}"
    if path not in _centres:
        if len(_centres) >= 4:  # a worker meets few dimensions at a time
            _centres.clear()
        try:
            _centres[path] = np.frombuffer(_load(path), np.float64).reshape(-1, dim)
        except FileNotFoundError:  # no row of this dimension was drawn
            _centres[path] = np.zeros((1, dim))
    return _centres[path]


def bounds(dots: np.ndarray, radius, least, most) -> np.ndarray:
    """What a unit query can get at most from vectors so far from a centre and of such norms."""
    reach = dots + radius
    return np.where(reach > 0, reach * most, reach * least)


class Clusters:
    """What the blocks of each cluster have in common: first block, number of blocks, distance and norms."""

    def __init__(self, folder: str, dim: int) -> None:
        rows = np.frombuffer(_load(f"{folder}/clusters-{dim}"), np.float64).reshape(-1, 6)
        self.number, self.first, self.blocks = (rows[:, i].astype(np.int64) for i in range(3))
        self.radius, self.least, self.most = rows[:, 3], rows[:, 4], rows[:, 5]
        self.centre = centres_of(folder, dim)[self.number]


def _low(path: str) -> np.ndarray:
    return np.frombuffer(_load(path), np.float64).copy()


def plan(folder: str, dim: int, number: int, k: int) -> list[tuple[int, int]]:
    """Writes the thresholds of a block of queries; the ranges (first, last) of index blocks that it must meet."""
    q, clusters, probes = Block(folder, "q", dim, number).read(), Clusters(folder, dim), max(PROBE, 2 * (k + 1))
    vectors = q.vectors()
    queries, best = Queries(vectors), Best(probes)
    dots = queries.unit @ clusters.centre.T
    m = min(PROBE_CLUSTERS, dots.shape[1])
    likely = np.unique(np.argpartition(-bounds(dots, 0, clusters.least, clusters.most), m - 1, axis=1)[:, :m])
    for c in likely:
        for b in range(clusters.first[c], clusters.first[c] + min(clusters.blocks[c], PROBE_BLOCKS)):
            x = Block(folder, "x", dim, b).read()
            if x.n:
                qi, xi, est = probe(q, queries, x, probes)
                best.add(qi, est, np.full(len(qi), b), xi)
    qi, _, xb, xi = best.rows
    score = np.empty(len(qi))
    for b in np.unique(xb):
        at = xb == b
        score[at] = _exact(vectors, Block(folder, "x", dim, b), qi[at], xi[at])
    found = Best(k)
    found.add(qi, score, xi, xb)
    # the k-th best of some is no more than the k-th best of all; none where there are fewer
    low = found.kth(np.full(q.n, -np.inf))
    write_shared(f"{folder}/q-{dim}-{number}.low", low.tobytes())
    reached = (bounds(dots, clusters.radius, clusters.least, clusters.most) >= (low / queries.norm)[:, None]).any(axis=0)
    most, out = max(1, TASK_BYTES // (INDEX_ROWS * (-(-dim // 8) + 32))), []
    for c in np.flatnonzero(reached):
        first, last = int(clusters.first[c]), int(clusters.first[c] + clusters.blocks[c]) - 1
        if out and out[-1][1] + 1 == first and last - out[-1][0] < most:
            out[-1] = (out[-1][0], last)
        else:
            out += [(a, min(a + most - 1, last)) for a in range(first, last + 1, most)]
    return out


def met(folder: str, dim: int, number: int, first: int, last: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(class of the query, class of the vector, score) of the best that blocks first to last have for a block of queries, and
    how many blocks were read."""
    q, low, centres = Block(folder, "q", dim, number).read(), _low(f"{folder}/q-{dim}-{number}.low"), centres_of(folder, dim)
    vectors = q.vectors()
    queries, best, read = Queries(vectors), Best(k + 1), 0
    for b in range(first, last + 1):
        x = Block(folder, "x", dim, b)
        asked = np.flatnonzero(bounds(queries.unit @ centres[x.cluster], x.radius, x.least, x.most) >= low / queries.norm)
        if not (x.n and len(asked)):
            continue
        x.read()
        read += 1
        qi, xi, score = rerank(q, vectors, queries, x, asked, low, k)
        best.add(qi, score, x.first_id[xi], x.cls[xi])
        low = best.kth(low, k)
    qi, score, _, cls = best.rows
    return q.cls[qi], cls, score, read


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    # NaN and the infinities fail x - x = 0
    fine = F.forall("v", lambda x: x.isNotNull() & F.coalesce(x - x == 0, F.lit(False))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine).distinct().withColumn("dim", F.size("v"))


def _sent(sizes: DataFrame) -> DataFrame:
    """Broadcast while there are few dimensions; a row for each."""
    return F.broadcast(sizes) if sizes.limit(DIMS + 1).count() <= DIMS else sizes


class Best:
    """The ``most`` rows of highest value of each query, ties to the smaller third column, of all that were added."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.rows = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, qi: np.ndarray, value: np.ndarray, tie: np.ndarray, more: np.ndarray) -> None:
        qi, value, tie, more = (np.concatenate(p) for p in zip(self.rows, (qi, value, tie, more), strict=True))
        order = np.lexsort((tie, -value, qi))
        qi = qi[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi, "left") < self.most
        self.rows = (qi[keep], value[order][keep], tie[order][keep], more[order][keep])

    def kth(self, low: np.ndarray, k: int | None = None) -> np.ndarray:
        """Thresholds raised to the k-th value (the last that is kept) of the queries that have so many."""
        qi, value = self.rows[:2]
        at = np.flatnonzero(np.arange(len(qi)) - np.searchsorted(qi, qi, "left") == (k or self.most) - 1)
        out = low.copy()
        at = at[np.isfinite(value[at])]
        out[qi[at]] = np.maximum(low[qi[at]], value[at] - 1e-12 * (1 + np.abs(value[at])))
        return out


def _written_blocks(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """Writes the files of (dim, block, cluster, cls, first_id, v) by block; (dim, block, cluster, radius, least, most) of each."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls", ignore_index=True)
        dim, block, cluster = (int(pdf[c].iloc[0]) for c in ("dim", "block", "cluster"))
        centre = centres_of(folder, dim)[cluster]
        far = Block.write(folder, kind, dim, block, cluster, centre, pdf["cls"].to_numpy(), pdf["first_id"].to_numpy(), np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame([(dim, block, cluster, *far)], columns=["dim", "block", "cluster", "radius", "least", "most"])

    return written(rows.groupBy("dim", "block").applyInPandas(write, "dim int, block bigint, cluster int, radius double, least double, most double"), "ann-written")


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows of (dim, cluster) with the block that each belongs to; a cluster's blocks have consecutive numbers."""
    counts = rows.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / size).alias("blocks"))
    before = F.sum("blocks").over(Window.partitionBy("dim").orderBy("cluster")) - F.col("blocks")  # CLUSTERS rows at most
    return rows.join(_sent(counts.select("dim", "cluster", "blocks", before.alias("first"))), ["dim", "cluster"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("v"), "blocks"))


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    bounded(spark)
    rows = usable(vectors)
    by_id = Window.partitionBy("v").orderBy("vec_id")
    # the number of copies in a group is cut before the window's sort: only the k + 1 smallest ids remain
    ids = rows.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    classes = written(ids.groupBy("v", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cls", F.monotonically_increasing_id()), "ann-classes")
    asked = written(rows.where(is_query(F.col("vec_id"))).join(classes.select("v", "cls"), "v").select("vec_id", "cls"), "ann-queries")
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n")).join(asked.join(classes, "cls").select("dim").distinct(), "dim", "left_semi")
    centres = F.least(F.lit(CLUSTERS), F.ceil(F.col("n") / INDEX_ROWS))
    drawn = F.greatest("centres", F.least(SAMPLE * F.col("centres"), F.floor(F.lit(SAMPLE_BYTES) / (8 * F.col("dim")))))
    sizes = sizes.withColumn("centres", centres).withColumn("drawn", drawn)
    folder = work_dir(spark, "ann-blocks")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        unit = units(np.stack(pdf.sort_values("h")["v"].to_numpy()).astype(float))[0]
        write_shared(f"{folder}/centres-{dim}", np.ascontiguousarray(fitted(unit, int(pdf["centres"].iloc[0]))).tobytes())
        return pdf[["dim"]][:1]

    base = classes.select("cls", F.col("ids")[0].alias("first_id"), "v", "dim").join(_sent(sizes), "dim")
    # a hash other than that which deals rows into blocks
    sample = base.withColumn("h", F.xxhash64(F.lit(SEED), "v")).where(F.pmod("h", "n") < F.col("drawn"))
    written(sample.groupBy("dim").applyInPandas(fit, "dim int"), "ann-fitted")

    @F.pandas_udf("int")
    def cluster(dims: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(dims), np.int32)
        for dim in dims.unique():
            at = np.flatnonzero(dims == dim)
            out[at] = nearest(units(np.stack(v.iloc[at].to_numpy()).astype(float))[0], centres_of(folder, int(dim)))
        return pd.Series(out)

    placed = written(base.select("cls", "first_id", "v", "dim", cluster("dim", "v").alias("cluster")), "ann-placed")
    xs = _written_blocks(_dealt(placed, INDEX_ROWS), folder, "x")

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = pdf.sort_values("cluster")[["cluster", "first", "blocks", "radius", "least", "most"]]
        write_shared(f"{folder}/clusters-{int(pdf['dim'].iloc[0])}", np.ascontiguousarray(columns.to_numpy(float)).tobytes())
        return pdf[["dim"]][:1]

    groups = xs.groupBy("dim", "cluster").agg(F.min("block").alias("first"), (F.max("block") - F.min("block") + 1).alias("blocks"), F.max("radius").alias("radius"), F.min("least").alias("least"), F.max("most").alias("most"))
    written(groups.groupBy("dim").applyInPandas(share, "dim int"), "ann-clusters")
    numbers = groups.select("dim", "cluster", F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("block"))

    def leave_empty(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, none = int(pdf["dim"].iloc[0]), np.zeros(0)
        for block, of in zip(pdf["block"], pdf["cluster"], strict=True):
            Block.write(folder, "x", dim, int(block), int(of), none, none, none, none)
        return pdf[["dim"]][:1]

    written(numbers.join(xs, ["dim", "block"], "left_anti").groupBy("dim").applyInPandas(leave_empty, "dim int"), "ann-empty")
    qs = _written_blocks(_dealt(placed.join(asked.select("cls").distinct(), "cls", "left_semi"), QUERY_ROWS), folder, "q").select("dim", F.col("block").alias("qb"))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, qb in zip(*(batch.column(c).to_pylist() for c in ("dim", "qb")), strict=True):
                ranges = plan(folder, dim, qb, k)
                first, last = ([r[i] for r in ranges] for i in (0, 1))
                yield pa.record_batch([pa.array([dim] * len(ranges), pa.int32()), pa.array([qb] * len(ranges), pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["dim", "qb", "first", "last"])

    n_blocks = qs.count()
    if not n_blocks:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    jobs = written(qs.repartition(min(n_blocks, 1 << 16)).mapInArrow(planned, "dim int, qb bigint, first bigint, last bigint"), "ann-jobs")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in zip(*(batch.column(c).to_pylist() for c in ("dim", "qb", "first", "last")), strict=True):
                q, x, score, _ = met(folder, *job, k)
                yield pa.record_batch([pa.array(q), pa.array(x), pa.array(score)], names=["q", "x", "score"])

    near = jobs.repartition(max(1, min(jobs.count(), 1 << 16))).mapInArrow(searched, "q bigint, x bigint, score double")
    first = classes.select("cls", F.col("ids")[0].alias("first_id"))
    # members of a query's class find its own vector exactly, whatever the estimates said
    own = classes.join(asked.select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("q"), F.col("cls").alias("x"), F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b).alias("score"))
    near = near.unionByName(own)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first_id")
    near = near.join(first.withColumnRenamed("cls", "x"), "x").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).select("q", "x", "score")
    members = near.join(classes.select(F.col("cls").alias("x"), F.explode("ids").alias("vec_id")), "x")
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("list"))
    out = asked.withColumnRenamed("vec_id", "query_id").distinct().join(members, F.col("cls") == F.col("q"))
    own_id = F.filter("list", lambda m: m["vec_id"] != F.col("query_id"))
    return out.select("query_id", F.posexplode(F.slice(own_id, 1, k)).alias("i", "m")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("m.vec_id"), F.col("m.score"))


def op1_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
