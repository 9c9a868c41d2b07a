"""Language-model scoring by deleted interpolation.

An n-gram model (ORDER words) over words (A-Z lowered) and one end token a text; a text begins behind ends. The
bigram part is P2(w | h) = l2 c(h w) / c(h) + l1 c(w) / N + l0 / (V + 1), and each higher order mixes its own
estimate with the one below, Pk(w | h) = m c(h w) / c(h) + (1 - m) Pk-1(w | h'). The weights go by the bucket of the
context's frequency c(h) (powers of two) and are learned by expectation maximisation on held-out counts: the
training texts are dealt by doc_id into FOLDS folds, and each fold's tokens are estimated from the counts of all other
folds, so every training text is held out once, with all other texts of its fold, wherever they lie.

Counts cover all training texts. Texts are packed into batches, which are written once; a batch asks for the counts
of its distinct n-grams, in a blob per bucket of keys, with its own training counts by fold; a bucket adds them up and
answers each batch. So a frequent n-gram is one entry per batch, not one per occurrence, and what is shuffled grows
with the corpus. There is a bucket for every BUCKET_BYTES of text. Words are told apart by 64 bits of a hash, longer
n-grams by as many as let at most one in 2^20 share its key with another, at every size. The weights are fitted on the driver from histograms of the estimates' ratios, of bounded size; they
and the scores do not depend on how rows are partitioned or batched.

Defined results: a null text is empty, and scores its end token; a null doc_id is learned from and not held
out; rows that repeat are texts of their own; with no training text every word has probability 1 / (V + 1) = 1; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded, crc_mod, discard, from_gaps, gaps, mix, mix_int, pack, pieces, small, table, trim, unpack, utf8, word_hashes, written

ORDER = 2  # of the query; trigrams ask for more disk than the check tool grants
CHUNK = 8 << 20
BUCKET_BYTES = 8 << 20
FOLDS = 4
LEVELS = 40  # buckets of context frequency
GRID, FINE, BELOW = 320, 4, 40  # bins of the ratios, per doubling; doublings below 1
ITERATIONS = 40
FLOOR = 1e-6
END = mix_int(0x656E64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
SPARE_BITS = 20


# ---- a batch's n-grams -----------------------------------------------------------------------


def _chained(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _MUL + token)


class Batch:
    """The tokens of some texts as places among the batch's distinct n-grams.

    Of each order, from words on: the sorted ``keys``, each token's ``gram``, and for each distinct n-gram its
    ``context`` (all but its last word, among those of the order below; -1 where a text begins).
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, order: int, bits: int) -> None:
        narrow = np.uint64((1 << 64) - (1 << (64 - bits)))
        h, w = word_hashes(raw, off)
        self.lengths = np.diff(w) + 1
        self.off = np.concatenate([[0], np.cumsum(self.lengths)])
        tokens = np.empty(int(self.off[-1]), np.uint64)
        last = self.off[1:] - 1
        mask = np.ones(len(tokens), dtype=bool)
        mask[last] = False
        tokens[mask], tokens[last] = h, np.uint64(END)
        begins = self.off[:-1]
        self.of = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        keys, at = np.unique(tokens, return_inverse=True)
        self.keys, self.gram, self.context = [keys], [at.astype(np.int32)], [np.full(len(keys), -1, np.int32)]
        self.end = int(np.searchsorted(keys, np.uint64(END)))
        chain, pad = tokens, np.array([END], np.uint64)
        for _ in range(1, order):
            back = np.empty_like(chain)
            back[1:] = chain[:-1]
            back[begins] = pad  # a text begins behind ends
            chain, pad = _chained(back, tokens), _chained(pad, np.array([END], np.uint64))
            keys, at = np.unique(chain & narrow, return_inverse=True)
            some = np.empty(len(keys), np.int64)  # a place of each
            some[at] = np.arange(len(at))
            context = self.gram[-1][np.maximum(some - 1, 0)]
            context[np.isin(some, begins)] = -1
            self.keys.append(keys)
            self.gram.append(at.astype(np.int32))
            self.context.append(context)

    def counts(self, k: int, chosen: np.ndarray) -> np.ndarray:
        """Of each distinct n-gram, within the chosen rows."""
        return np.bincount(self.gram[k][chosen[self.of]], minlength=len(self.keys[k]))


def _buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # sorted keys stay in order


def texts(docs: DataFrame) -> DataFrame:
    """(batch, bytes, blob): the rows, packed by batches of at most CHUNK bytes or one text; written once, so that a batch
    keeps its name and its rows whatever happens later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            for a, b in pieces(off, CHUNK):
                flags = [batch.column(c)[a:b].to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("train", "fold", "held_out")]
                ids = batch.column("doc_id")[a:b]
                known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                blob = pack(raw[off[a] : off[b]], off[a : b + 1] - off[a], *flags, known, ids.fill_null(0).to_numpy())
                yield pa.record_batch([pa.array([part << 32 | k], pa.int64()), pa.array([off[b] - off[a]], pa.int64()), pa.array([blob], pa.binary())], names=["batch", "bytes", "blob"])
                k += 1
        trim()

    return docs.select("doc_id", "text", "train", "fold", "held_out").mapInArrow(run, "batch bigint, bytes bigint, blob binary")


def ask(packed: DataFrame, buckets: int, order: int, bits: int) -> DataFrame:
    """(bucket, batch, kind, blob): the sorted distinct keys of each batch and order, and their training counts in it by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("batch").to_pylist(), batch.column("blob"), strict=True):
                raw, off, train, fold, *_ = unpack(blob.as_buffer())
                b = Batch(raw, off, order, bits)
                for kind, keys in enumerate(b.keys):
                    counts = np.stack([b.counts(kind, train.astype(bool) & (fold == f)) for f in range(FOLDS)])
                    cuts = np.searchsorted(_buckets_of(keys, buckets), np.arange(buckets + 1))
                    some = np.flatnonzero(np.diff(cuts))
                    blobs = [pack(gaps(keys[cuts[i] : cuts[i + 1]]), small(counts[:, cuts[i] : cuts[i + 1]])) for i in some]
                    n = len(some)
                    yield pa.record_batch([pa.array(some, pa.int32()), pa.array([name] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "batch", "kind", "blob"])
                del b
        trim()

    return packed.select("batch", "blob").mapInArrow(run, "bucket int, batch bigint, kind int, blob binary")


def answer(asked: DataFrame) -> DataFrame:
    """(batch, kind, bucket, blob, n, v): the corpus counts by fold of the keys asked, in their order; n (training tokens
    by fold) and v (distinct training words) stand in one row of each bucket of words, with no blob."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
        got = [(from_gaps(raw), counts.reshape(FOLDS, -1)) for raw, counts in map(unpack, pdf["blob"])]
        keys, inv = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.empty((FOLDS, len(keys)), np.int64)
        for f in range(FOLDS):
            total[f] = np.bincount(inv, weights=np.concatenate([g[1][f] for g in got]), minlength=len(keys))
        rows, at = [], 0
        for name, g in zip(pdf["batch"], got, strict=True):
            rows.append((name, kind, bucket, pack(small(total[:, inv[at : at + len(g[0])]])), None, 0))
            at += len(g[0])
        if kind == 0:
            rows.append((-1, kind, bucket, None, total.sum(axis=1).tolist(), int((total.sum(axis=0) > 0).sum())))
        del got, keys, inv, total
        trim()
        return pd.DataFrame(rows, columns=["batch", "kind", "bucket", "blob", "n", "v"])

    return asked.groupBy("kind", "bucket").applyInPandas(run, "batch bigint, kind int, bucket int, blob binary, n array<bigint>, v bigint")


# ---- the model -------------------------------------------------------------------------------


def level(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then 1 + floor(log2)."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], LEVELS - 1)


def _ratio_bins(p: np.ndarray, p0: float) -> np.ndarray:
    """0 for none, else 1 + a bin of log2(p / p0)."""
    with np.errstate(divide="ignore"):
        x = np.log2(p / p0)
    return np.where(p > 0, 1 + np.clip(np.round(FINE * np.nan_to_num(x, neginf=0)) + FINE * BELOW, 0, GRID - 1), 0).astype(np.int64)


def _bin_ratio(k: np.ndarray) -> np.ndarray:
    return np.where(k > 0, np.exp2((k - 1 - FINE * BELOW) / FINE), 0.0)


class Corpus:
    """Training tokens n and distinct words v of the whole corpus."""

    def __init__(self, n: int, v: int) -> None:
        self.n, self.v = n, v


def estimate(batch: Batch, k: int, at: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(c(h w) / c(h), c(h)) of the tokens ``at``, by n-grams of order k + 1. A context is counted as often as it is followed:
    that before a text's first word as often as there are ends."""
    g = batch.gram[k][at]
    context = batch.context[k][g]
    seen = np.where(context < 0, counts[0][batch.end], counts[k - 1][context])
    return counts[k][g] / np.maximum(seen, 1) * (seen > 0), seen


def probability(batch: Batch, at: np.ndarray, counts: list[np.ndarray], corpus: Corpus, weights: list[np.ndarray], order: int) -> np.ndarray:
    """The probabilities of the tokens ``at``, by the orders up to ``order``."""
    if not corpus.n:
        return np.full(len(at), 1 / (corpus.v + 1))
    p2, seen = estimate(batch, 1, at, counts)
    w = weights[0][level(seen)]
    p = w[:, 0] * p2 + w[:, 1] * counts[0][batch.gram[0][at]] / corpus.n + w[:, 2] / (corpus.v + 1)
    for k in range(2, order):
        own, seen = estimate(batch, k, at, counts)
        m = weights[k - 1][level(seen)]
        p = m * own + (1 - m) * p
    return p


def held_out(batch: Batch, train: np.ndarray, fold: np.ndarray, counts: list[np.ndarray], n: list[int], v: int, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, how often) of a batch's training tokens, each by the counts of the other folds: the level of its context of
    the next order to fit, the bin of that order's estimate, and the bin of what it is mixed with."""
    k, out = len(weights) + 1, []
    of = np.where(train.astype(bool), fold, FOLDS)[batch.of]
    for f in range(FOLDS):
        at = np.flatnonzero(of == f)
        if not len(at):
            continue
        left = [c.sum(axis=0) - c[f] for c in counts[: k + 1]]
        rest = Corpus(sum(n) - n[f], v)
        own, seen = estimate(batch, k, at, left)
        below = left[0][batch.gram[0][at]] / max(rest.n, 1) if k == 1 else probability(batch, at, left, rest, weights, k)
        out.append((level(seen) * (GRID + 1) + _ratio_bins(own, 1 / (v + 1))) * (GRID + 1) + _ratio_bins(below, 1 / (v + 1)))
    return np.unique(np.concatenate(out) if out else np.zeros(0, np.int64), return_counts=True)


def fit(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weights (l2, l1, l0) of every level, by expectation maximisation; a level without counts takes those of all."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]

    def em(a: np.ndarray, b: np.ndarray, c: np.ndarray, pairs: bool) -> np.ndarray:
        w = np.array([1 / 3, 1 / 3, 1 / 3]) if pairs else np.array([0.0, 0.5, 0.5])
        p = np.stack([a, b, np.ones(len(a))])
        for _ in range(ITERATIONS if c.sum() else 0):
            share = w[:, None] * p
            share *= c / np.maximum(share.sum(axis=0), 1e-300)
            w = share.sum(axis=1) / c.sum()
        w = np.maximum(w, [FLOOR * pairs, FLOOR, FLOOR])
        return w / w.sum()

    lev, rest = np.divmod(codes, (GRID + 1) ** 2)
    a, b = _bin_ratio(rest // (GRID + 1)), _bin_ratio(rest % (GRID + 1))
    seen = lev > 0
    every = em(a[seen], b[seen], counts[seen], True)
    alone = em(a, b, counts, False)
    out = np.tile(every, (LEVELS, 1))
    out[0] = alone
    for k in range(1, LEVELS):
        if (mine := lev == k).any():
            out[k] = em(a[mine], b[mine], counts[mine], True)
    return out


def fit_higher(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weight of a higher order's own estimate at every level, 0 at that of unseen contexts, likewise."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]

    def em(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
        m = 0.5
        for _ in range(ITERATIONS if c.sum() else 0):
            m = float((c * m * a / np.maximum(m * a + (1 - m) * b, 1e-300)).sum() / c.sum())
        return min(max(m, FLOOR), 1 - FLOOR)

    lev, rest = np.divmod(codes, (GRID + 1) ** 2)
    a, b = _bin_ratio(rest // (GRID + 1)), _bin_ratio(rest % (GRID + 1))
    seen = lev > 0
    out = np.full(LEVELS, em(a[seen], b[seen], counts[seen]))
    out[0] = 0.0
    for k in range(1, LEVELS):
        if (mine := lev == k).any():
            out[k] = em(a[mine], b[mine], counts[mine])
    return out


def score(batch: Batch, counts: list[np.ndarray], corpus: Corpus, weights: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of a batch's texts."""
    word = counts[0][batch.gram[0]]
    base = np.log10((word + 0.5) / (corpus.n + 0.5 * (corpus.v + 1)))
    p = np.log10(probability(batch, np.arange(len(word)), counts, corpus, weights, len(batch.keys)))
    add = lambda x: np.add.reduceat(x, batch.off[:-1])
    return batch.lengths, add((word > 0).astype(np.int64)), add(base), add(p)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text) rows; ``order`` is 2 at least."""
    spark = docs.sparkSession
    bounded(spark)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), (~held).alias("train"), fold.alias("fold"))
    packed = written(texts(docs), "lm-texts")
    size = packed.agg(F.sum("bytes") + F.count("*")).first()[0] or 0
    buckets, bits = max(1, math.ceil(size / BUCKET_BYTES)), min(64, size.bit_length() + SPARE_BITS)
    answers = written(answer(ask(packed, buckets, order, bits)), "lm-counts")
    *n, v = answers.where("batch < 0").agg(*(F.coalesce(F.sum(F.col("n")[f]), F.lit(0)) for f in range(FOLDS)), F.coalesce(F.sum("v"), F.lit(0))).first()
    corpus = Corpus(sum(n), v)

    def join(s: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, blob in zip(s["of"], s["blob"], strict=True):
            raw, off, train, fold, *_ = unpack(blob)
            batch, counts = Batch(raw, off, order, bits), []
            for kind in range(order):
                got = [unpack(b)[0].reshape(FOLDS, -1) for b in a[a["kind"] == kind].sort_values("bucket")["blob"]]
                counts.append(np.concatenate(got, axis=1) if got else np.zeros((FOLDS, 0), np.int64))
            codes, times = held_out(batch, train, fold, counts, n, v, [])
            rows.append((name, pack(*(small(c if order > 2 else c.sum(axis=0)) for c in counts)), 0, 0))
            rows += [(None, None, c, t) for c, t in zip(codes.tolist(), times.tolist(), strict=True)]
            del batch, counts
        trim()
        return pd.DataFrame(rows, columns=["batch", "blob", "code", "n"]).astype({"batch": "Int64"})

    named = packed.select(F.col("batch").alias("of"), "blob")
    answered = answers.where("batch >= 0").select("batch", "kind", "bucket", "blob")
    full = written(named.groupBy("of").cogroup(answered.groupBy("batch")).applyInPandas(join, "batch bigint, blob binary, code bigint, n bigint"), "lm-batches")
    discard(answers)
    batches = named.groupBy("of").cogroup(full.where("batch IS NOT NULL").select("batch", "blob").groupBy("batch"))

    def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        # LEVELS * (GRID + 1)^2 rows at most
        hist = rows.groupBy("code").agg(F.sum("n").alias("n")).toPandas()
        return hist["code"].to_numpy(np.int64), hist["n"].to_numpy(np.float64)

    def next_order(done: list[np.ndarray]) -> DataFrame:
        def run(s: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
            out = [held_out(batch, rows[2], rows[3], counts, n, v, done) for rows, batch, counts in _counted(s, a, order, bits)]
            return pd.DataFrame({"code": np.concatenate([o[0] for o in out]), "n": np.concatenate([o[1] for o in out])})

        return batches.applyInPandas(run, "code bigint, n bigint")

    weights = [fit(*histogram(full.where("batch IS NULL")))]
    for _ in range(2, order):
        weights.append(fit_higher(*histogram(next_order(list(weights)))))
    shared = spark.sparkContext.broadcast(weights)

    def run(s: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, _, _, is_held, known, ids), batch, counts in _counted(s, a, order, bits):
            tokens, seen, base, full_score = score(batch, [c.sum(axis=0) for c in counts], corpus, shared.value)  # sums in 64 bits
            doc_id = pd.arrays.IntegerArray(ids.astype(np.int64), ~known.astype(bool))
            out.append(pd.DataFrame({"doc_id": doc_id, "held_out": is_held.astype(bool), "n_tokens": tokens, "n_known": seen, "train_tokens": corpus.n, "base_score": base, "score": full_score}))
            del batch, counts
        trim()
        return pd.concat(out, ignore_index=True)

    return batches.applyInPandas(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _counted(s: pd.DataFrame, a: pd.DataFrame, order: int, bits: int) -> Iterator[tuple[list[np.ndarray], Batch, list[np.ndarray]]]:
    """(a batch's rows, its n-grams, their counts: by fold for orders above 2) of a group of texts and their counts."""
    for texts_, counts in zip(s["blob"], a["blob"], strict=True):
        parts = unpack(texts_)
        yield parts, Batch(parts[0], parts[1], order, bits), [c.reshape(FOLDS if order > 2 else 1, -1) for c in unpack(counts)]


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
