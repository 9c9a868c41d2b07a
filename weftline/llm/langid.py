"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's features are its byte n-grams of two to four within words (with the gaps around them), hashed to
BUCKETS rows of an embedding table; their mean goes through a linear softmax over the languages and one more class,
that of no known language. Both are trained by stochastic gradient descent in numpy on a bounded sample: about
TRAIN_DOCS labelled whole texts, dealt evenly over the languages, of which a part is kept back for calibration, and
noise made from them (their letters shuffled, random letters, strings as of base64, letters of other scripts) for the
class of none, so that subwords that no language has speak for it. As the model is linear in the features, prediction
sums one precomputed row of class scores for every n-gram of the whole text.

Calibration: the temperature minimises the kept-back texts' loss against targets smoothed by 1 / (texts + 2), so that a
separable sample gives no certainty beyond its size. A text's score is the probability of its best language. The
threshold lies below what one kept-back text in 10,000 would fall short of (on the scale of log-odds as far below the
score of one in 1,000 as that is below the score of one in 100), and half-way from there to the scores of texts that ought
to go, where those are lower: all but BETA of the kept-back noise, and of kept-back texts of languages that a model was not
taught, as the languages are left out in turn, in at most GROUPS groups.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected; so is every text
if no row can be learned from; a null doc_id is not held out and not learned from; rows that repeat are predicted each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, bounded, crc_mod, discard, pieces, table, trim, utf8, written

TRAIN_DOCS = 4000
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIM = 16
EPOCHS = 6
RATE = 0.5
BETA = 0.02
GROUPS, LEFT_OUT_EPOCHS = 4, 2
NOISE_SHARE = 2  # texts for one of noise
NOISE_CHARS = 2000
SEED = 7
CHUNK = 1 << 20
UND = "und"


def ngrams(raw: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each n the bucket at every place, BUCKETS where there is none; the first place of every row)."""
    low = LOWER[raw]
    sym = np.where((low >= 97) & (low <= 122) | (raw >= 128), low, np.uint8(32))
    buf = np.append(np.insert(sym, off, 32), np.full(4, 32, np.uint8)).astype(np.uint32)
    n = len(raw) + len(off)
    b = [buf[i : i + n] for i in range(4)]
    inner = b[1] != 32
    valid = {2: (b[0] != 32) | inner, 3: inner, 4: inner & (b[2] != 32)}
    out, code = [], b[0]
    for k in (2, 3, 4):
        code = code << np.uint32(8) | b[k - 1]
        h = ((code + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
        out.append(np.where(valid[k], h, np.uint32(BUCKETS)))
    return out, off[:-1] + np.arange(len(off) - 1)


def has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = LOWER[raw]
    count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[off])
    out = count((low >= 97) & (low <= 122)) > 0
    for i in np.flatnonzero(~out & (count(raw >= 128) > 0)):
        out[i] = any(map(str.isalpha, raw[off[i] : off[i + 1]].tobytes().decode()))
    return out


#: First and last letters of scripts that noise is drawn from: Latin supplements, Greek, Cyrillic, Arabic, Devanagari, Thai,
#: Hangul and Chinese.
SCRIPTS = [(0xC0, 0x17F), (0x391, 0x3C9), (0x410, 0x44F), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0xAC00, 0xD7A3), (0x4E00, 0x9FFF)]
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def noise(text: str) -> str:
    """A text in no language: of a kind, and from draws, that the text decides."""
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    chars = list(text[:NOISE_CHARS])
    at = [i for i, c in enumerate(chars) if c.isalpha()]
    kind = int(rng.integers(6))
    if kind <= 1:
        drawn = [chars[i] for i in rng.permutation(at)]
    elif kind == 2:
        drawn = [chr(97 + x) for x in rng.integers(26, size=len(at))]
    elif kind == 3:  # long words without gaps, as of keys and encoded data
        return " ".join("".join(_BASE64[x] for x in rng.integers(64, size=rng.integers(16, 77))) for _ in range(1 + len(chars) // 60))
    else:
        first, last = SCRIPTS[int(rng.integers(len(SCRIPTS)))]
        drawn = [chr(x) for x in rng.integers(first, last + 1, size=len(at))]
    for i, c in zip(at, drawn, strict=True):
        chars[i] = c
    return "".join(chars)


def features(texts: DataFrame) -> DataFrame:
    """(lang, part, idx, cnt) of (lang, part, text): the distinct buckets of each text and their counts; behind
    them, with no lang, those of noise made from some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            for a, b in pieces(off, CHUNK):
                plain = pa.array([raw[off[i] : off[i + 1]].tobytes().decode() for i in range(a, b)])
                lang, part = batch.column("lang")[a:b], batch.column("part")[a:b]
                some = pa.array([i for i in range(b - a) if zlib.crc32(raw[off[a + i] : off[a + i + 1]]) % NOISE_SHARE == 0], pa.int64())
                made = pa.array(map(noise, plain.take(some).to_pylist()), pa.string())
                for texts_, lang_, part_ in ((plain, lang, part), (made, pa.nulls(len(made), pa.string()), part.take(some))):
                    if not len(texts_):
                        continue
                    grams, first = ngrams(*utf8(texts_))
                    ends = np.append(first[1:], len(grams[0]))
                    idx, cnt = [], []
                    for x, y in zip(first, ends, strict=True):
                        u, c = np.unique(np.concatenate([g[x:y] for g in grams]), return_counts=True)
                        fine = u < BUCKETS
                        idx.append(u[fine].astype(np.uint32).tobytes())
                        cnt.append(c[fine].astype(np.float32).tobytes())
                    yield pa.record_batch([lang_, part_, pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], names=["lang", "part", "idx", "cnt"])

    return texts.mapInArrow(run, "lang string, part int, idx binary, cnt binary")


class Model:
    """Scores of every bucket by class: the languages in order, then none."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float) -> None:
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language or -1, calibrated score) of every row."""
        n = len(off) - 1
        if not n or not self.langs:
            return np.full(n, -1), np.zeros(n)
        grams, first = ngrams(raw, off)
        total, count = np.zeros((n, len(self.langs) + 1)), np.zeros(n, np.int64)
        for g in grams:
            total += np.add.reduceat(self.table[g], first, axis=0, dtype=np.float64)
            count += np.add.reduceat(g < BUCKETS, first, dtype=np.int64)
        p = softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)[:, :-1]
        best = p.argmax(axis=1)
        some = has_letter(raw, off)
        return np.where(some, best, -1), np.where(some, p[np.arange(n), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


#: A text of the sample: its class, its buckets and their shares.
Text = tuple[int, np.ndarray, np.ndarray]


def descend(texts: list[Text], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, output matrix, bias) by stochastic gradient descent."""
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for j in rng.permutation(len(texts)):
            y, idx, w = texts[j]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            rows = emb[idx]
            h = w @ rows
            g = softmax(h @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            bias -= rate * g
            # the mean shares a text's step among its features; every row takes the whole of it, as in word vectors
            rows -= (rate * len(idx) * w)[:, None].clip(max=1.0) * back
            emb[idx] = rows
    return emb, out, bias


def logits(texts: list[Text], emb: np.ndarray, out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.array([(w @ emb[idx]) @ out + bias for _, idx, w in texts], dtype=np.float64).reshape(len(texts), len(bias))


def fit(rows: list[tuple[str | None, int, bytes, bytes]]) -> Model:
    """Trains on the rows of part 0 and calibrates on those of part 1 (of part 0, if there are none)."""
    langs = sorted({r[0] for r in rows if r[0] is not None})
    none = len(langs)
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    parts: tuple[list[Text], list[Text]] = ([], [])
    for lang, part, idx, cnt in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2], r[3])):  # the order of collection does not show
        w = np.frombuffer(cnt, np.float32)
        if len(w):
            parts[part].append((none if lang is None else langs.index(lang), np.frombuffer(idx, np.uint32), w / w.sum()))
    train = parts[0] or parts[1]
    emb, out, bias = descend(train, none + 1)
    kept = parts[1] or train
    known = [t for t in kept if t[0] < none]
    z, y = logits(known, emb, out, bias), np.array([t[0] for t in known])
    grid = np.geomspace(0.05, 20, 60)
    target = np.full(z.shape, 1 / (len(y) + 2) / (none + 1))
    target[np.arange(len(y)), y] += 1 - 1 / (len(y) + 2)
    loss = [-(target * np.log(softmax(z / t) + 1e-300)).sum(axis=1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])

    def best(z: np.ndarray) -> np.ndarray:
        return softmax(z / temperature)[:, :-1].max(axis=1)

    foreign = [best(logits([t for t in kept if t[0] == none], emb, out, bias))]
    for g in range(min(GROUPS, none) if none > 1 else 0):
        left = {i for i in range(none) if i % GROUPS == g}
        classes = {c: k for k, c in enumerate(c for c in range(none + 1) if c not in left)}
        other = descend([(classes[c], *x) for c, *x in train if c in classes], len(classes), LEFT_OUT_EPOCHS)
        foreign.append(best(logits([t for t in kept if t[0] in left], *other)))
    odds = lambda p: float(np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9))))
    near, far = (odds(np.quantile(best(z), q, method="lower")) if len(known) else 0.0 for q in (0.01, 0.001))
    low = far - (near - far)
    # of several kinds of foreign texts the hardest counts
    high = max((odds(np.quantile(f, 1 - BETA, method="higher")) for f in foreign if len(f)), default=low)
    threshold = 1 / (1 + np.exp(-(min(low, (low + high) / 2))))
    scores = np.concatenate([emb @ out, np.zeros((1, none + 1), np.float32)]).astype(np.float32)
    return Model(langs, scores, bias.astype(np.float64), temperature, float(threshold))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from (doc_id, text, lang) rows with a lang whose crc32(doc_id) mod 5 is not 0.

    The sample is drawn by a hash of doc_id and text, so that it is the same however the table is partitioned and whichever
    files it lies in. Of equal rows as many are drawn as their number and the rate of their language say, to the nearest
    by chance: there are about ``train_docs`` rows in all, and no more classes than that.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    rows = rows.select("doc_id", "lang", "text", F.xxhash64("text", F.lit(SEED)).alias("_h"))
    alike = written(rows.groupBy("doc_id", "lang", "_h").agg(F.count("*").alias("_m")), "langid-rows")
    langs = alike.groupBy("lang").agg(F.sum("_m").alias("_n"))
    n_langs = langs.count()
    if not n_langs:
        return fit([])
    rate = F.least(F.lit(1.0), F.lit(train_docs / n_langs) / F.col("_n"))
    chance = F.pmod(F.xxhash64("doc_id", "_h", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    drawn = alike.join(langs, "lang").withColumn("_k", F.floor(F.col("_m") * rate + chance)).where("_k > 0").select("doc_id", "lang", "_h", "_k")
    # about train_docs rows of some 40 bytes at most; each one's text is taken once, and repeated after that
    texts = rows.join(F.broadcast(drawn), ["doc_id", "lang", "_h"]).groupBy("doc_id", "lang", "_h", "_k").agg(F.min("text").alias("text"))
    drawn = texts.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(3)) == 0, 1).otherwise(0)
    got = features(drawn.select("lang", part.alias("part"), "text"))
    model = fit([tuple(r) for r in got.toLocalIterator()])
    discard(alike)
    trim()
    return model


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, lang_pred, score, accepted of every row of docs (text)."""
    bounded(docs.sparkSession, 4 << 20)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages scores

    # only the texts go to Python; the rows wait in the JVM
    @F.arrow_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        m: Model = shared.value
        raw, off = utf8(texts)
        got = [m.predict(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in pieces(off, CHUNK)]
        trim()
        best, score = (np.concatenate(x) if x else np.zeros(0) for x in ([g[0] for g in got], [g[1] for g in got]))
        best = best.astype(np.int64)
        pred = pa.array([*m.langs, UND]).take(pa.array(np.where(best < 0, len(m.langs), best)))
        return pa.StructArray.from_arrays([pred, pa.array(score), pa.array((best >= 0) & (score >= m.threshold))], names=["lang_pred", "score", "accepted"])

    return docs.select(*keep, predict(F.col("text")).alias("_p")).select(*keep, "_p.lang_pred", "_p.score", "_p.accepted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised; the others go."""
    model = train(docs.select("doc_id", "text", "lang"))
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "text")  # whatever the columns' names are
    return identify(whole, model, ["_doc"]).where("accepted").select("_doc.*")
