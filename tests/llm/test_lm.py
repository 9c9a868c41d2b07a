import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import lm

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), "\0end"]


def check(rows, docs):
    train = [t for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((i is None, i or 0, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n, base))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6])


def test_counts_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = lm.op4_deleted_interpolation(spark, SMALL).collect()
    check(rows, docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the bigrams help on unseen texts


def test_odd_rows(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf[0]}/documents.parquet").select("doc_id", "text").collect()]
    check(lm.op4_deleted_interpolation(spark, sf[0]).collect(), docs)


def grams(w, k):
    padded = ["\0end"] * (k - 1) + w
    return [tuple(padded[i : i + k]) for i in range(len(w))]


class Brute:
    """The model by plain counts of some texts, under given weights."""

    def __init__(self, texts, order, v=None):
        self.c = [Counter(g for t in texts for g in grams(tokens(t), k)) for k in range(1, order + 1)]
        self.h = [Counter(g[:-1] for t in texts for g in grams(tokens(t), k)) for k in range(1, order + 1)]
        self.n, self.v, self.order = sum(self.c[0].values()), len(self.c[0]) if v is None else v, order

    def ml(self, g):
        k = len(g) - 1
        return (self.c[k][g] / self.h[k][g[:-1]] if self.h[k][g[:-1]] else 0.0), self.h[k][g[:-1]]

    def p(self, g, weights):
        lev = lambda x: int(lm.level(np.array([x]))[0])
        p2, seen = self.ml(g[-2:])
        l2, l1, l0 = weights[0][lev(seen)]
        p = l2 * p2 + l1 * self.c[0][g[-1:]] / self.n + l0 / (self.v + 1)
        for k in range(3, len(g) + 1):
            own, seen = self.ml(g[-k:])
            m = weights[k - 2][lev(seen)]
            p = m * own + (1 - m) * p
        return p


LINES = ["a b a c", "a b b", "c", "", "b a b a b d", "d a", "a b c d", "b b b", "zz a", "a b a c", "", "b a b a c"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_and_weights_against_brute_force(spark, monkeypatch, order):
    """The scores from plain counts and the fitted weights; the histograms that these are fitted on, fold by fold, from
    plain counts of all other folds; and each context's probabilities sum to one."""
    fitted, codes = [], []
    for name in ("fit", "fit_higher"):
        plain = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda c, n, plain=plain: codes.append(dict(zip(c.tolist(), n.tolist(), strict=True))) or fitted.append(plain(c, n)) or fitted[-1])
    df = spark.createDataFrame(list(enumerate(LINES)), "doc_id bigint, text string").repartition(3)
    rows = lm.score_documents(df, order).collect()
    folds = {r[0]: r[1] for r in df.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 11), {lm.FOLDS})").collect()}
    train = {i: t for i, t in enumerate(LINES) if zlib.crc32(str(i).encode()) % 5 != 1}
    model = Brute(train.values(), order)
    assert len(fitted) == order - 1
    for r in rows:
        w = tokens(LINES[r["doc_id"]])
        assert r["score"] == pytest.approx(sum(math.log10(model.p(g, fitted)) for g in grams(w, order)), abs=1e-9)
    words = [g[0] for g in model.c[0]]
    for h in {g[:-1] for g in model.c[order - 1]} | {("zz",) * (order - 1)}:
        assert sum(model.p((*h, w), fitted) for w in words) + model.p((*h, "new"), fitted) == pytest.approx(1)
    for k in range(2, order + 1):
        want = Counter()
        for f in set(folds.values()):
            rest = Brute([t for i, t in train.items() if folds[i] != f], order, model.v)
            for g in (g for i, t in train.items() if folds[i] == f for g in grams(tokens(t), k)):
                own, seen = rest.ml(g)
                below = rest.c[0][g[-1:]] / max(rest.n, 1) if k == 2 else rest.p(g[1:], fitted)
                bins = [int(lm._ratio_bins(np.array([x]), 1 / (model.v + 1))[0]) for x in (own, below)]
                want[(int(lm.level(np.array([seen]))[0]) * (lm.GRID + 1) + bins[0]) * (lm.GRID + 1) + bins[1]] += 1
        assert codes[k - 2] == want


def test_em_finds_known_weights():
    k = lm.GRID + 1
    # half of the events come from a component ten times as likely as the next, half from the last
    codes = np.array([(5 * k + lm._ratio_bins(np.array([x]), 1.0)[0]) * k + lm._ratio_bins(np.array([1e-3]), 1.0)[0] for x in (64.0, 0.0)])
    out = lm.fit(codes, np.array([500.0, 500.0]))
    assert out.shape == (lm.LEVELS, 3) and np.allclose(out.sum(axis=1), 1)
    # the likelihood 500 ln(64 a + b) + 500 ln(b), b = 1 - a, is largest where 63 / (63 a + 1) = 1 / (1 - a)
    assert out[5][0] == pytest.approx(62 / 126, abs=0.01) and out[0][0] == 0


def test_small_ratios_keep_their_size():
    """A word once among N >> V: its unigram probability is far below the uniform one."""
    x = np.exp2(np.arange(-39.0, 39.0))
    assert np.allclose(lm._bin_ratio(lm._ratio_bins(x, 1.0)), x)
    assert lm._bin_ratio(lm._ratio_bins(np.array([0.0]), 1.0))[0] == 0
    # 900 events four times and 100 a thousandth as likely under l1 as under l0
    codes = lm._ratio_bins(np.array([4.0, 2.0**-10]), 1.0)
    l1 = lm.fit(codes, np.array([900.0, 100.0]))[0][1]
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax(900 * np.log(1 + 3 * grid) + 100 * np.log(1 - grid * (1 - 2.0**-10)))]
    assert l1 == pytest.approx(best, abs=0.005)


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = None
    for parts in (1, 3, 16):
        got = sorted(map(tuple, lm.score_documents(docs.repartition(parts)).collect()))
        want = want or got
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=0)


def test_many_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "4096")
    try:
        docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
        rows = lm.op4_deleted_interpolation(spark, SMALL).collect()
        check(rows, docs)
        spark.conf.set(key, str(16 << 20))
        whole = {r["doc_id"]: r["score"] for r in lm.op4_deleted_interpolation(spark, SMALL).collect()}
        assert all(r["score"] == pytest.approx(whole[r["doc_id"]], rel=1e-9) for r in rows)
        spark.conf.set(key, "4096")
        lm.bounded(spark)
        assert spark.conf.get(key) == "4096"  # a session's own bound stays
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
