import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from weftline.llm import lattice
from weftline.llm.common import utf8

P = lattice.model(public_tokenizers.path("piece_bpe_32k.model"))


def sampled(texts, k, keys=None):
    raw, off = utf8(pa.array(texts, pa.string()))
    return lattice.Sampled(P, raw, off, np.arange(len(texts), dtype=np.uint64) if keys is None else keys, k)


def takes(got, i):
    """(piece ids, log-probability, perturbed value) of the samples of the i-th text."""
    out = []
    for texts, edges, off, logp, g in got.rounds:
        ids, off = got.ids(edges, off, texts)
        for t in np.flatnonzero(texts == i):
            out.append((tuple(ids[off[t] : off[t + 1]].tolist()), float(logp[t]), float(g[t])))
    return out


def all_takes(got, n):
    out = [[] for _ in range(n)]
    for texts, edges, off, logp, g in got.rounds:
        ids, off = got.ids(edges, off, texts)
        for t, i in enumerate(texts.tolist()):
            out[i].append((tuple(ids[off[t] : off[t + 1]].tolist()), float(logp[t]), float(g[t])))
    return out


def every(text):
    """All segmentations and their probabilities, by the plain lattice."""
    edges = lattice.lattice(P, lattice.SPACE + text.replace(" ", lattice.SPACE) if text else "")
    total = lattice.backward(edges)[0]
    out = {}

    def go(i, ids, w):
        if i == len(edges):
            out[ids] = out.get(ids, 0) + math.exp(w - total)
            return
        for j, x, k in edges[i]:
            go(j, ids + k, w + x)

    go(0, (), 0.0)
    return out


@pytest.mark.parametrize("text", ["then", "a b", "x\ny", "中a", "", "é 9"])
def test_probabilities_against_enumeration(text):
    p = every(text)
    assert sum(p.values()) == pytest.approx(1)
    k = min(len(p), 6)
    got = sampled([text], len(p) + 3 if len(p) <= 8 else k)
    mine = takes(got, 0)
    seen = [ids for ids, _, _ in mine]
    assert len(set(seen)) == len(seen) == (len(p) if len(p) <= 8 else k)
    for ids, logp, _ in mine:
        assert math.exp(logp) == pytest.approx(p[ids], rel=1e-6)
    values = [g for _, _, g in mine]
    assert values == sorted(values, reverse=True)
    if len(p) <= 8:  # all are returned, so each is included for sure
        assert (got.inclusion(np.zeros(len(mine), int), np.array([x for _, x, _ in mine])) == 0).all()


@pytest.mark.parametrize("text", ["a   b", "  a", "a  ", "x\n    y"])
def test_runs_of_spaces(text):
    """Against the plain search over the whole vocabulary, the model's own encoding among its paths."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    whole = {sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))}
    assert P.ids.keys() == whole
    p, n = every(text), 3000
    assert tuple(sp.encode(text)) in p
    edges = lattice.lattice(P, lattice.SPACE + text.replace(" ", lattice.SPACE))
    rng = np.random.default_rng(1)
    got = sampled([text] * n, 2)
    every_take = all_takes(got, n)
    for some in every_take:
        for ids, logp, _ in some:
            assert math.exp(logp) == pytest.approx(p[ids], rel=1e-6)
    mine = Counter(some[0][0] for some in every_take)
    plain = Counter(lattice.perturbed_search(edges, 1, rng)[0][0] for _ in range(n))
    for ids in sorted(p, key=p.get)[::-1][:4]:
        sd = math.sqrt(p[ids] * (1 - p[ids]) / n)
        assert abs(mine[ids] / n - p[ids]) < 5 * sd + 1e-9 and abs(plain[ids] / n - p[ids]) < 5 * sd + 1e-9
    many = takes(sampled([text], min(len(p), 400)), 0)
    assert len({ids for ids, _, _ in many}) == len(many) == min(len(p), 400)


def test_order_is_a_sample_without_replacement():
    text, n = "then", 4000
    p = every(text)
    top = sorted(p, key=p.get)[::-1][:3]
    got = sampled([text] * n, 2)
    rng = np.random.default_rng(0)
    edges = lattice.lattice(P, lattice.SPACE + text)
    mine = Counter(tuple(ids for ids, _, _ in some) for some in all_takes(got, n))
    plain = Counter(tuple(x for x, _, _ in lattice.perturbed_search(edges, 2, rng)) for _ in range(n))
    for a, b in itertools.permutations(top, 2):
        want = p[a] * p[b] / (1 - p[a])
        sd = math.sqrt(want * (1 - want) / n)
        assert abs(mine[a, b] / n - want) < 5 * sd and abs(plain[a, b] / n - want) < 5 * sd


def test_inclusion_scores_estimate_sums():
    """Over many samples, 1 / inclusion weighs each segmentation to one."""
    text, n = "then", 3000
    p = every(text)
    got = sampled([text] * n, 3)
    total = Counter()
    for i, some in enumerate(all_takes(got, n)):
        for ids, logp, _ in some:
            total[ids] += math.exp(logp - got.inclusion(np.array([i]), np.array([logp]))[0])
    best = max(p, key=p.get)
    assert total[best] / n == pytest.approx(p[best], abs=0.03)
    assert sum(total.values()) / n == pytest.approx(1, abs=0.1)


def test_seeded_by_key_and_not_by_batch():
    texts = ["the cat sat on the mat", "another text", "the cat sat on the mat"]
    keys = np.array([7, 8, 7], np.uint64)
    a, b = sampled(texts, 2, keys), sampled(texts[2:], 2, keys[2:])
    assert takes(a, 0) == takes(a, 2) == takes(b, 0)


@pytest.mark.parametrize("k", [1, 2, 8])
def test_top_k_of_the_whole_order(k):
    """The first k of a longer search are the search of k, with its next value as threshold."""
    texts = ["the cat sat on the mat, then it slept", "a", "", "x" * 300]
    long, short = sampled(texts, k + 4), sampled(texts, k)
    for i in range(len(texts)):
        a, b = takes(long, i), takes(short, i)
        assert a[: len(b)] == b and len(b) == min(k, len(a))
        if len(a) > k:
            assert short.threshold[i] == pytest.approx(a[k][2])
        else:
            assert short.threshold[i] == -np.inf


def test_texts_that_polynomial_hashes_confuse():
    a = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    got = sampled([a, b, f"{a} {b}"], 2)
    for i, t in enumerate([a, b, f"{a} {b}"]):
        assert [P.decode(ids) for ids, _, _ in takes(got, i)] == [t, t]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab the\n\t中😀é'▁x")), max_size=25), min_size=1, max_size=5))
def test_round_trip(texts):
    got = sampled(texts, 3)
    for i, t in enumerate(texts):
        seen = set()
        mine = takes(got, i)
        for ids, _, _ in mine:
            seen.add(ids)
            # a text's own U+2581 reads as a space
            assert P.decode(ids) == t.replace("▁", " ")
        assert len(seen) == len(mine) >= 1


def test_query(spark, sf):
    rows = lattice.op5_gumbel_segmentation(spark, "/root/testdata/sf0.001").collect()
    assert all(r["round_trip"] and r["log_inclusion"] <= 0 and r["log_prob"] <= 1e-9 for r in rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    full = lattice.sample(docs, public_tokenizers.path("piece_bpe_32k.model"), 2, "doc_id", ["doc_id"])
    import zlib

    by = {(r["doc_id"], r["sample"]): r for r in rows}
    for r in full.collect():
        assert zlib.crc32(np.array(r["ids"], "<u4")) == by[r["doc_id"], r["sample"]]["ids_crc32"]


def test_the_queries_return_the_segmentations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 20")
    p = lattice.model(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for out in (lattice.op5_gumbel_segmentation(spark, "/root/testdata/sf0.001").where("doc_id < 20"), corpus_pipeline.segmentation(spark, docs, "")):
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == set(texts)
        for r in rows:
            assert len(r["ids"]) == r["n_pieces"] and p.decode(r["ids"]) == texts[r["doc_id"]]
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
