import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from weftline.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    "a", "", None, " ", "   ", "a b", "Hello, world! don't 12 345", "x" * 5000, "word " * 3000, "a\n b\n  c\n\n\n d", "tab\t x\x0b y", "café con ñu", "  x  y　 z ",
    "<|endoftext|> <s> </s> <unk> <0x41>", "zero▁width", "中文 한국 \U0001f600\U0001f600", "  lead", "trail  ", "\u0085 \u0085", "\x00 \x01", "﻿bom", "é ́ x", " ▁", "I'll we've 'S s'",
]


def brute(texts):
    """The contract over whole texts: the libraries on each, places by sets, counts by Counter."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = align.byte_of_char()
    docs, pairs = [], Counter()
    for t in texts:
        docs.append(None)
        if not t:
            continue
        data = f" {t}".encode()
        ia, ib = a.encode(f" {t}", add_special_tokens=False), b.encode(t)
        ta = [bytes(of[c] for c in x) for x in ia.tokens]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ta) != data or b"".join(tb) != data:
            continue
        ends = []
        for parts in (ta, tb):
            at, out = 0, []
            for p in parts:
                at += len(p)
                out.append(at)
            ends.append(out)
        both = sorted(set(ends[0]) & set(ends[1]))
        by_end = [dict(zip(es, ids, strict=True)) for es, ids in zip(ends, (ia.ids, ib), strict=True)]
        links = [(by_end[0][p], by_end[1][p]) for p in both]
        pairs.update(links)
        text, held = [], ([], [])
        for p in sorted({*ends[0], *ends[1]}):
            for side in (0, 1):
                if p in by_end[side]:
                    held[side].append(str(by_end[side][p]))
            if p in by_end[0] and p in by_end[1]:
                text.append("|".join(map(",".join, held)))
                held = ([], [])
        docs[-1] = (len(ta), len(tb), len(both), links, hashlib.sha256(";".join(text).encode()).hexdigest())
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(pairs[x] == best[x[1]] for x in d[3]), sum(pairs[x] for x in d[3]), d[4]) for d in docs]


def run(spark, texts, parts=3):
    docs = spark.createDataFrame([(i, t, 1, "n", 2.0) for i, t in enumerate(texts)], "doc_id bigint, text string, links int, counts string, n_a double").repartition(parts)
    return [tuple(r)[1:] for r in sorted(align.alignment(docs, A, B).collect())]


def test_alignment_is_the_libraries(spark):
    draw = random.Random(5)
    parts = ["the", " ", "  ", "\n", "café", ",", "'s", "中", " ", "1234", "\t", "Unter", " ", "x" * 30, "<s>", "...", "́"]
    texts = TEXTS + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 60))) for _ in range(300)]
    want = brute(texts)
    assert run(spark, texts) == want
    assert run(spark, texts[::-1], 1)[::-1] == want


def test_documents(sf, spark):
    got = align.op11_token_alignment(spark, sf[0])
    rows = spark.read.parquet(f"{sf[0]}/documents.parquet").collect()
    want = [(r["doc_id"], *w) for r, w in zip(rows, brute([r["text"] for r in rows]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert align.op11_token_alignment(spark, sf[1]).collect() == []


def test_remembered_chunks_are_forgotten(monkeypatch):
    monkeypatch.setattr(align, "KNOWN_BYTES", 1000)
    import numpy as np

    texts = [f"some words {i} ▁" if i % 5 == 0 else f"some words {i}, and more" for i in range(40)]
    by, fresh = align.Aligner(A, B), []
    for t in texts:
        totals, digests, _ = by.align(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        fresh.append((*totals[:, 0], digests[0]))
    assert fresh == [(*w[:3], w[-1]) for w in brute(texts)]
    assert by.held < 100_000


def test_labels_and_groups():
    import numpy as np

    label = align.labels(7, np.array([1, 3, 7]), np.array([3, 5, 7]))
    assert label == bytes([1, 0, 3, 0, 2, 0, 3])
    assert align.groups(label).T.tolist() == [[2, 1], [1, 2]]
    assert align.groups(b"").shape == (2, 0)


@pytest.mark.parametrize("text", TEXTS)
def test_pairs_hold_all_links(text):
    import numpy as np

    by = align.Aligner(A, B) if not hasattr(test_pairs_hold_all_links, "by") else test_pairs_hold_all_links.by
    test_pairs_hold_all_links.by = by
    data = (text or "").encode()
    _, _, linked = by.align(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    for k in np.frombuffer(linked[0], "<u4"):
        x, y = by.a.tokens[by.pairs.codes[k] >> 32], by.b.tokens[by.pairs.b[k]]
        assert x.endswith(y) or y.endswith(x)
