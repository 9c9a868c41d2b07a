import random
import re

import pytest

from weftline.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, x in items:
            v = words(x)
            for j in range(max(1, len(v) - size + 1) if v else 0):
                g = v[j : j + size]
                for s in range(len(w) - len(g) + 1):
                    if w[s : s + len(g)] == g:
                        hit.update(range(s, s + len(g)))
                        found.add("null" if name is None else str(name))
        out.append((repr(i), len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out)


def ours(spark, docs, items, size=10):
    d = spark.createDataFrame([(n, *r) for n, r in enumerate(docs)], "_row bigint, doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["item_list"]) for r in decontaminate.contamination(d, b, ["_row", "doc_id"], size).collect())


ITEMS = [(1, "b c"), (2, "A"), (None, "b c"), (4, None), (5, ""), (6, "é"), (10, "one two three four five six seven eight nine ten eleven"), (9, "a a a a")]


def test_odd_rows(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 1000]
    docs += [(20, "x One, two: three four five six seven eight nine TEN eleven twelve"), (21, "a a a a a a b c"), (22, "two three four five six seven eight nine ten eleven two")]
    assert ours(spark, docs, ITEMS) == brute(docs, ITEMS)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_small_windows(spark, size):
    docs = [(i, " ".join("abc"[(i * k * k + k) % 3] for k in range(i + 4))) for i in range(12)]
    items = [(1, "a b c a b"), (2, "c c"), (3, "b")]
    assert ours(spark, docs, items, size) == brute(docs, items, size)


def test_no_items(spark):
    assert ours(spark, [(1, "a b"), (2, None)], []) == [("1", 2, 0, 0, ""), ("2", 0, 0, 0, "")]


def near(docs, items, slop, size):
    """(row, starts, items) by the definition, start by start."""
    out = []
    for n, t in enumerate(docs):
        w, starts, found = words(t), set(), set()
        for name, x in items:
            v = words(x)
            for j in range(max(1, len(v) - size + 1) if v else 0):
                g = v[j : j + size]
                for s in range(-slop, len(w) + slop):
                    if all(any(0 <= p < len(w) and w[p] == y for p in range(s + o - slop, s + o + slop + 1)) for o, y in enumerate(g)):
                        starts.add(s)
                        found.add(str(name))
        out.append((n, len(w), len(starts), ",".join(sorted(found))))
    return out


@pytest.mark.parametrize(("slop", "size"), [(0, 3), (1, 3), (2, 4)])
def test_proximity_is_its_definition(spark, slop, size):
    """Near matches on random texts; a document's are the same whether it stands alone or beside others."""
    rng = random.Random(slop)
    docs = [" ".join(rng.choice("abcdxyz") for _ in range(rng.randrange(0, 14))) for _ in range(40)] + ["alpha x beta y gamma", "", None]
    items = [(1, "a b c d a"), (2, "d c"), (3, "b"), (4, "alpha beta gamma"), (5, "c c b"), (6, None)]
    b = spark.createDataFrame(items, "item_id bigint, text string")

    def ours(texts):
        d = spark.createDataFrame(list(enumerate(texts)), "_row bigint, text string")
        return sorted((r["_row"], r["n_words"], r["n_near"], r["item_list"]) for r in decontaminate.proximity(d, b, ["_row"], slop, size).collect())

    want = near(docs, items, slop, size)
    assert ours(docs) == want
    assert ours(docs[40:]) == [(n, *w[1:]) for n, w in enumerate(want[40:])]


def test_loose_index_has_all_places_of_near_matches(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdexyz") for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["b a c x d", "b c d e a", "a x b y c d x e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_row bigint, text string")
    wins = [tuple("abcde"), tuple("edcba"), tuple("aabbc")]
    terms = spark.createDataFrame([(x,) for x in "abcde"], "term string")
    for slop in (1, 2):
        _, postings = decontaminate.index(docs, terms, 5, ["_row"], slop)
        rows = [tuple(r) for r in postings.select("_row", "pos", "term").collect()]
        assert len(set(rows)) == len(rows) and all(texts[i].split()[p] == x for i, p, x in rows)
        want = set()
        for n, w in enumerate(map(str.split, texts)):
            for g in wins:
                for start in range(-slop, len(w)):
                    at = [[p for p in range(max(0, start + o - slop), min(len(w), start + o + slop + 1)) if w[p] == x] for o, x in enumerate(g)]
                    if all(at):
                        want |= {(n, p, w[p]) for ps in at for p in ps}
        assert want and want <= set(rows)
        assert slop > 1 or len(rows) < sum(x in "abcde" for t in texts for x in t)


def test_drop_contaminated(spark):
    docs = spark.createDataFrame([(1, "x a b c y", 0), (2, "a c b", 0), (None, None, 0), (4, "A. b; C", 0)], "doc_id bigint, text string, n_hit int")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "a b c")], "item_id bigint, text string"))
    assert kept.columns == docs.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == ["2", "None"]
