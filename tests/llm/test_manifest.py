import hashlib
import zlib

import duckdb
import pytest

from weftline.llm import manifest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    """The contract, word by word: (doc_id, leaf, subroot, root, proof, folded, verified), sorted."""

    def leaf(i, text, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def tree(nodes):
        proofs, spans = [""] * len(nodes), [[i] for i in range(len(nodes))]
        steps = [[] for _ in nodes]
        while len(nodes) > 1:
            runs = [list(range(i, min(i + 3, len(nodes)))) for i in range(0, len(nodes), 3)]
            for run in runs:
                for k in run:
                    before, behind = "".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)
                    for d in spans[k]:
                        proofs[d] += before + behind
                        steps[d].append((before, behind))
            spans = [[d for k in run for d in spans[k]] for run in runs]
            nodes = [sha("".join(nodes[k] for k in run)) for run in runs]
        return nodes[0], proofs, steps

    by_source = {}
    for i, t, g, s, n in rows:
        own = leaf(i, t, g, s, n)
        tampered = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        by_source.setdefault(s, []).append((i is not None, i or 0, own, leaf(i, t.replace("\n", "") if t is not None and tampered else t, g, s, n)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(by_source[s])]) for s in names}
    root, above, up = tree([trees[s][0] for s in names])
    out = []
    for s, proof, steps in zip(names, above, up, strict=True):
        sub, proofs, own_steps = trees[s]
        for (known, i, own, fake), p, st in zip(sorted(by_source[s]), proofs, own_steps, strict=True):
            for before, behind in st + steps:
                fake = sha(before + fake + behind)
            out.append((i if known else None, own, sub, root, sha(p + proof), fake, fake == root))
    return sorted(out, key=repr)


def rows_of(n, sources=4):
    names = [None, "", "b", "a", "ä", "Z", "z" * 300][:sources]
    out = [(i * 7919 % 100_003 - 500, f"t{i}\n x\n" if i % 3 else f"t{i}", "en", names[min(i % 7, i % sources)], i) for i in range(n)]
    return out


@pytest.mark.parametrize(("fanout", "block", "bits", "wide"), [(3, 7, 11, 1 << 16), (3, 2, 3, 1 << 16), (3, 1, 16, 3)])
def test_manifest_is_the_contract_s(spark, fanout, block, bits, wide):
    rows = rows_of(150, 7) + [(5, "same\n", "x", "b", 1)] * 11 + [(5, f"other{i}", None, "b", None) for i in range(13)] + [(None, None, None, None, None)] * 2 + [(None, "a\nb", "en", "b", 3)]
    rows += [(2**63 - 1, "q\n", "e", "a", 1), (-(2**63), "q\n", "e", "a", 1), (-(2**62), "", "e", "a", 1)]
    got = manifest.manifest(spark.createDataFrame(rows, COLUMNS), fanout, block, bits, wide)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 4])
def test_small_trees(spark, n):
    for sources in (1, 3):
        rows = rows_of(n, sources)
        got = manifest.manifest(spark.createDataFrame(rows, COLUMNS))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == (brute(rows) if rows else [])


def test_many_equal_rows(spark):
    rows = [(7, "x\ny", "en", "s", 1)] * 9000
    got = manifest.manifest(spark.createDataFrame(rows, COLUMNS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_rows_that_nobody_tampered_with_are_folded_too():
    own, other = bytes(range(32)), bytes(32)
    path = f"{sha('a')},{sha('b')};,{sha('c')}"
    row = lambda fake: ("=s", 9, 0, own, 0, 7, fake)
    up = lambda h: sha(sha(sha("a") + h + sha("b")) + sha("c"))
    got = list(manifest.proved([(row(None), path, b"\x01"), (row(other), path, b"\x01")]))
    # a path that does not lead to the root shows, whether or not the row was changed
    assert [r[4] for r in got] == [up(own.hex()), up(other.hex())]
    assert {r[3] for r in got} == {sha(sha("a") + sha("b") + sha("c"))} and [r[0] for r in got] == [7, 7]


def test_twin(sf, spark):
    for folder in sf:
        got = manifest.op12_radix_manifest(spark, folder)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = con.sql(manifest.ORACLE)
        at = [want.columns.index(c) for c in got.columns]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
