"""WARC files, shard files and sharding."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import sharding, tokens, warc
from weftline.llm.common import utf8, work_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENC = tokens.Encoder(PATH)


# ---- WARC ------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=400), min_size=1, max_size=6), st.integers(1, 64))
def test_members_and_records(payloads, step):
    data = b"".join(warc.member(warc.record(str(i), f"u\n{i}", p, None if i % 2 else "7")) for i, p in enumerate(payloads))
    got = [warc.parse(m) for m in warc.members(memoryview(data), step)]
    for i, (p, (head, block)) in enumerate(zip(payloads, got, strict=True)):
        assert head["warc-type"] == ("response" if i % 2 else "revisit") and head["warc-target-uri"] == f"u {i}"
        assert block.partition(b"\r\n\r\n")[2] == (p if i % 2 else b"")
        assert head["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(p).digest()).decode()


def test_broken_files_are_errors():
    whole = warc.record("1", None, b"payload", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(whole.replace(b"payload", b"paYload"))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse(whole[:-5])
    with pytest.raises(ValueError, match="version"):
        warc.parse(b"HTTP/1.1 200\r\n\r\n")
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(memoryview(warc.member(whole)[:-3])))
    with pytest.raises(zlib.error):
        list(warc.members(memoryview(b"no gzip at all")))


def test_rolled_files(spark, sf):
    pages = spark.read.parquet(f"{sf[0]}/pages.parquet").select("page_id", "url", "html")
    folder = work_dir(spark, "test")
    files = warc.write(warc.with_refers(pages.coalesce(1)), folder, 300).collect()
    assert len(files) > 1 and sum(f["records"] for f in files) == pages.count()
    got = warc.read(spark, folder).collect()
    assert sorted(len(r["payload"]) for r in got if r["record_type"] == "response") == [0, 1, 100_000]
    assert sorted((r["page_id"] is None, r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit") == [(False, 1, 1), (False, 3, 2), (True, None, 1)]


def test_archives_of_others(spark):
    """Records without this writer's own headers and ids: payloads are measured, what is not said of a revisit is null."""

    def other(kind, block, **more):
        head = [f"{k.replace('_', '-')}: {v}" for k, v in {"WARC_Type": kind, "WARC_Record_ID": "<urn:uuid:1-2>", "Content_Length": len(block), **more}.items()]
        return warc.member("\r\n".join(["WARC/1.0", *head, "", ""]).encode() + block + b"\r\n\r\n")

    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x\r\n\r\ny"
    folder = work_dir(spark, "test")
    warc.write_shared(f"{folder}/a.warc.gz", b"".join([other("warcinfo", b"software: z"), other("response", answer, WARC_Target_URI="http://a"), other("revisit", b"HTTP/1.1 304\r\n\r\n", WARC_Payload_Digest="sha1:ABC"), other("response", b"cut")]))
    got = sorted((r["record_type"], r["page_id"], r["payload_bytes"], r["payload_digest"], r["payload"]) for r in warc.read(spark, folder).collect())
    assert got == [
        ("response", None, 0, warc.sha1_base32(b""), b""), ("response", None, 9, warc.sha1_base32(b"<p>x\r\n\r\ny"), b"<p>x\r\n\r\ny"),
        ("revisit", None, None, "ABC", None), ("warcinfo", None, 11, warc.sha1_base32(b"software: z"), b"software: z"),
    ]


def test_least_size(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b"), (4, "u", "b")], "page_id bigint, url string, html string")
    assert sorted(r["page_id"] for r in warc.with_refers(pages, 2).where("revisits").collect()) == [2]


# ---- wavelet matrices and shards ---------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500))
def test_wavelet_matrix(values):
    ids = np.array(values, np.uint16)
    shard = tokens.Shard(tokens.dump(ids, [None, 5], np.array([len(ids), 0]), 6))
    w = shard.wave
    assert w.all().tolist() == values and shard.doc_ids == [None, 5] and shard.starts.tolist() == [0, len(ids), len(ids)]
    rng = random.Random(len(values))
    for i in [rng.randrange(len(ids)) for _ in range(8)] if values else []:
        assert w.access(i) == values[i]
        s = values[rng.randrange(len(ids))]
        assert w.rank(s, i) == values[:i].count(s) and w.count(s) == values.count(s)
        where = [j for j, x in enumerate(values) if x == s]
        k = rng.randrange(len(where))
        assert w.select(s, k) == where[k]
    assert w.count(63) == 0 and w.count(1000) == 0
    if values:
        assert w.occurrences(values[0]) == [j for j, x in enumerate(values) if x == values[0]]


def check(texts):
    raw, off = utf8(pa.array(texts, pa.string()))
    ids, lengths = ENC.encode(raw, off)
    at = 0
    for t, n in zip(texts, lengths, strict=True):
        assert ids[at : at + n].tolist() == [*ENC.lib.encode(t or "", add_special_tokens=False).ids, 0], t
        at += n
    assert at == len(ids)


PART = st.sampled_from(["a", "B", "'", "s", "t", "re", "ll", "ve", "'s", "'S", " ", "  ", "\n", "\t", "\xa0", "\x85", "1", "²", "é", "Ł", "!", "-", "’", "—", "中", "😀", "<|endoftext|>", "ʼ", "\x1c", "_"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PART, max_size=16).map("".join)), min_size=1, max_size=20))
def test_encoding_equals_the_library(texts):
    check(texts)


def test_encoding_of_whole_texts(spark):
    check([r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    folder = work_dir(spark, "test")
    files = {r["file"]: r for r in tokens.write_shards(docs, folder, PATH, 3, 100).collect()}
    got = tokens.read_shards(spark, folder).collect()
    first, total = {}, 0
    for name in sorted(files):
        first[name] = total
        total += files[name]["ids"]
    got = sorted(((first[r["file"]] + r["at"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got))
    at, want = 0, []
    for i, t in rows:
        ids = np.array([*ENC.lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert got == want


# ---- sharding ----------------------------------------------------------------------------------


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    rng = random.Random(4)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(300)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 16, 17, 1000):
        got = {r["k"]: r["s"] for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k & ((1 << 64) - 1), n) for k in keys}


def test_law_and_slots(spark, sf):
    for folder in ("/root/testdata/sf0.01", sf[0]):
        rows = sharding.op9_jump_sharding(spark, folder).collect()
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        sizes = sorted((repr(d["doc_id"]), len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
        assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sizes
        by: dict = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16 and r["law"] == "key"
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})


def test_slots_over_many_buckets(spark):
    rows = sharding.assign(spark.range(5000), sharding.stable_key(F.col("id")), 4, ["id"], per_bucket=50).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == [0, 1, 2, 3] and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 1.3 * 1250


def test_slots_do_not_show_the_ranges(spark):
    """One order of slots whatever the number of ranges; a key with a third of all rows is dealt over them."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("size"))
    cut = [sharding.assign(df, sharding.stable_key(F.col("doc_id")), 4, ["doc_id", "size"], per_bucket=p).select("doc_id", "size", "shard", "slot").orderBy("size").collect() for p in (10, 100, 10_000)]
    assert cut[0] == cut[1] == cut[2]
    assert len({r["shard"] for r in cut[0] if r["doc_id"] == 7}) == 1


def test_keys_in_hex(spark):
    rows = spark.createDataFrame([("12",), ("",), (None,)], "k string")
    got = [r[0] for r in rows.select(sharding.stable_key(F.col("k"))).collect()]
    assert got == [int.from_bytes(hashlib.md5(x).digest()[:8], "big", signed=True) for x in (b"2:12", b"0:", b"-")]
