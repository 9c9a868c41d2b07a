import random

from weftline.operators import keywords
from weftline.operators.termstats import TermStats, stream_keywords


def made(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id int, text string")


def test_kept_statistics_are_those_of_all(spark, tmp_path):
    draw = random.Random(6)
    text = lambda: draw.choice([" ".join(draw.choice(["red", "fox", "dog", "page", "x", "É"]) for _ in range(draw.randint(0, 9))), None])
    stats, held = TermStats(spark, str(tmp_path)), {}
    assert stats.n_docs() == 0 and stats.df().collect() == []
    for epoch in range(4):
        batch = {10 * epoch + i: text() for i in range(6)}
        stats.add(made(spark, batch), epoch, fanout=3)
        held |= batch
    stats.add(made(spark, {99: "never red"}), 3)  # a batch that is run again
    old = {k: held[k] for k in (0, 11, 12)}
    stats.add(made(spark, old), 4, sign=-1)
    held = {k: v for k, v in held.items() if k not in old} | {11: "new words"}
    stats.add(made(spark, {11: "new words"}), 5)
    docs = made(spark, held)
    assert stats.n_docs() == len(held) and len(stats.deltas()) <= 4
    assert {tuple(r) for r in stats.df().collect()} == {tuple(r) for r in keywords.term_df(keywords.doc_terms(docs)).collect()}
    assert sorted(map(tuple, stats.keywords(docs, 3).collect())) == sorted(map(tuple, keywords.interesting_keywords(docs, 3).collect()))
    # of a few documents the keywords are those they have among all
    few = docs.where("doc_id IN (11, 20)")
    assert sorted(map(tuple, stats.keywords(few, 3).collect())) == sorted(tuple(r) for r in keywords.interesting_keywords(docs, 3).collect() if r["doc_id"] in (11, 20))


def test_stream(spark, tmp_path):
    src, stats = str(tmp_path / "in"), TermStats(spark, str(tmp_path / "stats"))
    for rows in ({1: "a b b", 2: "a"}, {3: "b c"}):
        made(spark, rows).coalesce(1).write.mode("append").json(src)
        q = stream_keywords(spark.readStream.schema("doc_id int, text string").json(src), stats, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert stats.n_docs() == 3 and {tuple(r) for r in stats.df().collect()} == {("a", 2), ("b", 2), ("c", 1)}
    assert {(r["doc_id"], r["keyword"]) for r in spark.read.parquet(str(tmp_path / "out")).where("rank = 0").collect()} == {(1, "b"), (2, "a"), (3, "c")}
