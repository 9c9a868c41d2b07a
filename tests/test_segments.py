import random

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import search, segments

FIELDS = ["text", "title"]
BOOSTS = {"text": 5.0, "title": 2.0}


def rows_of(spark, d):
    return spark.createDataFrame([(k, *v) for k, v in d.items()], "id string, text string, title string")


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def same(spark, index, want, queries=("red fox", "dog", "the pages")):
    """Everything that the segments answer is what an index built at once answers."""
    fresh = search.build_index(rows_of(spark, want), "id", FIELDS, index.analyzer)
    view = index.view()
    assert {tuple(r) for r in view.stats.select("field", "n_docs", F.round("avg_len", 9)).collect()} == {tuple(r) for r in fresh.stats.select("field", "n_docs", F.round("avg_len", 9)).collect()}
    for q in queries:
        wanted = search.simple_search(fresh, q, BOOSTS)
        assert scores(search.simple_search(view, q, BOOSTS)) == scores(wanted)
        found = index.top_k(q, BOOSTS, k=3)
        assert scores(found.hits) == scores(search.top_hits(wanted, "id", 3)) and found.read <= found.of
    assert scores(search.advanced_search(view, ["red fox"], ["dog"], [], BOOSTS)) == scores(search.advanced_search(fresh, ["red fox"], ["dog"], [], BOOSTS))


def test_batches_replacements_and_merges(spark, tmp_path):
    analyzer = text.ENGLISH
    draw = random.Random(4)
    words = ["red", "fox", "foxes", "the", "dog", "dogs", "page", "pages", "x"]
    index, want = segments.SegmentedIndex(spark, str(tmp_path), "id", FIELDS, analyzer, per_range=4), {}
    assert index.top_k("red").hits.collect() == [] and index.view().postings.collect() == []
    line = lambda: draw.choice([" ".join(draw.choice(words) for _ in range(draw.randint(0, 7))), None])
    for epoch in range(3):
        batch = {f"d{draw.randrange(30)}": (line(), line()) for _ in range(12)}
        index.add(rows_of(spark, batch), epoch, merge=False)
        want |= batch
    index.add(rows_of(spark, {"d0": ("never", "again")}), 2, merge=False)  # a batch that is run again
    assert len(index.segments()) == 3
    same(spark, index, want, ("red fox the pages",))
    # merging two of three keeps what they replaced in the third
    first = index.segments()[0]["seg"]
    tier = index.segments()[1:]
    index.segments = lambda: tier_first
    tier_first = [*tier, spark.createDataFrame([(first, 1 << 40, 0)], "seg string, docs long, epoch long").first()]
    assert index.merge(fanout=2)
    del index.segments
    assert len(index.segments()) == 2
    same(spark, index, want, ("red fox",))
    assert index.merge(everything=True) and len(index.segments()) == 1 and not index.merge(everything=True)
    index.vacuum(keep=1)
    assert len(index.versions.folder.names()) == 1
    same(spark, index, want, ("dog",))


def test_many_batches_stay_few_segments(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path), "id", ["text"], per_range=8)
    for epoch in range(5):
        index.add(spark.createDataFrame([(f"{epoch}-{i}", f"word{i} common") for i in range(4)], "id string, text string"), epoch, merge=False)
    while index.merge(fanout=3):
        pass
    assert len(index.segments()) <= 3 and index.segments()[-1]["epoch"] == 4
    assert index.view().postings.where("term = 'common'").count() == 20
    # a term's filter reaches the sorted postings
    plan = index.view().postings.where("term = 'word1'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,word1)" in plan


def test_ranges_are_skipped(spark, tmp_path):
    """Many weak documents and a few strong ones: most ranges are not read, and the best are the best."""
    rows = [(f"d{i:04d}", "common " + "filler " * (20 + i % 50) if i % 97 else "common " * 9) for i in range(2000)]
    index = segments.SegmentedIndex(spark, str(tmp_path), "id", ["text"], per_range=20)
    index.add(spark.createDataFrame(rows, "id string, text string"))
    found = index.top_k("common", {"text": 1.0}, k=10)
    assert found.of >= 90 and found.read < found.of // 2
    fresh = search.build_index(spark.createDataFrame(rows, "id string, text string"), "id", ["text"])
    assert scores(found.hits) == scores(search.top_hits(search.simple_search(fresh, "common", {"text": 1.0}), "id", 10))
    assert index.top_k("nothing").hits.collect() == [] and index.top_k("").hits.collect() == []


def test_two_writers(spark, tmp_path, monkeypatch):
    one, other = (segments.SegmentedIndex(spark, str(tmp_path), "id", FIELDS) for _ in range(2))
    one.add(rows_of(spark, {"a": ("red", None)}))
    commit, done = segments.SegmentedIndex._commit, []

    def late(self, rows, version):
        if not done:
            done.append(1)
            other.add(rows_of(spark, {"a": ("fox", None), "b": ("red fox", None)}))
        commit(self, rows, version)

    monkeypatch.setattr(segments.SegmentedIndex, "_commit", late)
    one.add(rows_of(spark, {"c": ("red dog", "fox"), "b": ("dog", None)}))
    monkeypatch.undo()
    same(spark, one, {"a": ("fox", None), "b": ("dog", None), "c": ("red dog", "fox")}, ("red fox",))


def test_indexer_stream_feeds_the_service(spark, tmp_path):
    """Pages that a stream brings twice: the later ones count, and the service finds them by other forms of their words."""
    from weftline.functions.html import parse_html
    from weftline.service import Service
    from weftline.streaming import crawl as stream

    src = str(tmp_path / "pages")

    def pages(*rows):
        df = spark.createDataFrame([(f"http://s.org/{n}.html", h) for n, h in rows], "url string, html string")
        df.select(parse_html("url", "html").alias("p")).select("p.*").coalesce(1).write.mode("append").parquet(src)
        q = stream.segment_pages(stream.page_source(spark, src), str(tmp_path / "index"), str(tmp_path / "ck"), text.ENGLISH)
        q.awaitTermination(200)
        assert q.exception() is None

    pages(("a", "<title>one</title><p>old words"), ("b", "<title>two</title><p>other words"))
    pages(("a", "<title>one</title><p>newer texts"))
    index = stream.page_index(spark, str(tmp_path / "index"), text.ENGLISH)
    urls = spark.createDataFrame([(f"http://s.org/{n}.html",) for n in "ab"], "url string").select(F.md5("url").alias("doc_key"), "url")
    none = spark.createDataFrame([], "node string, rank double")
    find = lambda q: [u for u, _ in Service(index.view(), urls, none, none, none).normal_search(q)]
    assert find("word") == ["http://s.org/b.html"] and find("texting") == ["http://s.org/a.html"] and find("old") == []


def test_postings_are_made_once(spark, tmp_path, monkeypatch):
    """No ranges of postings, whose bounds Spark draws by making all of them a first time; merges keep what is alive."""
    from pyspark.sql.classic.dataframe import DataFrame

    asked, by_range = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, *a: asked.append(a) or by_range(self, *a))
    index = segments.SegmentedIndex(spark, str(tmp_path), "id", ["text"], per_range=4)
    index.add(spark.createDataFrame([(f"d{i}", f"common word{i}") for i in range(12)], "id string, text string"), merge=False)
    index.add(spark.createDataFrame([("d3", "other"), ("d4", "common")], "id string, text string"), merge=False)
    assert index.merge(everything=True) and not asked
    held = {(r["id"], r["term"]) for r in index.view().postings.collect()}
    assert held == {(f"d{i}", t) for i in range(12) if i not in (3, 4) for t in ("common", f"word{i}")} | {("d3", "other"), ("d4", "common")}
