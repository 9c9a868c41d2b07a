import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.operators import crawl, news
from weftline.sources import sinks, tables
from weftline.streaming import crawl as stream
from weftline.streaming import news as news_stream

T0 = dt.datetime(2024, 1, 1, 12)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_politeness_batch(spark):
    rows = [(0, "h", at(-40)), (1, "h", at(-12)), (2, "h", at(-8)), (3, "h", at(0)), (4, "g", at(0)), (5, None, at(0)), (6, "h", None)]
    got = {r["id"]: (r["accepted"], r["wait_ms"]) for r in crawl.politeness(spark.createDataFrame(rows, "id int, host string, ts timestamp"), "host", "ts", "id").collect()}
    assert got == {0: (True, 0), 1: (False, 2000), 2: (True, 0), 3: (False, 22000), 4: (True, 0)}
    exact = spark.createDataFrame([(0, "h", at(0)), (1, "h", at(30))], "id int, host string, ts timestamp")
    assert [r["accepted"] for r in crawl.politeness(exact, "host", "ts", "id").orderBy("id").collect()] == [True, False]


def test_dedup_and_samples(spark):
    rows = spark.createDataFrame([(0, "A", at(0)), (1, "B", at(1)), (2, "A", at(2)), (3, "A", at(4000))], "id int, link string, ts timestamp")
    assert sorted(r["first"] for r in crawl.first_seen(rows, "link", "id").collect()) == [0, 1]
    assert sorted(r["first"] for r in crawl.dedup_ttl(rows, "link", "ts", "id").collect()) == [0, 1, 3]
    links = spark.createDataFrame([(1, f"l{i:02d}") for i in range(25)], "page int, link string")
    assert sorted(r["link"] for r in crawl.sample_links(links, "page", "link").collect()) == ["l00", "l10", "l20"]
    due = spark.createDataFrame([("b", at(5)), ("a", at(1)), ("c", at(9))], "link string, due_ts timestamp")
    assert [r["link"] for r in crawl.due_retries(due, at(5)).collect()] == ["a", "b"]


def test_stride_shuffle(spark):
    n, size, stride = 23, 10, 3
    rows = spark.range(n).withColumnRenamed("id", "k").repartition(3)
    got = [r["k"] for r in crawl.stride_shuffle(rows, "k", size=size, stride=stride).orderBy("emit").collect()]
    want = []
    for a in range(0, n, size):
        part = list(range(a, min(n, a + size)))
        for i in range(stride):
            want += part[i::stride]
    assert got == want


def test_feeds(spark):
    xml = "<rss xmlns:m='http://m'><channel><item><title>T1</title><link>L1</link><pubDate>Tue, 07 Aug 2018 12:30 +0000</pubDate></item><item><title>T2</title><m:title>M2</m:title><link>L2</link></item><item><link>L3</link></item></channel></rss>"
    feeds = spark.createDataFrame([("r", xml, "L3", at(0)), ("bad", "<x", None, at(0)), ("new", xml, None, at(0))], "rss_url string, xml string, last_link string, ingest_ts timestamp")
    items = news.new_items(feeds).orderBy("rss_url", "pos").collect()
    assert [(r["rss_url"], r["title"], r["link"]) for r in items] == [("new", "T1", "L1"), ("new", "M2", "L2"), ("new", None, "L3"), ("r", "T1", "L1"), ("r", "M2", "L2")]
    assert items[0]["pub_date"] == dt.datetime(2018, 8, 7, 12, 30) and items[1]["pub_date"] == at(0)
    assert {tuple(r) for r in news.high_water(feeds).collect()} == {("r", "L1"), ("bad", None), ("new", "L1")}
    pages = spark.createDataFrame([("L1", '<div class="b">Body <i>one</i></div>'), ("L2", "<p>none</p>")], "url string, html string")
    sites = spark.createDataFrame([("r", "class", "b")], "rss_url string, attr string, value string")
    assert [(r["url"], r["text"]) for r in news.articles(news.new_items(feeds), pages, sites).collect()] == [("L1", "Body one")]


def test_trends(spark):
    stop = spark.createDataFrame([("the",)], "word string")
    rows = spark.createDataFrame([("u", "the cat the cat", at(0)), ("v", "dog cat", at(60))], "url string, text string, ingest_ts timestamp")
    scores = news.trend_scores(rows, stop)
    assert {(r["url"], r["word"]) for r in scores.collect()} == {("u", "cat"), ("v", "dog"), ("v", "cat")}
    top = news.trend_top(scores, F.lit("2024-01-01 12:01:00").cast("timestamp")).collect()
    assert [tuple(r)[:2] for r in top] == [(0, "cat")]
    windows = news.trend_windows(scores).where("word = 'dog'").collect()
    assert len(windows) == 9


def drain(query):
    query.awaitTermination(120)
    if query.exception():
        raise query.exception()


def test_gate_stream_equals_batch(spark, tmp_path):
    rows = [(f"http://h{i % 3}.x/{i}", at(i * 7 % 120)) for i in range(40)]
    spark.createDataFrame(rows, "link string, ts timestamp").coalesce(1).write.json(str(tmp_path / "in"))
    src = stream.link_source(spark, str(tmp_path / "in"))
    q = stream.gate(src).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    drain(q)
    got = sorted(r["link"] for r in spark.table("gate").where("accepted").collect())
    batch = spark.createDataFrame([(i, *r) for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))], "id int, link string, ts timestamp").withColumn("host", F.regexp_extract("link", "//([^/]*)", 1))
    kept = crawl.politeness(batch, "host", "ts", "id").where("accepted").join(batch.select("id", "link"), "id")
    assert got == sorted(r["link"] for r in kept.collect())


def test_topic_filter(spark, tmp_path):
    rows = [("http://A.x/", at(0)), ("http://a.x", at(1)), ("http://b.x", at(2))]
    spark.createDataFrame(rows, "link string, ts timestamp").coalesce(1).write.json(str(tmp_path / "in"))
    go = lambda: drain(stream.topic_filter(stream.link_source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([("http://b.x/", at(100000)), ("http://c.x", at(100001))], "link string, ts timestamp").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_crawl_loop_and_indexer(spark, tmp_path):
    english = "what they should do when there is nothing else to be found in the other pages that people have read"
    page = lambda body: f'<html><head><title>t</title></head><body><p>{body}</p><a href="/next.html">n</a><a href="HTTP://WWW.O.X/">o</a></body></html>'
    pages = spark.createDataFrame([("http://a.x/1", page(english)), ("http://b.x/1", page("les gens qui ont lu cette page savent ce qu'il faut faire"))], "url string, html string")
    links = [("http://a.x/1", at(0)), ("http://a.x/2", at(1)), ("http://b.x/1", at(2))]
    spark.createDataFrame(links, "link string, ts timestamp").coalesce(1).write.json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    drain(stream.crawl(stream.link_source(spark, str(tmp_path / "in")), pages, out, str(tmp_path / "ck")))
    assert [r["link"] for r in spark.read.parquet(f"{out}/retry").collect()] == ["http://a.x/2"]
    assert [r["url"] for r in spark.read.parquet(f"{out}/pages").collect()] == ["http://a.x/1"]
    assert [r["link"] for r in spark.read.parquet(f"{out}/frontier").collect()] == ["http://a.x/next.html"]
    from weftline.functions.text import simple_terms

    drain(stream.index_pages(stream.page_source(spark, f"{out}/pages/*"), str(tmp_path / "index"), str(tmp_path / "ck2"), simple_terms))
    postings = spark.read.parquet(str(tmp_path / "index/postings"))
    assert postings.where("field = 'title'").select("term", "tf").first() == ("t", 1)
    assert spark.read.parquet(str(tmp_path / "index/out_links")).count() == 2


def test_indexer_feeds_the_search(spark, tmp_path):
    """Pages indexed twice, read as one index: the later one counts, and its out-links are resolved."""
    from weftline.functions.html import parse_html
    from weftline.functions.text import simple_terms
    from weftline.operators import search

    src, out = str(tmp_path / "pages"), str(tmp_path / "index")
    go = lambda: drain(stream.index_pages(stream.page_source(spark, src), out, str(tmp_path / "ck"), simple_terms))

    def pages(*rows):
        df = spark.createDataFrame([(f"http://s.org/d/{n}.html", h) for n, h in rows], "url string, html string")
        df.select(parse_html("url", "html").alias("p")).select("p.*").coalesce(1).write.mode("append").parquet(src)

    pages(("a", "<title>one</title><p>old words <a href='../b.html'>b</a>"), ("b", "<title>two</title><p>other words"))
    go()
    pages(("a", "<title>one</title><p>new text <a href=c.html>c</a>"))
    go()
    index = search.read_indexed(spark, out)
    md5 = {n: r["k"] for n in "ab" for r in spark.sql(f"SELECT md5('http://s.org/d/{n}.html') AS k").collect()}
    find = lambda q: {r["doc_key"] for r in search.best_fields(index, search.terms_of(q), {"title": 2.0, "text": 1.0}).collect()}
    assert find("old") == set() and find("new") == {md5["a"]} and find("words") == {md5["b"]} and find("one") == {md5["a"]}
    assert {(r["field"], r["n_docs"]) for r in index.stats.collect()} >= {("title", 2), ("text", 2)}
    assert {r["link"] for r in spark.read.parquet(f"{out}/out_links").collect()} == {"http://s.org/b.html", "http://s.org/d/c.html"}


def test_feed_stream(spark, tmp_path):
    pages = spark.createDataFrame([(f"L{i}", f'<div id="b">Body {i}</div>') for i in range(4)], "url string, html string")
    sites = spark.createDataFrame([("r", "id", "b")], "rss_url string, attr string, value string")
    feed = lambda *links: "<rss>" + "".join(f"<item><title>t</title><link>{x}</link></item>" for x in links) + "</rss>"
    schema = "rss_url string, xml string, ingest_ts timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    go = lambda: drain(news_stream.ingest_feeds(spark.readStream.schema(schema).json(src), pages, sites, out, str(tmp_path / "ck")))
    spark.createDataFrame([("r", feed("L2", "L1"), at(0))], schema).coalesce(1).write.json(src)
    go()
    spark.createDataFrame([("r", feed("L3", "L2", "L1"), at(600))], schema).coalesce(1).write.mode("append").json(src)
    go()
    assert sorted(r["url"] for r in spark.read.parquet(f"{out}/news").collect()) == ["L1", "L2", "L3"]


def test_trend_stream_equals_batch(spark, tmp_path):
    rows = [(f"w{i % 4}", float(i), at(i * 1800)) for i in range(60)]
    df = spark.createDataFrame(rows, "word string, score double, ingest_ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = news_stream.trends(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    drain(s.writeStream.outputMode("complete").format("memory").queryName("trends").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    assert sorted(map(tuple, spark.table("trends").collect())) == sorted(map(tuple, news.trend_windows(df).collect()))


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("e5", 2), ("f", 3)], "row_key string, v int")
    assert [r["v"] for r in tables.key_range(rows, F.col("row_key"), "e", "f").collect()] == [2]
    assert tables.key_range(rows, F.col("row_key")).count() == 3
    times = spark.createDataFrame([(1, at(0)), (2, at(10))], "v int, ts timestamp")
    assert [r["v"] for r in tables.time_range(times, F.col("ts"), at(0), at(10)).collect()] == [1]
    (tmp_path / "words").write_text("The\n\nand\nthe\n")
    assert sorted(r["word"] for r in tables.word_list(spark, str(tmp_path / "words")).collect()) == ["and", "the"]
    (tmp_path / "adj").write_text("node1 1 node2 node3\nnode2 1 node4\n")
    assert [tuple(r) for r in tables.words_per_line(spark, str(tmp_path / "adj"), ["node", "rank", "sinks"]).collect()] == [("node1", "1", ["node2", "node3"]), ("node2", "1", ["node4"])]
    props = tables.properties("# c\nnumberOfRssSite=2\nSite.0.RssUrl=http\\://x/y\nSite.0.Config=class/a\n\n!z\nk : v")
    assert props["k"] == "v" and [tuple(r)[:3] for r in tables.rss_sites(spark, props).collect()] == [("http://x/y", "class", "a")]
    (tmp_path / "log").write_text("INFO ok\nERROR bad\n")
    assert [tuple(r) for r in tables.log_lines(spark, str(tmp_path / "log"), {"err": "ERROR", "any": "^E"}).collect()] == [("err", "ERROR bad"), ("any", "ERROR bad")]
    web = spark.createDataFrame([("a", "text/html"), ("b", "image/png"), ("c", None)], "url string, content_type string")
    assert [r["url"] for r in tables.web_responses(web).collect()] == ["a", "c"] and tables.web_responses(times).count() == 2
    path = str(tmp_path / "cells")
    cell = lambda *r: spark.createDataFrame(r, "row string, q string, v int")
    sinks.upsert(cell(("r", "a", 1), ("r", "b", 2)), path, ["row", "q"])
    sinks.upsert(cell(("r", "b", 3), ("s", "a", 4)), path, ["row", "q"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("r", "a", 1), ("r", "b", 3), ("s", "a", 4)]
    sinks.upsert(cell(("s", "a", 5), ("s", "a", 4), ("s", "a", 5)), path, ["row", "q"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("r", "a", 1), ("r", "b", 3), ("s", "a", 5)]
    sinks.upsert(cell(("s", "a", 4)), path, ["row", "q"])
    assert {r["row"]: r["cells"] for r in sinks.wide_rows(spark.read.parquet(path), "row", "q", "v").collect()} == {"r": {"a": 1, "b": 3}, "s": {"a": 4}}
    sinks.create_table(spark, "marks", "k string")
    sinks.create_table(spark, "marks", "k string")
    assert spark.table("marks").count() == 0
    with pytest.raises(ValueError, match="more than"):
        sinks.to_dot(spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "src string, dst string, weight int"), limit=1)


def test_codec_and_meter(spark, tmp_path):
    from weftline.functions import codec
    from weftline.schemas import PAGE
    from weftline.streaming import io

    link = {"link": "l2", "anchor": "a2"}
    meta = {"name": "utf-8", "content": "Equiv", "charset": "html", "http_equiv": "salam", "scheme": "salam2"}
    page = ("u", "t", "x", None, ["h2_1", "h2_2"], [link], [meta])
    rows = spark.createDataFrame([page, (None, "t", "x", "h", [], [], []), ("v", "t", None, None, None, None, None)], PAGE)
    sent = rows.select(codec.encode(F.struct("*")).alias("value"))
    got = codec.decode_pages(sent.unionByName(spark.createDataFrame([("{no json",), (None,)], "value string"))).collect()
    assert [r.asDict(True) for r in got] == [dict(zip(PAGE.names, page, strict=True)) | {"h1": ""}]
    back = rows.select(codec.decode_links(codec.encode_links(F.col("links"))).alias("l")).first()["l"]
    assert [r.asDict() for r in back] == [link]
    meter = io.Meter()
    spark.streams.addListener(meter)
    try:
        sent.coalesce(1).write.json(str(tmp_path / "in"))
        src = spark.readStream.schema("value string").json(str(tmp_path / "in"))
        q = io.publish(io.observed(src, "pages", empty="value IS NULL"), "json", str(tmp_path / "ck"), path=str(tmp_path / "out"))
        io.finished(q)
        assert spark.read.json(str(tmp_path / "out")).count() == 3
        for _ in range(100):
            if any("pages" in m for m in meter.latest.values()):
                break
            __import__("time").sleep(0.1)
        assert {"rows": 3, "empty": 0} in [m.get("pages") for m in meter.latest.values()]
    finally:
        spark.streams.removeListener(meter)


def test_oracles_of_the_catalog(spark):
    """Every query that has SQL gives its rows, on the smallest tables."""
    import duckdb

    from weftline.plans import catalog

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in catalog.ORACLES.items():
        df, want = catalog.QUERIES[name](spark, folder), db.sql(sql)
        cols = sorted(want.columns)
        assert sorted(df.columns) == cols, name
        at = [want.columns.index(c) for c in cols]
        got = sorted(tuple(str(x) for x in r) for r in df.select(*cols).collect())
        assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall()), name
