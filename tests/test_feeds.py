import random
import time

import pytest

from weftline.streaming import feeds


def feed(*links):
    return "<rss><channel>" + "".join(f"<item><title>t {x}</title><link>{x}</link><pubDate>Tue, 07 Aug 2018 12:30 +0000</pubDate></item>" for x in links) + "</channel></rss>"


def test_marks_against_a_model():
    """A feed that grows, is cut and loses items, read by batches of any size: each item once, in order of age."""
    rng = random.Random(5)
    for _ in range(200):
        shown, got, mark, n = [], [], "", 0
        for _ in range(12):
            for _ in range(rng.randrange(4)):
                shown.insert(0, f"l{n}")
                n += 1
            if len(shown) > 1 and rng.random() < 0.3:
                gone = shown.index(rng.choice(shown))
                if shown[gone] in got:  # withdrawn once read; the others of the mark stand for it
                    del shown[gone]
            end = feeds.advanced(shown, mark, rng.randrange(1, 5))
            items = [i["link"] for i in feeds.between(feeds.linked_items(feed(*shown)), mark, end)]
            again = [f"l{n + 5}", *shown]  # the feed has moved on when the batch is run again
            if end != mark:
                assert [i["link"] for i in feeds.between(feeds.linked_items(feed(*again)), mark, end)] == items
            else:
                assert items == []
            got += reversed(items)
            mark = end
            if not any(x in mark.split("\n") for x in shown) and mark:
                break  # nothing of the mark is left: a new feed
        assert got == [f"l{i}" for i in range(len(got))]


def test_marks_at_the_edges():
    assert feeds.advanced([], "", 5) == "" and feeds.advanced(["a"], "a", 5) == "a"
    assert feeds.advanced(list("edcba"), "", 2) == "b\na" and feeds.advanced(list("edcba"), "b\na", 2) == "d\nc\nb\na"
    items = feeds.linked_items("<rss><item><title>x</title></item><item><link> </link></item><item><link>a</link></item><item><link>a</link><title>old</title></item></rss>")
    assert [(i["link"], i["title"]) for i in items] == [("a", None)]
    assert feeds.linked_items("no xml") == [] and feeds.between([], "a", "b") == []
    assert [i["link"] for i in feeds.between([{"link": x} for x in "cba"], "a", "gone")] == ["c", "b"]


def until(query, done):
    for _ in range(600):
        if query.exception():
            raise query.exception()
        if done():
            return
        time.sleep(0.2)
    raise AssertionError("the stream does not get there")


def read(spark, out):
    try:
        return sorted(tuple(r) for r in spark.read.parquet(out).select("url", "text").collect())
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return []
        raise


def test_feed_stream_and_its_restart(spark, tmp_path):
    """Two feeds and one that is missing: admitted by two items a feed, stopped, and started again from its marks."""
    a, b, gone = (tmp_path / f"{n}.xml" for n in "abc")
    a.write_text(feed("a3", "a2", "a1"))
    b.write_text(feed("b1"))
    urls = [f.as_uri() for f in (a, b, gone)]
    pages = spark.createDataFrame([(f"{n}{i}", f'<p id="m">{n} {i}</p>') for n in "abc" for i in range(1, 7)], "url string, html string")
    sites = spark.createDataFrame([(u, "id", "m") for u in urls], "rss_url string, attr string, value string")
    out, marks, ck = str(tmp_path / "out"), str(tmp_path / "marks" / "feeds"), str(tmp_path / "ck")

    def start():
        source = feeds.feed_source(spark, urls, marks, itemsPerFeed="2", tasks="2")
        return feeds.ingest_items(source, pages, sites, out, ck, trigger="200 milliseconds")

    want = lambda *ls: sorted((x, f"{x[0]} {x[1:]}") for x in ls)
    q = start()
    try:
        until(q, lambda: len(read(spark, out)) == 4)
        assert read(spark, out) == want("a1", "a2", "a3", "b1")
        first = spark.read.parquet(f"{out}/epoch=0").collect()
        assert {r["url"] for r in first} == {"a1", "a2", "b1"} and len({r["ingest_ts"] for r in first}) == 1  # a3 waited
        assert {str(r["pub_date"]) for r in first} == {"2018-08-07 12:30:00"}
    finally:
        q.stop()
    a.write_text(feed("a5", "a4", "a3"))
    b.unlink()  # for a while
    gone.write_text(feed("c1"))
    q = start()
    try:
        until(q, lambda: len(read(spark, out)) >= 7)
        b.write_text(feed("b2", "b1"))
        until(q, lambda: len(read(spark, out)) >= 8)
    finally:
        q.stop()
    assert read(spark, out) == want("a1", "a2", "a3", "a4", "a5", "b1", "b2", "c1")


def test_a_feed_that_fails_fails_its_task(spark, tmp_path):
    reader = feeds.FeedReader({"urls": (tmp_path / "none.xml").as_uri(), "marks": str(tmp_path / "m")})
    assert reader.initialOffset() == reader.latestOffset()
    with pytest.raises(OSError):
        list(reader.read(feeds.Share([(reader.urls[0], "", "x")], 0)))
    assert reader.partitions(reader.initialOffset(), reader.initialOffset()) == []
    none = feeds.FeedReader({"urls": "", "marks": str(tmp_path / "m2")})
    assert none.latestOffset() == none.initialOffset()
