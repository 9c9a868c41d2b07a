import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import crawl
from weftline.streaming import loop

T0 = dt.datetime(2024, 1, 1, 12)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def until(query, done, seconds=120):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        if done():
            return
        time.sleep(0.5)
    raise AssertionError("not done in time")


def seeds(spark, folder, rows):
    spark.createDataFrame(rows, loop.LINK).coalesce(1).write.mode("append").json(folder)


def pages_of(spark, path):
    try:
        return sorted(r["url"] for r in spark.read.parquet(path).collect())
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return []
        raise


def test_three_hops_feed_themselves(spark, tmp_path):
    """A seed leads to a page, that to two on its own host, one of them to a fourth: nobody reads a folder by hand, links
    that have been seen do not come again, and a host's visits lie apart."""
    english = "what they should do when there is nothing else to be found in the other pages that people have read"
    page = lambda *links: f"<title>t</title><p>{english}</p>" + "".join(f"<a href='{x}'>x</a>" for x in links)
    web = {"http://a.x/1.html": page("2.html", "/3.html", "http://b.x/none.html"), "http://a.x/2.html": page("/1.html", "http://c.x/4.html"), "http://a.x/3.html": page("2.html"), "http://c.x/4.html": page("http://a.x/1.html")}
    pages = spark.createDataFrame(list(web.items()), "url string, html string")
    links, out = str(tmp_path / "links"), str(tmp_path / "out")
    seeds(spark, links, [("http://a.x/1.html", T0), ("HTTP://A.x/1.html/", T0), (None, T0)])
    go = lambda: loop.crawl_loop(spark, links, pages, out, str(tmp_path / "ck"), interval_ms=1500, every=1, trigger="200 milliseconds")
    q = go()
    try:
        until(q, lambda: len(pages_of(spark, f"{out}/pages")) >= 3)
    finally:
        q.stop()
    q = go()  # what waits outlives the stream
    try:
        until(q, lambda: len(pages_of(spark, f"{out}/pages")) >= 4 and spark.read.parquet(f"{out}/visits").count() >= 5)
        time.sleep(3)
    finally:
        q.stop()
    assert pages_of(spark, f"{out}/pages") == sorted(web)
    visits = spark.read.parquet(f"{out}/visits").collect()
    assert sorted(r["link"] for r in visits) == sorted([*web, "http://b.x/none.html"])
    # 1 and then 2 and 3 of the same host: each but the first came early and had to wait
    waited = {r["link"]: r["waited_ms"] for r in visits}
    assert waited["http://a.x/1.html"] == waited["http://c.x/4.html"] == 0 and max(waited["http://a.x/2.html"], waited["http://a.x/3.html"]) > 0


def test_hosts_visits_are_apart(spark, tmp_path):
    seeds(spark, str(tmp_path / "in"), [(f"http://h{i % 2}.x/{i}", T0) for i in range(8)])
    source = spark.readStream.schema(loop.LINK).json(str(tmp_path / "in"))
    stamped = loop.polite(source, 700).withColumn("at", F.current_timestamp())
    q = stamped.writeStream.format("memory").queryName("polite").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
    try:
        until(q, lambda: spark.table("polite").count() == 8)
    finally:
        q.stop()
    rows = spark.table("polite").collect()
    assert len({r["link"] for r in rows}) == 8
    for host in ("h0.x", "h1.x"):
        waits = sorted(r["waited_ms"] for r in rows if r["host"] == host)
        assert waits[0] == 0 and all(b - a > 700 for a, b in zip(waits, waits[1:], strict=False))


@pytest.mark.parametrize("parts", [1, 3])
def test_strides_equal_the_batch_operator(spark, tmp_path, parts):
    n, size, stride = 43, 10, 3
    rows = [(f"http://x/{i:03d}", T0 + dt.timedelta(seconds=i)) for i in range(n)]
    q = None
    for k in range(parts):
        seeds(spark, str(tmp_path / "in"), rows[n * k // parts : n * (k + 1) // parts])
        source = spark.readStream.schema(loop.LINK).json(str(tmp_path / "in"))
        q = loop.strides(source, size=size, stride=stride, idle_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = {r["emit"]: r["link"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = crawl.stride_shuffle(spark.createDataFrame(rows, loop.LINK), "ts", "link", size=size, stride=stride)
    want = {r["emit"]: r["link"] for r in batch.collect() if r["emit"] < n // size * size}
    assert got == want and len(got) == 40


def test_the_last_buffer_leaves_when_idle(spark, tmp_path):
    rows = [(f"http://x/{i}", T0) for i in range(7)] + [(None, T0)]
    seeds(spark, str(tmp_path / "in"), rows)
    source = spark.readStream.schema(loop.LINK).json(str(tmp_path / "in"))
    q = loop.strides(source, size=5, stride=2, idle_ms=500, lanes=1).writeStream.format("memory").queryName("lanes").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
    try:
        until(q, lambda: spark.table("lanes").count() == 8)
    finally:
        q.stop()
    got = [r["link"] for r in sorted(spark.table("lanes").collect(), key=lambda r: r["emit"])]
    name = lambda *ns: [None if i is None else f"http://x/{i}" for i in ns]
    assert got == name(None, 1, 3, 0, 2, 4, 6, 5)


def test_full_buffers_do_not_wait_in_state():
    """What a batch's rows fill goes out at once; only what is left is put into state, and only that is read from it."""
    from pyspark.sql import Row

    state, told = {}, []
    value = type("Value", (), {"exists": lambda _: bool(told), "get": lambda _: told[-1], "update": lambda _, x: told.append(x)})()
    puts = []
    kept = type("Kept", (), {"updateValue": lambda _, k, v: (puts.append(k), state.__setitem__(k, v)), "getValue": lambda _, k: state[k], "clear": lambda _: state.clear()})()
    s = loop.Strides(["ts", "link"], 10, 3, None)
    s.init(type("Handle", (), {"getValueState": lambda *_: value, "getMapState": lambda *_: kept})())
    rows = [Row(lane=0, link=None if i == 7 else f"l{i:03d}", ts=None if i == 9 else T0 + dt.timedelta(seconds=i // 2)) for i in range(34)]
    order = sorted(rows[:25], key=lambda r: (r["ts"] is not None, r["ts"], r["link"] is not None, r["link"])) + rows[25:]
    want = [(order[a + k]["link"], order[a + k]["ts"]) for a in (0, 10, 20) for i in range(3) for k in range(i, 10, 3)]
    out = list(s.handleInputRows((0,), iter(rows[24::-1]), None))
    assert len(puts) == 5
    out += list(s.handleInputRows((0,), iter(rows[:24:-1]), None))
    assert len(puts) == 9 and [(r["link"], r["ts"]) for r in out] == want and [r["emit"] for r in out] == list(range(30))


def test_strides_come_in_frames(spark):
    """Frames instead of a Row for each link: the same order and numbers, nulls first, and only what is left is put into state."""
    import pandas as pd

    state, told = {}, []
    value = type("Value", (), {"exists": lambda _: bool(told), "get": lambda _: told[-1], "update": lambda _, x: told.append(x)})()
    kept = type("Kept", (), {"updateValue": lambda _, k, v: state.__setitem__(k, v), "getValue": lambda _, k: state[k], "clear": lambda _: state.clear()})()
    s = loop.StridesInFrames(["ts", "link"], 10, 3, None)
    s.init(type("Handle", (), {"getValueState": lambda *_: value, "getMapState": lambda *_: kept})())
    rows = [(None if i == 7 else f"l{i:03d}", None if i == 9 else i // 2) for i in range(34)]
    order = sorted(rows[:25], key=lambda r: (r[1] is not None, r[1], r[0] is not None, r[0])) + rows[25:]
    want = [order[a + k] for a in (0, 10, 20) for i in range(3) for k in range(i, 10, 3)]
    frame = lambda some: pd.DataFrame({"link": [r[0] for r in some], "ts": [r[1] or 0 for r in some], "none": [r[1] is None for r in some]})
    out = list(s.handleInputRows((0,), iter([frame(rows[24:9:-1]), frame(rows[9::-1])]), None))
    assert len(state) == 5
    out = pd.concat([*out, *s.handleInputRows((0,), iter([frame(rows[:24:-1])]), None)])
    assert [(r.link, None if r.none else r.ts) for r in out.itertuples()] == want and list(out["emit"]) == list(range(30))
    assert len(state) == 4
