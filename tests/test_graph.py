import pytest
from pyspark.sql import functions as F

from weftline import session
from weftline.operators import graph, keywords
from weftline.sources.sinks import to_dot

RING = [("node1", "node2"), ("node1", "node3"), ("node2", "node4"), ("node3", "node4"), ("node4", "node1")]
GOLDEN = {
    1: (1.0, 0.575, 0.575, 1.85),
    2: (1.7225, 0.575, 0.575, 1.1275),
    30: (1.2787120607163316, 0.6966956986322265, 0.6966956986322265, 1.3278965420192137),
    40: (1.2803588120262743, 0.6941524951111666, 0.6941524951111666, 1.331336197751391),
}


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def ranks(df):
    return {r["node"]: r["rank"] for r in df.collect()}


@pytest.mark.parametrize("n", GOLDEN)
def test_pagerank_golden(spark, n):
    got = ranks(graph.pagerank(edges(spark, RING), n))
    assert sorted(got) == ["node1", "node2", "node3", "node4"]
    assert [got[k] for k in sorted(got)] == pytest.approx(GOLDEN[n], abs=1e-9)
    assert sum(got.values()) == pytest.approx(4.0)


def test_pagerank_drop_outs(spark):
    # a has no in-edge, z is no source: both vanish; b -> c stands twice and counts twice; d keeps its loop's share
    rows = [("a", "b"), ("b", "c"), ("b", "c"), ("b", "z"), ("c", "b"), ("d", "d")]
    got = ranks(graph.pagerank(edges(spark, rows), 1))
    assert got == pytest.approx({"b": 0.15 + 0.85 * 2, "c": 0.15 + 0.85 * 2 / 3, "d": 1.0})


def test_pagerank_empty_and_loops(spark):
    assert ranks(graph.pagerank(edges(spark, []), 3)) == {}
    assert ranks(graph.pagerank(edges(spark, [("a", "b")]), 2, self_loops=True, restrict=True)) == pytest.approx({"a": 1.0})


def test_page_pagerank(spark):
    rows = [("u", "v"), ("v", "u"), ("u", "w#x"), ("y#z", "u")]
    got = {r["row_key"] for r in graph.page_pagerank(edges(spark, rows), 2).collect()}
    assert got == {r[0] for r in spark.range(1).select(F.explode(F.array(F.md5(F.lit("u")), F.md5(F.lit("v"))))).collect()}


def test_domain_edges(spark):
    links = spark.createDataFrame(
        [("http://google.com/aaa", x) for x in ("http://yahoo.com/111", "http://yahoo.com/222", "https://site.com/abd/abd.html")]
        + [("http://google.com/bbb", x) for x in ("http://yahoo.com/444", "http://yahoo.com/333")], "url string, link string",
    )
    got = {tuple(r) for r in graph.domain_edges(links).collect()}
    assert got == {("http://google.com", "http://yahoo.com", 4), ("http://google.com", "https://site.com", 1)}
    back = graph.transpose(graph.domain_edges(links))
    assert {tuple(r) for r in graph.in_neighbors(back, "http://google.com").collect()} == {("http://yahoo.com", 4), ("https://site.com", 1)}
    assert graph.out_neighbors(back, "http://nowhere").collect() == []


def test_links_however_they_are_written(spark):
    page = """<a href="/plain.html">Plain</a> <a class=x href='/single.html'>Single</a> <A HREF="/upper.html">Upper</A>
        <a href="/nested.html">With <b>bold</b> text</a> <a title="a > b" href="/gt.html">Gt</a> <a href="../up.html">Up &amp; away</a>
        <a href=/bare.html>Bare</a> <a data-href="/not.html">Not</a> <a href="/q.php?a=1&amp;b=2">Entity</a> <a name="top">None</a>"""
    pages = spark.createDataFrame([(1, "http://h.org/x/y.html", page), (2, "http://h.org", None)], "page_id bigint, url string, html string")
    got = {r["link"].removeprefix("http://h.org/"): r["anchor"] for r in graph.page_links(pages).collect()}
    assert got == {
        "plain.html": "Plain", "single.html": "Single", "upper.html": "Upper", "nested.html": "With bold text", "gt.html": "Gt", "up.html": "Up & away",
        "bare.html": "Bare", "q.php?a=1&b=2": "Entity",
    }
    # what the JVM's path sees of them
    assert {r["link"] for r in graph.plain_page_links(pages).collect()} <= {f"http://h.org/{x}" for x in ("plain.html", "q.php?a=1&amp;b=2", "not.html")}


def test_resolve_links_dedup(spark):
    rows = [(1, "", i, h, a) for i, (h, a) in enumerate([("http://www.google.com", "first"), ("http://google.com", "second"), ("http://www.google.com/", "third")])]
    anchors = spark.createDataFrame(rows, "page_id int, url string, at int, href string, anchor string")
    assert [tuple(r) for r in graph.resolve_links(anchors).select("link", "anchor").collect()] == [("http://google.com", "first")]
    same = anchors.withColumn("url", F.lit("http://google.com"))
    assert graph.resolve_links(same).collect() == []


def test_top_anchors(spark):
    rows = [("l", a) for a in ["x", "X", "y", "here", "Here", "b", "c", "d", "e", None]]
    got = [tuple(r)[1:] for r in graph.top_anchors(spark.createDataFrame(rows, "link string, anchor string")).orderBy("rank").collect()]
    assert got == [(0, "x", 2), (1, "b", 1), (2, "c", 1), (3, "d", 1), (4, "e", 1)]  # "Here" is no useless anchor, but comes behind


def test_clean_edges_and_subgraph(spark):
    rows = [("a", "a"), ("a", "b"), ("a", "b"), ("a#", "b"), ("b", "c#"), ("b", "a")]
    assert {tuple(r) for r in graph.clean_edges(edges(spark, rows)).collect()} == {("a", "b"), ("b", "a")}
    w = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("c", "a", 3)], "src string, dst string, weight int")
    r = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "node string, rank double")
    inside = graph.top_subgraph(w, r, 2)
    assert [tuple(x) for x in inside.collect()] == [("a", "b", 2)]
    assert to_dot(inside) == 'digraph G {\n  "a" -> "b" [label=2, penwidth=2];\n}\n'
    assert graph.rank_stats(r).first().asDict() == pytest.approx({"total": 4.0, "n": 3, "mean": 4 / 3})


def test_group_keywords(spark):
    g, y = "http://google.com", "http://yahoo.com"
    rows = [(g, "a1", 1.5), (g, "a1", 1.0), (g, "a2", 1.2), (g, "a3", 1.0), (g, "a4", 1.5), (g, "b1", 0.1), (g, "b2", 0.2)]
    rows += [(y, "a1", 2.0), (y, "a1", 2.0), (y, "a4", 4.0), (y, "a2", 5.0), (y, "a5", 5.0), (y, "a3", 6.0), (y, "b5", 3.0), (y, "b5", 3.0), ("http://test.com", "t1", 0.3)]
    got = keywords.group_keywords(spark.createDataFrame(rows, "domain string, keyword string, score double"), "domain").orderBy("domain", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["domain"], []).append(r["keyword"])
    assert by == {g: ["a1", "a4", "a2", "a3", "b2"], y: ["a3", "b5", "a2", "a5", "a1"], "http://test.com": ["t1"]}


def test_keyword_relations(spark):
    e = edges(spark, [("dom1", "dom2"), ("dom1", "dom3"), ("dom9", "dom2")])
    kw = spark.createDataFrame([("dom1", f"a{i}") for i in (1, 2, 3)] + [(d, f"b{i}") for d in ("dom2", "dom3") for i in (1, 2, 3, 4)], "domain string, keyword string")
    got = {(r[0], r[1]): r[2] for r in keywords.keyword_relations(e, kw).collect()}
    assert got == {(f"a{i}", f"b{j}"): 2 for i in (1, 2, 3) for j in (1, 2, 3, 4)}
    two = edges(spark, [("s", "x"), ("s", "y"), ("t", "x"), ("t", "y")])
    kw2 = spark.createDataFrame([("s", "k"), ("t", "k"), ("x", "m"), ("y", "m")], "domain string, keyword string")
    assert [tuple(r) for r in keywords.keyword_relations(two, kw2).collect()] == [("k", "m", 4)]
    assert {tuple(r) for r in keywords.keyword_index(kw2).collect()} == {("k", "s,t"), ("m", "x,y")}


def test_interesting_keywords(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, None), (4, "")], "doc_id int, text string")
    got = [tuple(r) for r in keywords.interesting_keywords(docs, 2).orderBy("doc_id", "rank").collect()]
    import math

    idf = lambda df: 1 + math.log(5 / (df + 1))
    assert got == [(1, 0, "a", 1.0), (1, 1, "b", pytest.approx(idf(1) / (2 * idf(2)))), (2, 0, "c", 1.0), (2, 1, "a", pytest.approx(idf(2) / idf(1)))]


def test_adjacency(spark):
    nodes = spark.createDataFrame([("a", 2.0, ["b", "b", "a", "c#x"]), ("b#", 1.0, ["a"]), ("b", 1.5, [])], "node string, rank double, sinks array<string>")
    clean = graph.clean_adjacency(nodes)
    assert {tuple(map(repr, r)) for r in clean.collect()} == {("'a'", "2.0", "['b']"), ("'b'", "1.5", "[]")}
    assert sorted(map(tuple, graph.from_adjacency(nodes).collect())) == [("a", "a"), ("a", "b"), ("a", "b"), ("a", "c#x"), ("b#", "a")]
    back = graph.to_adjacency(graph.from_adjacency(clean), clean.select("node", "rank"))
    assert [tuple(r) for r in back.collect()] == [("a", 2.0, ["b"])]


def test_ranks_by_changes(spark):
    """The same ranks as by whole steps, with nodes that vanish, targets that are no sources, loops and repeated edges."""
    import random

    draw = random.Random(8)
    pairs = [(f"n{draw.randrange(30)}", f"n{draw.randrange(40)}") for _ in range(150)] + [("root", "mid"), ("mid", "n1"), ("n2", "n2"), ("n3", "n4"), ("n3", "n4")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    for steps in (1, 2, 4):
        want = {r["node"]: r["rank"] for r in graph.pagerank(edges, steps).collect()}
        got = {r["node"]: r["rank"] for r in graph.settled_pagerank(edges, steps, part=2).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ranks_settle(spark):
    """What has come to rest is sent no more, and the iteration ends by itself."""
    chain = [(f"c{i}", f"c{i + 1}") for i in range(6)] + [("a", "b"), ("b", "a"), ("c6", "c6")]
    history = []
    got = {r["node"]: r["rank"] for r in graph.settled_pagerank(spark.createDataFrame(chain, "src string, dst string"), 60, 1e-2, history=history).collect()}
    assert history[-1] == 0 and len(history) < 40 and max(history[8:]) < 9
    assert abs(got["a"] - 1) < 1e-9 and "c0" not in got and "c5" not in got and abs(got["c6"] - 1) < 0.1


def test_a_hot_source_is_many_tasks_work(spark):
    star = spark.range(6000).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst")).unionByName(spark.range(50).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("hub").alias("dst")))
    sizes = [r["count"] for r in graph.split_shares(star, 100).groupBy("src", "part").count().collect() if r["src"] == "hub"]
    assert len(sizes) == 60 and max(sizes) < 160
    want = {r["node"]: r["rank"] for r in graph.pagerank(star, 3).collect()}
    got = {r["node"]: r["rank"] for r in graph.settled_pagerank(star, 3, part=100).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_steps_do_not_sort_the_edges(spark):
    shares = edges(spark, [("a", "b"), ("b", "a")]).withColumn("deg", F.lit(1))
    ranks = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "node string, rank double")
    plan = graph.pagerank_step(shares, ranks)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_pages_come_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        for have, want in ((str(1 << 30), 4 << 20), ("1000", 1000)):
            spark.conf.set(key, have)
            graph.page_links(spark.createDataFrame([(1, "http://a.x/", "<a href='/b'>c</a>")], "page_id long, url string, html string"))
            assert int(spark.conf.get(key).rstrip("b")) == want
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_ranks_added_in_order(spark, partitions):
    """All nodes point at all: ranks are 1 but for the digits that adding one by one leaves, which re-ranking compares with 1."""
    names = [f"n{i}" for i in range(25)]
    edges = spark.createDataFrame([(a, b) for a in names for b in names], "src string, dst string")
    want = 1.0
    for _ in range(3):
        s = 0.0
        for _ in names:
            s += want / 25
        want = 0.15 + 0.85 * s
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["rank"] for r in graph.pagerank(edges, 3, in_order=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert want != 1.0 and got == {want}


def test_steps_leave_neither_shuffles_nor_ranks(spark, tmp_path, monkeypatch):
    """Of many edges, every step's ranks are written; the step's shuffle files and the ranks before go then."""
    monkeypatch.setattr(graph, "MANY_EDGES", 1, raising=False)
    star = edges(spark, [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", "hub") for i in range(40)])
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    had = shuffles()
    got = graph.page_pagerank(star, 6)
    assert not shuffles() - had
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("ranks_")]) == 1
    assert got.count() == 41
