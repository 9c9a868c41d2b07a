import json
import math
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from weftline.operators import search
from weftline.schemas import PAGE
from weftline.service import Service, serve

DOCS = [(1, "red fox jumps", "fox"), (2, "the red red dog", "dog"), (3, "fox red", None), (4, None, None)]


@pytest.fixture(scope="module")
def index(spark):
    return search.build_index(spark.createDataFrame(DOCS, "doc_id int, text string, title string"), "doc_id", ["text", "title"]).cached()


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def bm25(tf, df, n, length, avg):
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))


def test_best_fields(index):
    got = scores(search.simple_search(index, "fox"))
    assert got == pytest.approx({1: max(5 * bm25(1, 2, 3, 3, 3), 2 * bm25(1, 1, 2, 1, 1)), 3: 5 * bm25(1, 2, 3, 2, 3)})
    assert scores(search.simple_search(index, "nothing")) == {}
    assert scores(search.simple_search(index, "fox", blocked=["red fox", ""])) == pytest.approx({3: 5 * bm25(1, 2, 3, 2, 3)})


def test_phrases(index):
    assert set(scores(search.advanced_search(index, ["red fox"], [], []))) == {1}
    assert set(scores(search.advanced_search(index, ["red"], ["fox jumps"], []))) == {2, 3}
    assert set(scores(search.advanced_search(index, ["", " "], [""], ["fox red", "red dog"]))) == {2, 3}
    both = scores(search.advanced_search(index, ["red"], [], ["fox"]))
    assert set(both) == {1, 2, 3} and both[1] > scores(search.advanced_search(index, ["red"], [], []))[1]
    assert scores(search.advanced_search(index, [], [], [])) == {}


def test_rerank(spark):
    hits = spark.createDataFrame([("http://a.x/1", 1.0), ("http://b.x/2", 3.0), ("http://c.x/3", 2.0), ("http://d.x/4", 9.0)], "url string, score double")
    ranks = spark.createDataFrame([("http://a.x", 5.0), ("http://b.x", 1.0), ("http://c.x", 1.5)], "node string, rank double")
    assert [tuple(r) for r in search.rerank_by_domain(hits, ranks).select("url", "score").collect()] == [("http://a.x/1", 5.0), ("http://c.x/3", 3.0)]


def test_decay(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([("2024-01-01 11:45:00",), ("2024-01-01 07:30:00",), ("2024-01-01 16:30:00",)], "t string")
    assert [r[0] for r in rows.select(search.decay(F.col("t").cast("timestamp"), now)).collect()] == pytest.approx([1.0, 0.5, 0.5])


def test_page_fields_and_updates(spark):
    meta = lambda n, c: {"name": n, "content": c, "charset": "", "http_equiv": "", "scheme": ""}
    page = ("u", "t", "x", "h", ["a", "b"], [], [meta("description", "old"), meta("description", "new"), meta("Keywords", "no")])
    rows = search.page_fields(spark.createDataFrame([page], PAGE))
    r = rows.first()
    assert (r["h2"], r["description"], r["keywords"], r["anchors"]) == (" a b", "new", "", "")
    more = spark.createDataFrame([("u", "click")], "link string, anchors string")
    assert search.page_fields(spark.createDataFrame([page], PAGE), more).first()["anchors"] == "click"
    up = rows.select("doc_key", F.lit("T").alias("title"), F.lit(None).cast("string").alias("text"))
    assert search.update_fields(rows, up).select("title", "text").first() == ("T", "x")


def test_index_round_trip(spark, index, tmp_path):
    index.write(str(tmp_path))
    again = search.Index.read(spark, str(tmp_path), "doc_id")
    assert scores(search.simple_search(again, "red fox")) == pytest.approx(scores(search.simple_search(index, "red fox")))


def test_service(spark, index):
    urls = spark.createDataFrame([(i, f"http://s{i}.x/p") for i in (1, 2, 3, 4)], "doc_id int, url string")
    ranks = spark.createDataFrame([("http://s3.x", 4.0), ("http://s1.x", 1.0)], "node string, rank double")
    graph = spark.createDataFrame([("a", "b", 2), ("c", "b", 1)], "src string, dst string, weight int")
    trends = spark.createDataFrame([(1, "second"), (0, "first")], "rank int, word string")
    news = urls.select("doc_id", "url", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("pub_date"))
    s = Service(index, urls, ranks, graph, trends, (index, news), ["jumps"], lambda: F.lit("2024-01-01 01:00:00").cast("timestamp"))
    call = lambda m, *p: json.loads(s.handle(json.dumps({"jsonrpc": "2.0", "id": 7, "method": m, "params": list(p)})))
    assert call("ping") == {"jsonrpc": "2.0", "id": 7, "result": "pong"}
    assert {u for u, _ in call("normalSearch", "fox", False, False)["result"]} == {"http://s1.x/p", "http://s3.x/p"}
    assert call("normalSearch", "fox", True, False)["result"] == [["http://s3.x/p", ""]]
    assert call("normalSearch", "fox", False, True)["result"] == [["http://s3.x/p", ""]]
    assert call("advanceSearch", ["red fox"], [""], [], False, False)["result"] == [["http://s1.x/p", ""]]
    assert call("newsSearch", "dog")["result"] == [["http://s2.x/p", "2024-01-01 00:00:00"]]
    assert call("keywords")["result"] == [["first", ""], ["second", ""]]
    assert call("getSink", "a")["result"] == [["b", 2]] and call("getSource", "b")["result"] == [["a", 2], ["c", 1]] and call("getSink", "?")["result"] == []
    assert call("nope")["error"]["code"] == -32601 and json.loads(s.handle("{"))["error"]["code"] == -32700 and call("getSink")["error"]["code"] == -32602
    server = serve(s, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/any", json.dumps({"jsonrpc": "2.0", "id": 1, "method": "ping"}).encode())
        with urllib.request.urlopen(request) as r:
            assert json.load(r)["result"] == "pong" and r.headers["Access-Control-Allow-Origin"] == "*"
    finally:
        server.shutdown()


ENGLISH = [(1, "The pages of a book, turned", None), (2, "one page and booking", "Pages"), (3, "pages, books", "nothing's here"), (4, None, ""), (5, "the of and", None), (6, "page in the book", None)]


def test_english_index(spark):
    from weftline.functions import text

    docs = spark.createDataFrame(ENGLISH, "doc_id int, text string, title string")
    index = search.build_index(docs, "doc_id", ["text", "title"], text.ENGLISH).cached()
    got = {(r["doc_id"], r["field"], r["term"]): (r["tf"], r["positions"]) for r in index.postings.collect()}
    want = {}
    for i, *values in ENGLISH:
        for f, value in zip(("text", "title"), values, strict=True):
            for t, at in text.english_tokens(value):
                want.setdefault((i, f, t), []).append(at)
    assert got == {k: (len(v), v) for k, v in want.items()}
    assert {(r["doc_id"], r["field"]): r["len"] for r in index.lengths.collect()} == {(1, "text"): 3, (2, "text"): 3, (2, "title"): 1, (3, "text"): 2, (3, "title"): 2, (6, "text"): 2}
    assert set(scores(search.simple_search(index, "PAGE's"))) == {1, 2, 3, 6} and scores(search.simple_search(index, "the")) == {}
    # a stop word in a phrase keeps its place, whichever it is
    phrase = lambda p: set(scores(search.advanced_search(index, [p], [], [])))
    assert phrase("pages and a books") == {1, 6} and phrase("pages books") == {3} and phrase("page of books") == {2} == phrase("page and book")
    assert phrase("the of") == set() and set(scores(search.advanced_search(index, ["books", "the"], ["pages books"], []))) == {1, 2, 6}
    # stems that are stored with an index serve the next one
    stems = text.stem_table(docs.select(F.explode(text.english_words(F.col("text"))["word"]).alias("word")))
    assert {tuple(r) for r in stems.collect()} == {("pages", "page"), ("turned", "turn"), ("booking", "book"), ("books", "book"), ("one", "on")}
    again = search.build_index(docs, "doc_id", ["text"], text.ENGLISH, stems)
    assert set(scores(search.best_fields(again, ["book"], {"text": 1.0}))) == {1, 2, 3, 6}


def test_service_over_an_english_index(spark):
    from weftline.functions import text

    docs = spark.createDataFrame(ENGLISH, "doc_id int, text string, title string")
    urls = docs.select("doc_id", F.concat(F.lit("http://s.x/"), "doc_id").alias("url"))
    none = spark.createDataFrame([], "node string, rank double")
    s = Service(search.build_index(docs, "doc_id", ["text", "title"], text.ENGLISH), urls, none, none, none)
    assert {u for u, _ in s.normal_search("booked")} == {f"http://s.x/{i}" for i in (1, 2, 3, 6)}
    assert s.advance_search(["paging the books"], [], []) == [["http://s.x/2", ""]]


def test_english_words_are_the_tokens(spark):
    from weftline.functions import text

    samples = ["Don't the dog's O’Neil’s 12th's", "", None, "É à l'eau ²x _y_ a_b", "the THE's", "x's's 's", "中文 are here"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string").select("i", F.inline(text.english_words(F.col("t"))))
    got = sorted((r["i"], r["pos"], r["term"]) for r in text.stemmed(rows).collect())
    assert got == sorted((i, at, w) for i, t in enumerate(samples) for w, at in text.english_tokens(t))


def test_porter_in_sql():
    import duckdb

    from weftline.functions import text

    words = "yyy sayyed yyed flying syyings by toys bedded tilling hissed fizzing controlled ingot sing conditional vietnamization trying eed agreed xeed at ation lly ll aably happier y's ä ii nationally"
    words = sorted(set(words.split()) | {a + b for a in ("rat", "hop", "troy", "ayb", "bly", "o", "abil", "sensit") for b in ("ing", "ed", "s", "ies", "ational", "izer", "ness", "fully", "ement", "ion", "e", "y", "ly")})
    con = duckdb.connect()
    con.execute("CREATE TABLE given (word VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?)", [(w,) for w in words])
    assert dict(con.sql(f"WITH {text.porter_sql('given')} SELECT word, stem FROM stems").fetchall()) == {w: text.porter(w) for w in words}
