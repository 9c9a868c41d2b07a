import html
import itertools
import random
import re

import pytest

from weftline.llm import maintext as mt

PRIORS = mt.learned({})
STORY = ["Ferry returns to the harbour", "The ferry came back on Monday after eleven weeks in the yard, and hundreds of people waited on the quay to see it.", "Its new engines are quieter, the captain said. They use a third less fuel than the old ones did.", "Short one.", "Tickets are sold from Thursday on, at the old prices, and children travel free until the end of the school year."]
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Weather and tides</a></li></ul>"
P = "".join(f"<p>{s}</p>" for s in STORY[1:])
H = f"<h1>{STORY[0]}</h1>"

PAGES = {
    "marked": f"<html><head><title>x y z</title><style>p{{}}</style></head><body><nav>{MENU}</nav><div>An offer you should not miss today or ever</div><article>{H}{P}</article><p>Another paragraph that is not part of it</p></body>",
    "all kinds left out": f"<body><header><p>The daily paper of the coast</p></header><main><article>{H}<script>if (a<b) document.write('<p>no</p>')</script>{P}<aside><p>An aside of some length about other things</p></aside>"
    "<form><p>Sign up <input name=q><button>Go</button></p></form><div class='ad-box big'><p>Buy this now, it is cheap and good</p></div><div class=cookie-notice>We use cookies to make this site better for you.</div>"
    "<section id=comments><h2>Comments</h2><p>I was there and saw it with my own eyes, great boat and a fine crew!</p></section></article></main><footer><p>Copyright of the paper and all who write in it</p></footer></body>",
    "named only": f"<body><div id=header><p>The daily paper of the coast, since 1901</p></div><div class=menu>{MENU}</div><div id=content class='post with-sidebar'>{H}{P}</div>"
    f"<div class=sidebar><p>Most read of the week: something else altogether</p></div><ol class=commentlist><li><p>What a fine boat it is, says a reader of this paper</p></li></ol><div role=contentinfo><p>All rights reserved by us</p></div></body>",
    "nothing named": f"<body><div>{MENU}</div><div>{H}{P}</div><div>{MENU}</div><div>All rights reserved</div></body>",
    "tables": f"<table><tr><td><a href=x>Home</a><td><a href=y>News</a><tr><td>{H}{P}</table>",
    "unclosed": f"<body><nav><ul><li><a href=x>Home<li><a href=y>News</ul></nav><article>{H}" + "".join(f"<p><b>{s}" for s in STORY[1:]) + "</article><footer>end of it all, my friends",
    "wrapped in a form": f"<body><form id=aspnet><div class=menu>{MENU}</div><div>{H}{P}</div></form></body>",
    "article's own header": f"<body><header>{MENU}</header><article><header>{H}</header>{P}<footer>Filed under boats</footer></article>",
    "wrapper's name means something else": f"<body><div class='widget-area'><main>{H}{P}</main></div></body>",
    "hidden": f"<article>{H}<div hidden><p>not seen by any reader</p></div><p style='display: none'>nor is this one seen</p>{P}</article>",
    "comments in markup": f"<!-- <article><p>old text</p></article> --><article>{H}<!-- > -->{P}<!-- never closed <p>more",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert mt.Page(PAGES[name]).text(PRIORS) == "\n".join(STORY)


def test_text_of_blocks():
    page = "<article><p>a&nbsp;&amp;&#33; \n\t b<br>c &lt;p&gt; d<i>e</i>f < 5 > 3 &unknown; &copy</p><ul><li>x<li> y </ul><pre>\n k\n  l</pre>tail</article>"
    assert mt.Page(page).text(PRIORS) == "a &! b c <p> def < 5 > 3 &unknown; ©\nx\ny\nk l\ntail"


@pytest.mark.parametrize(("page", "want"), [("", ""), ("plain words only", "plain words only"), ("<p></p>", ""), ("<script>x y z", ""), ("<p>cut off <a href='", "cut off"), ("<", "<"), ("a <b", "a"), ("</p></div>x", "x"), ("<title>t</title>", ""), ("<p title='a > b'>x</p>", "x"), ("<p title=don't>x</p>", "x"), ("<P CLASS=Ad>no</P><P>yes", "yes"), ("<svg/><p>x", ""), ("<x-y/>z w", "z w")])
def test_odd_pages(page, want):
    assert mt.Page(page).text(PRIORS) == want


def test_best_run_is_the_best():
    draw = random.Random(3)
    for _ in range(400):
        scores = [draw.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(draw.randint(0, 12))]
        runs = [(sum(scores[a:b]), -a, -b) for a, b in itertools.combinations(range(len(scores) + 1), 2)]
        best = max(runs, default=(0,))
        assert mt.best_run(scores) == ((-best[1], -best[2]) if best[0] > 0 else (0, 0)) or sum(scores[slice(*mt.best_run(scores))]) == best[0]


def test_long_and_deep_pages_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 80_000):
        pages = ["<div>" * n + "</span>" * n, "<p>word " * n, "<a '" * n, "<!" * n, "< " * n, "<b>x</i>" * n, "&" * n, "<form>" * (n // 100) + "x"]
        began = time.perf_counter()
        for page in pages:
            mt.Page(page).text(PRIORS)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_weights_are_learned_and_layout_does_not_count(spark):
    draw = random.Random(1)
    words = lambda n: " ".join(draw.choice(["sea", "wind", "boat", "rope"]) for _ in range(n))
    made = [f"<body><div><span>{words(4)}</span></div><article><h1>{words(3)}</h1>{''.join(f'<p>{words(20)}</p>' for _ in range(3))}</article><div>{words(9)}</div><table><tr><td>{words(9)}</table></body>" for _ in range(120)]
    rows = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(made)], "page_id bigint, url string, html string, h string")
    by = [mt.weights(rows.repartition(n)) for n in (1, 5)]
    assert by[0] == by[1]
    assert by[0]["paragraph"] == mt.MOST and by[0]["bare"] == mt.LEAST < PRIORS["bare"] and by[0]["div"] < PRIORS["div"]
    # what is learned holds for pages without marks
    plain = made[0].replace("article>", "div>")
    want = "\n".join(re.findall(r"<(?:h1|p)>(.*?)</", made[0]))
    assert mt.Page(plain).text(by[0]) == want
    assert len(mt.weights(rows, limit=10)) == len(by[0])


def test_whole_query(sf, spark, tmp_path):
    rows = [tuple(r) for r in mt.op13_main_text(spark, sf[0]).collect()]
    assert sorted(rows, key=repr) == sorted([(1, "u", "x", 1), (2, None, "", 0), (3, "u\n v", "", 0), (None, "u", "x", 1), (1, "u", "x", 1), (9, "w", "y" * 100_000, 100_000)], key=repr)
    assert mt.op13_main_text(spark, sf[1]).collect() == []


def test_articles_of_the_given_pages(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in mt.op13_main_text(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = r["html"].partition("<article>")[2].partition("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])
