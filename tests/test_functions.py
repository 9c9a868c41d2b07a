import pytest
from pyspark.sql import functions as F

from weftline.functions import dates, html, lang, text, urls


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(expr.alias("x")).first()["x"]


# URLs are put together from parts, and what is expected of them from the same parts, so that the models parse nothing.
SCHEMES, HOSTS = ["http", "https"], ["k9.test", "q.k9.test:8443", "me@k9.test"]
PATHS = [[], [""], ["r"], ["r", ""], ["r", "S2.html"], ["r", "s", "t.php?x=1&y=2"]]


def all_of(spark, expr, rows, *cols):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["i int", *(f"{c} string" for c in cols)]))
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def url(scheme, host, path):
    return "/".join([f"{scheme}://{host}" if scheme else host, *path])


@pytest.mark.parametrize("case", [str.lower, str.upper, str.title])
@pytest.mark.parametrize("www", ["", "www."])
def test_names_of_urls(spark, case, www):
    parts = [(s, h, p, slashes) for s in [*SCHEMES, ""] for h in HOSTS for p in PATHS if p != [""] and p[-1:] != [""] for slashes in ("", "/", "///")]
    given = [(case(url(s, www + h, p)) + slashes,) for s, h, p, slashes in parts]
    u = F.col("u")
    assert all_of(spark, urls.normalize_url(u), given, "u") == [url(s, www + h, p).lower() for s, h, p, _ in parts]
    assert all_of(spark, urls.simple_url(u), given, "u") == [url("", h, p).lower() for s, h, p, _ in parts]
    assert all_of(spark, urls.host_name(u), given, "u") == [h for s, h, p, _ in parts]
    lowered = [(g.lower(),) for (g,) in given]
    assert all_of(spark, urls.domain(u), lowered, "u") == [url(s, www + h, []) for s, h, p, _ in parts]
    assert all_of(spark, urls.strip_www(u), lowered, "u") == [url(s, h if s else www + h, p).lower() + slashes for s, h, p, slashes in parts]
    bare = [(g, p) for g, p in zip(lowered, parts, strict=True) if p[0]]
    assert all_of(spark, urls.abs_link(u), [g for g, _ in bare], "u") == [url("", www + h, p).lower() + slashes for _, (s, h, p, slashes) in bare]


@pytest.mark.parametrize("f", [urls.normalize_url, urls.simple_url, urls.domain, urls.host_name, urls.url_hash, urls.strip_www, urls.abs_link])
def test_no_url(spark, f):
    assert one(spark, f(F.col("u")), u=None) is None
    assert one(spark, f(F.col("u")), u="") == ("d41d8cd98f00b204e9800998ecf8427e" if f is urls.url_hash else "")


def references():
    """(reference, what it gives on a base of (scheme, host, path)), kind by kind."""
    rest = ["", "x", "x/Y.html", "x?k=1"]
    for s in SCHEMES:
        for r in rest:
            yield url(s, "far.test", [r]), lambda b, r=r, s=s: url(s, "far.test", [r])
    for r in rest:
        yield f"javascript:{r}", lambda b: "#"
        yield f"//far.test/{r}", lambda b, r=r: url("http" if b[0] == "http" else "https", "far.test", [r])
        yield f"./{r}", lambda b, r=r: url(*b[:2], [*b[2][:-1], r]) if b[2] else "#"
        yield f"/{r}", lambda b, r=r: url(*b[:2], [r])
        yield r, lambda b, r=r: url(*b[:2], [*b[2][:-1], r])
        for ups in (1, 2, 5):
            yield "../" * ups + r, lambda b, r=r, ups=ups: url(*b[:2], [*b[2][:-1][: max(0, len(b[2][:-1]) - ups)], r])


def test_resolve_url(spark):
    bases = [(s, h, p) for s in SCHEMES for h in HOSTS for p in PATHS]
    asked = [(b, ref, want(b)) for b in bases for ref, want in references()]
    got = all_of(spark, urls.resolve_url(F.col("b"), F.col("h")), [(url(*b), ref) for b, ref, _ in asked], "b", "h")
    assert [(url(*b), ref, g) for (b, ref, _), g in zip(asked, got, strict=True)] == [(url(*b), ref, w) for b, ref, w in asked]
    # without the UDF '..' has no target, and nothing else changes
    plain = all_of(spark, urls.resolve_url(F.col("b"), F.col("h"), up=False), [(url(*b), ref) for b, ref, _ in asked], "b", "h")
    assert plain == ["#" if ref.startswith("..") else w for _, ref, w in asked]


def test_resolve_url_without_a_scheme_or_base(spark):
    rows = [("k9.test", "./x"), ("k9.test", "x"), ("k9.test", "../x"), ("k9.test", "//far.test"), (None, "x"), ("http://k9.test", None)]
    assert all_of(spark, urls.resolve_url(F.col("b"), F.col("h")), rows, "b", "h") == ["#", "k9.test/x", "#", "https://far.test", None, None]


def test_resolve_url_legacy(spark):
    """Hosts by their dots, and what names the base's host, stay; the rest hangs below the base's directory."""
    for path in (["r", "s"], ["r", "s", ""], []):
        base = ("https", "k9.test", path)
        below = [(r, url(*base[:2], [*path[:-1], r.lstrip("/")])) for r in ("x", "x/y", "/x", "x.html", "x.php?k=1", "a.b/c.html"[4:])]
        stay = [(r, r) for r in ("http://far.test/x", "https://far.test", "far.test", "sub.far.test", "far.test/x", "/at/k9.test")]
        rows = below + stay
        assert all_of(spark, urls.resolve_url_legacy(F.col("b"), F.col("h")), [(url(*base), r) for r, _ in rows], "b", "h") == [w for _, w in rows]


def test_is_valid_link(spark):
    """By the parts of a link: its scheme, whether it has a path, the suffix of the last part, a fragment."""
    rows, want = [], []
    for scheme in [*SCHEMES, "", "ftp", "HTTP"]:
        for path in PATHS[:4]:
            for suffix, page in [("", True), (".html", True), (".php?x=1", True), (".htmlx", True), (".pdf", False), (".tar.gz", False), (".", False), (".HTML", False)]:
                if suffix and not (path and path[-1]):
                    continue
                for fragment in ("", "#top"):
                    link = url(scheme, "k9.test", [*path[:-1], path[-1] + suffix] if path else path) + fragment
                    rows.append((link,))
                    want.append(page and not fragment and scheme in ("http", "https", ""))
    rows += [("base",), ("#",), ("mailto:me@k9.test",), ("me.too",), (None,)]
    want += [False, False, False, True, None]
    got = all_of(spark, urls.is_valid_link(F.col("u"), F.lit("base")), rows, "u")
    assert list(zip(rows, got, strict=True)) == list(zip(rows, want, strict=True))


def test_parse_page():
    page = html.parse_page("http://e.x", '<html><head><title>Warp  &amp; weft</title><meta charset="utf-8"><meta name="author" content="w"><style>p{}</style></head><body><h1>On &lt;looms&gt;</h1><p>One<p>two <b>bold<script>var t="</p>";</script><a href="http://loom.example/a/b">The next one</a></body></html>')
    assert page["title"] == "Warp & weft" and page["h1"] == "On <looms>" and page["h2"] == []
    assert page["links"] == [{"link": "http://loom.example/a/b", "anchor": "The next one"}]
    assert [m["charset"] for m in page["metas"]] == ["utf-8", ""] and page["text"] == "On <looms> One two boldThe next one"
    empty = html.parse_page("u", None)
    assert empty["title"] == "" and empty["h1"] is None and empty["links"] == []


def test_element_text():
    assert html.element_text('<div class="a">x <div>y</div> z</div><div class="a">w</div>', "class", "a") == "x y z"
    assert html.element_text("<p>x</p>", "class", "a") is None and html.element_text(None, "class", "a") is None


def test_porter():
    # pairs of the published description of the algorithm
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert [text.porter(w) for w in pairs[::2]] == pairs[1::2]


def test_english_tokens():
    assert text.english_tokens("The Dog's running, and the cats") == [("dog", 1), ("run", 2), ("cat", 5)]
    assert text.english_tokens(None) == []


def test_simple_terms(spark):
    assert one(spark, text.simple_terms(F.col("t")), t="É a-b, 1!") == ["é", "a", "b", "1"]
    assert one(spark, text.simple_terms(F.col("t")), t=None) == []


def test_is_english(spark):
    rows = spark.createDataFrame([("the weaver sat at the loom",), ("le tisserand était à son métier",), ("",), (None,), ("12 34",)], "t string")
    assert [r[0] for r in rows.select(lang.is_english(F.col("t"))).collect()] == [True, False, False, False, False]


def test_fit_profiles(spark):
    rows = spark.createDataFrame([("en", "the cat and the dog"), ("xx", "zzq qqz zqz"), (None, "a"), ("en", None)], "lang string, text string")
    p = lang.fit_profiles(rows)
    assert set(p) == {"en", "xx"} and lang.probabilities("the dog", p)["en"] > 0.9 and lang.probabilities("", p) == {}


def test_pub_dates(spark):
    given = ["Tue, 07 Aug 2018 12:30 +0000", "07 Aug 2018 13:30:05 +0430", "Tue, 07 Aug 2018 23:00:01 GMT", "2018-08-07T01:02:03 +0000", "2018-08-07T01:02:03+0000", "soon", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, t string")
    got = rows.orderBy("i").select(F.date_format(dates.parse_pub_date(F.col("t"), F.lit("2000-01-01 00:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("x")).collect()
    assert [r["x"] for r in got] == ["2018-08-07 12:30:00", "2018-08-07 09:00:05", "2018-08-07 23:00:01", "2018-08-07 01:02:03", "2018-08-07 01:02:03", "2000-01-01 00:00:00", "2000-01-01 00:00:00"]
