import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from frameloom.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad banner">Buy</div>
<article><h1>Head {n}&amp;</h1><p><b>Bold {n}<br><p>One  {n}\n three&nbsp;four</p><p>Shared words here</p><div class="share">Share me</div></article>
<aside>Side</aside><form><label>Mail</label><input></form><section id="comments"><p>First!</p></section><footer>&copy; x</footer></body></html>"""
TEXT = "Head {n}&\nBold {n}\nOne {n} three four\nShared words here"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_article_without_the_rest(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i), "x") for i in range(8)]
    got = {r.page_id: r for r in h.extract(pages(spark, rows)).collect()}
    for i in range(8):
        assert got[i].text == TEXT.format(n=i) and got[i].n_chars == len(got[i].text)  # shared wording stays in an article


def test_few_pages_have_no_template(spark):
    got = h.extract(pages(spark, [(1, "http://b.example/1", PAGE.format(n=1), None)])).collect()
    assert got[0].text == TEXT.format(n=1)


def outlined(spark, htmls, host="a.example"):
    return h.outlines(pages(spark, [(i, f"http://{host}/{i}", x, None) for i, x in enumerate(htmls)]).withColumn("host", F.lit(host)))


def by_definition(htmls, share):
    """Classes of tokens by their whole vectors of counts, page by page."""
    tags = [h.parse(x)[0] for x in dict.fromkeys(htmls)]
    vectors = defaultdict(list)
    for t in {t for page in tags for t in page}:
        vectors[tuple(Counter(page)[t] for page in tags)].append(t)
    often = {v: frozenset(ts) for v, ts in vectors.items() if sum(n > 0 for n in v) >= share * len(tags)}
    outer = max((v for v in often if set(v) <= {0, 1}), key=lambda v: (sum(v), len(often[v])), default=None)
    return often, outer, tags


@pytest.mark.parametrize("seed", range(4))
def test_classes_equal_the_definition(spark, seed):
    rng = random.Random(seed)

    def page(i):
        records = "".join(f"<li><b>{rng.random()}</b><em>x</em></li>" for _ in range(rng.randint(1, 4)))
        often = f"<section>{'<p>q</p>' * rng.randint(0, 3)}</section>"
        return f"<body><header>{i}</header><ul>{records}</ul><div>a</div><div>b{i}</div>{often if rng.random() < 0.9 else ''}<dl><dt>{rng.random()}</dt><dd>y</dd></dl></body>"

    htmls = [page(i) for i in range(30)] * 2
    often, outer, tags = by_definition(htmls, 0.8)
    outlines = outlined(spark, htmls)
    seen = {r.token: (r.support, r.total) for r in h.occurrence(outlines).collect()}
    assert seen.pop(0) == (30, 30)
    assert seen == {t: (sum(t in p for p in tags), sum(p.count(t) for p in tags)) for p in tags for t in p}
    t = h.templates(outlines, share=0.8).collect()[0]
    div = next(i for i in often for k in [often[i]] if set(i) == {2} and not any(x & 1 for x in k))
    assert set(t.numbered) == often[div] and {r for r in t.order if r in often[outer]} == often[outer]
    assert len(t.order) == len(often[outer]) + 2  # both roles of the div
    valid = {v: k for v, k in often.items() if v != outer and all(_alternate(p, k) for p in tags)}
    assert {frozenset(c[1:]) for c in t.nested} == set(valid.values())


def _alternate(page, one):
    found = [t for t in page if t in one]
    return all(found[i] == found[i % len(one)] for i in range(len(found)))


def test_a_class_without_one_order_is_no_template(spark):
    htmls = [f"<body><i>{i}</i><div>x</div><ul>y</ul></body>" if i % 2 else f"<body><i>{i}</i><ul>y</ul><div>x</div></body>" for i in range(20)]
    assert h.templates(outlined(spark, htmls)).count() == 0
    assert h.templates(outlined(spark, htmls[::2])).count() == 1


def plain(n, mark):
    """A page whose markup says nothing: link list, advert, article, notice."""
    rng = random.Random(n)
    words = lambda k: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(k))
    text = [words(6), *[words(rng.randint(5, 60)) for _ in range(rng.randint(1, 5))], "Wording that all articles share."]
    box = lambda k, inner: f'<div class="{k}">{inner}</div>' if mark else f"<div>{inner}</div>"
    menu = "<ul>" + "".join(f"<li><a href=/>{x}</a></li>" for x in ("Home", "World", words(1))) + "</ul>"
    return "<html><body>" + box("q", menu) + box("r", "Buy " + words(3)) + box("s", f"<h2>{text[0]}</h2>" + "".join(f"<p>{x}</p>" for x in text[1:])) + box("t", "All rights reserved, call us at once") + "</body></html>", "\n".join(text)


@pytest.mark.parametrize("mark", [True, False])
def test_only_the_template_can_tell(spark, mark):
    made = [plain(i, mark) for i in range(40)]
    got = {r.page_id: r.text for r in h.extract(pages(spark, [(i, f"https://c.example/{i}", x, "t") for i, (x, _) in enumerate(made)])).collect()}
    assert got == {i: text for i, (_, text) in enumerate(made)}
    assert all(h.main_text(x) != text for x, text in made)  # without it every page is wrong


def test_given_pages_with_meaningless_markup(spark):
    """The article of each page of the given table, found with all meaning taken out of its markup."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = df.select("page_id", "url", "html", h.host_of(F.col("url")).alias("host"))
    want = {r.page_id: h.main_text(r.html) for r in rows.collect()}
    many = {r.host for r in rows.groupBy("host").count().where("count >= 12").collect()}
    veiled = F.col("html")
    for name in ("nav", "article", "footer", 'div class="ad"'):
        veiled = F.regexp_replace(F.regexp_replace(veiled, f"<{name}>", "<div>"), f"</{name.split()[0]}>", "</div>")
    got = [r for r in h.extract(rows.withColumn("html", veiled)).join(rows.select("page_id", "host"), "page_id").collect() if r.host in many]
    assert len(got) > 50 and all(r.text == want[r.page_id] for r in got)


def test_names_of_extra_columns_do_not_matter(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i), None) for i in range(6)]
    df = pages(spark, rows)
    more = df.withColumns({c: F.lit("x") for c in ("host", "page", "tags", "order", "slots", "token", "_salt", "n_chars", "word")})
    assert {r.text for r in h.extract(more).collect()} == {TEXT.format(n=i) for i in range(6)}


def test_decide_keeps_near_copies_and_the_headline_beside():
    slot = lambda i, chars, chain, **x: h.Slot(**{"slot": i, "chars": chars, "link": 0, "fixed": 0, "inside": 0, "own": 0, "chain": chain} | x)
    body = [slot(1, 900, (5,), own=900), slot(2, 50, (6,), fixed=50), slot(3, 60, (7,), link=60), slot(4, 20, (), own=20), slot(5, 30, (8,))]
    assert h.decide(body) == {1, 4}
    assert h.decide([slot(1, 900, (5,), fixed=900, own=900), slot(2, 50, (6,))]) == {1}
    assert h.decide([]) == frozenset()


def test_odd_pages(spark):
    rows = [(1, None, None, "c"), (2, "not a url", "", "c"), (None, "http://c.example/", "<p>a < b &lt; c", "c"), (4, "http://c.example/", "<article>cut <b>off", None), (4, "http://c.example/", "<article>cut <b>off", None), (5, "x://y", "<p>" + "long " * 100000, None), (6, "http://d/", "plain words", None), (7, "http://d/", "<!-- never closed", None), (8, "http://d/", "<script>x", None)]
    got = h.extract(pages(spark, rows)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert by[1] == "" and by[2] == "" and by[None] == "a < b < c" and by[4] == "cut off" and by[6] == "plain words" and by[7] == "" and by[8] == ""
    assert len(by[5]) == 499999


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i), "x") for i in range(8)]
    monkeypatch.setattr(h, "BROADCAST_TOKENS", 0)
    assert {r.text for r in h.extract(pages(spark, rows)).collect()} == {TEXT.format(n=i) for i in range(8)}


@pytest.mark.parametrize("page, text", [("<ul><li>a<li>b</ul>", "a\nb"), ("<div>a<p>b</div>c", "a\nb\nc"), ("<p>a<i>b</i>c</p>", "abc"), ("<td>1</td><td>2</td>", "1\n2"), ("<main><p>m</p></main><p>o</p>", "m"), ("<p hidden>x</p><p>y</p>", "y"), ("<div><a href=x>l</a></div><p>t <a>u</a></p>", "t u"), ('<article><div class="post-header"><h1>h</h1></div><p>t</p><article class="comment">c</article></article>', "h\nt")])
def test_blocks(page, text):
    assert h.main_text(page) == text


def test_empty(spark):
    assert h.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("n", [5, 1000])
def test_copies_of_a_page_keep_their_text(spark, n):
    want = TEXT.format(n=1)
    rows = [(i % max(n // 2, 1), f"http://a.example/{i % 3}", PAGE.format(n=1), None) for i in range(n)]
    rows += [(i, f"http://b.example/{i}", PAGE.format(n=1).replace("Side", f"Side {i}"), None) for i in range(n)]
    got = h.extract(pages(spark, rows)).collect()
    assert len(got) == 2 * n and {r.text for r in got} == {want}


@pytest.mark.parametrize("page, text", [
    ('<article><section id="discussion"><p>a</p></section><h2 id="related">b</h2><div class="notice">c</div><p class="alert">d</p><div id="search">e</div><div class="modal rail">f</div></article>', "a\nb\nc\nd\ne\nf"),
    ('<div><h1 class="header">t</h1><div class="post-header"><p>l</p></div><div class="site-header">s</div></div>', "t\nl"),
    ('<main><h1>t</h1><article><p>a</p></article><p>b</p></main>', "t\na\nb"),
    ('<article><p>a</p><div class="comments">c</div><section id="comments">d</section><div class="ad">e</div></article>', "a"),
])
def test_an_articles_own_sections_stay(page, text):
    assert h.main_text(page) == text
