import pytest

from logloom.llm import html_text as H

PAGE = "page_id long, url string, html string, host string, main_text string"


def text(html, templates=frozenset()):
    return H.text_of(H.walk(html, templates)[0])


@pytest.mark.parametrize("html, want", [
    ("", ""), ("plain", "plain"), ("<p>a<p>b &amp; c&nbsp;d<br>e", "a\n\nb & c d e"),
    ("<head><title>t</title></head><body><nav>n</nav><p>x</p></body>", "x"),
    ("<article><h1>T</h1><p><b>one<br><p>two</p></article><footer>f</footer>", "T\n\none\n\ntwo"),
    ("<script>var t='</p><p>no';</script><p>yes</p><style>p{}</style>", "yes"),
    ("<div class='ad'>buy</div><div id=sidebar>s</div><div class=shadow>kept</div>", "kept"),
    ("<article>a<section class=comments><article>c</article></section></article>", "a"),
    ("<article>a</article><article class='comment'>c</article>", "a"),
    ("<main><header>h</header>x<aside>y</aside><form><input>z</form></main>out", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
    ("a < b <c", "a < b <c"), ("<!-- x --><p>y<!-- open", "y"), ("<p title='a>b'>q</p>", "q"),
    ("</p></div>x</b>", "x"), ("<p>&lt;b&gt; &#233; &am</p>", "<b> é &am"), ("<div hidden>h</div><p>v", "v"),
    ("<div role=navigation>n</div><div>v</div>", "v"), ("<p>a\n\t b</p>", "a b"),
])
def test_walk(html, want):
    assert text(html) == want


def test_long_and_broken_input_is_linear():
    for html in ("<a" * 100_000, "<div>" * 50_000 + "x", "<p>" + "w " * 500_000, '<a "' * 50_000, "<!--" * 50_000, "&" * 100_000):
        text(html)


def pages(article="<article><p>Text {i}.</p></article>"):
    rows = []
    for i in range(20):
        box = "<div class=x>Read our paper</div>" if i % 2 else ""
        rows.append((i, "http://a.example/p", f"<body>{box}{article.format(i=i)}<p>Always {i % 1}</p></body>"))
    return rows


@pytest.mark.parametrize("limit", [H.BROADCAST_ROWS, 0])
def test_templates_are_removed_per_host(spark, limit):
    rows = pages("<div class=body><p>Text {i}.</p><div class=x>Read our paper</div></div>")
    rows += [(100 + i, "http://b.example/", "<body><div class=x>Read our paper</div><p>Own " + str(i) + "</p></body>") for i in range(3)]
    rows += [(200, None, None), (201, "no url", ""), (200, None, None)]
    df = spark.createDataFrame([(*r, "h", "m") for r in rows], PAGE)
    got = [(r.row.page_id, r.main_text) for r in H.extract(df, broadcast_rows=limit).collect()]
    want = [(i, f"Text {i}.") for i in range(20)] + [(100 + i, f"Read our paper\n\nOwn {i}") for i in range(3)] + [(200, ""), (200, ""), (201, "")]
    assert sorted(got) == sorted(want)


def test_articles_keep_recurring_paragraphs_and_copies(spark):
    same = "<body><article><p>Shared line.</p><ul><li>one</li></ul></article></body>"
    rows = [(i, "http://a.example/", same) for i in range(30)]
    rows += [(50 + i, "http://a.example/", f"<body><article><p>Shared line.</p><p>{i}</p></article></body>") for i in range(30)]
    df = spark.createDataFrame([(*r, "h", "m") for r in rows], PAGE)
    got = {r.row.page_id: r.main_text for r in H.extract(df).collect()}
    assert got == {i: "Shared line.\n\none" for i in range(30)} | {50 + i: f"Shared line.\n\n{i}" for i in range(30)}


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], PAGE)).count() == 0


@pytest.mark.parametrize("html, want", [
    ("<article><h2 class=section-header>H</h2><div class=entry-header><h1>T</h1></div><p>x</p></article>", "H\n\nT\n\nx"),
    ("<article><h2 id=related-work>R</h2><section id=social-history><p>s</p></section><p class=notice>n</p></article>", "R\n\ns\n\nn"),
    ("<article><h2 id=cookies class=promotion>C</h2><p role=alert>a</p></article>", "C\n\na"),
    ("<article><p>a <math><mi>x</mi><mo>=</mo></math> b <object>o</object><noscript>n</noscript></p></article>", "a x= b on"),
    ("<article><p>a</p><div class='box related'>r</div><ul role=menu><li>m</ul><div class=ads>d</div></article>", "a"),
    ("<p>a</p><noscript>n</noscript><div class=related-work>r</div><div id=cookies>c</div>", "a"),
])
def test_names_inside_an_article(html, want):
    assert text(html) == want


def test_a_block_of_one_section_goes_on_a_large_host(spark):
    box = "<div class=x>Sport desk</div>"
    rows = [(i, "http://a.example/", f"<body>{box if i < 120 else ''}<h2>Intro</h2><p>Own {i}</p></body>") for i in range(900)]
    rows += [(1000 + i, "http://b.example/", f"<body>{box if i < 90 else '<h2>Intro</h2>'}<p>Own {i}</p></body>") for i in range(900)]
    df = spark.createDataFrame([(*r, "h", "m") for r in rows], PAGE)
    got = {r.row.page_id: r.main_text for r in H.extract(df).collect()}
    assert all(got[i] == f"Own {i}" for i in range(900))  # the heading stands on every page
    assert all(got[1000 + i] == ("Sport desk\n\n" if i < 90 else "") + f"Own {i}" for i in range(900))


def test_headings_of_many_pages_stay_below_the_share(spark):
    rows = [(i, "http://a.example/", f"<body>{'<h2>Results</h2>' if i < 150 else ''}<p>Own {i}</p></body>") for i in range(900)]
    df = spark.createDataFrame([(*r, "h", "m") for r in rows], PAGE)
    got = {r.row.page_id: r.main_text for r in H.extract(df).collect()}
    assert got == {i: ("Results\n\n" if i < 150 else "") + f"Own {i}" for i in range(900)}
