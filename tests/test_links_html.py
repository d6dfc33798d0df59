"""Pricing-link search and HTML text extraction on pages of our own."""

from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.operators.links import page_links, with_pricing_link
from tree_walk import extract_text

BASE = "https://shop.test/start"
# Each page shows one rule of the search; the result is the chosen address.
PRICING_PAGES = {
    # a keyword in the address or in the text, in either case
    '<p><a href="blog">Блог</a> <a href="katalog/tarif.html">Тарифный план</a></p>': "https://shop.test/katalog/tarif.html",
    '<li><a href="/k?x=price">К оплате</a>': "https://shop.test/k?x=price",
    "<a href='/a1'>СКОЛЬКО: СТОИМОСТЬ</a>": "https://shop.test/a1",
    # the first of several, and none
    '<a href="/p2">прайс-лист</a><a href="/p3">цена</a>': "https://shop.test/p2",
    '<a href="/team">Команда</a><a href="/jobs">Работа</a>': None,
    # other hosts and ports are passed over, a full address of the own host is not
    '<a href="http://cost.test/cost">1</a><a href="https://shop.test:443/cost">2</a><a href="//shop.test/cost">3</a>':
        "https://shop.test/cost",
    '<a href="https://SHOP.test/price">p</a>': None,
    # fragments, mail and telephone are passed over
    '<a href="#цены">x</a><a href="mailto:price@shop.test">x</a><a href="tel:price">x</a><a href="price">x</a>':
        "https://shop.test/price",
    # an unresolvable keyword link voids the page; other links do not
    '<a href="//[oops/price">x</a><a href="/pricing">y</a>': None,
    '<a href="//[oops/about">x</a><a href="/pricing">y</a>': "https://shop.test/pricing",
    # a nested tag in the text does not match; the last href of a tag counts; broken markup after it does no harm
    '<a href="/price"><i>Цены</i></a><a href="/cost">c</a>': "https://shop.test/cost",
    '<A CLASS=b HREF="/x" data-href="/price">p</A>': "https://shop.test/price",
    "<a href='/plan'>план</a><b <c": "https://shop.test/plan",
    "": None, "<a href='/price'>": None,
}


def test_pricing_link_rules(spark):
    df = spark.createDataFrame([(i, h, BASE) for i, h in enumerate(PRICING_PAGES)], "i long, html string, base string")
    got = {r.i: r.p for r in with_pricing_link(df, "html", "base", "p").collect()}
    assert [got[i] for i in range(len(PRICING_PAGES))] == list(PRICING_PAGES.values())


def test_page_links_positions(spark):
    df = spark.createDataFrame([(1, "<a href='/a'>A</a> <a href=\"/b\">B\nC</a><a href='/n'><i>x</i></a>")],
                               "page_id long, html string")
    rows = page_links(df).orderBy("pos").collect()
    assert [(r.pos, r.href, r.text) for r in rows] == [(0, "/a", "A"), (1, "/b", "B\nC")]


# Page -> its text. White space is collapsed at the end, so tags add none.
TEXTS = {
    "<p>один</p><p>два</p>": "одиндва",
    "<p>a</p>\n <p>\tb </p>": "a b",
    "<head><title>T</title></head><body>x<!-- y --><script>z()</script><style>q{}</style><noscript>n</noscript>w": "xw",
    "<SCRIPT type=a>var s='<b>';</SCRIPT >t": "t",
    "a<script>never closed <p>b</p>": "a",
    "a<script>1</script>b<script>2": "ab",
    "a<!-- open <p>b": "a",
    "<headline>x</headline><header>y</header>": "xy",
    # quotes hide a tag's end
    '<p title="a>b">t</p>': "t", "<p title='>' data-x=\">>\">u</p>": "u", "<a href=x>y>z</a>": "y>z",
    # character references: decimal, hexadecimal, named, doubly encoded, without semicolon, unknown
    "&#8212;&#x27;&#X41;&eacute;&rsquo;&euro;&nbsp;&hellip;&AElig;": "—'Aé’€\xa0…Æ".replace("\xa0", " "),
    "&amp;lt; &lt;b&gt; &amp;amp;": "&lt; <b> &amp;",
    "&copy2024 &unknown; &; & &#; AT&T": "©2024 &unknown; &; & &#; AT&T",
    "&#0;&#xD800;&#1114112;&#128;": "\ufffd\ufffd\ufffd€",
    "1 < 2": "1 < 2", "": "", " \n": "", None: "",
}


def test_html_to_text_literals(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, html string")
    got = {r.i: r.t for r in df.select("i", H.html_to_text("html").alias("t")).collect()}
    for i, (page, want) in enumerate(TEXTS.items()):
        assert got[i] == want, page


def test_text_equals_the_tree_walk(spark):
    """The column expression against the standard library's parser."""
    pages = [t for t in TEXTS if t and "AT&T" not in t and "<!-- open" not in t]  # the parser's version decides there
    df = spark.createDataFrame(list(enumerate(pages)), "i long, html string")
    for r in df.select("i", H.html_to_text("html").alias("t")).collect():
        assert r.t == extract_text(pages[r.i]), pages[r.i]


# Page -> what a reader sees of it.
VISIBLE = {
    '<p>a</p><div style="color:red;DISPLAY : none">b<div>c</div>d</div><p>e</p>': "ae",
    '<ul class="menu hidden-xs"><li>a</li></ul><p class=unHIDDEN>b</p><p class="hide">c</p>': "c",
    "<nav><a>x</a></nav><p>y</p><footer>z<p>w</p></footer>q": "yq",
    '<div class=hidden>a<div>b<p>c</div>d</div>e': "e",
    "<br class=hidden>a<img style='display:none'>b": "ab",
    '<p data-class="hidden" title="display:none">seen</p>': "seen",
    "<span style='display:none'>never closed <b>x</b>": "",
    "plain": "plain", "": "", None: "",
}


def test_visible_text(spark):
    df = spark.createDataFrame(list(enumerate(VISIBLE)), "page_id long, html string")
    got = {r.page_id: r.v for r in H.with_visible_text(df, "html", "v").collect()}
    assert got == dict(enumerate(VISIBLE.values()))
    for page, want in VISIBLE.items():
        assert extract_text(page, visible_only=True) == want, page


def test_gates_and_strip_tags(spark):
    rows = [(n, "x" * n) for n in (49, 50, 51, 499, 500)]
    df = spark.createDataFrame(rows, "n int, t string")
    home, js = H.home_gate("t")
    got = {r.n: (r.h, r.js, r.p) for r in df.select("n", home.alias("h"), js.alias("js"),
                                                     H.pricing_ok("t").alias("p")).collect()}
    assert got[49] == ("", True, False)
    assert got[50][1:] == (True, False) and got[50][0] == "x" * 50
    assert got[51][1:] == (True, True)
    assert got[499][1] is True and got[500][1] is False
    r = spark.range(1).select(H.strip_tags(F.lit(" <b>a</b>\n <i>b</i> ")).alias("s")).first()
    assert r.s == "a b"
