import html as H
import random
import re

from orrery.llm import mincut_extract as M


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|article)>", inside)
    return "\n\n".join(x for x in (" ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks) if x)


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in M.query(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == (article(r["html"]), len(article(r["html"])))


def test_boilerplate_of_many_kinds(spark, data):
    odds = M.trained(spark.read.parquet(f"{data}/pages.parquet"))
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies. Accept them all, please.</p></div>
    <main><article><header><h1>Title here</h1></header><p>Long text one. With two &lt;sentences&gt;.<p>More &amp; more text <a href=x>link</a>&nbsp;here.<ul><li>An item.</ul><pre>a
    b</pre><script>if (a < b) { "<p>no</p>" }</script><div class="advert">Buy now!</div><section id="comments"><p>Nice post! I really liked it, thank you.</p></section></article>
    <aside><p>Related stuff, with a sentence.</p></aside></main><form><label>Name</label><input></form><!-- <p>gone</p> --><footer>c</footer></body></html>"""
    assert M.main_text(page, odds) == "Title here\n\nLong text one. With two <sentences>.\n\nMore & more text link here.\n\nAn item.\n\na b"
    assert "Plain text in a div." in M.main_text('<div id=menu><a href=1>Home</a></div><div class="post-content">Plain text in a div.<br>Second line.</div>', odds)


def stripped(page):
    return re.sub(r'\s(?:class|id|role)="[^"]*"', "", page)


def test_pages_without_names(spark, data):
    """The classifier and the cut find the article without any class, id or role, and without article, nav and footer elements."""
    pages = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/pages.parquet")
    odds = M.trained(pages)
    wrong = 0
    for r in pages.collect():
        want = article(r["html"])
        soup = re.sub(r"(</?)(?:article|nav|footer)\b", r"\1div", stripped(r["html"]))
        assert M.main_text(stripped(r["html"]), odds) == want
        wrong += M.main_text(soup, odds) != want
    assert wrong <= 25  # of 250


def test_names_that_mislead(spark, data):
    odds = M.trained(spark.read.parquet(f"{data}/pages.parquet"))
    text = "A sentence that is long enough to be text, and then some more of it. Another one follows here."
    for page in (
        f'<body class="no-sidebar"><article><h1>Title</h1><p>{text}</p><p class="legal">{text}</p><p>{text}</p></article></body>',
        f'<body class="ad"><article><h1>Title</h1><p>{text}</p><div class="share-price">{text}</div><p>{text}</p></article></body>',
        f'<div class="widget"><h1>Title</h1><p>{text}</p><p>{text}</p><p>{text}</p></div>',
    ):
        assert M.main_text(page, odds).count(text) == 3, page
    assert M.main_text(f"<article><p>{text} <math><mi>x</mi></math> <svg><text>in a drawing</text></svg></p></article>", odds) == f"{text} x in a drawing"


def test_ties_overrule_a_block(spark, data):
    """A block that looks like boilerplate stays where all around it is content, and goes where all around it is boilerplate."""
    odds = M.trained(spark.read.parquet(f"{data}/pages.parquet"))
    text = "<p>A sentence that is long enough to be text, and then some more of it. Another one follows here.</p>"
    blocks = M.blocks_of(f"<div>{text * 3}<div>* * *</div>{text * 3}</div>")
    lean, label = M.leanings(blocks, odds), M.label(blocks, odds)
    assert blocks[3].text == "* * *" and lean[3] < 0 and label == [True] * 7
    assert M.label(blocks[3:4], odds) == [False]


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        lean = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(i, j, rng.random() * 2) for i in range(n) for j in range(i) if rng.random() < 0.5]
        total = lambda side: sum(abs(x) for s, x in zip(side, lean, strict=True) if s != (x > 0)) + sum(w for i, j, w in ties if side[i] != side[j])  # noqa: B023, E731
        best = min(total([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(total(M.cut(lean, ties)) - best) < 1e-9


def test_time_grows_with_the_page():
    """Pages of many blocks, of elements that are never closed, and of closing tags without an element."""
    import time

    odds = M.np.zeros(M.BUCKETS)
    for make in (lambda n: "<p>Some words here.</p>" * n, lambda n: "<b><div>Some words here." * n, lambda n: "<i>" * n + "</u>" * n + "<p>x" * n):
        took = []
        for n in (2000, 16000):
            page, at = make(n), time.process_time()
            M.main_text(page, odds)
            took.append(time.process_time() - at)
        assert took[1] < 24 * took[0] + 0.5, took


def test_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (2, None, "<p>", "x"), (3, "u", "<article><p>A text that is short.</article>" + "<div>" * 3000 + "deep", "x"), (4, "u", "<article>" + "<p>Some words here. " * 3000 + "</article>", "x"), (5, "u", "</p></b><article>x<", "x"), (6, "u", "<script>never closed", "x"), (7, "u", "<a href='>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in M.query(pages).collect()]
    assert len(out) == len(rows) and all(n == len(t) for _, t, n in out) and {t for p, t, _ in out if p in (1, 2, 6, 7, None)} == {""}
    assert {p: t.count("\n\n") for p, t, _ in out}[4] == 2999
    assert M.query(pages.limit(0)).count() == 0


def test_attributes_are_read_one_by_one():
    for shown in ('style="overflow:hidden"', 'href="/hidden-valley"', 'data-hidden="false"', "title='hidden id=nav'", 'data-id="nav"', "data-x=a/hidden", 'alt="x" data-role=menu', 'aria-hidden="false"'):
        assert M.attributes_of(f" {shown}") == ((), ""), shown
    for gone in ("hidden", ' class="a b" HIDDEN', "hidden=''", 'aria-hidden="true"', "ARIA-HIDDEN = true", 'x="1"hidden', "hidden/", "x='1' hidden /"):
        assert M.attributes_of(f" {gone}")[1] == "away", gone
    assert M.attributes_of(" data-id=\"x\" id = 'mainNav' class=post-content") == (("mainnav", "post-content"), "away")
    assert [M.attributes_of(f' class="{c}"')[1] for c in ("share-price", "no-sidebar", "cookie_notice", "postContent", "entry")] == ["", "", "away", "here", "here"]
    page = '<article><div style="overflow:hidden"><p>The text, with a <a href="/hidden-valley">link</a> in it.</p></div></article>'
    assert M.main_text(page, M.np.array([1.0] * M.BUCKETS)) == "The text, with a link in it."
