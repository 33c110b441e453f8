import itertools
import operator
import random

import pytest

from tributary.llm import mincut_html as m

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p><p>nor this";</script></head><body>
<header><h1>Site name</h1><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies. Please accept all of them now.</p></div><div class=sideBar><p>Side matter with many words in it, really many of them.</p></div>
<article><header><h1>A headline &amp; more</h1></header><p>First   paragraph\nwith <b>bold</b> &#233;t&eacute; &lt;tag&gt; words.<p>Short.
<div class="ad">Buy now, the best offer of all times, only today, really.</div><ul><li>one item</li><li>another item</li></ul>
<p>Last paragraph of the article<br>after a break.</p></article>
<section id="comments"><p>I think that this is a great article, thank you very much.</p></section>
<form><p>Leave your mail here to get more of this.</p><button>Send</button></form><footer><p>All rights reserved. &copy; 2020</p></footer></body></html>"""


def test_page():
    assert m.main_text(PAGE).split("\n") == ["A headline & more", "First paragraph with bold été <tag> words.", "Short.", "one item", "another item", "Last paragraph of the article after a break."]


def test_page_without_article():
    words = "Here are many plain words in a sentence that goes on for quite a while, as text does. " * 3
    page = f"<body><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul><div><p>{words}</p><p>A short one.</p><p>{words}</p></div><div class=footer>Contact us</div>"
    got = m.main_text(page).split("\n")
    assert len(got) == 3 and got[1] == "A short one."  # held by its neighbours


def test_odd_pages():
    for html in (None, "", "<", "<p", "<!--", "<script>never closed", "<p class='", "</p></div>", "<a<b<c", "\x00<p>\x00"):
        assert isinstance(m.main_text(html), str)
    assert m.main_text("<article><p>" + "word " * 200_000 + "</p></article>").count(" ") == 199_999
    deep = "<article>" + "<div>" * 3000 + "<p>Deep text here.</p>"
    assert m.main_text(deep) == "Deep text here."


def test_cut_by_brute_force():
    r = random.Random(1)
    for _ in range(400):
        n = r.randint(0, 8)
        lean = [r.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(n)]
        arcs = [(i, j, r.choice([0.3, 0.4, 0.8, 1.5])) for i in range(n) for j in range(n) if i != j and r.random() < 0.4]
        cost = lambda x: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(lean, x)) + sum(w for i, j, w in arcs if x[i] and not x[j])
        labels = list(itertools.product([False, True], repeat=n))
        got, least = m.minimum_cut(lean, arcs), min(map(cost, labels))
        assert abs(cost(got) - least) < 1e-9
        assert sum(got) == min(sum(x) for x in labels if cost(x) < least + 1e-9)


WORDS = "Some words here, that are a text."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<div style="overflow:hidden"><article><p>{WORDS}</p></article></div>', WORDS),
        (f'<article title="the hidden gem"><p>{WORDS}</p></article>', WORDS),
        (f'<article data-id="comments-12"><p>{WORDS}</p></article>', WORDS),
        (f"<article><p data-x=it's>{WORDS}</p><p>It's more of it.</p></article>", f"{WORDS}\nIt's more of it."),
        (f'<div class="post-with-sidebar"><p>{WORDS}</p><p>And another sentence of it.</p></div>', f"{WORDS}\nAnd another sentence of it."),
        (f'<article><p>First.</p><p class="related-work">{WORDS}</p></article>', f"First.\n{WORDS}"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><object>See this</object></article>", "Let x=1 be.\nSee this"),
        (f"<article><p>{WORDS}</p><p><a href=x>Read on</a></p><ul><li>a</li><li><a href=y>b</a></li></ul></article>", f"{WORDS}\nRead on\na\nb"),
        (f'<main><article><p>{WORDS}</p><aside><p>{WORDS * 9}</p></aside></article></main><div id="comments"><article><p>{WORDS * 9}</p></article></div>', WORDS),
        (f"<form id=all><nav><a href=x>Home</a></nav><main><p>{WORDS}</p></main></form><form><p>{WORDS}</p></form>", WORDS),
        (f"<article><script>var a = '</p>';</script><p>{WORDS}</p><style>p {{}}</style><select><option>no</select><button>Send</button></article>", WORDS),
        (f"<article><header><h1>Title</h1></header><p>{WORDS}</p><footer>Tags</footer></article><footer>{WORDS}</footer>", f"Title\n{WORDS}"),
        ("<article><p>a&nbsp;&amp;\tb &lt;p&gt; &#x41;&copy</p>tail</article>", "a & b <p> A©\ntail"),
        (f"<body><p>{WORDS}</body></html><p>And more after the end of it.", f"{WORDS}\nAnd more after the end of it."),
    ],
)
def test_small_pages(html, text):
    assert m.main_text(html) == text


MENU = "<nav><ul><li><a href=a>Start</a></li><li><a href=b>Contact</a></li></ul></nav>"
FOOT = "<footer><p>All rights reserved, of course, to all of us here.</p></footer>"
TWENTY = "This is the one paragraph of the page, and it has about twenty words, which is not many at all."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<nav>Start Contact</nav><div><p>{TWENTY}</p></div>", TWENTY),
        (f"{MENU}<div><h1>Bridge closed</h1><p>The old bridge is closed.</p><p>It opens in May.</p></div>{FOOT}", "Bridge closed\nThe old bridge is closed.\nIt opens in May."),
        (f"{MENU}<div><h2>Things to bring</h2><ul><li>Boots</li><li>A map</li><li>Water</li></ul></div>{FOOT}", "Things to bring\nBoots\nA map\nWater"),
        (f"{MENU}<div><h2>Heights</h2><table><tr><th>Name</th><th>Metres</th></tr><tr><td>Anai</td><td>2695</td></tr></table></div>{FOOT}", "Heights\nName Metres\nAnai 2695"),
        (f"{MENU}<main><p>{TWENTY}</p><article class='comment'><p>{TWENTY * 3} I say.</p></article></main>", TWENTY),
        (f"{MENU}<div><p>{TWENTY}</p><p>{TWENTY} Again.</p><p>{TWENTY} And again.</p></div><form><h1>Subscribe</h1><p>Leave your address here and we will write to you.</p></form>", f"{TWENTY}\n{TWENTY} Again.\n{TWENTY} And again."),
        (f"<form id=aspnetForm>{MENU}<h1>A title</h1><p>{TWENTY}</p></form>", f"A title\n{TWENTY}"),
        ("<p>Hi.", "Hi."),
        ("<div>Hello</div>", "Hello"),
        (MENU, ""),
    ],
)
def test_pages_without_article_elements(html, text):
    assert m.main_text(html) == text


def test_rewritten_pages():
    """The table's pages with their article elements made plain: none is empty, and blocks
    agree with what the elements said."""
    import duckdb

    pages = duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet' where page_id % 8 = 1").fetchall()
    assert len(pages) > 300
    blocks = agree = whole = 0
    for (html,) in pages:
        page = m.parsed(html)
        inside = []
        for e in page.elements:
            inside.append(e.tag == "article" or e.around >= 0 and inside[e.around])
        truth = [(b.text, inside[b.around]) for b in page.blocks]
        plain = html.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div")
        found, keep = m.labelled(plain)
        assert any(keep) and [b.text for b in found] == [t for t, _ in truth]
        same = [k == t for k, (_, t) in zip(keep, truth)]
        blocks, agree, whole = blocks + len(same), agree + sum(same), whole + all(same)
    assert agree > 0.99 * blocks and whole > 0.95 * len(pages)


def test_long_and_deep_pages_in_time():
    import time

    begin = time.monotonic()
    mixed = "".join(f"<p>{TWENTY if i % 2 else 'Short one'}</p><div>Read <a href=x>more of it</a></div>" for i in range(21_000))
    assert len(mixed) > 2_000_000
    m.main_text(f"<body>{MENU}<div>{mixed}</div>{FOOT}</body>")
    long_page = time.monotonic()
    m.main_text("<div>" * 20_000 + f"<p>{TWENTY}</p>" + "</section>" * 20_000)
    deep = time.monotonic()
    m.main_text("".join(f"<section class=comments><p>{TWENTY}</p><article><h1>x</h1>" for _ in range(4_000)))
    boxed = time.monotonic()
    assert long_page - begin < 15 and deep - long_page < 5 and boxed - deep < 10  # of seconds, on a busy machine


def test_the_flow_decides(monkeypatch):
    """On the table's pages the maximum flow runs, and what it changes is right: all of the
    article and nothing else."""
    import duckdb

    pages = duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet' where page_id % 5 = 0").fetchall()
    runs = []
    reached = m._reached
    monkeypatch.setattr(m, "_reached", lambda *a: runs.append(1) or reached(*a))
    changed = by_sign = by_cut = blocks = 0
    for (html,) in pages:
        page = m.parsed(html)
        keep = m.minimum_cut(*m.graph(page))
        inside = []
        for e in page.elements:
            inside.append(e.tag == "article" or e.around >= 0 and inside[e.around])
        truth = [inside[b.around] for b in page.blocks]
        signs = [b.leaning > 0 for b in page.blocks]
        changed += any(s != k for s, k in zip(signs, keep))
        by_sign += sum(map(operator.eq, signs, truth))
        by_cut += sum(map(operator.eq, keep, truth))
        blocks += len(truth)
    assert len(runs) > 0.9 * len(pages) and changed > 0.5 * len(pages)
    assert by_cut == blocks > 1.05 * by_sign


def test_table(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "", "", None), (1, "u", PAGE, "x"), (None, "v", "<p>", "z")], "page_id long, url string, html string, text string")
    got = m.extracted(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(1, len(m.main_text(PAGE)))] * 2 + [(2, 0), (3, 0), (0, 0)])
    assert m.extracted(pages.limit(0)).count() == 0
    whole = m.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert whole.where("n_chars = 0 or n_chars <> length(text)").count() == 0
