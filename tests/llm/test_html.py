import math
import random
import re
from collections import Counter

from cuelark.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad-box">Buy</div><div id="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;line <i>it</i>alic.<br><p>Second
   line &lt;x&gt; &#233;</p><div class="share">Share</div><form><p>Mail</p></form><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>
<section class="comments"><h2>Comments</h2><p>Nice!</p></section></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_an_article_without_what_surrounds_it():
    assert hx.main_text(PAGE, frozenset()).split("\n") == ["Title & more", "First line italic.", "Second line <x> é", "one", "two", "c1", "c2"]


def test_broken_markup():
    assert hx.main_text(None, frozenset()) == hx.main_text("", frozenset()) == ""
    assert hx.main_text("plain & text", frozenset()) == "plain & text"
    assert hx.main_text("<p>a<p>b</div></p>c<script>x", frozenset()) == "a\nb\nc"
    assert hx.main_text("<article><p>cut off <b>here", frozenset()) == "cut off here"
    assert hx.main_text('<p title="a>b">x</p><P>y</P>', frozenset()) == "x\ny"
    assert hx.main_text("<p>1 < 2 and 3 > 2</p>", frozenset()) == "1 < 2 and 3 > 2"
    assert len(hx.main_text("<div>" * 3000 + "deep" + "<p>x" * 3000, frozenset())) > 3000


def test_hosts():
    assert [hx.host(u) for u in ("http://A.b:80/x", "https://u@c.d?x", "//e.f", "nothing", None)] == ["a.b", "c.d", "e.f", "", ""]


def site(n, repeated="Home News Shop"):
    """Pages without telling markup: the same lines around texts of their own."""
    return [(i, f"http://h.example/{i}", f'<body><div class="xa"><div>{repeated}</div></div><div class="xb"><p>Text number {i} of its own.</p><p>And {i * 7} more.</p></div><div class="xc">All rights {i % 2}</div></body>', 0) for i in range(n)]


def test_branches_that_repeat_over_a_site_go(spark):
    pages = spark.createDataFrame([*site(40), (100, "http://lone.example/", "<div>Home News Shop</div><p>own</p>", 0)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in hx.extract(pages).collect()}
    assert got[3] == "Text number 3 of its own.\nAnd 21 more." and len(got) == 41
    assert got[100] == "Home News Shop\nown"


def test_branches_that_repeat_inside_articles_go_too(spark):
    page = '<body><div>Shop</div><article><h1>Title {0}</h1><div class="xa"><p>Read more on our site.</p></div><p>Text number {0} of its own.</p></article></body>'
    own = [(i, f"http://h.example/{i}", page.format(i)) for i in range(40)]
    copies = [(100 + i, f"http://c.example/{i}", page.format(7)) for i in range(8)]
    mains = [(200 + i, f"http://m.example/{i}", page.format(i).replace("article", "main")) for i in range(40)]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame([*own, *copies, *mains], "page_id long, url string, html string")).collect()}
    assert got[3] == got[203] == "Title 3\nText number 3 of its own."
    # Where the article itself returns on every page, nothing tells its branches apart.
    assert got[100] == "Title 7\nRead more on our site.\nText number 7 of its own."


def test_many_sites_meet_by_host(spark, monkeypatch):
    pages = spark.createDataFrame(site(40), "page_id long, url string, html string, text int")
    want = sorted(map(tuple, hx.extract(pages).collect()))
    monkeypatch.setattr(hx, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, hx.extract(pages).collect())) == want


def test_nulls_repeats_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None, None, "h"), (1, None, None, "h"), (None, "x", "<p>a</p>", "h")], "page_id long, url string, html string, host string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in hx.extract(pages).collect()), key=str)
    assert got == [(1, "", 0), (1, "", 0), (None, "a", 1)] and hx.extract(pages.limit(0)).count() == 0


def tree_by_hand(pages):
    """Weak branches of a host's pages, each branch looked at by itself."""
    seen = []
    for html in pages:
        layouts = {}
        seen.append(([(p, t) for p, t, noise, _ in hx.blocks(html, layouts) if not noise], layouts))
    importance = {}
    for branch in {b for own, _ in seen for p, _ in own for b in hx.branches(p)}:
        on = [(own, layouts[branch]) for own, layouts in seen if branch in layouts]
        m = len(on)
        if m == 1:
            importance[branch] = 1.0
            continue
        entropies = []
        for path in {p for own, _ in on for p, _ in own if p == branch or p.startswith(branch + ">")}:
            pages_of = Counter(t for own, _ in on for t in {t for p, t in own if p == path})
            entropies += [math.log(k, m) for k in pages_of.values() for _ in range(k)]
        ways = Counter(tuple(x) for _, x in on)
        shown = -sum(k / m * math.log(k / m, m) for k in ways.values())
        by_text = hx.WEIGHT ** len([w for w in ways if w])
        both = (1 - by_text) * shown + by_text * (1 - sum(entropies) / len(entropies))
        importance[branch] = 1 - (1 - both) * (m - 1) / (m + 1)
    weak = set()
    for branch, x in importance.items():
        m = re.match(hx.ARTICLE, branch + ">")
        bound = importance.get(m[1], 1.0) if m and m[1] != branch else 1.0
        if x < hx.LEAST * bound - 1e-12:
            weak.add(branch)
    return weak


def test_trees_are_those_made_by_hand(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(12)]

    def page():
        line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
        parts = [f"<div class='a{rng.randrange(2)}x'>" + "".join(f"<p>{line()}</p>" for _ in range(rng.randrange(4))) + "</div>" for _ in range(rng.randrange(1, 5))]
        box = rng.choice(["article", "section"])
        return f"<body><div class='top'>same</div><{box}><h1>{line()}</h1>{''.join(parts)}<div class='end'><p>more here</p></div></{box}></body>"

    hosts = {f"h{n}.example": [page() for _ in range(n)] for n in (1, 2, 5, 9, 30)}
    rows = [(f"http://{h}/{i}", html) for h, pages in hosts.items() for i, html in enumerate(pages)]
    got = {r.host: set(r.weak) for r in hx.site_trees(spark.createDataFrame(rows, "url string, html string")).collect()}
    want = {h: tree_by_hand(pages) for h, pages in hosts.items()}
    assert got == {h: w for h, w in want.items() if w} and "h30.example" in got and "h1.example" not in got


def test_varied_layouts_hold_a_branch_up(spark):
    """Texts of few words return on many pages; how they follow each other does not."""
    rng = random.Random(8)
    same = "<body><div class='xa'><p>one</p><p>two</p></div>"
    pages = [same + "<div class='free'>" + "".join(rng.choice(["<p>one</p>", "<h2>two</h2>", "<ul><li>one</ul>"]) for _ in range(9)) + "</div></body>" for _ in range(60)]
    weak = hx.site_trees(spark.createDataFrame([(f"http://h.example/{i}", x) for i, x in enumerate(pages)], "url string, html string")).first().weak
    assert ">body>div.xa" in weak and ">body>div.free" not in weak


def test_a_very_long_page(spark):
    html = "<article>" + "".join(f"<p>line {i} é</p>" for i in range(300_000)) + "</article>"
    r = hx.extract(spark.createDataFrame([(1, "http://h.example/", html)], "page_id long, url string, html string")).first()
    assert r.n_chars == len(r.text) and r.text.count("\n") == 299_999
