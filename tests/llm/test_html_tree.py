"""HTML extraction: parsing, the style tree against a brute-force one, both ways to remove nodes."""

import math
import random

from inkstone.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, extra int"


def test_parsing():
    page = '<html><head><title>t</head><body><nav><li>menu</nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>one<br>two<p>three  \n four<script>var x="</p>"</script></article><footer>foot</footer>'
    assert H.Page(page).text() == ["A & B", "one two", "three four"]
    assert H.Page("").text() == [] and H.Page("< 5 &amp; 6 <p").text() == ["< 5 & 6 <p"]


def test_roles_and_unclosed_elements():
    inside = '<article><p class="reply-title">a<p class="side-by-side">b <span class="advert">no</span><ins class="adsbygoogle">no</ins>c</p><div class="header-of-section">d</div></article>'
    assert H.Page(inside).text() == ["a", "b c", "d"]
    assert H.Page("<body><div><object>unseen<button>unseen</div><p>seen<title>t<p>too").text() == ["seen", "too"]
    assert H.Page('<article><p>x</p><article class="comment">no</article></article><div class="site-header">no</div>').text() == ["x"]
    assert H.Page("<div><p>a</b></section>b</div></div>c").text() == ["ab", "c"]
    deep = H.Page("<div>" * 300 + "x" + "</div>" * 300 + "y")
    assert deep.text() == ["x", "y"] and max(deep.depth) == H.DEEP


def site(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice("river stone quiet lamp walk green seven light".split()) + str(r.randrange(50))
    para = lambda: "<p>" + " ".join(word() for _ in range(20)) + "</p>"
    promo = ["<div><p>Read our terms</p><p>Call us</p></div>", "<div><p>Read our terms</p></div>"]
    return [f"<html><body><nav><ul><li>home<li>{word()}</ul></nav>{r.choice(promo)}<section>{''.join(para() for _ in range(r.randrange(1, 6)))}</section><div class=ad>{word()}</div><article><h1>{word()}</h1>{para()}<p>Share this</p></article></body></html>" for _ in range(n)]


def brute(pages):
    """Composite importance of each element, by recursion over pages merged as nested lists: (page, element) -> comp."""
    out = {}

    def merge(members):  # (page number, Page, element) of one tree node
        m = len(members)
        shown = {}
        for no, p, i in members:
            key = ("style", *[p.label[k] for k in p.kids[i]]) if p.kids[i] else ("content", " ".join("".join(x for b in p.blocks for j, x in b if j == i).split()))
            shown.setdefault(key, []).append((no, p, i))
        if m > 1:
            imp = -sum(len(x) / m * math.log(len(x) / m, m) for x in shown.values())
            imp = (m * imp + H.PRIOR) / (m + H.PRIOR)
        else:
            imp = 1.0
        below = 0.0
        for key, x in shown.items():
            if key[0] == "content":
                c = imp
            else:
                c = [merge([(no, p, p.kids[i][j]) for no, p, i in x]) for j in range(len(key) - 1)]
                c = sum(c) / len(c) if len(x) > 1 else 1.0
            below += len(x) / m * c
        fade = H.GAMMA ** len(shown)
        comp = (1 - fade) * imp + fade * below if m > 1 else 1.0
        for no, _, i in members:
            out[no, i] = comp
        return comp

    merge([(no, p, 0) for no, p in enumerate(pages)])
    return out


def test_tree_against_brute_force(spark):
    html = site(1, 25)
    rows = [(i, f"http://h.example/{i}", x, 0) for i, x in enumerate(html)] + [(90 + i, "http://h.example/again", html[0], 0) for i in range(5)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r.node: r.comp for r in H.importances(H.style_tree(H.page_nodes(d))).collect()}
    pages = [H.Page(x) for x in html]
    want = brute(pages)
    seen = 0
    for (no, i), c in want.items():
        node = pages[no].nodes("h.example")[i][0]
        assert abs(got.get(node, 1.0) - c) < 1e-9
        seen += node in got
    assert seen > 100


def test_what_a_host_repeats_goes(spark):
    html = site(2, 60)
    rows = [(i, f"http://h.example/{i}", x, 0) for i, x in enumerate(html)] + [(100, None, None, 1), (101, "http://one.example/", "<p>alone</p><p>Read our terms</p>", None), (0, "http://h.example/0", html[0], 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = [{x.page_id: x.text for x in H.extract(d, small).collect()} for small in (H.SMALL, 0)]
    assert out[0] == out[1] and H.extract(d).count() == len(rows)
    for i, x in enumerate(html):
        p = H.Page(x)
        body = [b for b in p.text() if b not in ("Read our terms", "Call us", "Share this")]
        assert out[0][i].split("\n") == body and len(p.text()) > len(body)
    assert out[0][100] == "" and out[0][101] == "alone\nRead our terms"
    assert H.extract(d.limit(0)).count() == 0
