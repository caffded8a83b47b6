"""HTML extraction on sites without tags that give the article away, on odd markup, and against the tree counted in plain Python."""

import collections
import math
import random

import pytest

from stratalake.llm import html_text
from stratalake.llm.page_tree import Page

SCHEMA = "page_id long, url string, html string, text string, Host string"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_articles_are_found_without_names(spark):
    """Templates of bare containers: only what repeats over the site can tell the article."""
    rnd, rows, expected = random.Random(3), [], {}
    for i in range(12):
        paragraphs = [prose(rnd, 20) for _ in range(rnd.randint(1, 5))]
        title = prose(rnd, 4)
        page = f"<body><div>The Daily Site</div><div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<div class=box9><p>Read our letter</p></div></div><div>All rights reserved</div></body>"
        rows.append((i, "http://a.example/%d" % i, page, "x", "y"))
        expected[i] = " ".join([title, *paragraphs])
        rows.append((100 + i, "http://b.example/%d" % i, f"<p>Welcome to b</p><p>{title}</p><p>Goodbye</p>", "x", "y"))
        expected[100 + i] = title
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected


def test_copies_of_one_page_keep_their_article(spark):
    page = "<nav>m</nav><article><h1>Same</h1><p>Words of it</p></article><footer>f</footer>"
    near = [page.replace("Words", f"Words {i}") for i in range(6)]
    rows = [(i, "https://u@c.example:80/x", p, None, None) for i, p in enumerate([page] * 9 + near)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Same {'Words' if i < 9 else f'Words {i - 9}'} of it" for i in range(15)}


ODD = [
    (None, ""),
    ("", ""),
    ("no markup &amp; &lt;tags&gt; &copy;x &#233; &nbsp; end", "no markup & <tags> ©x é end"),
    ("<p>5 < 6 and 7 > 3 <3</p>", "5 < 6 and 7 > 3 <3"),
    ("<p>a<!-- <p>no</p> -->b<b>c</b>d<br>e\n\t f</p>", "abcd e f"),
    ("<script>var x='</p><article>'</script><p>ok</p><style>p{}</style><script>no end", "ok"),
    ("<body><nav><ul><li><a href=x>menu</a><article><p>first<p>second</article><footer>foot</footer>", "first second"),
    ("<form id=aspnetForm><div id=main><h1>H</h1><p>text of the page</p></div><div class=footer>x</div></form>", "H text of the page"),
    ("<div class='page has-sidebar'><article><h1>T</h1><p>x</p><section class=comments><article>mine</article></section></article></div>", "T x"),
    ("<main><p>main text</p></main><div>other</div>", "main text"),
    ("<article><header><h1>Title</h1></header><p>p</p><aside>side</aside><form>f<input></form><div class='cookieNotice'>c</div><div hidden>h</div><footer>by</footer></article>", "Title p"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></article>", "a b c d e"),
    ("<p title='a>b' class=\"x>y\">quoted</p><p>tail", "quoted tail"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<article><p>" + "long " * 200_000 + "</p></article>", ("long " * 200_000).strip()),
    ("<article><p>cut <b", "cut"),
    ("<div id=siteHeader>site</div><div class='post-header'><h1>T</h1></div><p>x</p><div class=cookiebar>c</div><div class=LeftSidebar2>s</div>", "T x"),
    ("<main><div class=header><h1>T</h1></div><p>x</p></main><section id='comments-area'>mine</section>", "T x"),
]


def test_odd_markup(spark):
    rows = [(i, None if i % 2 else "not a url", source, "t", None) for i, (source, _) in enumerate(ODD)]
    rows += [rows[3], (None, "http://x.example", "<p>null id</p>", None, None)]
    frame = html_text.op11_html_extraction(spark.createDataFrame(rows, SCHEMA))
    assert frame.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in frame.collect()), key=str)
    want = [(i, text, len(text)) for i, (_, text) in enumerate(ODD)] + [(3, ODD[3][1], len(ODD[3][1])), (None, "null id", 7)]
    assert got == sorted(want, key=str)
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def counted(sources):
    """The tree of one host by plain counting: path -> (m, leaf, branch)."""
    pages = {}
    for source in sources:
        nodes, blocks = html_text._parsed(source)
        pages["\n".join(sorted({b[3] for b in blocks}))] = nodes
    m, styles, features, above, inner = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), {}, {}
    for nodes in pages.values():
        for path, up, style, flow, found, *_ in nodes:
            m[path] += 1
            styles[path][style] += 1
            features[path].update(found)
            above[path], inner[path] = up, flow
    left = {p: [1 - math.log(c) / math.log(m[p]) if m[p] > 1 else 1 for c in features[p].values()] for p in m}
    tree = {}
    for p in m:
        leaf = sum(left[p]) / len(left[p]) if left[p] else 1
        leaf = (leaf * m[p] + html_text.TRUST) / (m[p] + html_text.TRUST) if inner[p] else leaf
        below = [x for q in m if p in above[q] for x in left[q]]
        look = -sum(c / m[p] * math.log(c / m[p], m[p]) for c in styles[p].values()) if m[p] > 1 else 1
        fade = html_text.GAMMA ** len(styles[p])
        tree[p] = (m[p], leaf, (1 - fade) * look + fade * sum(below) / len(below) if below else 1)
    return tree


def test_tree_against_counting(spark):
    rnd = random.Random(9)
    sources = [f"<div><p>fixed</p><div>{prose(rnd, 2)}</div></div>" + "<h2>head</h2>" * rnd.randint(0, 1) + "".join(f"<p class=c{i}>{rnd.choice('ab')}</p>" for i in range(rnd.randint(0, 3))) for _ in range(40)]
    rows = [(i, "http://h.example/", s, None, None) for i, s in enumerate(sources + sources[:5])]
    parsed = html_text.stash(html_text.parse(spark.createDataFrame(rows, SCHEMA)))
    tree, _, _ = html_text.style_tree(parsed)
    got = {r.node: (r.m, r.leaf, r.branch) for r in tree.collect()}
    want = counted(sources)
    assert got.keys() == want.keys()
    for p, values in want.items():
        assert got[p] == pytest.approx(values, abs=1e-9)


def test_paths_do_not_grow_with_depth():
    page = Page("<div>" * 500 + "x")
    assert len(set(page.paths)) <= 49 + 1 and page.blocks[0][1] == "x"
