import math
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pytest

from kinfold.llm import html_main as S

PAGE = "<html><head><title>t</title><style>p{{}}</style><script>var x='</p><p>no';</script></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; line</h1>{}</article><footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>One\n two<p>Three", "One two\n\nThree"), ("<p>a<br>b <b>c</b>d</p>", "a b cd"), ("<ul><li>x<li>y &lt; z</ul>", "x\n\ny < z"), ("<p>k<div class='share-buttons'>s</div><p>l", "k\n\nl"), ("<table><tr><td>1<td>2</table>", "1\n\n2"),
        ("<p>t<section id='comments'><p>c</section>", "t"), ("<form><p>f</form><p>g", "g"), ("<p>x<!-- y --> z", "x z"), ("<p>&#x41;&eacute;&bogus; &am", "Aé&bogus; &am"), ("<p>a<script>b</script>c", "a\n\nc"), ("<div><p>deep</div>loose", "deep\n\nloose"), ("<p>cut <a href='x", "cut"),
    ],
)
def test_article(body, want):
    assert S.main_text(PAGE.format(body), None) == "Head & line\n\n" + want


def test_odd_pages():
    assert S.main_text(None) == S.main_text("") == S.main_text("<nav>x</nav>") == ""
    assert S.main_text("plain text", None) == "plain text"
    assert S.main_text("a < b <c", None) == "a < b"
    assert S.main_text("<div>" * 3000 + "x", None) == "x"
    assert S.main_text("".join(f"<div>{k} " for k in range(3000)), None).split() == [str(k) for k in range(3000)]
    assert S.main_text("<p>" + "y " * 200_000, None) == ("y " * 200_000).strip()
    assert S.main_text("<article>a<aside><article>b</article></aside></article><article class='comment'>c</article>", None) == "a"
    assert S.main_text("<body class='menu'><form><div class='sidebar'><main>m<header>h</header></main></div></form>", None) == "m\n\nh"


def site(words):
    return f"<body><div class='top'><span>Home</span><span>About us</span></div><div class='text'><p>{words}</p></div><div class='legal'>All rights kept by nobody</div></body>"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 5, 1, 2, 3, 4) for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int, host int, template int, nodes int, low int")


def test_what_a_site_repeats_is_removed(spark):
    rows = [(k, f"http://site.org/{k}", site(f"Story number {k} tells of {k * k}")) for k in range(12)] + [(50 + k, f"http://few.org/{k}", site(f"Few {k}")) for k in range(3)]
    rows += [(60 + k, f"http://two.org/{k}", site(f"Two {k}")) for k in range(2)]
    got = {r.page_id: r.text for r in S.extract(pages(spark, rows)).collect()}
    assert got[3] == "Story number 3 tells of 9"
    assert got[51] == "Few 1" and got[61] == "HomeAbout us\n\nTwo 1\n\nAll rights kept by nobody"
    tree = {(r.pages, round(r.content, 3)) for r in S.site_tree(S.parsed(pages(spark, rows))).where("host = 'site.org'").collect()}
    assert (12, 0.0) in tree and (12, 1.0) in tree


def test_a_site_of_copies_keeps_its_text(spark):
    rows = [(k, "http://copy.org/a", site("the same story")) for k in range(20)]
    assert all("the same story" in r.text for r in S.extract(pages(spark, rows)).collect())


def test_rows_are_kept(spark):
    rows = [(1, None, "<article>a</article>"), (None, "http://u", None), (2, "not a url", ""), (2, "not a url", ""), (3, "https://U@Host.org:80/x", PAGE.format("<p>" + "z" * 50_000))]
    got = S.extract(pages(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id, r.n_chars) for r in got.collect()), key=str) == sorted([(1, 1), (None, 0), (2, 0), (2, 0), (3, 50_013)], key=str)
    assert S.extract(pages(spark, [])).count() == 0


def test_what_a_site_repeats_in_articles_is_removed(spark):
    story = lambda k: f"<body><article><h1>Head {k}</h1><p>Story number {k} tells of {k * k} and of much more besides</p><div class='box'>Write to us</div></article></body>"
    rows = [(k, f"http://site.org/{k}", story(k)) for k in range(12)] + [(50 + k, f"http://copy.org/{k}", story(1)) for k in range(12)]
    # One element marked by its id does not take its namesakes along.
    rows[0] = (0, "http://site.org/0", story(0).replace("<p>", "<p id='ad'>x</p><p>"))
    got = {r.page_id: r.text for r in S.extract(pages(spark, rows)).collect()}
    assert all(got[k] == f"Head {k}\n\nStory number {k} tells of {k * k} and of much more besides" for k in range(12))
    assert got[50].startswith("Head 1\n\nStory number 1 ")


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<body class='ad-free'><article><p>Long text here<p>more of it</article></body>", "Long text here\n\nmore of it"), ("<body class='ad-free'><p>No article", "No article"),
        ("<div class='page comments-open'><nav>n</nav><article><header>h</header><p>Long text</article></div>", "h\n\nLong text"), ("<article class='post social-share'><p>Long text<div class='ad'>Buy</div></article>", "Long text"),
        ("<div class='related'><article>teaser</article></div><article class='post ad-free'>The long text of the page</article>", "The long text of the page"), ("<article>The long text</article><div class='related'><article>teaser</article></div>", "The long text"),
        ("<main><p>All the text of the page is here<article>teaser</article></main>", "All the text of the page is here\n\nteaser"), ("<main><p>top<article>All the text of the page</article></main>", "All the text of the page"),
        ("<main><article class='post social-share'>The long text</article><p>foot</main>", "The long text"), ("<div role='main' class='header'>x</div>", "x"),
        ("<aside><article>not this</article></aside><p>x", "x"),
    ],
)
def test_marks_do_not_take_the_article(source, want):
    assert S.main_text(source, None) == want


def by_brute_force(rows):
    """Each page's text from its host's merged tree, counted node by node."""
    sites = defaultdict(lambda: defaultdict(lambda: ([], [], [])))
    for _, url, source in rows:
        for node, weight, shape, words in S.Page(source).merged()[0]:
            for into, x in zip(sites[urlsplit(url).hostname][node], (weight, shape, words), strict=True):
                into.append(x)

    def entropy(signatures):
        m = len(signatures)
        return 1.0 if m == 1 else -sum(c / m * math.log(c / m) for c in Counter(signatures).values()) / math.log(m)

    importance = {}
    for host, nodes in sites.items():
        for node, (weights, *signatures) in nodes.items():
            m, own = len(weights), max(map(entropy, signatures))
            importance[host, node] = (m, weights[0] * (m * own + S.PRIOR_PAGES) / (m + S.PRIOR_PAGES))
    low = defaultdict(set)
    for (host, node), (_, x) in importance.items():
        if x < S.LEAST_IMPORTANCE:
            low[host].add(node)
    return importance, {i: S.main_text(source, low[urlsplit(url).hostname]) for i, url, source in rows}


def test_trees_and_texts_match_brute_force(spark):
    story = lambda k: f"<p>Story number {k} tells of {k * k} and more</p>" * (1 + k % 3)
    box = lambda k: f"<div class='box b{k % 2}'>Box {k % 2}<span>Write to us</span></div>"
    form = [lambda k: f"<body><div class='top'>Home {k % 2}</div>{story(k)}{box(k)}<footer>End</footer></body>", lambda k: PAGE.format(story(k) + box(k)), lambda k: f"<main>loose {k}<article>{story(k)}</article>{box(k)}</main>"]
    rows = [(100 * f + k, f"http://site{f}{k % 2}.org/{k}", form[f](k // 3)) for f in range(3) for k in range(17)]
    importance, texts = by_brute_force(rows)
    read = S.parsed(pages(spark, rows))
    got = {(r.host, r.node): (r.pages, r.importance) for r in S.site_tree(read).collect()}
    assert set(got) == set(importance) and all(got[k] == (m, pytest.approx(x)) for k, (m, x) in importance.items())
    assert {r.page_id: r.text for r in S.extract(pages(spark, rows)).collect()} == texts


def test_every_removal_comes_from_the_tree(spark):
    rows = [(k, f"http://site.org/{k}", PAGE.format(f"<p>Story {k}")) for k in range(5)]
    read = S.parsed(pages(spark, rows))
    low = S.low_nodes(read, S.site_tree(read))
    assert all(r.text == f"Head & line\n\nStory {r.page_id}" for r in S.page_texts(read, low).collect())
    assert all(r.text == f"Menu\n\nBuy\n\nHead & line\n\nStory {r.page_id}\n\n© x" for r in S.page_texts(read, low.limit(0)).collect())
