"""Page extraction: article text stays, templates are counted as by brute force, deep pages take linear time."""

import time
from collections import defaultdict

from ledgerline.llm import extraction
from ledgerline.llm.common import ship


def text(html, **repeated):
    return extraction.main_text(extraction.parse(html), **repeated)


def test_class_names_count_as_a_whole():
    names = ("social-history", "search-engines", "alert-fatigue", "menu-planning", "promotional-science", "related-work", "ads-in-history")
    for name in names:
        assert text(f"<main><p>a</p><div class='{name}'><p>kept</p></div></main>") == "a\nkept"
        assert text(f"<body><p>a</p><section id={name}><p>kept</p></section></body>") == "a\nkept"
    for name in ("ad", "ads", "left-sidebar", "cookie-notice", "comments", "site-footer", "share-buttons", "x nav-bar", "advert_slot"):
        assert text(f"<body><p>a</p><div class='{name}'><p>gone</p></div></body>") == "a"


def test_only_explicit_names_count_within_an_article():
    for name in ("alert", "search", "menu", "social", "related", "notice", "banner"):
        assert text(f"<article><p>a</p><div class='{name}'>kept</div></article>") == "a\nkept"
    for name in ("comments", "ad", "share-bar", "advertisement", "disqus_thread"):
        assert text(f"<article><p>a</p><div class='{name}'>gone</div></article>") == "a"
    assert text("<article><p>a</p><form>f</form><nav>n</nav><script>s</script><footer>f</footer></article>") == "a"


def test_what_stands_beside_a_lone_article_stays():
    page = "<body><nav>menu</nav><div><h1>Title</h1><p>lead</p><article><p>one</p></article><p>last</p></div><footer>f</footer></body>"
    assert text(page) == "Title\nlead\none\nlast"
    two = "<body><nav>m</nav><div><h1>T</h1><div><article>one</article></div><article>two</article></div><p>out</p></body>"
    assert text(two) == "T\none\ntwo"
    assert text("<article>alone</article>") == "alone"
    assert text("<p>out</p><main><p>in</p></main><article>also</article>") == "in\nalso"


def pages_of(spark, pages):
    ship(spark)
    rows = [(i, url, html, "x", 1) for i, (url, html) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, template string, host int")
    return {r.page_id: r.text for r in extraction.extracted(df).collect()}


def test_sections_of_some_pages_stay_and_those_of_most_go(spark):
    own = "<main><p>text {}</p>{}</main>"
    few = "<section><h2>Ingredients</h2><p>salt</p></section>"
    most = "<div>Follow us on all channels</div>"
    pages = [("http://large.example/", own.format(i, (few if i < 10 else "") + most)) for i in range(60)]
    found = pages_of(spark, pages)
    assert found == {i: f"text {i}" + ("\nIngredients\nsalt" if i < 10 else "") for i in range(60)}
    outside = [("http://other.example/", ("<div>Told on some</div>" if i < 6 else "") + f"<p>own {i}</p>") for i in range(60)]
    assert pages_of(spark, outside) == {i: f"own {i}" for i in range(60)}


def test_templates_equal_brute_force(spark):
    ship(spark)
    pages = []
    for i in range(40):
        host = f"h{i % 3}.example"
        blocks = [f"<div>block {k}</div>" for k in range(8) if (i // 3) % (k + 1) == 0]
        inner = "".join(f"<section>part {k}</section>" for k in range(5) if (i // 3) % (k + 2) == 0)
        pages.append((i, f"http://{host}/{i}", f"<body>{''.join(blocks)}<main><p>own {i // 2}</p>{inner}</main></body>"))
    on, all_pages = defaultdict(set), defaultdict(set)
    trees = {i: extraction.parse(html) for i, _, html in pages}
    for i, _, _ in pages:
        body = extraction.main_text(trees[i])
        all_pages[i % 3].add(body)
        for h in extraction.template_candidates(trees[i]):
            on[i % 3, h].add(body)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in extraction.site_templates(df).collect()}
    signed = lambda hashes: {h - (1 << 64) if h >> 63 else h for h in hashes}
    for i, _, _ in pages:
        mine = {h for h in extraction.template_candidates(trees[i]) if len(on[i % 3, h]) >= extraction.MANY_PAGES}
        most = {h for h in mine if 100 * len(on[i % 3, h]) >= extraction.MOST_PERCENT * len(all_pages[i % 3])}
        assert (set(found[i].template) if i in found else set()) == signed(mine)
        assert (set(found[i].everywhere) if i in found else set()) == signed(most)


def test_deep_nesting_takes_linear_time():
    for start, end in (("<div>", "</div>"), ("<span>", "</b>"), ("<p><object><div>", ""), ("<ul><li>", "</i>"), ("<article>", "")):
        begin = time.perf_counter()
        extraction.main_text(extraction.parse(start * 100_000 + "deep" + end * 100_000))
        assert time.perf_counter() - begin < 20, start
