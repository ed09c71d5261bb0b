"""Copies and like headings inside the article are not template."""

import random

import brute
import pytest

from motionlake.llm import pages


def texts(spark, rows):
    table = spark.createDataFrame([(i, "http://a.b/c", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.extract_pages(table).collect()}


def test_like_headings_of_articles_stay(spark):
    page = "<body><div class=x><p>Same words on every page</p></div><article><h2>Method</h2><p>{}</p></article></body>"
    got = texts(spark, [page.format(f"step {i} " * 9) for i in range(12)])
    assert all(got[i] == "Method\n" + (f"step {i} " * 9).strip() for i in got)
    assert not any("Same" in t for t in got.values())


def test_copies_of_one_body_count_once(spark):
    page = "<body><div class=y><h1>{0}</h1><p>{1}</p></div><div class=z><p>words around it that are longer than the text {2}</p></div></body>"
    copies = [page.format("Title", "own text", "of the page " * 4)] * 12
    own = [page.format(f"Head {i}", f"body {i} {i}", "of the page " * 4) for i in range(4)]
    got = texts(spark, copies + own)
    assert all("Title\nown text" in got[i] for i in range(12))
    assert all(f"Head {i}\nbody {i} {i}" in got[12 + i] for i in range(4))


def test_copies_with_other_furniture_count_once(spark):
    page = "<body><nav>menu {0}</nav><div class=y><h1>Title</h1><p>own text</p></div></body>"
    got = texts(spark, [page.format(i) + f"<footer>{'foot ' * 9}</footer>" for i in range(12)])
    assert set(got.values()) == {"Title\nown text"}


@pytest.mark.parametrize(
    "names", ["content has-sidebar", "entry-content print-content", "post no-comments", "article-body alert-free", "content sidebar-left", "page-wrapper with-ads modal-open"]
)
def test_names_of_a_container_do_not_drop_the_article(spark, names):
    page = "<body><nav>menu a b</nav><div class='{0}'><h1>Title {1}</h1><p>{2}</p><div class='comments'><p>no {1}</p></div></div><footer>foot</footer></body>"
    got = texts(spark, [page.format(names, i, f"own words {i} " * 20) for i in range(3)])
    assert all(got[i] == f"Title {i}\n" + (f"own words {i} " * 20).strip() for i in got)


def test_parts_of_a_page_still_go_by_name(spark):
    page = (
        "<body><form id=aspnet><div class='site-header'>top</div><div id=main><h1>Head</h1><p>{0}</p></div>"
        "<div class='sidebar-content'>side</div><section class='post-comments'><p>{1}</p></section><div hidden><h1>x</h1>{2}</div></form></body>"
    )
    got = texts(spark, [page.format("short text", "long opinions of readers " * 30, "unseen " * 200)])
    assert got[0] == "" or got[0] == "Head\nshort text"
    got = texts(spark, [page.format("long text of the page " * 60, "opinions " * 9, "x")])
    assert got[0] == "Head\n" + ("long text of the page " * 60).strip()


def site(rng, n):
    """Pages without an article mark or telling names: only repetition shows what is template."""
    out = []
    for i in range(n):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
        out.append(
            f"<body><div class=a1><ul><li>Home</li><li>World</li><li>Sport</li></ul></div><div class=b2><div class=c3><h2>T{i}</h2><p>{own}</p></div></div>"
            f"<div class=d4><p>Buy our shoes today</p></div><div class=e5><p>All rights of the house</p><p>Write to us</p></div></body>"
        )
    return out


def test_template_goes_by_importance_alone(spark):
    rows = site(random.Random(5), 20)
    got = texts(spark, rows)
    assert all(got[i].startswith(f"T{i}\nw") and got[i].count("\n") == 1 for i in got)
    assert not any(w in t for t in got.values() for w in ("Home", "Sport", "shoes", "rights", "Write"))


def test_tree_equals_brute_force(spark):
    rng = random.Random(6)
    rows = site(rng, 9) + ["<body><div class=b2><p>only <b>bold</b> here</p></div><div class=a1><ul><li>Home</li></ul></div></body>"] * 2
    table = spark.createDataFrame([(i, "http://h.example/x", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    got = sorted((r.pages, r.chars, round(r.importance, 9)) for r in pages.style_tree(table).collect())
    assert got == sorted((n, c, round(v, 9)) for n, c, v in brute.style_tree(rows, pages.PRESENTATION))
