from __future__ import annotations

import time

import pytest

from navpulse.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div>
<article><header><h1>Head &amp; line</h1></header><p>One&nbsp; two<br>three <b>bold<p>Next <script>x<y</script>part.
<div class="share-box">Share this</div><div class="comments"><p>Nice!</p></div><ul><li>a<li>b</ul>
<aside>Side</aside><form><p>Name</p></form><table><tr><td>c1<td>c2</table><!-- gone --></article>
<footer>&copy; Site</footer></body></html>"""


def one(page: str) -> str:
    return "\n".join(H.read(page))


def test_what_an_element_says_about_itself():
    assert one(PAGE) == "Head & line\nOne two three bold\nNext part.\na\nb\nc1\nc2"


def test_broken_markup():
    assert one("") == ""
    assert one("plain  text") == "plain text"
    assert one("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert one("<article><p>cut off <a href='x") == "cut off"
    assert one("<script>never closed <p>x</p>") == ""
    assert one("1 < 2 &lt; 3 &#x41; &bogus;") == "1 < 2 < 3 A &bogus;"
    assert one("<p>" * 3000 + "deep") == "deep"
    assert one("<div>" * 3000 + "deep") == "deep"
    assert one('<p title="a > b">x</p>') == "x"


def test_recurring_subtrees_of_a_host_go(spark):
    frame = "<html><body><div><p>Welcome to the site</p><ul><li>Here</li></ul></div><p>Text number {n}</p><p>Same words</p></body></html>"
    rows = [(n, f"http://Host.example/{n}", frame.format(n=n), "x") for n in range(12)]
    rows += [(50 + n, f"https://other.example:80/{n}", frame.format(n=n), "x") for n in range(3)]
    article = "<article><p>Same words</p><div><p>Read more</p></div><p>Only {n}</p></article>"
    rows += [(100 + n, "http://art.example/x", article.format(n=n), "x") for n in range(10)]
    rows += [(200, None, None, "x"), (201, "u", "", None), (0, "http://Host.example/0", frame.format(n=0), "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {}
    for r in H.main_text(df).collect():
        got[r["page_id"]] = r["text"]
        assert r["n_chars"] == len(r["text"])
    assert len(H.main_text(df).collect()) == len(rows)
    assert got[3] == "Text number 3\nSame words"  # a paragraph is no box
    assert got[51] == "Text number 1\nSame words"  # three pages are all of that host
    assert got[104] == "Same words\nOnly 4"
    assert got[200] == got[201] == ""
    assert H.main_text(df.where("false")).collect() == []


def texts_of(spark, rows: list[tuple[int, str, str]]) -> dict[int, str]:
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in H.main_text(df).collect()}


def test_copies_of_a_page_count_once(spark):
    bare = "<body><div><p>Story of {n}</p><p>And its end {n}</p></div></body>"
    boxed = "<article><div class=body><p>Told by {n}</p></div></article>"
    rows = [(n, "http://half.example/", bare.format(n=0)) for n in range(15)]
    rows += [(n, "http://half.example/", bare.format(n=n)) for n in range(15, 30)]
    rows += [(n, "http://boxed.example/", boxed.format(n=1)) for n in range(100, 112)]
    got = texts_of(spark, rows)
    assert got[3] == "Story of 0\nAnd its end 0" and got[20] == "Story of 20\nAnd its end 20"
    assert got[105] == "Told by 1"


def test_template_of_small_hosts_and_of_sections(spark):
    page = "<body><div><p>Part {s}</p><ul><li>Go</li></ul></div><p>Text number {n}</p></body>"
    rows = [(n, "http://small.example/", page.format(s="one", n=n)) for n in range(4)]
    rows += [(n, "http://large.example/", page.format(s=n % 40, n=n)) for n in range(1000, 1400)]
    got = texts_of(spark, rows)
    assert all(text == f"Text number {n}" for n, text in got.items())


def test_text_outside_an_article_stays():
    assert one("<div class=story><p>Story</p></div><article><h3>Teaser</h3></article>") == "Story\nTeaser"
    for name in ("has-sidebar", "layout no-sidebar", "with-widget", "main-nav-wrapper"):
        assert one(f"<div class='{name}' id='{name}'><p>Own</p></div>") == "Own", name
    for name in ("sidebar", "layout nav", "widget"):
        assert one(f"<div class='{name}'><p>Own</p></div>") == "", name
        assert one(f"<div class='{name}'><p>Before</p><main><p>Own</p></main></div>") == "Before\nOwn", name
    assert one("<form><div class=menu>Go</div><article>Own</article></form>") == "Own"
    assert one("<article>Own</article><div id=comments><article class=comment-body>Nice</article></div>") == "Own"
    assert one("<aside class=related><article>Card</article></aside><p>Own</p>") == "Own"


def test_boxes_outside_an_article_are_judged_by_recurrence(spark):
    page = "<div><p>Call us</p></div><div class=story><p>Story {n}</p></div><article><p>Card {n}</p></article>"
    got = texts_of(spark, [(n, "http://mixed.example/", page.format(n=n)) for n in range(6)])
    assert all(text == f"Story {n}\nCard {n}" for n, text in got.items())


def test_navigation_and_adverts_are_counted_too(spark):
    page = """<nav><ul><li>Home</li><li>News</li></ul></nav><div class=ad>Buy</div>{more}
    <article><p>Story {n}</p></article><footer>Site</footer>"""
    rows = [(n, "http://a.example/", page.format(n=n, more="")) for n in range(4)]
    rows += [(9, "http://a.example/", page.format(n=9, more="<div><ul><li>Home</li><li>News</li></ul><p>Own</p></div>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = {r["page_id"]: r["text"] for r in H.main_text(df, lists=False).collect()}
    assert alone == {n: f"Story {n}" for n in range(4)} | {9: "Own\nStory 9"}
    assert texts_of(spark, rows) == alone
    made = H.parsed(rows[0][2])
    assert made.quiet == [True] * 3 + [False, True]
    assert [(b.lo, b.hi, b.loud) for b in made.boxes] == [(0, 2, False), (0, 2, False), (2, 3, False), (4, 5, False)]


def paragraphs(seed: str, count: int, size: int = 12) -> list[str]:
    return [" ".join(f"{seed}{k}x{w}" for w in range(size)) for k in range(count)]


@pytest.mark.parametrize("copies", [2, 3, 4, 60])
def test_near_copies_keep_what_they_share(spark, copies):
    """Each copy differs in one word; half of the host's other pages are of their own."""
    rows, told = [], {}
    for n in range(copies):
        told[n] = paragraphs("a", 6) + [f"unique {n}"]
        rows.append((n, "http://near.example/", "".join(f"<div><p>{p}</p></div>" for p in told[n])))
    assert texts_of(spark, rows) == {n: "\n".join(t) for n, t in told.items()}
    menu = "<div><ul><li>Home</li><li>News</li></ul></div>"
    rows = [(n, url, menu + page) for n, url, page in rows]
    for n in range(1000, 1000 + 2 * copies + 2):
        told[n] = paragraphs(f"b{n}y", 3)
        rows.append((n, "http://near.example/", menu + "".join(f"<section>{p}</section>" for p in told[n])))
    assert texts_of(spark, rows) == {n: "\n".join(t) for n, t in told.items()}


def test_hosts_of_one_to_five_pages_lose_their_menu_alike(spark):
    page = "<div>Our menu</div><div><p>{text}</p></div>"
    rows, told = [], {}
    for size in range(1, 6):
        for n in range(size):
            told[10 * size + n] = paragraphs(f"h{size}p{n}w", 1)[0]
            rows.append((10 * size + n, f"http://h{size}.example/", page.format(text=told[10 * size + n])))
    got = texts_of(spark, rows)
    assert got.pop(10) == "Our menu\n" + told.pop(10)  # one page shows no recurrence
    assert got == told


def test_time_grows_with_the_page():
    n = 40_000
    quarter = "promo_" * 2_000
    for page, blocks in (
        ("<div>x" * n, n), ("<b>x" * n, 1), ("<a " * n + '"', 0), ("<div>" * n + "<li>y</li>" * n, n),
        ("<div>" * n + "</b>x" * n, 1), ("<svg>" + "</svg " * n, 0), (f"<div class='{quarter}!'>x", 1),
        ("<span class=ad>x" * n, 0), ("<a '\">" * n, 0), ("<i><p>x" * n, n),
    ):
        start = time.process_time()
        assert len(H.read(page)) == blocks, page[:20]
        assert time.process_time() - start < 20, page[:20]


def test_numbers_of_any_length_and_quotes_without_a_partner():
    assert one("&#" + "9" * 6000 + ";x &#" + "0" * 6000 + "65;") == "\ufffdx A"
    assert one("<p>a</p><a title=\">b</a><p>c</p>") == "a\nb\nc"


def test_boxes_are_hashed_from_their_children():
    same = [H.parsed(f"<div><ul><li>{x}</li></ul></div><p>{y}</p>").boxes for x, y in (("a", "b"), ("a", "c"), ("d", "b"))]
    trees = [[b.tree for b in boxes] for boxes in same]
    assert trees[0] == trees[1] and not set(trees[0]) & set(trees[2])
    assert same[0][0].rest == same[2][0].rest != same[1][0].rest
    apart = [H.parsed(p).boxes[0].tree for p in ("<div><p>a</p>b</div>", "<div><p>a b</p></div>", "<div>a<p>b</p></div>")]
    assert len(set(apart)) == 3
