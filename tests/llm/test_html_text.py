import random

import pytest

from emberlane.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Top</header>
<nav><ul><li>Home</li></ul></nav><div class="cookie-banner">We use cookies</div><article><header><h1>Head &amp; line</h1></header>
<p>One&nbsp;<b>two</b>
three<p>Four<br>five<script>var x = "</p>";</script><div class="share-buttons"><div>Share</div></div><p>Six &lt;b&gt;
<form><input>Mail</form></article><section id="comments"><article class="comment">Nice</article></section><footer>&copy;</footer></body>"""


@pytest.mark.parametrize(
    "page, article, opened",
    [
        (PAGE, ["Head & line", "One two three", "Four five", "Six <b>"], []),
        ("<main><p>a</p></main><p>b", ["a"], []),
        ("<p>a<p>b<div hidden>c</div><div style='display:none'>d</div>", [], ["a", "b"]),
        ("<article>cut off &amp", ["cut off &"], []),
        ("<article>x<!-- no --> y<p", ["x y"], []),
        ("no markup & nothing else", [], ["no markup & nothing else"]),
        ("", [], []),
        ("<div class='ad'>x</div><script>y", [], []),
        ("<article><p title='a>b'>in</p><aside>out</aside></article>", ["in"], []),
    ],
)
def test_blocks(page, article, opened):
    found = html_text.page_blocks(page)
    assert (found[0], found[1]) == (article, opened)


def test_suffix_array_and_coverage_equal_brute_force():
    draw = random.Random(3)
    for _ in range(60):
        streams = [[draw.choice("abc") for _ in range(draw.randint(0, 14))] for _ in range(draw.randint(1, 5))]
        flat = html_text.np.array([ord(c) for s in streams for c in s], dtype=html_text.np.int64)
        if len(flat):
            assert html_text.suffix_array(flat).tolist() == sorted(range(len(flat)), key=lambda i: flat[i:].tolist())
        for least, pages in ((2, 2), (3, 3)):
            runs = {}
            for p, s in enumerate(streams):
                for i in range(len(s) - least + 1):
                    runs.setdefault(tuple(s[i : i + least]), set()).add(p)
            for s, hit in zip(streams, html_text.covered(streams, least, pages), strict=True):
                wanted = [
                    any(len(runs.get(tuple(s[i : i + least]), ())) >= pages for i in range(max(0, j - least + 1), min(j, len(s) - least) + 1))
                    for j in range(len(s))
                ]
                assert hit.tolist() == wanted


def test_repeats_of_a_host_go_and_unique_blocks_stay(spark):
    menu = "<div>Home News Sport Weather Travel Money</div>"
    end = "<div>All rights reserved by the example company since long ago</div>"
    pages = [(k, f"https://a.example.com/{k}", f"{menu}<p>Unique story number {k} told in {k * 37} own words</p>{end}") for k in range(9)]
    pages += [(100, "https://b.example.com/", f"{menu}<p>alone</p>"), (101, None, None), (102, "x", ""), (9, "https://a.example.com/9", "<article>All of it</article>")]
    rows = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r.text for r in html_text.extract(rows, pages_per_group=4, min_pages=2).collect()}
    assert len(got) == len(pages)
    assert [got[k] for k in range(9)] == [f"Unique story number {k} told in {k * 37} own words" for k in range(9)]
    assert got[100] == "Home News Sport Weather Travel Money\nalone"
    assert got[101] == got[102] == "" and got[9] == "All of it"
    assert html_text.extract(rows.filter("false")).count() == 0


def test_repeats_are_counted_over_the_whole_host(spark):
    notice = "<div>Subscribers read this with no limit at all today</div>"
    rows = [(k, f"https://a.example.com/{k}", f"<p>Unique story {k} told in {k * 37} own words</p>{notice * (k % 6 == 0)}") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    # Ten of sixty pages bear the notice: fewer than three in many of the groups, whatever their size.
    for size in (4, 20, 250):
        got = {r.page_id: r.text for r in html_text.extract(pages, pages_per_group=size).collect()}
        assert got == {k: f"Unique story {k} told in {k * 37} own words" for k in range(60)}
