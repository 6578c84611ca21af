import html
import re
from collections import Counter

import duckdb
import pytest

from lakeweave.llm import html_main as h
from lakeweave.llm import queries


def brute_surges(lengths, window):
    """Runs of lines between which `window` or more lines in a row are empty."""
    out = []
    for i, n in enumerate(lengths):
        if n:
            if out and i - out[-1][1] < window:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
    return [tuple(x) for x in out]


def test_surges_equal_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(500):
        lengths = [rng.choice([0, 0, 0, 5]) for _ in range(rng.randint(0, 25))]
        for window in (1, 2, 3):
            assert h.surges(lengths, window) == brute_surges(lengths, window)


PAGE = """<!doctype html><html><head><title>T</title><script>if (a < b) { x = "</p>" }</script></head><body class="home ad">
<header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice"><p>We use cookies, lots of them, and this notice is much longer than any paragraph of the page.</p></div>
<article><h1>Title &amp; more</h1><p>One  <b>bold</b>
line&nbsp;here<br>same block<p>Tiny.</p>
<div class="sidebar">Aside</div><aside>More aside</aside>
<!-- a comment <p>no</p> --><p>x &lt; y &#233; &copy;</p><form><label>Name</label><input></form>
<div id="comments"><p>First!</p><div>Second</div></div>
<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>
<div class="ad">Buy</div><footer>&copy; us</footer></body></html>"""


def test_page_by_hand():
    assert h.main_text(PAGE) == "Title & more\n\nOne bold line here same block\n\nTiny.\n\nx < y é ©\n\na\n\nb\n\nc\n\nd"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p></p><div> </div>", ""),
        ("plain words", "plain words"),
        ("<p>cut <b>off", "cut off"),
        ("<p>cut off <b att", "cut off"),
        ("a < b and c > d", "a < b and c > d"),
        ("</p></div>stray<p>tags</article>", "stray\n\ntags"),
        ("<p title='a > b' data-class=ad>kept</p>", "kept"),
        ("<p class=lead>download headings</p>", "download headings"),
        ("<script>never ends <p>x</p>", ""),
        ("<![CDATA[a & b]]>", "a & b"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ("<div class='layout sidebar'><div class='ad'>buy</div><article><p>in</p><div class=comments>c</div></article></div><div class='ad'>x</div>", "in"),
        ("<div class='has-sidebar no-comments'><p>kept</p></div>", "kept"),
        ("<article><div class='post-header'><h1>T</h1></div><p>x <a href=/>only a link</a></p></article>", "T\n\nx only a link"),
        ("<div><a href=/>Home</a> | <a href=/a>About</a></div><p>Text of the page.</p><p>More.</p><div><a href=/b>Imprint</a></div>", "Text of the page.\n\nMore."),
        ("<p>" + "long " * 50 + "</p><nav>m</nav><p>" + "too " * 40 + "</p><nav>m</nav><p>x</p>", ("long " * 50).strip() + "\n\n" + ("too " * 40).strip()),
        ("<div class='ad'>" * 3000 + "x" + "</div>" * 3000 + "<p>y", "y"),
    ],
)
def test_cases(page, want):
    assert h.main_text(page or "") == want


LONG = "a sentence that is long enough " * 6


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><div>Home of all things</div></div><div><h2>Title</h2><p>{LONG}</p></div><div><div>Small print of it</div></div>", f"Title\n\n{LONG.strip()}"),
        (f"<div><div><h1>Title</h1></div></div><div><div><p>{LONG}</p></div></div><div><div>Small print of it</div></div>", f"Title\n\n{LONG.strip()}"),
        (f"<p>{LONG}</p><div><div>between them</div></div><div><p>{LONG}</p></div>", f"{LONG.strip()}\n\nbetween them\n\n{LONG.strip()}"),
        (f"<div><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>", LONG.strip()),
        (f"<article><p>{LONG}</p></article><div><div><p>{LONG}</p></div></div>", LONG.strip()),
        (f"<div class=comments><p>{LONG}</p></div><p>x y</p>", LONG.strip()),
    ],
)
def test_surges_and_ties(page, want):
    assert h.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><form id=aspnetForm><div>menu</div><article><h1>T</h1><p>in</p></article></form></body>", "T\n\nin"),
        ("<body><form id=aspnetForm><nav>m</nav><div class='content-widget'><p>The text of the page.</p></div></form><footer>f</footer></body>", "The text of the page."),
        ("<div class='search-results'><p>The text of the page.</p><form>Search</form></div><p>And its end.</p>", "The text of the page.\n\nAnd its end."),
        ("<div hidden><p>Much that no reader ever sees.</p></div><p>seen</p>", "seen"),
        ("<p>The text of the page.</p><form>Search</form>", "The text of the page."),
    ],
)
def test_wrappers_with_the_pages_text_are_kept(page, want):
    assert h.main_text(page) == want


def test_short_runs_beside_a_long_one_are_kept():
    long = ("long " * 20000).strip()
    short = ("too " * 4999).strip()
    page = f"<h1>Title</h1><div class=share>s</div><p>{long}</p><div class=ad>a</div><p>{short}</p><nav>m</nav><p>|</p>"
    assert h.main_text(page) == f"Title\n\n{long}\n\n{short}"


def article_of(page):
    """What the article element of the driver's pages holds, read plainly."""
    article = re.search("<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", re.sub("</?b>", "", article))]
    return "\n\n".join(b for b in blocks if b)


def f1(text, want):
    a, b = Counter(text.split()), Counter(want.split())
    return 2 * (a & b).total() / max(1, a.total() + b.total())


def test_the_distribution_decides_where_names_say_nothing():
    """Ablation: article, nav and footer elements renamed to div, all classes alike, and a sidebar of many short lines added."""
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()
    exact, score = 0, {"on": 0.0, "all lines": 0.0, "no lengths": 0.0}
    for (page,) in pages:
        want, bare = article_of(page), re.sub('class="[^"]*"', 'class="x"', re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", page))
        listed = "".join(f"<li>topic {k}</li>" for k in range(400))  # a sidebar without links
        bare = bare.replace("</nav>", "").replace("</ul></div>", f"</ul></div><div><ul>{listed}</ul></div>", 1)
        got, found = h.main_text(bare), h.lines(bare)
        exact += got == want
        score["on"] += f1(got, want)
        score["all lines"] += f1("\n".join(x.text for x in found), want)
        for x in found:
            x.length = min(1, x.length)
        score["no lengths"] += f1("\n".join(x.text for r in h.choose(found, h.runs(found)) for x in found[r.start : r.stop]), want)
        assert h.main_text(page) == want
    mean = {k: v / len(pages) for k, v in score.items()}
    assert exact >= 0.96 * len(pages) and mean["on"] > 0.96 and mean["all lines"] < 0.95 and mean["no lengths"] < 0.95, (exact, mean)


def test_query_equals_a_plain_reading_of_these_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in queries.queries()["op7_html_extraction"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        want = article_of(p.html)
        assert (rows[p.page_id].url, rows[p.page_id].text, rows[p.page_id].n_chars) == (p.url, want, len(want))


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (None, "u", "<p>x", "b"), (2, "u", "<p>y</p>" * 20000, "c"), (2, "u", "", "c")], "page_id long, url string, html string, text string")
    rows = h.extract(pages).collect()
    assert sorted((r.page_id or -1, r.n_chars) for r in rows) == [(-1, 1), (1, 0), (2, 0), (2, 59998)]
    assert h.extract(pages.limit(0)).count() == 0
