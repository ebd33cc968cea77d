"""Main text of pages."""

from __future__ import annotations

import html
import re

from pyspark.sql import functions as F

from sensorloom.llm import html_text
from sensorloom.llm.html_text import extract_pages, main_text
from sensorloom.llm.queries import op8_html_extraction

SF = "/root/testdata/sf0.001"


def plain(page: str) -> str:
    inside = page.split("<article>")[1].split("</article>")[0]
    blocks = (" ".join(html.unescape(re.sub(r"</?(b|br)>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inside))
    return "\n".join(b for b in blocks if b)


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op8_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


PAGE = """<html><body class="page has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class="cookie-notice">We use cookies, ok.</div><div id="wrap">
<div class="sidebar"><ul><li><a>One</a><li><a>Two</a></ul></div><div class="content"><h1>Title  here</h1><p>First para with text, long enough to count. And more of it, yes.<br>line two<p>Short.
<ul><li>item one, is text</li><li>item two</li></ul><div class="ad">Buy now!</div><blockquote>Quote &amp; more &#233;.</blockquote><p>Last paragraph, that also has quite some text in it. Fine.</div></div>
<div class="comments"><p>Great article, I liked all of it very much. Thanks for this.</p></div><form><input name=a>Sub</form><footer>&copy; x</footer><script>if(a<b){"</p>"}</script></body></html>"""
TEXT = "Title here\nFirst para with text, long enough to count. And more of it, yes. line two\nShort.\nitem one, is text\nitem two\nQuote & more é.\nLast paragraph, that also has quite some text in it. Fine."


def bare(page: str) -> str:
    """The page without landmarks, classes, ids and roles."""
    return re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(?:nav|footer|article|aside|header|main)\b", r"<\1div", page))


def test_paths_choose_the_text(monkeypatch):
    """Pages without landmarks and names give the same text, with short blocks around it too; with a constant score they do not."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    assert all(main_text(p) == plain(p) for p in pages)
    assert [i for i, p in enumerate(pages) if main_text(bare(p)) != plain(p)] == []
    teasers = "".join(f"<div>Some few words {i}</div>" for i in range(4))
    noisy = [(bare(p).replace("<body>", f"<body>{teasers}").replace("</body>", f"{teasers}</body>"), plain(p)) for p in pages if len(plain(p)) > 600]
    assert len(noisy) > 100 and all(main_text(p) == t for p, t in noisy)
    # Without a title, and between sentences: what the ratios find by themselves.
    teasers = "".join(f"<div>Read how the {x} was made over the years, and what it has cost so far.</div>" for x in ("bridge", "tower", "railway", "harbour"))
    flat = [(bare(p).replace("h1>", "p>").replace("<body>", f"<body>{teasers}").replace("</body>", f"{teasers}</body>"), t) for p, t in ((p, plain(p)) for p in pages) if len(t) > 800]
    told = [main_text(p) for p, _ in flat]
    assert len(flat) > 100 and sum(x == t for x, (_, t) in zip(told, flat, strict=True)) > 0.95 * len(flat)
    monkeypatch.setattr(html_text, "score", lambda nodes, blocks: [setattr(b, "score", 1.0) for b in blocks])
    changed = sum(main_text(p) != x for (p, _), x in zip(flat, told, strict=True))
    assert changed > len(flat) / 4, changed


def test_names_of_paragraphs_say_nothing():
    """Paragraphs of the article may be named as anything; a wrapper with most of the text may, too."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet").html
    names = "share-note search header comments ad social notice login related popup".split()
    for n, page in enumerate(pages):
        name = names[n % len(names)]
        before, _, rest = page.partition("<article>")
        inside, _, after = rest.partition("</article>")
        named = f"{before}<article>{inside.replace('<p>', f'<p class="{name}">')}</article>{after}"
        assert main_text(named) == plain(page), name
        if n < 250:
            assert main_text(bare(page).replace("<p>", f'<p id="{name}">', 1)) == plain(page), name
    text = "<h2>T</h2><p>A paragraph of some length, with marks; and more of it.</p><p>Then some more, yes.</p>"
    assert main_text(f'<body><div class="share-page">{text}</div><div class="share">Share this</div></body>').startswith("T\nA paragraph")


def test_sentences_beside_the_article():
    """Teasers that are sentences, before and after the article: right on 95 % of pages with a title."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet").html
    teasers = "".join(f"<div>Read how the {x} was made over the years, and what it has cost so far.</div>" for x in ("bridge", "tower", "railway", "harbour"))
    for around in ("", teasers):
        right = sum(main_text(bare(p).replace("<body>", f"<body>{around}").replace("</body>", f"{teasers}</body>")) == plain(p) for p in pages)
        assert right >= 0.95 * len(pages)


def test_a_title_over_other_text():
    """A title with a short line beside the article's own element: the line's path has the lower ratios."""
    body = "".join(f"<p>Paragraph {i} of some length, with marks; and more of it. Then some more, yes, and so on.</p>" for i in range(6))
    page = f'<body><div class="hero"><h1>T</h1><span>by me</span></div><div class="x">{body}</div></body>'
    assert main_text(page).count("Paragraph") == 6


def test_no_name_makes_content():
    """An article element without text of its own, beside long paragraphs elsewhere, is not taken."""
    text = "A paragraph of some length, with marks; and more of it. Then some more, yes."
    page = f"<body><article><p>x</p></article><div><div><p>{text}</p><p>{text}</p><p>short</p></div></div><div><div>menu</div></div></body>"
    assert main_text(page) == f"{text}\n{text}\nshort"


def test_page_without_an_article():
    assert main_text(PAGE) == TEXT
    assert main_text(PAGE.replace('class="content"', 'class="post"')) == TEXT


def test_parts_of_an_article():
    page = '<body><main><header><h1>T</h1><p>by</p></header><section><p>Text of it, and more.</p></section><section class="comments"><p>c</p></section><aside>no</aside></main></body>'
    assert main_text(page) == "T\nText of it, and more."


def test_broken_markup():
    assert main_text(None) == main_text("") == main_text("<html><body><nav>x</nav>") == ""
    assert main_text("only text") == "only text"
    assert main_text("<p>a<p>b") == "a\nb"
    assert main_text('<article><p title="a > b">x <b>y</p><p>z</article') == "x y\nz"
    assert main_text("<article><p>1 < 2 &lt; 3</p><!-- <p>no</p> --><script>var a = '<p>'</article>") == "1 < 2 < 3"
    assert main_text("<article>" + "<div>" * 3000 + "deep</article>") == "deep"


def test_long_quoted_values():
    """A > in a quoted value ends no tag, however long the value is."""
    long = "x > y " * 5000
    for value in (f'"{long}"', f"'{long}'", f"""'{{"a": "{long}"}}'""", f'"<p>{long}</p>"'):
        assert main_text(f"<article><p data-a={value} title='b > c'>one</p><p>two</p></article>") == "one\ntwo", value[:20]
    assert main_text("<article><p title=\"" + long + ">one</p></article>").endswith("one"), "no closing quote: the first > ends the tag"


def test_edges(spark):
    rows = spark.createDataFrame([(1, "u", None), (None, None, "<p>a</p>"), (1, "u", "")], "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    assert sorted((r.page_id is None, r.text, r.n_chars) for r in extract_pages(rows).collect()) == [(False, "", 0), (False, "", 0), (True, "a", 1)]
    assert extract_pages(rows.limit(0)).count() == 0
