import html as std
import re

from slipweave.llm import html

SF = "/root/testdata/sf0.001"


def article(page):
    inner = re.sub(r"</?(p|h1)>", "\n", page.split("<article>")[1].split("</article>")[0])
    lines = (" ".join(std.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in inner.split("\n"))
    return "\n".join(x for x in lines if x)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_furniture_goes_and_short_blocks_stay():
    page = """<!doctype html><html><body class="no-sidebar"><header>Site</header><nav><ul><li><a href=a>Home<li><a href=b>About</ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article><h1>T&eacute;st &amp page</h1><p>One   long
    paragraph with <b>bold</b> <a href=c>link</a> text and more of it, going on for a while.<p>Be.<div class=ad>Buy</div><form>Mail<input name=q></form>
    <ul><li>item one<li>item two</ul><script>var x = "</p>";</script><p>Last one here, again with a good number of words in it.</p></article></main>
    <aside>Side</aside><section id="comments"><p>A reader's long comment, which goes on and on and on and on and on and on and on.</p></section><footer>&copy; x</footer>"""
    assert html.extract(page) == "Tést & page\nOne long paragraph with bold link text and more of it, going on for a while.\nBe.\nitem one\nitem two\nLast one here, again with a good number of words in it."


def test_without_an_article():
    text = "A paragraph of the text that is long enough to be taken for content, surely."
    menu = "".join(f"<li><a href={i}><span>m{i}</span></a></li>" for i in range(12))
    page = f"<html><body><ul>{menu}</ul><div><p>{text}</p><p>Short.</p><p>{text}</p></div><ul>{menu}</ul></body></html>"
    assert html.extract(page) == f"{text}\nShort.\n{text}"


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "u", "plain words"), (3, "u", "plain words"), (None, "u", "<p>a</p><![x y]><p>b"), (6, "u", "<article><p>" + "word " * 200000 + "</p>"), (7, "u", "<nav>x</nav>"), (8, "u", "</p></div><<>&#x41;&bogus;")]
    pages = spark.createDataFrame([(a, b, c, "t") for a, b, c in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text[:20], r.n_chars) for r in html.main_text(pages).collect())
    assert got == [(0, "a\nb", 3), (1, "", 0), (2, "", 0), (3, "plain words", 11), (3, "plain words", 11), (6, ("word " * 4), 999999), (7, "", 0), (8, "<<>A&bogus;", 11)]
    assert html.main_text(pages.limit(0)).collect() == []
