import html
import re

from trackloom.llm.html import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies and the like for you.</div>%s<aside>See also the other one</aside>
<section id="comments"><p>I like this, and it is the best of all that I have seen in the world.</p></section><form><label>Name</label><input></form><footer>&copy; 2020 Some One</footer></body></html>"""
GOOD = "<p>This is the first paragraph of the text, and it is long enough to be seen as good by the rules of the page for all.</p>"
LATER = "<p>Then there is the second paragraph of the text &amp; it has many of the words that are stop words in it.</p>"


def test_an_article():
    inside = f"<article><header><h1>A\n heading</h1></header>{GOOD}<p>Zzz.<p>Qqq <b>wo</b>rd<br>next&nbsp;&eacute;<script>x</script></p><nav><a href=1>1</a></nav><div class='share-buttons'>Share</div></article>"
    got = main_text(PAGE % inside)
    assert got == "A heading " + re.sub("<.*?>", "", GOOD) + " Zzz. Qqq word next é"


def test_no_article():
    body = f"<div id=content><h2>A heading</h2>{GOOD}<p>Short one.</p><ul><li><a href=a>Link one</a><li><a href=b>Link two</a></ul>{LATER}</div>"
    assert main_text(PAGE % body) == "A heading " + re.sub("<.*?>", "", GOOD) + " Short one. " + html.unescape(re.sub("<.*?>", "", LATER))


def test_an_article_without_stop_words_stays_whole():
    assert main_text(PAGE % "<article><h1>Xyz</h1><p>QWE!! RTY!!</p><p>a1 | b2 | c3</p></article>") == "Xyz QWE!! RTY!! a1 | b2 | c3"


def test_nothing_else_of_an_article_goes():
    assert main_text("<article><p>Read this.</p><p>More text here</p><ul><li><a>Source one</a></li></ul></article>") == "Read this. More text here Source one"
    kept = "<fieldset><legend>Box</legend>in it</fieldset><div class=notice>Note that this holds for all of the rest.</div><div class='related-work'><p>Others did this.</p></div><section id=discussion><p>We find that.</p></section><p>© signs are explained here.</p>"
    gone = "<div class=notice>We use cookies</div><div class=related><a href=1>Other story</a></div><div class='share-bar'>Share</div><div id=comments><p>I liked it</p></div><form><p>Name</p></form>"
    want = "Box in it Note that this holds for all of the rest. Others did this. We find that. © signs are explained here."
    assert main_text(f"<article><p>One.</p>{kept}{gone}</article>") == "One. " + want
    assert main_text("<form id=page><main class='has-sidebar'><p>Text</p></main></form>") == "Text"
    assert main_text("<aside><article><p>Text</p></article></aside><article class='related-post'><p>Text</p></article>") == ""


#: Pages without a marked article and what is to be read of them, by hand.
BY_HAND = [
    # A long block between links: density decides; the short one below it goes by its neighbour.
    ("<div><a href=1>Home</a> <a href=2>News</a></div><div><h1>Rain in the hills</h1><p>The rain that fell on the hills in the night was more than the river could hold, and it was over the road by the morning.</p><p>Nobody was hurt.</p></div><div><a href=3>Next</a></div>",
     "Rain in the hills The rain that fell on the hills in the night was more than the river could hold, and it was over the road by the morning. Nobody was hurt."),
    # Few stop words and long: a list of names. Good text on one side, a notice on the other.
    ("<table><tr><td>Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi Omega Stigma Koppa</td></tr></table><p>It is not known who the first of them was, but the last one is said to have been here in the year of the fire.</p><p>More below.</p><p>We use cookies.</p>",
     "It is not known who the first of them was, but the last one is said to have been here in the year of the fire. More below."),
    # Words that aren't known: length and links alone.
    ("<div><a href=1>Etusivu</a></div><p>" + "sana toinen kolmas " * 12 + "</p><p>Loppu</p>", ("sana toinen kolmas " * 12).strip() + " Loppu"),
    # Nothing but links and labels.
    ("<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>Menu</p>", ""),
]


def test_pages_without_an_article():
    for page, want in BY_HAND:
        assert main_text(f"<html><body>{page}</body></html>") == want


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "just <b>text"), (4, "u", "<article><p>a &lt; b <!-- c --> d"), (4, "u", "<article><p>a &lt; b <!-- c --> d"), (5, None, "<article>" + "<p>the word of it</p>" * 20_000), (None, "u", "<div hidden><article>x</article></div>"), (6, "u", "<<p a='>'>1 < 2</p <"), (7, "u", "<!-- never closed <p>x"), (8, "u", "<article><div class=comment>no</div>yes</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "'y' AS tag")
    got = sorted([(r.page_id, r.text) for r in extract(df).collect()], key=str)
    assert (1, "") in got and (2, "") in got and got.count((4, "a < b d")) == 2 and (7, "") in got and (8, "yes") in got and (None, "") in got
    assert [len(t) for p, t in got if p == 5] == [20_000 * 14 + 19_999]
    assert extract(df.limit(0)).count() == 0


def test_real_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        a = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^<>]*>", "", re.sub(r"<(/?(p|h1|br))\b[^>]*>", " ", a))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
