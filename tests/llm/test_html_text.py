import random
import re
from html import escape, unescape

from pyspark.sql import functions as F

from tracewright.llm import html_text
from tracewright.llm.html_text import main_text


def page(article, around=True):
    before = (
        '<!DOCTYPE html><html><head><meta charset="utf-8"><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>'
        '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice"><p>We use cookies</p></div>'
        '<div class="ad">Buy <div>now</div> cheap</div>'
    )
    after = (
        '<aside><p>Aside</p></aside><form action="x"><p>Mail <input name="m"></p><select><option>One</option></select></form>'
        '<section class="user-comments"><article class="comment"><p>Reader</p></article></section><div class="side bar sidebar">Side</div>'
        "<footer>&copy; 2020</footer></body></html>"
    )
    return before + article + after if around else article


def test_article_is_kept_whole():
    rng = random.Random(1)
    for _ in range(300):
        blocks = [" ".join(rng.choice(["a", "word", "x<y", "R&D", "é", "1"]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 9))]
        body = "".join(f"<{t}>{escape(b)}</{t}>" for b, t in ((b, rng.choice(["p", "h2", "li", "blockquote", "div"])) for b in blocks))
        for tag in ("article", "main", 'div role="main"'):
            close = tag.split()[0]
            assert main_text(page(f"<{tag}>{body}</{close}>")) == "\n\n".join(blocks)


def test_markup_details():
    article = (
        "<article><h1>Title<p><b>Bold <i>and</i></b>\n\t more<br>line&nbsp;two<br><p>x<!-- <p>gone</p> --><span class='ad'>ad</span>y</p>"
        '<div class="advert"><p>in</p></div><p>1 &lt; 2 &#39;q&#x27; &euro;</p><p> </p><script>s</script><ul><li>i<li>j</ul></article>'
    )
    assert main_text(page(article)) == "\n\n".join(["Title", "Bold and more line two", "x", "y", "1 < 2 'q' €", "i", "j"])


def test_text_without_article_element():
    long = ["This is a rather long paragraph of the story, number %d, with words enough to count as text." % i for i in range(5)]
    body = "<div>" + "".join(f"<p>{x}</p>" for x in long[:3]) + "<p>Short.</p>" + "".join(f"<p>{x}</p>" for x in long[3:]) + "</div>"
    links = "<div>" + "".join(f'<p><a href="/{i}">A link to another story {i}</a></p>' for i in range(6)) + "</div>"
    got = main_text(f"<body>{links}{body}{links}</body>")
    assert got == "\n\n".join([*long[:3], "Short.", *long[3:]])


def test_link_lists_inside_the_article():
    long = ["This is a rather long paragraph of the story, number %d, with words enough to count as text." % i for i in range(4)]
    p = [f"<p>{x}</p>" for x in long]
    links = "<ul>" + "".join(f'<li><a href="/{i}">A link to another story {i}</a> {i}</li>' for i in range(6)) + "</ul>"
    inline = '<p>See <a href="/r">the report on all of this</a>.</p>'
    for tag in ("article", "main"):
        got = main_text(page(f"<{tag}>{links}{p[0]}{p[1]}{links}{p[2]}{inline}{p[3]}<p>End.</p></{tag}>"))
        assert got == "\n\n".join([*long[:3], "See the report on all of this.", long[3], "End."])
    assert main_text(f"<article>{links}</article>") == ""


def test_stretches():
    assert html_text.stretches([]) == [] == html_text.stretches([1, 1, 1], 3, 50)
    assert html_text.stretches([0, 90, 0, 0, 0, 0, 0, 60, 0, 70, 0], 3, 50) == [(1, 2), (7, 10)]
    rng = random.Random(6)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 3, 40, 90]) for _ in range(rng.randint(1, 25))]
        high = [i for i in range(-2, len(weights)) if sum(weights[max(i, 0) : i + 3]) > 50]
        inside = {k for first, last in html_text.stretches(weights, 3, 50) for k in range(first, last)}
        covered = {k for i in high for k in range(max(i, 0), min(i + 3, len(weights)))}
        assert inside <= covered and all(not weights[k] for k in covered - inside)


def test_surge_and_dive():
    assert html_text.surge_and_dive([]) == (0, 0)
    assert html_text.surge_and_dive([0, 5, 0, 0, 90, 0, 3, 0, 0, 0, 0, 7], 3, 50) == (4, 7)
    assert html_text.surge_and_dive([1, 1, 1], 3, 50) == (0, 0)
    assert html_text.surge_and_dive([0, 0, 1, 0, 0, 0, 0, 2], 3, 0) == (2, 8)


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<<<>>") == main_text("<script>never closed <p>x</p>") == ""
    assert main_text("<body><article><p>open <b>end") == "open end"
    assert main_text("<article><p>cut off <im") == "cut off"
    assert main_text("<head><title>t</title><body><article>in</article>") == "in"
    assert main_text("<div class='ad'>never closed<article><p>text</p></article>") == "text"
    assert main_text("<article>" + "<p>x</p>" * 20000 + "</article>").count("x") == 20000
    assert main_text("<article><p>a</p></article><article class='x'><p>b</p></article>") == "a\n\nb"


def test_table(spark):
    rows = [(1, "u", page("<article><p>x</p></article>")), (None, None, None), (1, "u", page("<article><p>x</p></article>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id or 0, r.text) for r in html_text.extract(pages).collect())
    assert got == [(0, ""), (1, "x"), (1, "x")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_query_on_table(spark):
    from tracewright.llm.queries import op9_html

    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op9_html(spark, sf).collect()
    assert len(got) == len(html)
    for r in got:
        inside = re.search("<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>|<br>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_cut_off_tags_take_no_time():
    import time

    attributes = " ".join(f'data-a{i}="v{i}" b{i}=\'w{i}\'' for i in range(4000))
    long = "word " * 40
    pages = [
        f"<p>{long}</p><div {attributes}",
        f"<p>{long}</p><div {attributes} c=\"",
        f"<p>{long}</p>" + '<a ">" ' * 60000,
        f"<p>{long}</p>" + "<a '" * 60001,
        f"<p>{long}</p><script " + '"x" ' * 60000,
        f"<p>{long}</p>" + "<" * 200000,
        f"<p>{long}</p>" + "<!--" * 60000,
    ]
    for page in pages:
        began = time.time()
        assert html_text.main_text(page).startswith(long.strip())
        assert time.time() - began < 10


def test_quotes_in_tags():
    long = "words of an article " * 8
    for tag in ("<p title=it's>", "<p title='a > b'>", '<p title="a > b" x>', "<p title=\"it's\">", '<p title="open>'):
        assert html_text.main_text(f"<div>{tag}{long}</p></div>") == long.strip()
