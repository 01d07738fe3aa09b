"""Main text against a direct cut of the given template, and odd pages."""

import html as h
import re

from pyspark.sql import functions as F

from skein.llm import html, queries

SF = "/root/testdata/sf0.01"


def direct(page):
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:h1|p)\b[^>]*>", inner[1]) if inner else []
    return "\n\n".join(x for b in blocks if (x := " ".join(h.unescape(re.sub(r"<br\s*/?>", " ", re.sub(r"</?[bi]>", "", b))).split())))


def test_op2_on_whole_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op2_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == direct(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_template_words_and_slots(spark):
    """No article element: the template's own words go, and what the roles tell."""

    def page(i):
        body = "".join(f"<p>Paragraph {k} of page {i} has words that no other page has, number {i * 31 + k}.</p>" for k in range(3))
        return f"<html><body><div class='top-menu'><a href=/>Home</a> <a href=/x>All</a></div><div id=content><div>Share this story</div><h2>Title {i}</h2>{body}<section id='comments'><p>First! {i}</p></section><div class=related-links><a href=/y{i}>Other {i}</a></div></div><div><a href=/q{i}>link {i}</a></div><form><input name=q>Search</form></body></html>"

    rows = spark.createDataFrame([(i, f"https://Site.example:80/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    for r in html.main_text(rows, out="text").collect():
        i = r["page_id"]
        assert r["text"] == "\n\n".join([f"Title {i}", *(f"Paragraph {k} of page {i} has words that no other page has, number {i * 31 + k}." for k in range(3))])


def test_odd_pages(spark):
    pages = [
        (1, None, None), (2, "", ""), (3, "http://a.example/1", "plain text &amp; more"), (4, "not a url", "<article><h1>A</h1><p>b <i>c</i>d<br>e&nbsp;f<p>g<script>x<p>y</script></article>"),
        (5, "http://a.example/2", "<article><p>unclosed <b>bold<p>next <!-- no --> one<aside>side</aside><div class='ad'>buy</div>after"), (6, "http://a.example/3", "<p>x" * 3000), (7, "http://a.example/3", "<div>" * 3000 + "deep"),
        (4, "not a url", "<article><h1>A</h1><p>b <i>c</i>d<br>e&nbsp;f<p>g<script>x<p>y</script></article>"), (8, "http://b.example", "<a title='>'>t</a> <p data-x=\"</p>\">1 < 2 &lt; 3 &#x41;</p><style>p{}"), (None, "http://b.example", "<main>m</main><footer>f</footer>"),
        (9, "http://b.example", "<table><tr><td>1<td>2</table><ul><li>a<li>b</ul>"), (10, "http://b.example", "<![CDATA[x]]><!-- open"),
    ]
    rows = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, host string, template int")
    got = html.main_text(rows, out="text")
    assert got.columns == [*rows.columns, "text"]
    text = {r["page_id"]: r["text"] for r in got.collect()}
    assert text[1] == "" and text[2] == "" and text[3] == "plain text & more" and text[4] == "A\n\nb cd e f\n\ng"
    assert text[5] == "unclosed bold\n\nnext one\n\nafter" and text[6] == "\n\n".join(["x"] * 3000) and text[7] == "deep"
    assert text[8] == "t\n\n1 < 2 < 3 A" and text[None] == "m" and text[9] == "1\n\n2\n\na\n\nb"
    assert html.main_text(rows.limit(0), out="text").count() == 0


def host(spark, pages, url="http://a.example/"):
    return spark.createDataFrame([(i, f"{url}{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def texts(rows):
    return {r["page_id"]: r["text"] for r in html.main_text(rows, out="text").collect()}


def words(i, n, start="w"):
    return " ".join(f"{start}{i}x{k}" for k in range(n))


def test_classes_are_nested_in_gaps_of_the_skeleton(spark):
    """Tags once on each page are the skeleton, in page order; tags as often as each other are a class in one of its gaps."""
    pages = [f"<body><ul>{''.join(f'<li><a>{i}.{k}</a></li>' for k in range(2 + i % 3))}</ul><p>t{i}</p></body>" for i in range(6)]
    keyed = host(spark, pages).withColumn("host", html.host_of(F.col("url"))).withColumn("key", F.xxhash64("html"))
    read = html.sequences(keyed, "key", "host", "html")
    profile = html.profiles(read)
    named = html.skeletons(profile, html._of_hosts(profile))
    body = html._path(html.ROOT, "body")
    ul, p = html._path(body, "ul"), html._path(body, "p")
    li = html._path(ul, "li")
    a = html._path(li, "a")
    assert named.first()["skeleton"] == [body, ul, ul ^ 2, p, p ^ 2, body ^ 2]
    template = html.templates(html.gap_sums(read, named, True), named).first()
    assert [(c["gap"], c["tokens"]) for c in template["classes"]] == [(2, [li, a, a ^ 2, li ^ 2])]


def sides(i):
    """Neither element nor mark tells the story from what is beside it."""
    story = f"<div class=x2><h1>{words(i, 3, 'h')}</h1><p>{words(i, 3 if i == 5 else 40)}</p><p>{words(i, 2, 'v')}</p></div>"
    return f"<html><body><div class=x1><p>{words(i, 12, 's')}</p></div><div>Said <b>before</b> all</div>{story}<div class=x3><ul>{''.join(f'<li>{words(i * 10 + k, 4, chr(114))}<br><i>Reply</i></li>' for k in range(1 + i % 3))}</ul></div></body></html>"


def test_template_decides(spark):
    pages = [sides(i) for i in range(12)]
    want = {i: f"{words(i, 3, 'h')}\n\n{words(i, 3 if i == 5 else 40)}\n\n{words(i, 2, 'v')}" for i in range(12)}
    assert texts(host(spark, pages)) == want
    alone = {i: html.extract(p) for i, p in enumerate(pages)}
    assert alone != want and alone[5] != want[5]


def test_gaps_tell_equal_paths_apart(spark):
    pages = [f"<body><div><p>{words(i, 30 if i else 4)}</p></div><hr><div><p>{words(i, 9, 'c')}</p></div></body>" for i in range(5)]
    assert texts(host(spark, pages)) == {i: words(i, 30 if i else 4) for i in range(5)}


def test_text_of_the_article_is_kept(spark):
    card = "<article class=card><p>card</p></article>"
    pages = [
        "<article><h2 id='related-work'>Related work</h2><p class='search'>find</p><section id='related-work'><p>more</p></section><p>A <span class='share'>share</span> of <button>x</button>it</p></article>",
        f"<body><div class=story><h1>T</h1><p>{words(1, 30)}</p></div>{card}</body>",
        "<div id=list><article><p>one</p></article><article><p>two two</p></article></div>",
        f"<body><header><p>Site</p></header><h1>Title</h1><div><p>{words(2, 20)}</p></div><p>note</p></body>",
        f"<article><p>{words(3, 9)}</p><div class='ad-slot'>buy</div><section class=comments><p>First!</p></section><form>q</form></article>",
        f"<body><div>{'<div>' * 400}deep</div></body>",
        f"<body><div class=story><div class='share-price'><p>{words(6, 30)}</p></div><div class='post-share-links'>Tell all</div></div><div class='site-footer'>end</div></body>",
    ]
    rows = spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert texts(rows) == {0: "Related work\n\nfind\n\nmore\n\nA share of it", 1: f"T\n\n{words(1, 30)}", 2: "one\n\ntwo two", 3: f"Title\n\n{words(2, 20)}", 4: words(3, 9), 5: "deep", 6: words(6, 30)}


def test_mirrored_pages_keep_their_words(spark):
    page = f"<body><nav>menu</nav><article><h1>Same</h1><p>{words(0, 30)}</p></article></body>"
    assert set(texts(host(spark, [page] * 12)).values()) == {f"Same\n\n{words(0, 30)}"}


def test_two_templates_on_one_host(spark):
    """Pages of the rarer kind have no region of the host's template: theirs is looked for on the page."""
    pages = [f"<body><nav>m</nav><div class=a><h1>{words(i, 2)}</h1><p>{words(i, 30)}</p></div><footer>f</footer></body>" for i in range(9)]
    pages += [f"<body><nav>m</nav><div class=b><table><tr><td>{words(i, 30)}</td></tr></table></div><footer>f</footer></body>" for i in range(9, 12)]
    assert texts(host(spark, pages)) == {**{i: f"{words(i, 2)}\n\n{words(i, 30)}" for i in range(9)}, **{i: words(i, 30) for i in range(9, 12)}}


def test_very_long_page(spark):
    long = "".join(f"<p>{words(i, 50)}</p>" for i in range(4000))
    rows = host(spark, [f"<body><nav>m</nav><div>{long}</div></body>", None, ""])
    got = texts(rows)
    assert len(got[0]) > 1_000_000 and got[0] == "\n\n".join(words(i, 50) for i in range(4000)) and got[1] == got[2] == ""


def test_attributes_behind_a_long_one(spark):
    long = f"data-props=\"{'x' * 450} class='main'\""
    page = f"<body><div {long}><p>kept</p></div><div {long} class=\"sidebar comments\"><p>side</p></div><p {long} hidden>hidden</p><p title=\"a class=ad b\">title</p></body>"
    rows = spark.createDataFrame([(1, "http://a.example/1", page), (2, "http://b.example/1", f"<body><p>x</p><div {long} itemprop='articleBody'>body</div></body>")], "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html.main_text(rows, out="text").collect()}
    assert text == {1: "kept\n\ntitle", 2: "body"}
