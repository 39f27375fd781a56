import random

import numpy as np

from tidemark.llm import html as H

PAGES = "page_id long, url string, html string"


def text(source, template=frozenset()):
    return H.main_text(H.parse(source), set(template))


def test_article_without_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="<p>no</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1><nav><ul><li>Menu</li></ul></nav></header><div id="cookie-notice">We use cookies</div>
    <div class="ad banner">Buy</div><main><article><header><h1>Title &lt; 1 &amp;amp;</h1></header><p>One<br>two  <b>bo</b>ld&nbsp;x
    <ul><li>i<li>j</ul><!-- <p>no</p> --><p>end<aside>side</aside><form>f<input></form><div class="share-buttons">share</div>
    <section class="comments"><article>comment</article></section></article></main><footer>&copy; us</footer></body></html>"""
    assert text(page) == "Title < 1 &amp;\n\nOne two bold x\n\ni\n\nj\n\nend"


def test_broken_markup_and_edges():
    assert text(None) == text("") == text("<p") == text("<p title='x") == text("<script>x") == "" and text("<") == "<"
    assert text("<p title=it's>a</p><p title=\"b>c</p>d") == "a\n\nc\n\nd"
    assert text("plain &#x41;&#66; text") == "plain AB text"
    assert text("a < b and c > d <3") == "a < b and c > d <3"
    assert text("<p>one<p>two</div></p>three</b>") == "one\n\ntwo\n\nthree"
    assert text("<div><p>a</p><div>b</div>c</div>") == "a\n\nb\n\nc"
    assert text('<p title="a > b">x</p><p hidden>y</p><p style="display: none">z</p>') == "x"
    assert text("<article>kept") == "kept" and text("<p>x</p><nav><ul><li>open menu") == "x"
    assert len(text("<p>" + "word " * 400_000)) == 5 * 400_000 - 1
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert text(deep) == "x"


def test_classes_nest_and_hold():
    a, b = [(1, 10, 0.0), (2, 10, 5.0), (3, 10, 9.0)], [(4, 20, 2.0), (5, 20, 3.0)]
    outer = H.nest(a + b)
    assert [c.tokens for c in outer] == [[1, 2, 3]] and [c.tokens for c in outer[0].children] == [[4, 5]]
    crossing = H.nest(a + [(6, 30, 4.0), (7, 30, 6.0)])
    assert [c.tokens for c in crossing] == [[1, 2, 3]] and not crossing[0].children
    page = H.Page(tokens=[1, 4, 8, 5, 2, 3])
    assert H.template_tokens(page, outer) == {1, 2, 3, 4, 5}
    assert H.template_tokens(H.Page(tokens=[1, 2, 4, 5, 3]), outer) == {1, 2, 3}  # the inner class stands in another slot
    assert H.template_tokens(H.Page(tokens=[2, 1, 3]), outer) == set()


def test_names_in_an_article_count_as_a_whole(spark):
    kept = ('<section id="related-work">a</section>', '<p class="share-price">a</p>', '<div class="social-history">a</div>', '<div class="comment-on-results">a</div>')
    gone = ('<div class="related-posts">b</div>', '<div id="shareBar2">b</div>', '<p class="x ad">b</p>', '<div class="newsletter-signup">b</div>')
    for k in kept:
        assert text(f"<article><p>x</p>{k}</article>") == text(f"<p>x</p>{k}") == "x\n\na"
    for g in gone:
        assert text(f"<article><p>x</p>{g}</article>") == text(f"<p>x</p>{g}") == "x"
    rows = [(i, f"http://h.example/{i}", f'<article><p>x{i}</p><div class="related-teasers">t{i}</div></article>') for i in range(6)]
    rows += [(9, "http://one.example/", '<article><p>x9</p><div class="related-teasers">t9</div></article>')]
    assert {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()} == {**{i: f"x{i}" for i in range(6)}, 9: "x9\n\nt9"}


def test_template_text_of_a_host_is_no_content(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    bodies = [[" ".join(word() for _ in range(20)) for _ in range(rnd.randint(1, 4))] for _ in range(12)]
    rows = [(i, f"https://News.example.org/{i}", "<html><body><div>Daily Planet</div><p>Welcome to our site</p>" + "".join(f"<p>{p}</p>" for p in b) + "<div>All about us</div></body></html>")
            for i, b in enumerate(bodies)]
    rows += [(90, "https://alone.example.org/", "<p>Welcome to our site</p>"), (91, None, None), (None, "x", ""), (92, "https://News.example.org/1", rows[1][2]), (92, "https://News.example.org/1", rows[1][2])]
    df = spark.createDataFrame(rows, PAGES)
    from pyspark.sql import functions as F
    got = {(r.page_id, r.url): r for r in H.extract(df.withColumn("text", F.lit("x")).withColumn("host", F.lit("y")).withColumn("token", F.lit(1))).collect()}
    for i, b in enumerate(bodies):
        assert got[i, rows[i][1]].text == "\n\n".join(b)
        assert got[i, rows[i][1]].n_chars == len(got[i, rows[i][1]].text)
    assert got[90, "https://alone.example.org/"].text == "Welcome to our site"
    assert got[91, None].text == got[None, "x"].text == "" and got[92, rows[1][1]].text == "\n\n".join(bodies[1])
    assert H.extract(df).count() == len(rows) and H.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_wrappers_with_marks_hold_their_article():
    for wrapper in ('div class="layout has-sidebar"', 'div class="content-with-sidebar"', 'div class="page no-comments"', 'form id="aspnetForm"'):
        close = wrapper.split()[0]
        assert text(f"<{wrapper}><article><p>One</p></article></{close}><p>x</p>") == "One"
        assert text(f"<{wrapper}><main><p>One</p><form><p>Name</p></form></main></{close}>") == "One"
    assert text("<form><p>Name</p></form><p>One</p>") == "One"
    assert text('<article><p>One</p><form><article>no</article></form></article>') == "One"
    assert text('<div class="sidebar"><article>teaser</article></div><p>One</p>') == "One"


def test_end_tag_without_a_name_is_a_comment():
    assert text("<p>One </3 two.</p><p>Three.</p>") == "One\n\nThree."
    assert text("<p>One </ two</p><p>Three.</p>") == "One\n\nThree." and text("<p>One</> two</p>") == "One two"
    assert text("<p>One </3 two") == "One"


def test_recurring_article_text_stays_and_boxes_go(spark):
    words = lambda i, j: " ".join(f"w{i}x{j}n{k}" for k in range(12))
    page = lambda i: (f"<body><article><div>Daily desk</div><h1>T{i}</h1><h2>Summary</h2><p>{words(i, 0)}</p><p>Read more on our site</p><div>Between</div><ul><li>Salt<li>w{i}</ul>"  # noqa: E731
                      f"<table><tr><th>Name</th><td>{i}</td></tr></table><h2>Conclusion</h2><p>{words(i, 1)}</p><div>x <a href='/'>All news</a></div><p>Serve warm.</p><div>By the desk</div></article></body>")
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    rows += [(10 + i, f"http://h.example/copy/{i}", page(0)) for i in range(9)] + [(30, "http://alone.example/", page(30))]
    rows += [(40 + i, f"http://near.example/{i}", page(40).replace("T40", f"T{i}")) for i in range(4)]
    rows += [(50 + i, None, f"<p>Same line</p><p>w{i}</p>") for i in range(6)]  # no host, no template
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(6):
        assert got[i] == f"T{i}\n\nSummary\n\n{words(i, 0)}\n\nRead more on our site\n\nBetween\n\nSalt\n\nw{i}\n\nName\n\n{i}\n\nConclusion\n\n{words(i, 1)}\n\nx\n\nServe warm."
    assert {got[10 + i] for i in range(9)} == {got[0]}
    assert "Daily desk" in got[30] and got[30].endswith("By the desk") and all(words(40, 0) in got[40 + i] for i in range(4))
    assert all(got[50 + i] == f"Same line\n\nw{i}" for i in range(6))


def test_copies_of_an_article_stay_whole(spark):
    body = "<article><h1>Same</h1><p>Every word of it</p></article><p>Every word of it</p>"
    rows = [(i, f"http://h.example/{i}", body) for i in range(8)]
    assert {r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"Same\n\nEvery word of it"}


def test_occurrence_vectors_do_not_depend_on_partitions(spark):
    rows = [(i, "http://h.example/", f"<div><p>a{i % 3}</p><p>b</p></div>") for i in range(40)]
    df = spark.createDataFrame(rows, PAGES)
    one, many = ({r.host: sorted(map(tuple, r.template)) for r in H.templates(d).collect()} for d in (df.repartition(1), df.repartition(7)))
    assert one == many and np.isfinite([t[2] for t in one["h.example"]]).all()
