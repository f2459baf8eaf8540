from quaestor.llm import html_extract as hx

SCHEMA = "page_id bigint, url string, html string"


def page(k):
    box = f"<div class='x{k % 2}z'><p>Short {k}</p></div>"
    return f"<html><body><div class='top'><p>Site name</p></div>{box}<div class='story'><p>Story number {k}, a long and quite different text of its own</p><p>More of {k} here</p></div><p>All rights reserved</p></body></html>"


def test_stubs_do_not_make_the_wrapper(spark):
    """The shortest pages of a host are all alike; its other pages still have a template and a container."""
    rows = [(k, "http://h/x", page(k)) for k in range(60)] + [(100 + k, "http://h/e", "<html><body><p>Not found</p></body></html>") for k in range(20)]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == f"Story number {k}, a long and quite different text of its own\n\nMore of {k} here" for k in range(60))


def test_wrapper_acts_inside_articles(spark):
    def article(k):
        return f"<html><body><article><h1>Title {k}</h1><p>Text of <b>page</b> {k}</p><p>{'Twice' if k < 2 else k} said</p><p>Read <a>more</a> on our site</p></article></body></html>"

    rows = [(k, "http://h/x", article(k)) for k in range(40)] + [(50 + k, f"http://few/{k}", article(k)) for k in range(3)]
    rows += [(60 + k, f"http://same/{k}", article(0) + f"<p>{k}</p>") for k in range(8)]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == f"Title {k}\n\nText of page {k}\n\n{'Twice' if k < 2 else k} said" for k in range(40))
    assert all(got[50 + k].endswith("Read more on our site") for k in range(3))
    assert got[60] == "Title 0\n\nText of page 0\n\nTwice said\n\nRead more on our site"


def test_top_article_is_not_judged_by_its_class():
    for name in ("post category-notices", "has-comments"):
        assert hx.main_text(f"<body><div class='menu'>m</div><article class='{name}'><p>text</p><article class='comment'>c</article></article></body>") == "text"
