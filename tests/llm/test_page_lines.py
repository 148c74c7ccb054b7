"""Which lines of a page stay: small pages whose main text is known."""

from scrubline.llm import page_diff

HTML = "<html><body>{}</body></html>"


def texts(spark, pages):
    d = spark.createDataFrame([(i, u, HTML.format(h)) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in page_diff.extract_pages(d).orderBy("page_id").collect()]


def test_differencing_decides_beside_and_inside_an_article(spark):
    body = "<div>Body {0} stands in a plain block of its own</div><article>Teaser {0} of another page</article>"
    notice = "<article><p>Read our notice</p><p>The article {0} has a text of its own here</p></article>"
    got = texts(spark, [(f"http://a.example.org/{k}", body.format(k)) for k in (1, 2, 3)]
                + [(f"http://b.example.org/{k}", notice.format(k)) for k in (1, 2, 3)])
    assert got == [f"Body {k} stands in a plain block of its own Teaser {k} of another page" for k in (1, 2, 3)] \
        + [f"The article {k} has a text of its own here" for k in (1, 2, 3)]


def test_a_near_copy_deletes_nothing_of_the_article(spark):
    long_ = "<p>A long paragraph that both copies of one article have in common, word by word</p><p>And one more of the same kind, as long as that</p>"
    got = texts(spark, [("http://a.example.org/x/1", f"<div>Shared top</div>{long_}<p>Seen 1</p>"), ("http://a.example.org/x/2", f"<div>Shared top</div>{long_}<p>Seen 2</p>"),
                        ("http://a.example.org/y/1", "<div>Shared top</div><p>Something else altogether is told at this address</p>")])
    assert all("A long paragraph" in t and "one more" in t for t in got[:2])
    assert "Shared top" not in got[1] and got[2] == "Something else altogether is told at this address"


def test_names_of_wrappers_do_not_hide_the_text(spark):
    shapes = ['<div class="layout has-sidebar"><article>Text {}</article></div>', '<div id="page-header-content"><main>Text {}</main></div>',
              '<div class="sidebar"><article>Text {}</article><p>Side</p></div>', '<div class="no-sidebar"><p>Text {}</p></div><div class="sidebar">Side {}</div>',
              '<main><div class="related">Text {}</div><p>Tail</p><div class="share">Send it on</div></main><nav class="x">Menu {}</nav>']
    for shape in shapes:
        for z, pages in (("z", (1, 2, 3)), ("one", (1,))):
            got = texts(spark, [(f"http://{z}.example.org/{k}", shape.format(k, k)) for k in pages])
            if "related" in shape and z == "one":  # no other page to ask
                assert got == ["Tail"]
            else:
                assert got == [f"Text {k}" for k in pages]


def test_marks_that_stay_sure():
    lines, zones = page_diff.page_lines('<aside><article>Teaser</article></aside><div class="ad">Buy</div><div id="cookie-notice">We</div><article>A<p hidden>B</p></article>')
    assert lines == ["Teaser", "Buy", "We", "A", "B"]
    assert zones == [page_diff.APART] * 3 + [page_diff.ARTICLE, page_diff.APART]


def test_copies_at_consecutive_addresses_are_one_page(spark):
    page = "<div>Menu of the site</div><p>Article {} is told in these words</p><div>End of the page</div>"
    got = texts(spark, [(f"http://a.example.org/a/{k}", page.format("one")) for k in (1, 2, 3)] + [(f"http://a.example.org/b/{k}", page.format("two")) for k in (1, 2, 3)])
    assert got == ["Article one is told in these words"] * 3 + ["Article two is told in these words"] * 3
