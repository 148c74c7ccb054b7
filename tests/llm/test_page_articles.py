"""Pages of sf0.1 against the articles their markup holds, read by the standard parser."""

import collections
import html.parser
import os

import pytest

from scrubline.llm import page_diff
from scrubline.llm import queries as L
from test_page_lines import texts

SF = next((d for d in ("/root/testdata/sf0.1", "/root/testdata/sf0.01", "/root/testdata/sf0.001") if os.path.isdir(d)), None)
DROP = {"nav", "header", "footer", "aside", "form", "script", "style", "button"}


class Article(html.parser.HTMLParser):
    """The blocks inside <article>, without what the contract names."""

    def __init__(self):
        super().__init__()
        self.blocks, self.buf, self.on, self.off = [], [], False, 0

    def flush(self):
        t = " ".join("".join(self.buf).split())
        if t:
            self.blocks.append(t)
        self.buf = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.flush()
            self.on = True
        elif self.off or tag in DROP or set((dict(attrs).get("class") or "").split()) & {"ad", "ads", "comments", "comment", "sidebar", "notice", "share", "related"}:
            self.flush()
            self.off += tag not in ("br", "img", "hr", "input")
        elif tag in ("p", "h1", "h2", "h3", "h4", "div", "li", "ul", "ol", "blockquote", "pre", "section", "td", "tr", "table"):
            self.flush()
        elif tag == "br":
            self.buf.append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.flush()
            self.on = False
        elif self.off:
            self.off -= 1
        elif tag in ("p", "h1", "h2", "h3", "h4", "div", "li", "ul", "ol", "blockquote", "pre", "section", "td", "tr", "table"):
            self.flush()

    def handle_data(self, data):
        if self.on and not self.off:
            self.buf.append(data)


@pytest.mark.skipif(SF is None, reason="no test tables")
def test_all_pages_keep_their_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in L.op6_page_diff(spark, SF).collect()}
    assert got.keys() == pages.keys()
    host = lambda r: r.url.split("//")[1].split("/")[0].lower()
    blocks, held, of_host = {}, collections.Counter(), collections.Counter()
    for i, r in pages.items():
        a = Article()
        a.feed(r.html or "")
        a.flush()
        blocks[i] = a.blocks
        of_host[host(r)] += 1
        held.update((host(r), b) for b in set(a.blocks))
    fate = collections.defaultdict(set)
    for i, r in pages.items():
        h = host(r)
        for b in set(blocks[i]):
            stays = b in got[i]
            fate[h, b].add(stays)
            # only what the host repeats widely may go
            assert stays or held[h, b] >= page_diff.WIDE_PAGES and 2 * held[h, b] >= of_host[h], (i, b)
        if all(held[h, b] < 2 for b in blocks[i]):
            assert got[i] == " ".join(blocks[i])
    assert all(len(v) == 1 for v in fate.values())  # one answer a line and host


def test_shared_paragraphs_stay_and_unmarked_menus_go(spark):
    same = "".join(f"<p>Paragraph {k} is told on both pages</p>" for k in range(5))
    own = "".join(f"<p>Own words of page {{0}}, part {k}</p>" for k in range(4))
    page = f"<div>Menu of the whole site</div><article>{same}{own}</article><div>Bottom of the site</div>"
    got = texts(spark, [(f"http://two.example.org/{k}", page.format(k)) for k in (1, 2)])
    want = [" ".join([*(f"Paragraph {k} is told on both pages" for k in range(5)), *(f"Own words of page {i}, part {k}" for k in range(4))]) for i in (1, 2)]
    assert got == want


def test_one_answer_on_all_pages(spark):
    """A menu that some neighbours lack goes everywhere; a sentence that few neighbours share stays everywhere."""
    menu, said = "<div>Menu of the site</div>", "<div>A sentence that turns up again</div>"
    pages = [(f"http://h.example.org/{k:03}", (menu if k % 4 else "") + (said if k in (1, 2, 9, 20, 30) else "") + f"<div>Text {k} is told here alone</div>") for k in range(40)]
    got = texts(spark, pages)
    for k, t in enumerate(got):
        assert "Menu" not in t and f"Text {k} is" in t and ("A sentence" in t) == (k in (1, 2, 9, 20, 30))
