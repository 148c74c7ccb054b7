"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in the order of their URL paths and each is paired
with its nearest neighbour.  The text lines (blocks) of the two pages are
aligned by a longest common subsequence, and lines they share are deleted:
menus, notices and footers repeat from page to page, the article does not.
A check by the markup follows: lines that the page marks as navigation,
footer, sidebar, advert, form or comment go even if no neighbour has them.
A neighbour that shares nearly all of the text is a copy of the page and
says nothing of its lines.

One neighbour is little evidence, and a line should fare alike on all pages
of its host, so what the pairs found is put to the vote of the host: a line
beside a marked article goes if at least half of the pages that have it
share it with their neighbour; a line inside a marked article goes only if
that holds for at least WIDE_PAGES pages and half of all pages of the host,
as for a notice that stands in the article of every page.

Ordering is a global range sort of narrow rows, so a host with a third of
all pages is spread over tasks like any other, and neighbours meet by an
equi-join on their rank.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import cut, q, small_batches

#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "object", "xmp", "noembed", "noframes"}
#: Elements that hold no part of an article.
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "datalist", "label", "input"}
#: Roles that mark such parts, and words of which a class or an id that marks them consists.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
         "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead",
         "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
         "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "widget", "pagination", "pager"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
          "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An element that starts closes an open one of these at the top of the stack.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
TOKEN = re.compile(r"<!--(?:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
HINT = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: A page that shares more than this part of another's text (in characters) is a copy of it.
COPY = 0.8
#: Pages of a host that must share a line of their articles before it counts as no part of them (and half of all its pages).
WIDE_PAGES = 3
#: Parts that the rows of a line that very many pages hold are dealt into.
SALT = 16
#: What the markup says of a line; DOUBT is a block inside the article with a class or id of WORDS.
APART, OPEN, ARTICLE, DOUBT = 1, 2, 3, 4
#: How an element is marked as apart: by what it is, or only by the words of its class or id.
SURE, NAMED = 2, 1


def _marked(tag: str, attrs: str, inside: bool) -> int:
    """How an element is marked as holding no part of an article; a header
    within the article belongs to it.  A class or an id counts if it is made
    of WORDS only: 'cookie-notice' does, 'has-sidebar' does not."""
    if tag in ASIDE or tag == "header" and not inside:
        return SURE
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    named = 0
    for name, *values in HINT.findall(attrs):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
        if name in ("class", "id"):
            for part in value.split():
                words = {w for w in re.split(r"[^a-z0-9]+", part) if w}
                if words and words <= (WORDS - {"header"} if inside else WORDS):
                    named = NAMED
    return named


def page_lines(page: str | None) -> tuple[list[str], list[int]]:
    """Text lines (blocks) of a page with what its markup says of each."""
    page = page or ""
    lines, zones = [], []
    buf, buf_zone = [], OPEN
    stack: list[tuple[str, tuple]] = []  # tag, state outside of it
    state = (False, False, False)  # apart for sure, apart by name, in an article
    at, n = 0, len(page)

    def flush():
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                lines.append(text)
                zones.append(buf_zone)
            buf.clear()

    def add(text):
        nonlocal buf_zone
        if text:
            sure, named, article = state
            zone = APART if sure or named and not article else DOUBT if named else ARTICLE if article else OPEN
            if buf and buf_zone != zone:
                flush()
            buf_zone = zone
            buf.append(html.unescape(text))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:  # a comment or a declaration
            continue
        tag, attrs = tag.lower(), m.group(3) or m.group(6) or ""
        if m.group(1) or m.group(4):  # an end tag closes what is open inside
            if tag in BLOCKS:
                flush()
            if any(t == tag for t, _ in stack):
                flush() if tag in BLOCKS else None
                while True:
                    t, state = stack.pop()
                    if t == tag:
                        break
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/") or tag != "svg":
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
            while stack and tag in CLOSES.get(stack[-1][0], ()):
                _, state = stack.pop()
        if tag in VOID:
            continue
        sure, named, article = state
        mark = _marked(tag, attrs, article)
        root = mark != SURE and (tag in ("article", "main") or bool(re.search(r"\brole\s*=\s*[\"']?main\b", attrs)))
        if mark or tag in BLOCKS or root:
            stack.append((tag, state))
            # names around an article do not hide it
            state = (sure or mark == SURE, not root and (named or mark == NAMED), article or root)
    flush()
    return lines, zones


def _lcs_row(a: list, b: list) -> list[int]:
    """Lengths of the common subsequences of ``a`` with every prefix of ``b``."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    out, k = [0], 0
    for bit in reversed(bin(v | 1 << len(b))[3:]):
        k += bit == "0"
        out.append(k)
    return out


def common_positions(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``: bit
    vectors over ``b``, halved by divide and conquer in linear memory."""
    both = set(a) & set(b)
    pos = [i for i, x in enumerate(a) if x in both]
    a, b = [a[i] for i in pos], [x for x in b if x in both]
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        mid = (a0 + a1) // 2
        up = _lcs_row(a[a0:mid], b[b0:b1])
        down = _lcs_row(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        k = max(range(b1 - b0 + 1), key=lambda i: up[i] + down[i])
        todo += [(a0, mid, b0, b0 + k), (mid, a1, b0 + k, b1)]
    return sorted(pos[i] for i in out)


def nearest(path: str, before: str | None, after: str | None) -> list[int]:
    """0 (before) and 1 (after) in the order of nearness: more path segments
    in common, then the longer common start, then the one before."""
    def near(other):
        x, y = path.split("/"), other.split("/")
        seg = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
        ch = next((i for i, (s, t) in enumerate(zip(path, other)) if s != t), min(len(path), len(other)))
        return seg, ch
    have = [(i, p) for i, p in enumerate((before, after)) if p is not None]
    return [i for i, p in sorted(have, key=lambda x: near(x[1]), reverse=True)] if len(have) < 2 or near(before) != near(after) else [0, 1]


def shared_lines(zones: bytes, hashes: list[int], sizes: list[int], mates: list[list[int]]) -> set[int] | None:
    """Positions of the lines that the nearest mate shares.  A mate that
    shares nearly all text is the same article at another address and says
    nothing; then the next one is compared.  None if there is no mate to ask."""
    rest = [i for i, z in enumerate(zones) if z != APART]
    most = COPY * sum(sizes[i] for i in rest)
    for mate in filter(None, mates):
        found = set(common_positions(hashes, mate))
        if sum(sizes[i] for i in rest if i in found) <= most:
            return found
    return None


def goes(zone: int, shared: bool, asked: bool) -> bool:
    """Whether a line goes by what its own page knows.  A block of the
    article that only its class or id marks goes if there is no mate to ask."""
    return zone == APART or zone != ARTICLE and shared or zone == DOUBT and not asked


def _path_key(path: str) -> str:
    return re.sub(r"\d+", lambda m: m.group().zfill(12), path.rstrip("/"))


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """The pages with a 128-bit key of the row: rows with one key are equal."""
    small_batches(pages.sparkSession)
    src = pages.select(F.col(q(id_col)).alias("page_id"), F.col(q(url_col)).cast("string").alias("url"), F.col(q(html_col)).cast("string").alias("html"))
    key = [F.xxhash64(F.lit(k), "page_id", F.col("page_id").isNull(), "url", F.col("url").isNull(), "html") for k in (1, 2)]
    return src.select(key[0].alias("k1"), key[1].alias("k2"), *src.columns)


def _lines(keyed: DataFrame) -> DataFrame:
    """(k1, k2, d1, d2, host, path, zones, hashes, sizes): narrow rows, a hash
    and a length for every line; (d1, d2) is a key of the host and its lines,
    so copies of a page have one."""
    def run(batches):
        for t in batches:
            host, path, marks, hashes, sizes, keys = [], [], [], [], [], ([], [])
            for u, page in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*([^?#]*)", u or "")
                host.append(m.group(1).lower() if m else None)
                path.append(_path_key(m.group(2)) if m else None)
                lines, zones = page_lines(page)
                marks.append(bytes(zones))
                hashes.append([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for x in lines])
                sizes.append([len(x) for x in lines])
                digest = np.frombuffer(hashlib.blake2b(np.array(hashes[-1], np.int64).tobytes() + marks[-1] + (host[-1] or "").encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.int64)
                for k, v in zip(keys, digest.tolist()):
                    k.append(v)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), *(pa.array(k, pa.int64()) for k in keys), pa.array(host, pa.string()), pa.array(path, pa.string()),
                                              pa.array(marks, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                                             ["k1", "k2", "d1", "d2", "host", "path", "zones", "hashes", "sizes"])

    return keyed.select("k1", "k2", "url", "html").mapInArrow(run, "k1 long, k2 long, d1 long, d2 long, host string, path string, zones binary, hashes array<long>, sizes array<int>")


def _ranked(lines: DataFrame) -> DataFrame:
    """(rank, d1, d2, host, path): the global order of (host, path, key),
    copies once by their first path, from a range sort and one offset per partition."""
    s = lines.where("host is not null").groupBy("host", "d1", "d2").agg(F.min("path").alias("path")).orderBy("host", "path", "d1", "d2")
    s = cut(s.withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    n = s.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # one row per partition of the sort
    off = n.withColumn("off", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return (s.withColumn("part", part).join(F.broadcast(off), "part")
            .select((F.coalesce("off", F.lit(0)) + F.col("at") - F.col("first")).alias("rank"), "d1", "d2", "host", "path"))


def _decisions(lines: DataFrame) -> DataFrame:
    """(k1, k2, keep): for every page with a host, which of its lines that are
    not marked as apart stay, as a bitmap."""
    paged = lines.where("host is not null")
    once = paged.dropDuplicates(["d1", "d2"]).select("d1", "d2", "zones", "hashes", "sizes")
    rank = _ranked(lines)
    own = rank.join(once, ["d1", "d2"]).drop("d1", "d2")
    mates = cut(own, "rank")
    def mate(step, name):
        return mates.select((F.col("rank") + step).alias("rank"), F.col("host").alias(f"{name}_host"), F.col("path").alias(f"{name}_path"), F.col("hashes").alias(name))
    met = mates.join(mate(1, "before"), "rank", "left").join(mate(-1, "after"), "rank", "left")
    same = lambda n, c: F.when(F.col(f"{n}_host") == F.col("host"), F.col(c))
    met = met.select("rank", "path", "zones", "hashes", "sizes", same("before", "before_path").alias("bp"), same("before", "before").alias("before"),
                     same("after", "after_path").alias("ap"), same("after", "after").alias("after"), F.xxhash64("host").alias("hk"))

    def compare(batches):
        for t in batches:
            asked, marks, lines, bits = [], [], [], []
            for _, path, zones, hashes, sizes, bp, before, ap, after, _ in zip(*(c.to_pylist() for c in t.columns)):
                found = shared_lines(zones, hashes, sizes, [(before, after)[i] or [] for i in nearest(path or "", bp, ap)])
                rest = [i for i, z in enumerate(zones) if z != APART]
                asked.append(found is not None)
                marks.append([zones[i] for i in rest])
                lines.append([hashes[i] for i in rest])
                bits.append([found is not None and i in found for i in rest])
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(9), pa.array(asked, pa.bool_()), pa.array(marks, pa.list_(pa.int8())),
                                              pa.array(lines, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.bool_()))], ["rank", "hk", "asked", "zone", "line", "shared"])

    shared = cut(met.mapInArrow(compare, "rank long, hk long, asked boolean, zone array<tinyint>, line array<long>, shared array<boolean>"), "shared")
    rows = shared.select("rank", "hk", F.inline(F.arrays_zip("zone", "line", "shared")))
    salted = lambda df: df.withColumn("salt", F.pmod("rank", F.lit(SALT)))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt")
    # beside the article: lines on which the pages disagree follow the majority
    loose = rows.where(F.col("zone") != ARTICLE)
    votes = loose.groupBy("hk", "line").agg(F.count("*").alias("n"), F.count_if("shared").alias("s")).where("s > 0 AND s < n")
    votes = votes.select("hk", "line", (F.col("s") * 2 >= F.col("n")).alias("go"), parts)
    judged = salted(loose.select("rank", "hk", "line")).join(votes, ["hk", "line", "salt"])
    judged = judged.groupBy("rank").agg(F.collect_set(F.struct("line", "go")).alias("votes"))
    # inside: lines that half of a host's pages share, so a host has no more of them than two average pages have lines
    pages = shared.groupBy("hk").agg(F.count("*").alias("pages"))
    wide = rows.where((F.col("zone") == ARTICLE) & F.col("shared")).select("rank", "hk", "line").distinct().groupBy("hk", "line").agg(F.count("*").alias("s"))
    wide = wide.where(F.col("s") >= WIDE_PAGES).join(pages, "hk").where("s * 2 >= pages").groupBy("hk").agg(F.collect_list("line").alias("wide"))
    wide = salted(shared.select("rank", "hk")).join(wide.select("hk", "wide", parts), ["hk", "salt"]).select("rank", "wide")
    met = shared.join(judged, "rank", "left").join(wide, "rank", "left").select("rank", "asked", "zone", "line", "shared", "votes", "wide")

    def run(batches):
        for t in batches:
            keep = []
            for _, asked, zones, hashes, own, said, wide_ in zip(*(c.to_pylist() for c in t.columns)):
                said, wide_ = {v["line"]: v["go"] for v in said or ()}, set(wide_ or ())
                gone = [h in wide_ if z == ARTICLE else said.get(h, goes(z, s, asked)) for z, h, s in zip(zones, hashes, own)]
                keep.append(np.packbits(~np.array(gone, bool)).tobytes())
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(keep, pa.binary())], ["rank", "keep"])

    keep = rank.join(met.mapInArrow(run, "rank long, keep binary"), "rank").select("d1", "d2", "keep")
    # every copy takes the decision on its lines
    return paged.select("k1", "k2", "d1", "d2").distinct().join(keep, ["d1", "d2"]).select("k1", "k2", "keep")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    Character references are decoded, white space in a block is one space,
    blocks are joined by one space.  A null or empty page has an empty text.
    A page without a URL has no neighbours and is judged by its markup
    alone, and so is the only page of a host.  Repeated rows are one page,
    each with its text; pages of a host with equal lines are one page too, so
    the neighbours that are compared differ from it.
    Very long pages are parsed whole.  An empty table gives an empty result;
    other columns are ignored.
    """
    keyed = _keyed(pages, id_col, url_col, html_col)
    keep = _decisions(cut(_lines(keyed), "lines"))
    kind = keyed.schema["page_id"].dataType.simpleString()

    # the texts are parsed again from the scan: they move once, packed, and are never written between
    def pack(batches):
        for t in batches:
            packed = []
            for page in t.column(4).to_pylist():
                lines, zones = page_lines(page)
                rest = [i for i, z in enumerate(zones) if z != APART]
                lines, zones = [lines[i] for i in rest], [zones[i] for i in rest]
                packed.append(zlib.compress("\n".join([bytes(zones).hex(), *lines]).encode("utf-8", "surrogatepass"), 6))
            yield pa.RecordBatch.from_arrays([*t.columns[:4], pa.array(packed, pa.binary())], ["k1", "k2", "page_id", "url", "packed"])

    src = (keyed.mapInArrow(pack, f"k1 long, k2 long, page_id {kind}, url string, packed binary")
           .join(keep, ["k1", "k2"], "left").select("page_id", "url", "packed", "keep"))

    def run(batches):
        for t in batches:
            texts = []
            for packed, kept in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                zones, *lines = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
                if kept is None:  # no neighbours
                    at = [i for i, z in enumerate(bytes.fromhex(zones)) if not goes(z, False, False)]
                else:
                    at = np.nonzero(np.unpackbits(np.frombuffer(kept, np.uint8))[:len(lines)])[0].tolist()
                texts.append(" ".join(lines[i] for i in at))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
