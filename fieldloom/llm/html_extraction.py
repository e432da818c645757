"""Main text of web pages by a site style tree.

A page is read once into blocks of text, each with the path of its open elements and their class and
id names (its place in the site's style tree). Elements whose very name says what they are (menus,
footers, forms, scripts, and classes or roles such as `sidebar`, `ad`, `cookie`, `comments`) are
branches of no importance. For the others the pages of one host are merged: a node's importance joins
the entropy of its presentation over the host's pages with how evenly its contents recur on them, and
branches below `IMPORTANCE` are cut from each page; SMOOTH pages that share nothing are added to every host, so that a
host of few pages proves little. What stays of an article (or of the body, where a
page has none) is the main text.

Only (host, path, content) hashes are shuffled and counted; no host's pages meet in one task. Plain
blocks of an article are its content and stay whatever a host's copies look like.

Defined results: a null or empty html, or one without main text, gives an empty string and 0; a null
url is a host of its own; repeated rows give repeated results; broken markup is read as far as it can
be, tag by tag; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import may_hold, stash, table

#: A branch is cut below this importance, which is that on its host's pages and so many more that share nothing.
IMPORTANCE, SMOOTH = 0.4, 3
#: Share of the contents in a node's importance; the rest is its presentation's.
CONTENT = 0.9

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe canvas select button head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An opening tag ends an open element of these names, up to the nearest of the second kind.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The last ones describe a drawing or a formula and aren't shown.
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu desc metadata annotation annotation-xml".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu submenu footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social breadcrumb breadcrumbs "
    "comment comments respond disqus replies related recommended widget widgets pagination pager masthead login signup toolbar skip copyright".split()
)
#: What may stand beside such a word in a name, as in `ad-slot-2`; a name with any other word (`share-prices`) says nothing.
NEUTRAL_NAMES = frozenset(
    "container wrapper wrap box block list links link bar area section panel module unit slot item items button buttons posts post articles stories "
    "content inner outer main top bottom left right site page global primary secondary header footer column col row icon icons text label title message form "
    "the to us up by your our this more all js is has u c l o ui fixed sticky large small mobile desktop".split()
)
HEADER_NAMES = frozenset(["header", "head", "masthead"])
ARTICLE = frozenset(["article", "main"])
PLAIN = frozenset("article main section div body html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table tbody thead tr td th header".split())

#: Comments, declarations, tags with quoted values, and tags with stray quotes. No part but a comment runs past a `<`, so each place is read once.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["'/=]""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Raw elements whose missing end tag runs to the end of the page; others without an end tag are only passed over.
TO_THE_END = frozenset("script style textarea title head".split())
_END_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: These may stand without an end tag; the next tag of the name tells.
NESTED = frozenset(["button", "select"])
_NEXT = {t: re.compile(rf"<(/?){t}\b", re.I) for t in NESTED}


def _telling(name: str) -> bool:
    """Whether a class or id says that its element is none of the article: its words are of the list, beside neutral ones and numbers."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return any(p in BOILERPLATE_NAMES for p in parts) and all(p in BOILERPLATE_NAMES or p in NEUTRAL_NAMES or p.isdigit() for p in parts)


def _names(attributes: str) -> tuple[str, bool, set[str], str]:
    """What an element's attributes call it: its label in the tree, whether it is hidden, its classes and ids, its role."""
    label, hidden, names, role = "", False, set(), ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            label += f".{value}"
            names.update(value.split())
        elif key == "role":
            role = value.strip().lower()
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return label, hidden, names, role


def blocks(html: str) -> list[tuple[str, int, bool, bool]]:
    """(text, path, inside an article, plain) of every block that no element's name rules out, in page order.

    path: a hash that runs along the open elements; plain: inside an article, below elements without class or id only.
    """
    import xxhash

    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", 0, False, False, True, False)]  # tag, path, dropped, in article, plain, in a list
    open_: Counter[str] = Counter()
    text: list[str] = []
    linked = [0, 0]  # characters in links, and all, of the block

    def flush() -> None:
        if text:
            words = " ".join(unescape("".join(text)).split())
            _, path, dropped, article, plain, listed = stack[-1]
            links_only = linked[1] and linked[0] >= 0.9 * linked[1] and not article and listed
            if words and not dropped and not links_only:
                out.append((words, path, article, article and plain))
            text.clear()
        linked[0] = linked[1] = 0

    def close(k: int) -> None:
        while len(stack) > k:
            if stack[-1][0] in BLOCK:
                flush()
            open_[stack.pop()[0]] -= 1

    at, anchors, endless = 0, 0, set()
    while m := _TAG.search(html, at):
        if m.start() > at:
            piece = html[at : m.start()]
            if not stack[-1][2]:
                text.append(piece)
                k = len(piece.strip())
                linked[1] += k
                linked[0] += k * (anchors > 0)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag == "a":
                anchors = 0
            if open_[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            elif tag == "p":
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if tag in VOID:
            if tag in BLOCK:
                flush()
            else:
                text.append(" " if tag == "br" and not stack[-1][2] else "")
            continue
        if tag in RAW and not attributes.endswith("/"):
            if tag == "head":  # its end tag may be left out
                end = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(html, at)
            else:
                next_ = _NEXT[tag].search(html, at) if tag in NESTED and tag not in endless else None
                if next_ and not next_[1]:
                    continue  # the end tag is a later one's
                end = None if tag in endless else _END_RAW[tag].search(html, at)
                if tag not in TO_THE_END and end is None:
                    endless.add(tag)
                    continue
            at = end.end() if end else len(html)
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1) if open_["p"] else ():  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1) if any(open_[t] for t in ends) else ():
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in stops:
                    break
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag == "a":
            anchors = 1
        label, hidden, names, role = _names(attributes) if attributes else ("", False, (), "")
        _, path, dropped, article, plain, listed = stack[-1]
        told = tag not in ARTICLE and tag not in HEADINGS and tag not in ("body", "html") and any(map(_telling, names))
        comment = tag == "article" and any(p.lower() in ("comment", "comments") for n in names for p in _PARTS.findall(n))
        boilerplate = tag in BOILERPLATE_TAGS or hidden or role in BOILERPLATE_ROLES or told or comment
        header = (tag == "header" or any(p.lower() in HEADER_NAMES for n in names for p in _PARTS.findall(n))) and not article and tag not in ("body", "html")
        inside = article or tag in ARTICLE or role in ARTICLE
        if tag in BLOCK or boilerplate:
            path = xxhash.xxh64_intdigest(f"{tag}{label}".encode("utf-8", "replace"), seed=path)
            plain = (plain if article else True) and (tag in PLAIN) and not (label and article)
        open_[tag] += 1
        stack.append((tag, path, dropped or boilerplate or header, inside, plain, listed or tag == "li"))
    if at < len(html) and not stack[-1][2]:
        text.append(html[at:])
    close(1)
    flush()
    return out


def main_text(html: str | None, cut: set[int]) -> str:
    """The blocks that stay: those of articles where there are any, without the branches in `cut`."""
    found = blocks(html or "")
    if any(article for _, _, article, _ in found):
        found = [b for b in found if b[2]]
    if cut:
        found = [b for b in found if b[3] or _signed(b[1]) not in cut]
    return "\n".join(b[0] for b in found)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def host_of(url):
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """One row a node of the hosts' style trees: host, path (hash), pages, importance. pages: host, html."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = lambda v: _signed(xxhash.xxh64_intdigest(v.encode("utf-8", "replace")))
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nodes: dict[int, list[str]] = {}
                found = blocks(html or "")
                for text, path, _, plain in found:
                    if not plain:
                        nodes.setdefault(path, []).append(text)
                page = digest("\n".join(f"{text} {path}" for text, path, _, _ in found)) if nodes else 0
                for path, texts in nodes.items():
                    for column, v in zip(out, (host, _signed(path), digest("\n".join(texts)), len(texts), page), strict=True):
                        column.append(v)
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["host", "path", "content", "style", "page"])

    nodes = pages.select("host", "html").mapInArrow(run, "host string, path long, content long, style long, page long")
    # Copies of a page count once: what recurs in them is not the site's template.
    nodes = nodes.distinct()
    counted = nodes.groupBy("host", "path", "content", "style").agg(F.count(F.lit(1)).alias("n"))
    node = ["host", "path"]
    # n pages that share a content: log(n) / log(m) is 0 where it is on one page and 1 where it is on all m; m is more than the host's pages, so few prove little.
    contents = counted.groupBy(*node, "content").agg(F.sum("n").alias("n"))
    contents = contents.groupBy(*node).agg(F.sum("n").alias("pages"), F.avg(F.log("n")).alias("recurring"))
    styles = counted.groupBy(*node, "style").agg(F.sum("n").alias("n"))
    styles = styles.groupBy(*node).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))
    most = F.log(F.col("pages") + SMOOTH)
    content, style = 1 - F.col("recurring") / most, F.col("entropy") / most
    return contents.join(styles, node).select(*node, "pages", (F.lit(CONTENT) * content + F.lit(1 - CONTENT) * style).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    low = style_tree(hosted).filter(F.col("importance") < IMPORTANCE)
    cuts = stash(low.groupBy(F.col("host").alias("at")).agg(F.collect_set("path").alias("cut")), "cuts")  # a host's recurring branches, not its pages
    # Only pages of hosts with something to cut are shuffled, and a host's pages in as many parts as there are partitions.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cuts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    concerned = may_hold(hosted, "host", cuts, "at").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(parts)).cast("int"))
    joined = concerned.alias("p").join(spread.alias("c"), (F.col("p.host") == F.col("c.at")) & (F.col("p.part") == F.col("c.part")), "left").select("page_id", "url", "html", "cut")
    joined = joined.unionByName(may_hold(hosted, "host", cuts, "at", rest=True).select("page_id", "url", "html", F.lit(None).cast("array<long>").alias("cut")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(html, set(cut or ())) for html, cut in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, hosted.select("page_id", "url", F.lit("").alias("text")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
