"""Main text of web pages with site templates removed (operator 4).

Every page is walked twice.  The first walk hashes element subtrees (tag,
class, text and the children's hashes) and Spark counts, per host, on how many
different articles each stands.  The second walk deletes subtrees that recur on
many of the host's articles (MIN_SHARE of them, or for containers MANY_PAGES, so
that the block of one section goes on a large host, too), and what tags, classes and roles name as menus,
headers, footers, sidebars, notices, adverts, forms or comments, and returns the
blocks of the article (else of main, else of the body).

Paragraphs and headings inside an article are content even if they recur, and
whatever their classes and ids are; there, only containers are dropped by name,
and only if a class is the name itself ("related", not "related-work").  Copies
of an article on one host count once.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import durable, map_batches, packed, sliced, table

MIN_PAGES = 5  # articles of a host that must share a subtree ...
MIN_SHARE = 0.3  # ... and their share of the host's articles
MANY_PAGES = 100  # articles of a host that make a container a template, whatever their share
BROADCAST_ROWS = 500_000  # template subtrees sent to all workers (16 bytes each); more are joined

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/<>]*+)(?P<attr>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>"""
                 r"""|<[!?/][^<>]*+>|<[A-Za-z][^<>]*+>""", re.S)
ATTR = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: raw elements whose content is text of an article that holds them
ARTICLE_TEXT = frozenset("noscript math object".split())
DROP = frozenset("head nav header footer aside form dialog menu button label fieldset".split()) | RAW
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROP_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|notices?|popup|modal|sidebars?|nav|navbar|navigation|menus?|"
    r"breadcrumbs?|header|masthead|footer|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|newsletter|"
    r"subscribe|signup|login|pagination|pager|toolbar|widgets?)(?=$|[\s_-])", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply)(?=$|[\s_-])", re.I)
ROOTS = frozenset("html body main article".split())
#: elements that may be deleted as templates inside an article, too
CONTAINERS = frozenset("div section ul ol dl table figure details".split())
#: start tag -> open tags that it ends, up to the nearest of the scope
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BREAK = None


def _attributes(attr: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attr)} if attr.strip("/ \t\r\n") else {}


def _dropped(tag: str, a: dict[str, str], within: bool) -> bool:
    """True for what its tag, role, class or id names as something else than the article.

    ``within``: the element stands in an article, where ids and parts of class names decide nothing.
    """
    if tag in DROP:
        return not (within and tag in ARTICLE_TEXT)
    if not a or tag in ("html", "body"):
        return False
    if tag == "article" or tag == "main":
        return bool(COMMENT_NAMES.search(a.get("class", ""))) and tag == "article"
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if within:
        return tag in CONTAINERS and (a.get("role", "").lower() in DROP_ROLES or any(map(DROP_NAMES.fullmatch, a.get("class", "").split())))
    if a.get("role", "").lower() in DROP_ROLES:
        return True
    return bool(DROP_NAMES.search(a.get("class", "")) or DROP_NAMES.search(a.get("id", "")))


def walk(html: str, templates=frozenset()) -> tuple[list, set[int]]:
    """Pieces of the main text (strings and BREAK) and the hashes of the subtrees that may be templates.

    The hash of a container is odd, that of another element even.
    A subtree whose hash is in ``templates`` is left out.
    """
    out: list = []
    found: set[int] = set()
    picked: dict[str, list] = {"article": [], "main": []}
    stack: list[list] = []  # tag, place in out, dropped, parts of the hash, inside an article or main
    parts: list[str] = []
    dropping, inside, articles, at = 0, 0, 0, 0

    def close():
        nonlocal parts, dropping, inside, articles
        tag, place, dropped, outer, name = stack.pop()
        inside -= tag in ("article", "main")
        articles -= tag == "article"
        digest = 0
        if tag not in ROOTS and tag in BLOCK and (not inside or tag in CONTAINERS or dropped):
            digest = xxhash.xxh3_64_intdigest(f"{tag}|{name}|" + "\x00".join(parts)) & (2**63 - 2) | (tag in CONTAINERS)
            if any(not p.isspace() for p in parts):
                found.add(digest)
        elif tag not in ROOTS:
            digest = xxhash.xxh3_64_intdigest(f"{tag}|" + "\x00".join(parts))
        parts = outer
        parts.append(f"#{digest:x}")
        dropping -= dropped
        if dropped or digest in templates and tag not in ROOTS:
            del out[place:]
        elif tag in picked and not dropping and not any(s[0] == tag for s in stack):
            picked[tag].append(out[place:])
        if tag in BLOCK:
            out.append(BREAK)

    m = TAG.search(html)
    while m:
        if m.start() > at:
            text = html[at:m.start()]
            parts.append(text)
            if not dropping:
                out.append(text)
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            pass
        elif m["end"]:
            if any(s[0] == tag for s in reversed(stack)):
                while stack[-1][0] != tag:
                    close()
                close()
        elif tag == "br" or tag in VOID:
            if not dropping:
                out.append(BREAK if tag == "hr" else " " if tag == "br" else "")
        else:
            if tag in BLOCK:
                _end_open(stack, tag, close)
            if tag in RAW and not (articles and tag in ARTICLE_TEXT):
                last = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = last.start() if last else len(html)
            a = _attributes(m["attr"])
            drop = _dropped(tag, a, articles > 0)
            if tag in BLOCK and not dropping:
                out.append(BREAK)
            stack.append([tag, len(out), drop, parts, a.get("class", "")])
            parts = []
            dropping += drop
            inside += tag in ("article", "main")
            articles += tag == "article"
            if m["attr"].endswith("/") and tag in RAW:
                close()
        m = TAG.search(html, at)
    if at < len(html):
        parts.append(html[at:])
        if not dropping:
            out.append(html[at:])
    while stack:
        close()
    for name in ("article", "main"):
        if picked[name]:
            return [x for part in picked[name] for x in (*part, BREAK)], found
    return out, found


def _end_open(stack: list, tag: str, close) -> None:
    """End what a block start tag ends: an open paragraph, and items of the same list or row."""
    ended, scope = ENDS.get(tag, ((), ()))
    for k in range(len(stack) - 1, -1, -1):
        name = stack[k][0]
        if name == "p" or name in ended:
            while len(stack) > k:
                close()
            if name == "p" and ended:
                _end_open(stack, tag, close)
            return
        if name in scope or name in BLOCK and not ended or name in ROOTS:
            return


def text_of(pieces: list) -> str:
    """Blocks joined by blank lines; character references decoded, white space folded."""
    blocks, held = [], []
    for p in (*pieces, BREAK):
        if p is not BREAK:
            held.append(unescape(p) if "&" in p else p)
        elif held:
            block = " ".join("".join(held).split())
            if block:
                blocks.append(block)
            held = []
    return "\n\n".join(blocks)


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, digest) of the subtrees that stand on many different articles of a host.

    Many are ``min_share`` of them and ``min_pages`` at least, for containers also ``many_pages``.
    """

    def run(batch):
        host, page, digest = [], [], []
        for h, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            pieces, found = walk(html or "")
            own = xxhash.xxh3_64_intdigest(text_of(pieces)) & (2**63 - 1)
            host += [h] * (len(found) + 1)
            page += [own] * (len(found) + 1)
            digest += [-1, *found]  # -1 stands for the page itself
        return {"host": host, "page": pa.array(page, pa.int64()), "digest": pa.array(digest, pa.int64())}

    rows = map_batches(pages, run, "host long, page long, digest long")
    counts = rows.distinct().groupBy("host", "digest").agg(F.count("*").alias("n"))
    sizes = counts.where("digest = -1").select("host", F.col("n").alias("pages"))
    return (counts.where(F.col("digest") >= 0).where(F.col("n") >= min_pages).join(sizes, "host")
            .where((F.col("n") >= min_share * F.col("pages")) | (F.col("digest") % 2 == 1) & (F.col("n") >= many_pages))
            .select("host", "digest"))


def host_of(url) -> F.Column:
    """Hash of the host of a URL, '' for null or unreadable ones."""
    host = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.xxhash64(host)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``row`` (all columns of ``pages(url, html, ...)``) and ``main_text`` for every page.

    Null html is empty; a page without text gives ''.  Null URLs share the host
    ''.  Repeated rows are returned each; no pages, no rows.
    """
    kind = packed(pages).schema["row"].dataType.simpleString()
    rows = packed(pages).select("row", host_of(F.col("row.url")).alias("host"), F.col("row.html").cast("string").alias("html"))
    marks = durable(site_templates(rows.select("host", "html"), min_pages, min_share))

    def lines(batch, templates_of):
        texts = [text_of(walk(html or "", t)[0]) for html, t in zip(batch.column("html").to_pylist(), templates_of)]
        return {"row": batch.column("row"), "main_text": pa.array(texts, pa.string())}

    schema = f"row {kind}, main_text string"
    if marks.count() <= broadcast_rows:
        got = marks.toArrow()
        shared = pages.sparkSession.sparkContext.broadcast((got["host"].to_numpy(), got["digest"].to_numpy()))

        def run(batches):
            by_host: dict[int, set] = {}
            for h, d in zip(*map(np.ndarray.tolist, shared.value)):
                by_host.setdefault(h, set()).add(d)
            for batch in sliced(batches):
                yield pa.RecordBatch.from_pydict(lines(batch, [by_host.get(h, frozenset()) for h in batch.column("host").to_pylist()]))

        return rows.mapInArrow(run, schema)
    # per host at most (subtrees of a page / min_share) digests, and containers of many pages
    sets = marks.groupBy("host").agg(F.collect_set("digest").alias("digests"))
    return map_batches(rows.join(sets, "host", "left"),
                       lambda b: lines(b, [frozenset(d or ()) for d in b.column("digests").to_pylist()]), schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages."""
    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), F.col("main_text").alias("text"),
                      F.length("main_text").cast("long").alias("n_chars"))


#: For the layout of the given pages: one article of paragraphs and a heading.
_PLAIN = ("regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^<>]*>', '', 'g')")
_DECODED = f"replace(replace(replace(replace(replace({_PLAIN}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
OP4_SQL = rf"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
    string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(p|h1)>'),
    lambda x: trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text
  FROM pages)
"""
