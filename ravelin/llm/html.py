"""Main text of HTML pages by removing site templates.

Every container element of a page is hashed with all that it holds, from the innermost outwards. Spark counts, per host
and hash, how many different surroundings (the rest of the page's text) a subtree has; those with many are part of the
site's template and are deleted. Copies of a page, and a container that holds all of its text, have one surrounding
however often they occur. What the counts can't see, as its text differs from page to page, goes by fixed names: tags,
roles and classes of menus, footers, adverts, forms, comments; and where a page marks an article or main element, only
what is inside remains.

Headings, and paragraphs inside an article, are not counted: many articles of a site share a heading or a sentence.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_batches, stored
from .urls import parts as url_parts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Fixed values of the HTML standard: elements without content, with raw content, and of inline text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that hold no article text, by tag, role and words of class and id.
DROPPED = frozenset("nav footer aside form button select head dialog menu svg canvas object audio video math datalist".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu form comment".split())
#: Fixed words of class and id names. A name counts where it is such a word with nothing but the words around it that are
#: listed here: names are often made from headings and topics (related-work, social-science, article-share-price).
_AROUND = "site page main top bottom left right global primary secondary article post entry user reader single inline sticky mobile desktop google wp js".split()
_WORDS = (
    r"ads?|adsbygoogle|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|pop-up|modal|overlay|newsletters?|subscribe|subscription|sign-?up|side-?bar\w*|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"comments?|disqus|respond|reply|replies|share|sharing|social|related|recommended|recommendations|skip-?link|skip-to-content|toolbar|widgets?"
)
_AFTER = (
    r"\d+|top|bottom|left|right|box|bar|block|wrapper|wrap|container|section|area|list|form|links?|buttons?|icons?|inner|outer|content|thread|posts?|articles?|stories|news|main|menu|banner|notice|consent|slot|unit|widget|items?|body|"
    r"card|entry|header|footer|title|text|signup|subscribe|info|warning|danger|success|error|dialog|overlay|popup|modal|media|share|follow|ads?|panel|row|sm|md|lg|xl"
)
_NAME = re.compile(rf"(?:(?:{'|'.join(_AROUND)})[-_]+)*(?:{_WORDS})(?:[-_]+(?:{_AFTER}))*|(?:(?:{'|'.join(_AROUND)})[-_]+)*(?:(?:{_AFTER})[-_]+)?(?:comments|ads?|advert\w*|newsletter|sidebar)")
#: Names of a head and foot, which an article may have too; there they count if they name the site.
_EDGE = re.compile(r"(?:(?:site|page|main|top|bottom|global)[-_]*)*(?:header|footer|masthead)(?:[-_]+(?:\d+|top|bottom|bar|wrapper|wrap|container|inner|content|links?|menu|widgets?))*")
#: Names of a reader's comment, which may be an article of its own.
_COMMENT = re.compile(r"(?:(?:user|reader|single|child|parent|nested)[-_]+)*(?:comments?|reply|replies)(?:[-_]+(?:item|body|card|box|list|thread|content|entry|\d+))*")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Containers whose subtrees are counted; paragraphs only outside an article, with a link or so many words.
PARAGRAPH_WORDS = 8
CONTAINERS = frozenset("nav footer aside header form div section ul ol table figure details fieldset menu blockquote dl center".split())
MAIN = ("article", "main")
#: A subtree recurs when it has at least so many different surroundings on its host.
MIN_PAGES = 5
_ALL = (1 << 64) - 1


def _hidden(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    values = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
    words = [_CAMEL.sub("-", w).lower() for w in (*values.get("class", "").split(), values.get("id", "").strip())]
    if tag == "article" and not in_article:
        return values.get("role", "").lower() == "comment" or values.get("itemtype", "").endswith("/Comment") or any(map(_COMMENT.fullmatch, words))
    named = tag not in _HEADINGS and any(_NAME.fullmatch(w) or (not in_article or w.startswith(("site", "global"))) and _EDGE.fullmatch(w) for w in words)
    return values.get("role", "").lower() in ROLES or named or "display:none" in values.get("style", "").replace(" ", "") or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))


class Page:
    """A page's text pieces, each with the innermost container around it, and the containers with their hashes."""

    def __init__(self, source: str, names: bool = True):
        self.names = names  # whether tags, roles and classes tell what is an article and what is none
        self.open: list[list] = []  # tag, what it holds for the hash, hidden, container's number or None, is article
        self.depth: Counter = Counter()  # open elements by tag
        self.around: list[int] = [-1]
        self.hashes: list[int] = []
        self.up: list[int] = []  # the container around each container
        self.spans: list[list[int]] = []  # first piece, piece after the last, words (links count as many)
        self.pieces: list[tuple[str, bool, int]] = []  # text, in an article, innermost container
        self.hidden = self.articles = 0
        self.has_article = False
        at, lower = 0, None
        for m in iter(lambda: _TOKEN.search(source, at), None):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
            else:
                self._start(tag, attributes)
                if tag in RAW:
                    lower = lower if lower is not None else source.lower()
                    end = lower.find(f"</{tag}", at)
                    at = len(source) if end < 0 else end
        if at < len(source):
            self._text(source[at:])
        while self.open:
            self._pop()

    def _text(self, raw: str) -> None:
        if not self.hidden:
            self.pieces.append((entities.unescape(raw) if "&" in raw else raw, self.articles > 0, self.around[-1]))
        if self.open and not raw.isspace():
            self.open[-1][1].append(" ".join(raw.split()).encode("utf-8", "surrogatepass"))

    def _gap(self) -> None:
        if self.pieces and self.pieces[-1][0] != " ":
            self.pieces.append((" ", True, -1))

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._gap()
        if tag in CLOSES_P and self.depth["p"]:
            self._close("p", within=("button", "td", "th", "caption", "object", *MAIN, "div", "section"))
        for other in SIBLINGS.get(tag, ()):
            self._close(other, within=("ul", "ol", "menu", "dl", "table", "select"))
        if tag in VOID or attributes.endswith("/") and tag not in MAIN and tag not in CONTAINERS:
            if self.open:
                self.open[-1][1].append(b"<" + tag.encode("utf-8", "surrogatepass"))
            return
        hidden = _hidden(tag, attributes, self.articles > 0) if self.names else tag in RAW or tag == "head"
        counted = tag in CONTAINERS or tag == "p" and not self.articles
        if counted:
            self.up.append(self.around[-1])
            self.around.append(len(self.hashes))
            self.hashes.append(0)
            self.spans.append([len(self.pieces), 0, PARAGRAPH_WORDS if tag != "p" else 0])
        elif tag == "a" and self.around[-1] >= 0:
            self.spans[self.around[-1]][2] = PARAGRAPH_WORDS
        article = self.names and tag in MAIN and not self.hidden
        self.open.append([tag, [], hidden, self.around[-1] if counted else None, article])
        self.depth[tag] += 1
        self.hidden += hidden
        self.articles += article
        self.has_article |= article

    def _pop(self) -> None:
        tag, holds, hidden, number, article = self.open.pop()
        self.depth[tag] -= 1
        own = xxhash.xxh64_intdigest(b"\n".join([tag.encode("utf-8", "surrogatepass"), *holds]))
        if self.open:
            self.open[-1][1].append(b"<%d>" % own)
        if number is not None:
            self.hashes[number] = own
            self.spans[number][1] = len(self.pieces)
            self.around.pop()
        self.hidden -= hidden
        self.articles -= article
        if tag not in INLINE:
            self._gap()

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        if not self.depth[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in within or not within and self.open[k][0] in MAIN and tag not in ("body", "html", *MAIN):
                return

    def main(self) -> list[tuple[str, int]]:
        """The pieces of the article, or of the whole page if it marks none, with the innermost container around each."""
        return [(t, c) for t, inside, c in self.pieces if inside or not self.has_article]

    def parts(self) -> list[tuple[int, int]]:
        """Hash and surroundings (a hash of all other text that main gives) of each container; 0 and 0 where it doesn't count.

        What holds no text of the page, or all of it, doesn't count, nor do short paragraphs without a link."""
        sums, words = [0], [0]
        for text, inside, _ in self.pieces:
            text = " ".join(text.split()) if inside or not self.has_article else ""
            sums.append(sums[-1] + (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) | 1) & _ALL if text else sums[-1])
            words.append(words[-1] + text.count(" ") + 1 if text else words[-1])
        out = []
        for own, (start, stop, known) in zip(self.hashes, self.spans, strict=True):
            held = words[stop] - words[start]
            good = 0 < held < words[-1] and held + known >= PARAGRAPH_WORDS
            out.append((own - (1 << 63), (sums[-1] - (sums[stop] - sums[start]) & _ALL) - (1 << 63)) if good else (0, 0))
        return out


def joined(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, names: bool = True) -> DataFrame:
    """id_col, url_col, text for every row of pages.

    Null html is empty and gives an empty text; pages without a host are one site. Other columns are ignored;
    repeated rows each come back, and count as one page. With names=False neither an article mark nor any tag, role
    or class matters (but raw elements and the head), so only the counts decide."""
    own = [F.col(id_col).alias("_id"), F.col(url_col).alias("_url")]
    keys = [F.xxhash64(*own, F.col(html_col)).alias("_k1"), F.xxhash64(F.col(html_col), F.lit("page"), *own).alias("_k2")]
    rows = pages.select(*own, *keys, url_parts(F.col(url_col))[0].alias("_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    types = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_url")}
    piece = pa.list_(pa.struct([("text", pa.string()), ("within", pa.int32())]))
    part = pa.list_(pa.struct([("hash", pa.int64()), ("rest", pa.int64()), ("up", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, 5):
                texts, pieces, parts = [], [], []
                for source in some.column(5).to_pylist():
                    page = Page(source, names)
                    main, counted = page.main(), page.parts()
                    bare = not any(h or r for h, r in counted)
                    texts.append(joined([t for t, _ in main]) if bare else None)
                    pieces.append(None if bare else [{"text": t, "within": c} for t, c in main])
                    parts.append(None if bare else [{"hash": h, "rest": r, "up": u} for (h, r), u in zip(counted, page.up, strict=True)])
                yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array(texts, pa.string()), pa.array(pieces, piece), pa.array(parts, part)], names=["_id", "_url", "_k1", "_k2", "_host", "text", "pieces", "parts"])

    schema = f"_id {types['_id']}, _url {types['_url']}, _k1 bigint, _k2 bigint, _host string, text string, pieces array<struct<text string, within int>>, parts array<struct<hash bigint, rest bigint, up int>>"
    parsed = stored(in_batches(rows, run, schema), "parsed")
    counted = parsed.where("pieces is not null")
    around = counted.select("_k1", "_k2", "_host", F.explode("parts").alias("p")).where("p.hash <> 0 or p.rest <> 0").select("_k1", "_k2", "_host", "p.hash", "p.rest").distinct()
    often = around.select("_host", "hash", "rest").distinct().groupBy("_host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("_host", "hash")
    gone = around.join(often, ["_host", "hash"], "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("hash").alias("gone"))
    rest = counted.join(gone, ["_k1", "_k2"], "left").select("_id", "_url", "pieces", "parts", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for pieces, parts, off in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                off, dropped = set(off or ()), []
                for p in parts:  # what is around a container comes before it
                    dropped.append(p["hash"] in off or p["up"] >= 0 and dropped[p["up"]])
                texts.append(joined([p["text"] for p in pieces if p["within"] < 0 or not dropped[p["within"]]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["_id", "_url", "text"])

    done = parsed.where("pieces is null").select("_id", "_url", "text")
    rest = in_batches(rest, cut, f"_id {types['_id']}, _url {types['_url']}, text string")
    return done.unionByName(rest).select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
