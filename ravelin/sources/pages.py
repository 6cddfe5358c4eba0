"""Links and documents of pages: anchors, index lists, PDF discovery, syndication entries, advisory listings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import network, times
from ..functions import text as T
from ..session import stored
from . import nodes as N


def _links_of(html: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    places, pos, node, href, texts = [], [], [], [], []
    for place, markup in enumerate(html):
        if not markup.is_valid:
            continue
        page = N.read(markup.as_py())
        own = [k for k, tag in enumerate(page.tag) if tag == "a" and "href" in page.attributes[k]]
        places += [place] * len(own)
        pos += range(len(own))
        node += own
        href += [page.attributes[k]["href"] for k in own]
        texts += N.texts_between(page, own)
    return pa.array(places, pa.int64()), [pa.array(pos, pa.int32()), pa.array(node, pa.int32()), pa.array(href, pa.string()), pa.array(texts, pa.string())]


def anchors(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each link of each page (an `a` with an href): its place among them (pos), its node, href, text and absolute url.

    Characters are decoded and quoted signs are no markup; pages without links, null ones included, give no row. Only
    links leave the reader of a page, not its nodes."""
    rows = N.each_page(pages, html_col, _links_of, "pos int, node int, href string, link_text string")
    rows = rows.withColumns({"href": F.trim("href"), "link_text": T.fold_space(F.col("link_text"))})
    return rows.withColumn("absolute", network.resolve(F.col(url_col), F.col("href")))


def selected_anchors(pages: DataFrame, page_cols: list[str], selector: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The anchors that a selector picks; page_cols tell the pages apart. A selector of another form raises ValueError."""
    picked = N.select(N.node_rows(pages.select(*page_cols, html_col), html_col), page_cols, selector).where("selected and tag = 'a'")
    links = anchors(pages, url_col, html_col)
    keys = picked.select(*[F.col(c).alias(f"_k_{c}") for c in page_cols], F.col("pre").alias("_pre"))
    return links.join(keys, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in page_cols] + [F.col("node") == F.col("_pre")], "left_semi")


def index_links(links: DataFrame, page_col: str, hosts: list[str], path_pattern: str, base_col: str = "url", slash: bool = False) -> DataFrame:
    """Confined links of an index page, each once, in page order; with slash every path ends in one."""
    url = network.confined(F.col(base_col), F.col("href"), hosts, path_pattern)
    url = F.when(F.lit(slash) & ~url.endswith("/"), F.concat(url, F.lit("/"))).otherwise(url) if slash else url
    rows = links.withColumn("link", url).where("link is not null")
    return rows.groupBy(page_col, "link").agg(F.min("pos").alias("pos"))


def links_on_hosts(links: DataFrame, page_col: str, hosts: DataFrame, path_pattern: str, base_col: str = "url") -> DataFrame:
    """The same where the hosts are a table (column host) of any size; links join it by the host they lead to."""
    url = F.regexp_replace(network.resolve(F.col(base_col), F.col("href")), r"#.*$", "")
    rows = links.withColumn("link", url).where(network.url_is_admissible(F.col("link")) & network.url_part(F.col("link"), "path").rlike(path_pattern))
    rows = rows.withColumn("_host", network.url_part(F.col("link"), "host")).join(hosts.select(F.col("host").alias("_host")).distinct(), "_host", "left_semi")
    return rows.groupBy(page_col, "link").agg(F.min("pos").alias("pos"))


def first_per_page(links: DataFrame, page_col: str, base_col: str, most: int = 5) -> DataFrame:
    """The first links of each page, those on its own host before others."""
    other = network.url_part(F.col("absolute"), "host") != network.url_part(F.col(base_col), "host")
    rank = F.row_number().over(W.partitionBy(page_col).orderBy(other, "pos"))
    return links.withColumn("rank", rank).where(F.col("rank") <= most)


def pdf_links(links: DataFrame, pattern: str | None = None) -> DataFrame:
    """Links that name a PDF (and match a pattern); those of selected_anchors, where a recipe has a selector."""
    rows = links.where(F.lower(network.url_part(F.col("absolute"), "path")).endswith(".pdf"))
    return rows.where(F.col("absolute").rlike(pattern)) if pattern else rows


def unseen(links: DataFrame, seen: DataFrame, on: str = "link") -> DataFrame:
    """Links whose url has not been processed."""
    return links.join(seen.select(F.col("url").alias(on)).distinct(), on, "left_anti")


def cap_per_source(links: DataFrame, source_col: str, most: int, order: str = "pos") -> DataFrame:
    """At most so many new links of a source in one cycle."""
    rank = F.row_number().over(W.partitionBy(source_col).orderBy(order))
    return links.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def entry_url(links: Column, enclosures: Column, guid: Column) -> Column:
    """The address of an entry: of what is typed as a PDF the first, links before enclosures; else the last alternate page; else a permanent guid.

    links: (_VALUE, _href, _rel, _type); enclosures: (_url, _type); guid: (_VALUE, _isPermaLink)."""
    first = lambda found, name: F.get(F.filter(found, lambda x: (F.lower(F.trim(x["_type"])) == "application/pdf") & (x[name] != "")), F.lit(0))[name]
    page = lambda x: (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate") & F.coalesce(x["_type"], F.lit("text/html")).isin("text/html", "application/xhtml+xml")
    own = F.filter(F.transform(F.filter(links, page), lambda x: F.coalesce(x["_href"], F.trim(x["_VALUE"]))), lambda x: x != "")
    permanent = F.when(F.lower(F.coalesce(guid["_isPermaLink"], F.lit("true"))) == "true", F.trim(guid["_VALUE"]))
    return F.trim(F.coalesce(first(links, "_href"), first(enclosures, "_url"), F.get(own, F.size(own) - 1), permanent))


_ENTRY = (
    "struct<title: string, link: array<struct<_VALUE: string, _href: string, _rel: string, _type: string>>, enclosure: array<struct<_url: string, _type: string>>, "
    "guid: struct<_VALUE: string, _isPermaLink: string>, pubDate: string, published: string, updated: string, date: string>"
)
_FEED = f"struct<channel: struct<title: string, item: array<{_ENTRY}>>, item: array<{_ENTRY}>, entry: array<{_ENTRY}>, broken: string>"


def _parsed(xml: Column) -> Column:
    """(entries, broken) of one body: RSS with its items in the channel or beside it, or Atom, whatever the prefixes.

    A body that is no XML is read by its entries, a bare & as itself; broken says so."""
    options = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}
    none = F.array().cast(f"array<{_ENTRY}>")
    whole = F.from_xml(F.trim(xml), _FEED, options)
    mended = F.regexp_replace(xml, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")
    single = F.regexp_extract_all(mended, F.lit(r"(?s)(<(?:\w+:)?(?:item|entry)[\s>].*?</(?:\w+:)?(?:item|entry)>)"), F.lit(1))
    wrapped = F.concat(F.lit('<rss><channel xmlns:x="x">'), F.array_join(F.transform(single, lambda x: F.regexp_replace(F.regexp_replace(x, r"<(/?)\w+:", "<$1"), r"\s[\w-]+:([\w-]+\s*=)", " $1")), ""), F.lit("</channel></rss>"))
    rest = F.from_xml(F.regexp_replace(F.regexp_replace(wrapped, r"<(/?)entry([\s>])", "<$1item$2"), "^$", "<rss/>"), _FEED, options)

    def of(feed: Column) -> Column:
        return F.concat(F.coalesce(feed["channel"]["item"], none), F.coalesce(feed["item"], none), F.coalesce(feed["entry"], none))

    bad = F.coalesce(whole["broken"].isNotNull(), F.lit(True))
    return F.struct(F.when(bad, of(rest)).otherwise(of(whole)).alias("entries"), bad.alias("broken"))


def feed_entries(bodies: DataFrame, xml_col: str = "xml") -> DataFrame:
    """The other columns of bodies with pos, title, link and published of each entry; entries without a usable link are left out."""
    rows = bodies.withColumn("_feed", _parsed(F.col(xml_col))).select(*[c for c in bodies.columns if c != xml_col], F.posexplode("_feed.entries").alias("pos", "_e"))
    text = lambda c: F.nullif(T.fold_space(F.coalesce(F.col(f"_e.{c}"), F.lit(""))), F.lit(""))
    link = entry_url(F.col("_e.link"), F.col("_e.enclosure"), F.col("_e.guid"))
    rows = rows.withColumns({"title": F.coalesce(text("title"), F.lit("")), "link": link, "published": F.coalesce(*map(text, ("pubDate", "published", "updated", "date")))}).drop("_e")
    return rows.where(network.url_is_admissible(F.coalesce("link", F.lit(""))))


def feed_health(bodies: DataFrame, xml_col: str = "xml") -> DataFrame:
    """The other columns of bodies with the number of entries and an error: 'no feed' where nothing could be read from a body, 'no entries' where a feed has none."""
    rows = bodies.withColumn("_feed", _parsed(F.coalesce(F.col(xml_col), F.lit(""))))
    n = F.size("_feed.entries")
    error = F.when(n > 0, None).when(F.col("_feed.broken"), "no feed").otherwise("no entries")
    return rows.select(*[c for c in bodies.columns if c != xml_col], n.alias("entries"), error.alias("error"))


def advisories(listing: DataFrame, json_col: str, prefix: str, most: int = 10) -> DataFrame:
    """The latest advisory files of a JSON listing by name: .json files under a URL prefix."""
    rows = listing.select(F.inline(F.from_json(json_col, "array<struct<name: string, download_url: string>>")))
    rows = rows.where(F.col("name").endswith(".json") & F.col("download_url").startswith(prefix))
    return rows.orderBy(F.desc("name")).limit(most)


def _first_or_conflict(values: Column, what: str) -> tuple[Column, Column]:
    """The only value of a list (null, if empty), and the reason where there are several."""
    distinct = F.array_distinct(values)
    return F.get(distinct, F.lit(0)), F.when(F.size(distinct) > 1, F.lit(f"conflicting {what}"))


def _title(texts: Column, what: str) -> tuple[Column, Column]:
    """The first title that isn't empty; others may differ in case alone."""
    shown = F.filter(texts, lambda t: t != "")
    return F.get(shown, F.lit(0)), _first_or_conflict(F.transform(shown, lambda t: F.lower(t)), what)[1]


def _days(stamps: Column, text: Column) -> Column:
    """(day, kind, reason) of a scope: the day of the datetime values of its time elements, else the one written in Spanish in its text; all must agree."""

    def judged(x: Column) -> Column:
        by_time, several = _first_or_conflict(x["stamps"], "datetime values")
        by_text, more = _first_or_conflict(x["shown"], "visible dates")
        bad = lambda days, what: F.when(F.exists(days, lambda d: d.isNull()), F.lit(f"malformed {what}"))
        both = F.when(by_time != by_text, F.lit("conflicting time and visible dates"))
        kind = F.when(by_time.isNotNull(), "time").when(by_text.isNotNull(), "text")
        reason = F.coalesce(bad(x["stamps"], "datetime"), several, bad(x["shown"], "visible date"), more, both)
        return F.struct(F.coalesce(by_time, by_text).alias("day"), kind.alias("kind"), reason.alias("reason"))

    return T.let(F.struct(F.transform(stamps, times.iso_day).alias("stamps"), times.spanish_dates(T.fold_space(text)).alias("shown")), judged)


_SCOPE = "struct<mains: int, titles: array<string>, headings: array<string>, stamps: array<string>, shown: string>"


def _scopes(html: pa.Array) -> pa.Array:
    """What the main element of each page holds, if it is the only one: texts of h1 and h2, datetime values, and the text outside navigation and footers."""
    mains, titles, headings, stamps, shown = [], [], [], [], []
    for markup in html:
        page = N.read(markup.as_py() or "")
        own = [k for k, tag in enumerate(page.tag) if tag == "main"]
        mains.append(len(own))
        start, end = (own[0] + 1, page.last[own[0]]) if len(own) == 1 else (0, -1)
        for tag, out in (("h1", titles), ("h2", headings)):
            out.append(N.texts_between(page, [k for k in range(start, end + 1) if page.tag[k] == tag]))
        stamps.append(N.stamps(page, start, end))
        shown.append(N.shown(page, start, end, page.margin[own[0]]) if len(own) == 1 else "")
    lists = [pa.array(x, pa.list_(pa.string())) for x in (titles, headings, stamps)]
    return pa.StructArray.from_arrays([pa.array(mains, pa.int32()), *lists, pa.array(shown, pa.string())], ["mains", "titles", "headings", "stamps", "shown"])


def provenance(html: Column) -> Column:
    """(mains, title, heading, day, kind, reason, conflict) of a landing page: h1, h2 and date inside its only main element.

    Titles may differ in case only; dates that disagree or that no calendar has, and any other number of main elements,
    are a reason. Null pages have no main element. Only these parts leave the reader of a page, not its nodes."""

    def folded(s: Column) -> Column:
        each = lambda name: F.transform(s[name], T.fold_space).alias(name)
        return F.struct(s["mains"].alias("mains"), each("titles"), each("headings"), _days(s["stamps"], s["shown"]).alias("dates"))

    def shaped(j: Column) -> Column:
        (title, one), (heading, two) = _title(j["titles"], "landing h1 titles"), _title(j["headings"], "landing h2 titles")
        single = lambda c: F.when(j["mains"] == 1, c)
        reason = F.when(j["mains"] != 1, F.lit("landing must contain exactly one main element")).otherwise(F.coalesce(one, two, j["dates"]["reason"]))
        own = [single(c).alias(name) for name, c in (("title", title), ("heading", heading), ("day", j["dates"]["day"]), ("kind", j["dates"]["kind"]))]
        return F.struct(j["mains"].alias("mains"), *own, reason.alias("reason"))

    judged = lambda p: F.struct(*[p[c].alias(c) for c in ("mains", "title", "heading", "day", "kind", "reason")], p["reason"].isNotNull().alias("conflict"))
    return T.let(T.let(T.let(F.arrow_udf(_scopes, _SCOPE)(html), folded), shaped), judged)


def _cards_of(html: pa.Array, picked: pa.Array, most: int) -> tuple[pa.Array, list[pa.Array]]:
    places, node, href, title, scopes = [], [], [], [], []
    for place, (markup, own) in enumerate(zip(html.to_pylist(), picked.to_pylist(), strict=True)):
        page = N.read(markup or "")
        for at, before, after, text in zip(own, [-1, *own][:-1], [*own, len(page.tag)][1:], N.texts_between(page, own), strict=True):
            if page.tag[at] != "a" or "href" not in page.attributes[at]:
                continue
            elements = N.around(page, at, most)
            mains = next((k for k, e in enumerate(elements) if page.tag[e] == "main"), len(elements))
            alone = [e for e in elements[:mains] if before <= e and page.last[e] < after]
            places.append(place)
            node.append(at)
            href.append(page.attributes[at]["href"])
            title.append(text)
            scopes.append([{"stamps": N.stamps(page, e + 1, page.last[e]), "shown": N.shown(page, e + 1, page.last[e], page.margin[e])} for e in alone])
    kind = pa.list_(pa.struct([("stamps", pa.list_(pa.string())), ("shown", pa.string())]))
    return pa.array(places, pa.int64()), [pa.array(node, pa.int32()), pa.array(href, pa.string()), pa.array(title, pa.string()), pa.array(scopes, kind)]


def cards(pages: DataFrame, page_cols: list[str], selector: str, url_col: str = "url", html_col: str = "html", most: int = 4) -> DataFrame:
    """page_cols, node, href, title, day, kind and reason of each anchor that a selector picks: the date of the nearest card around it.

    Of the `most` elements around an anchor, up to a main element, those that hold no other picked anchor are its cards;
    the nearest with a date gives it, or the reason why its dates don't count."""
    own = stored(pages.select(*page_cols, url_col, html_col), "pages")
    picked = N.select(N.node_rows(own.select(*page_cols, html_col), html_col), page_cols, selector).where("selected").groupBy(*page_cols).agg(F.sort_array(F.collect_list("pre")).alias("_picked"))
    picked = picked.select(*[F.col(c).alias(f"_k_{c}") for c in page_cols], "_picked")
    rows = own.join(picked, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in page_cols])
    rows = rows.select(*page_cols, F.col(url_col).alias("_url"), F.struct(html_col, "_picked").alias("_page"))
    found = N.each_page(rows, "_page", lambda page: _cards_of(*page.flatten(), most), "node int, href string, title string, scopes array<struct<stamps: array<string>, shown: string>>")
    dates = F.filter(F.transform("scopes", lambda s: _days(s["stamps"], s["shown"])), lambda d: d["day"].isNotNull() | d["reason"].isNotNull())
    out = found.select(*page_cols, F.col("_url").alias(url_col), "node", F.trim("href").alias("href"), T.fold_space(F.col("title")).alias("title"), F.get(dates, F.lit(0)).alias("_d"))
    return out.select(*page_cols, url_col, "node", "href", "title", "_d.day", "_d.kind", "_d.reason")


def collected(cards_: DataFrame, hosts: list[str], path_pattern: str, url_col: str = "url") -> DataFrame:
    """(landing, pos, title, day, kind, reason): the confined landings of a collection, each once, at the place of its first card.

    Titles that differ beyond case, and days or kinds of dates that differ, are a reason, as is that of a card."""
    rows = cards_.withColumn("landing", network.confined(F.col(url_col), F.col("href"), hosts, path_pattern)).where("landing is not null")
    own = rows.groupBy("landing").agg(
        F.min("node").alias("pos"), F.min(F.when(F.col("title") != "", F.struct("node", "title"))).alias("_t"), F.count_distinct(F.when(F.col("title") != "", F.lower("title"))).alias("_titles"),
        F.min("day").alias("day"), F.count_distinct("day").alias("_days"), F.min("kind").alias("kind"), F.count_distinct("kind").alias("_kinds"), F.min(F.when(F.col("reason").isNotNull(), F.struct("node", "reason"))).alias("_r"),
    )
    several = F.when(F.col("_titles") > 1, "conflicting collection titles").when(F.col("_days") > 1, "conflicting collection dates").when(F.col("_kinds") > 1, "conflicting collection date sources")
    return own.select("landing", "pos", F.col("_t.title").alias("title"), "day", "kind", F.coalesce("_r.reason", several).alias("reason"))


def confirm_landings(collection: DataFrame, landings: DataFrame) -> DataFrame:
    """(landing, title, title_source, day, day_source, reason) of the landings that a collection names.

    A title or day of the collection must be that of the landing's h1 or h2 (in any case) or date; what the collection
    lacks comes from the landing. collection: landing, title, day, and kind and reason if it has them."""
    own = {c: F.col(c) if c in collection.columns else F.lit(None).cast("string") for c in ("kind", "reason")}
    cards_ = collection.select("landing", F.col("title").alias("_title"), F.col("day").alias("_day"), own["kind"].alias("_kind"), own["reason"].alias("_reason"))
    N.small_batches(landings.sparkSession)
    read = landings.select("landing", F.inline(F.array(F.struct(provenance(F.col("html")).alias("p")))))  # worked out once a page
    rows = cards_.join(read, "landing")
    titled, dated = F.coalesce(F.col("_title"), F.lit("")) != "", F.col("_day").isNotNull()
    agrees = F.coalesce(F.lower("_title") == F.lower("p.title"), F.lit(False)) | F.coalesce(F.lower("_title") == F.lower("p.heading"), F.lit(False))
    reason = F.coalesce(
        "_reason", "p.reason",
        F.when(titled & F.coalesce("p.title", "p.heading").isNull(), "missing landing title confirmation").when(titled & ~agrees, "title conflict between collection and landing"),
        F.when(~titled & F.coalesce("p.title", "p.heading").isNull(), "missing title provenance"),
        F.when(dated & F.col("p.day").isNull(), "missing landing publication date confirmation").when(dated & (F.col("_day") != F.col("p.day")), "publication date conflict between collection and landing"),
        F.when(~dated & F.col("p.day").isNull(), "missing publication date provenance"),
    )
    source = F.when(titled, "collection_anchor+landing_confirmed").when(F.col("p.title").isNotNull(), "landing_main_h1").when(F.col("p.heading").isNotNull(), "landing_main_h2")
    card = F.when(F.col("_kind") == "time", "collection_card_time+landing_confirmed").otherwise("collection_card_text+landing_confirmed")
    day_source = F.when(dated, card).otherwise(F.concat(F.lit("landing_main_"), "p.kind"))
    return rows.select("landing", F.when(titled, F.col("_title")).otherwise(F.coalesce("p.title", "p.heading")).alias("title"), source.alias("title_source"), F.coalesce("_day", "p.day").alias("day"), day_source.alias("day_source"), reason.alias("reason"))


def confirm_documents(collection: DataFrame, landings: DataFrame, bodies: DataFrame, hosts: list[str], path_pattern: str, selector: str = "a[href]") -> DataFrame:
    """Collection -> landing -> PDF: (landing, document, title, day) of the first confirmed PDF of each landing, a document for one landing only.

    collection: as in confirm_landings; landings: landing, html; bodies: url, content_type, head (first bytes)."""
    agreed = confirm_landings(collection, landings).where("reason is null")
    links = selected_anchors(landings.select("landing", "html"), ["landing"], selector, "landing", "html").join(agreed, "landing")
    links = links.withColumn("url", network.confined(F.col("landing"), F.col("href"), hosts, path_pattern)).where("url is not null")
    pdf = links.join(bodies, "url").where(network.looks_like_pdf(F.col("content_type"), F.col("head"), F.col("url")))
    first = F.row_number().over(W.partitionBy("landing").orderBy("pos"))
    once = F.row_number().over(W.partitionBy("url").orderBy("landing"))
    rows = pdf.withColumn("n", first).where("n = 1").withColumn("n", once).where("n = 1")
    return rows.select("landing", F.col("url").alias("document"), "title", "day")
