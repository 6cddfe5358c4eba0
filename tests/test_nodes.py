"""Node tables and selectors against a walk over the tree that the standard parser gives."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from ravelin.sources import nodes, pages

VOID = set("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    def __init__(self, tag, attributes, parent):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        if parent:
            parent.children.append(self)

    def walk(self):
        for c in self.children:
            yield c
            if isinstance(c, Element):
                yield from c.walk()


class Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.here = Element("[document]", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        if tag not in VOID:
            self.here = e

    def handle_startendtag(self, tag, attrs):
        Element(tag, {k: v or "" for k, v in attrs}, self.here)

    def handle_endtag(self, tag):
        e = self.here
        while e.parent and e.tag != tag:
            e = e.parent
        if e.parent:
            self.here = e.parent

    def handle_data(self, data):
        if data.strip():
            if self.here.children and isinstance(self.here.children[-1], str) and self.here.tag not in ("script", "style"):
                self.here.children[-1] += data
            else:
                self.here.children.append(data)


def tree(html):
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


def shape(e, depth=0):
    out = []
    for c in e.children:
        if isinstance(c, str):
            out.append((depth, "#raw" if e.tag in ("script", "style") else "#text", {}, " ".join(c.split())))
        else:
            out += [(depth, c.tag, c.attributes, None), *shape(c, depth + 1)]
    return out


def made(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        k = rng.random()
        if k < 0.3 or depth > 4:
            out.append(rng.choice(["some text", " two  words ", "a &amp; b", "x &#38; y", "&lt;i&gt;"]))
        elif k < 0.38:
            out.append(rng.choice(["<br>", "<img src='a.png'/>", "<!-- no <b> here -->", "<hr class=x>", "<script>if (a < b) {'</p>'}</script>"]))
        else:
            tag = rng.choice(["div", "p", "a", "ul", "li", "section", "main", "nav", "h1", "SPAN"])
            attributes = rng.choice(["", ' class="card"', ' class="x card  y"', ' id=one', ' href="/a?b=1&amp;c=2"', ' title="1 > 0" href=\'/y\'', ' data-k="en-us" lang=en-US', ' class="card" data-k=en'])
            out.append(f"<{tag}{attributes}>" + "".join(made(rng, depth + 1)) + (f"</{tag}>" if rng.random() < 0.9 else ""))
    return out


@pytest.fixture(scope="module")
def made_pages(spark):
    rng = random.Random(11)
    data = [(k, "https://s.example/x/", "".join(made(rng))) for k in range(120)] + [(900, "u", None), (901, "u", ""), (902, "u", "no markup"), (None, "u", "<p class=card><a href=q>null key</a></p>")]
    return data, spark.createDataFrame(data, "id int, url string, html string").repartition(3).persist()


def test_nodes_are_the_tree(spark, made_pages):
    data, df = made_pages
    found = {r["id"]: r["n"] for r in df.select("id", nodes.nodes("html").alias("n")).collect()}
    for i, _, html in data:
        if html is None:
            assert found[i] is None
            continue
        n = found[i]
        assert [(x["depth"], x["tag"], x["attributes"], x["text"] if x["text"] is None else " ".join(x["text"].split())) for x in n] == shape(tree(html)), html
        for k, x in enumerate(n):
            assert x["pre"] == k and (x["parent"] == -1) == (x["depth"] == 0)
            assert x["parent"] == -1 or n[x["parent"]]["pre"] < k <= n[x["parent"]]["last"]
            assert x["last"] == max([k] + [y["pre"] for y in n[k + 1 :] if all(z["depth"] > x["depth"] for z in n[k + 1 : y["pre"] + 1])])


def fits(e, compound):
    for m in re.finditer(r"(^[\w*]+)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:(.?=)[\"']?([^\"'\]]*)[\"']?)?\]", compound):
        tag, id_, part, name, how, v = m.groups()
        value = e.attributes.get(name) if name else None
        ok = {
            None: lambda: value is not None, "=": lambda: value == v, "^=": lambda: value.startswith(v), "$=": lambda: value.endswith(v), "*=": lambda: v in value,
            "~=": lambda: v in value.split(), "|=": lambda: value == v or value.startswith(v + "-"),
        }
        if tag and tag != "*" and e.tag != tag.lower() or id_ and e.attributes.get("id") != id_ or part and part not in e.attributes.get("class", "").split() or name and (value is None or not ok[how]()):
            return False
    return True


def picks(root, selector):
    out = set()
    for alternative in selector.split(","):
        parts = alternative.replace(">", " > ").split()

        def holds(e, at, parts=parts):
            if not fits(e, parts[at]):
                return False
            if at == 0:
                return True
            if parts[at - 1] == ">":
                return e.parent.parent is not None and holds(e.parent, at - 2)
            up = e.parent
            while up.parent:
                if holds(up, at - 1):
                    return True
                up = up.parent
            return False

        out |= {id(e) for e in root.walk() if isinstance(e, Element) and holds(e, len(parts) - 1)}
    return out


SELECTORS = ["a", "*", "div a", "div > a", ".card", "p.card a[href]", "[data-k|=en]", "[data-k='en-us']", "a[href^='/a']", "[href$=\"2\"]", "a[title*='1'], #one", "section div > ul li", "[class~=y] > *", "div div div", "main > p , nav > *", "span.card > a , div.card"]


@pytest.mark.parametrize("selector", SELECTORS)
def test_selectors_pick_as_a_walk_does(spark, made_pages, selector):
    data, df = made_pages
    out = nodes.select(nodes.node_rows(df), ["id"], selector)
    found = {(r["id"], r["pre"]) for r in out.where("selected").select("id", "pre").collect()}
    want = set()
    for i, _, html in data:
        root = tree(html or "")
        chosen = picks(root, selector)
        want |= {(i, k) for k, e in enumerate(root.walk()) if id(e) in chosen}
    assert found == want and out.count() == sum(len(list(tree(h or "").walk())) for _, _, h in data)


@pytest.mark.parametrize("selector", ["", " ", "> a", "a,", "a[", "a:not(b)", "a + b", "a ~ b", "[x=]", "a >", "..x"])
def test_other_selectors_raise(selector, spark):
    with pytest.raises(ValueError):
        nodes.steps(selector)


def test_anchors(spark, made_pages):
    data, df = made_pages
    found = sorted((r["id"] is None, r["id"], r["pos"], r["href"]) for r in pages.anchors(df).collect())
    want = []
    for i, _, html in data:
        own = [e for e in tree(html or "").walk() if isinstance(e, Element) and e.tag == "a" and "href" in e.attributes]
        want += [(i is None, i, k, e.attributes["href"].strip()) for k, e in enumerate(own)]
    assert found == sorted(want)


def test_hard_anchors(spark):
    one = lambda html: [(r["href"], r["link_text"], r["absolute"]) for r in pages.anchors(spark.createDataFrame([("https://s.example/d/i", html)], "url string, html string")).orderBy("pos").collect()]
    assert one('<a title="1 > 0" href="/y">Y</a>') == [("/y", "Y", "https://s.example/y")]
    assert one("<a href='?a=1&#38;b=&lt;'>t &amp; <b>u</b></a>") == [("?a=1&b=<", "t & u", "https://s.example/d/i?a=1&b=<")]
    assert one("<a name=x>no link</a><a href=>empty</a><A HREF=z>") == [("", "empty", "https://s.example/d/i"), ("z", "", "https://s.example/d/z")]
    assert one('<!-- <a href="no">no</a> --><script>"<a href=no>"</script><a href="yes">yes') == [("yes", "yes", "https://s.example/d/yes")]
    assert one('<a href="unclosed>x</a> <p>y') == [("unclosed", "x", "https://s.example/d/unclosed")]


@pytest.mark.parametrize("piece", ["<a ", "<a href=x>", "<", "</", "<!--", "<a '", '<a b="', "&", "<div>", "</p", "<script>", "<nav>t", "<li><b>", "a='", "<!", "< a", "<a/"])
def test_pages_of_one_piece_take_linear_time(piece):
    began = time.perf_counter()
    page = nodes.read(piece * (2_000_000 // len(piece)))
    assert time.perf_counter() - began < 20
    assert all(x >= k for k, x in enumerate(page.last))


def test_nested_links_and_headings_stay_small(spark):
    html = "<main>" + "<a href=x>word <h1>t " * 20_000
    df = spark.createDataFrame([("https://s.example/", html)], "url string, html string")
    assert pages.anchors(df).agg(F.max(F.length("link_text"))).first()[0] == len("word t")
    p = df.select(pages.provenance(F.col("html")).alias("p")).first()["p"]
    assert p["title"] == "t word" or p["conflict"]


LANDING = "<html><nav>1 de enero de 2020</nav><main>{}</main><h1>outside</h1></html>"


@pytest.mark.parametrize(
    ("inside", "title", "heading", "day", "kind", "reason"),
    [
        ("<h1>One <b>two</b></h1><time datetime=2024-03-04>x</time>", "One two", None, "2024-03-04", "time", None),
        ("<h1> A  b</h1><h1>a B</h1><h2>Sub</h2><p>el 4 de Marzo de 2024</p>", "A b", "Sub", "2024-03-04", "text", None),
        ("<h1>A</h1><h1>B</h1>", "A", None, None, None, "conflicting landing h1 titles"),
        ("<h2>A</h2><h2>B</h2>", None, "A", None, None, "conflicting landing h2 titles"),
        ("<h1></h1><h1>A</h1><footer>4 de marzo de 2024</footer><nav>5 de marzo de 2024</nav><script>'6 de marzo de 2024'</script>", "A", None, None, None, None),
        ("<time datetime='2024-03-04T23:00:00-05:00'></time><time datetime='2024-03-04'></time>4 de <b>marzo</b> de 2024", None, None, "2024-03-04", "time", None),
        ("<time datetime='2024-03-04'></time><time datetime='2024-03-05'></time>", None, None, "2024-03-04", "time", "conflicting datetime values"),
        ("<time datetime='yesterday'></time>", None, None, None, None, "malformed datetime"),
        ("<time>no value</time>4 de marzo de 2024 y 5 de marzo de 2024", None, None, "2024-03-04", "text", "conflicting visible dates"),
        ("31 de febrero de 2024", None, None, None, None, "malformed visible date"),
        ("<time datetime='2024-03-04'></time>5 de marzo de 2024", None, None, "2024-03-04", "time", "conflicting time and visible dates"),
        ("x</main><main>y", None, None, None, None, "landing must contain exactly one main element"),
    ],
)
def test_provenance(spark, inside, title, heading, day, kind, reason):
    p = spark.createDataFrame([(LANDING.format(inside),)], "html string").select(pages.provenance(F.col("html")).alias("p")).first()["p"]
    assert p["reason"] == reason and p["conflict"] == (reason is not None)
    if reason is None or p["mains"] == 1 and "landing h" in reason:
        assert (p["title"], p["heading"], str(p["day"]) if p["day"] else None, p["kind"]) == (title, heading, day, kind)


def test_provenance_of_nothing(spark):
    rows = spark.createDataFrame([(None,), ("",)], "html string").select(pages.provenance(F.col("html")).alias("p")).collect()
    assert all(r["p"]["mains"] == 0 and r["p"]["conflict"] for r in rows)


def test_cards(spark):
    html = """<main><div id=list>
      <article><time datetime="2024-01-02">x</time><h3><a class=t href="/l/1">One</a></h3><a href="/other">o</a></article>
      <article><p><span><b><i><a class=t href="/l/2">Two</a></i></b></span></p> 3 de enero de 2024</article>
      <article>4 de enero de 2024 <a class=t href="/l/3">Three</a> <a class=t href="/l/4">Four</a></article>
      <article>5 de enero de 2024 <time datetime="2024-01-06"></time><a class=t href="/l/5">Five</a></article>
      <li>7 de enero de 2024 <a class=t href="/l/6"></a><a class=t href="/l/6">Six</a></li>
      <article>8 de enero de 2024 <ul><li><a class=t href="/l/7">Seven</a></li></ul></article><a class=t href="/l/7">SEVEN</a><span class=t>no link</span>
      <article><nav>1 de enero de 2020</nav>9 de enero de 2024 <a class=t href="https://elsewhere.example/l/8">Eight</a></article></div></main>"""
    pages_ = spark.createDataFrame([(1, "https://s.example/", html), (2, "https://s.example/", None)], "id int, url string, html string")
    found = {r["href"] + r["title"]: (str(r["day"]) if r["day"] else None, r["kind"], r["reason"]) for r in pages.cards(pages_, ["id"], "a.t, span.t").collect()}
    assert found == {
        "/l/1One": ("2024-01-02", "time", None), "/l/2Two": (None, None, None), "/l/3Three": (None, None, None), "/l/4Four": (None, None, None), "/l/5Five": ("2024-01-06", "time", "conflicting time and visible dates"),
        "/l/6": (None, None, None), "/l/6Six": (None, None, None), "/l/7Seven": ("2024-01-08", "text", None), "/l/7SEVEN": (None, None, None), "https://elsewhere.example/l/8Eight": ("2024-01-09", "text", None),
    }
    own = {r["landing"]: (r["title"], str(r["day"]) if r["day"] else None, r["reason"]) for r in pages.collected(pages.cards(pages_, ["id"], "a.t"), ["s.example"], "^/l/").collect()}
    assert own["https://s.example/l/6"] == ("Six", None, None) and own["https://s.example/l/7"] == ("Seven", "2024-01-08", None) and "https://elsewhere.example/l/8" not in own
    assert own["https://s.example/l/5"][2] == "conflicting time and visible dates"


def test_landings_are_held_against_their_cards(spark):
    page = lambda h, day: f"<main>{h}<time datetime={day}></time></main>"
    landings = spark.createDataFrame([("a", page("<h1>Title</h1>", "2024-01-02")), ("b", page("<h1>x</h1><h2>TITLE</h2>", "2024-01-02")), ("c", "<main><h1>Title</h1></main>"), ("d", page("", "2024-01-02"))], "landing string, html string")
    rows = [("a", "title", "2024-01-02"), ("a", "other", None), ("a", None, "2024-01-03"), ("a", "", None), ("b", "Title", None), ("b", "", None), ("c", "Title", "2024-01-02"), ("c", "Title", None), ("d", "Title", None), ("d", None, None), ("none", "Title", None)]
    cards = spark.createDataFrame(rows, "landing string, title string, day string").withColumn("day", F.to_date("day"))
    found = sorted((r["landing"], r["title"] or "", r["title_source"] or "", str(r["day"]), r["day_source"] or "", r["reason"] or "") for r in pages.confirm_landings(cards, landings).collect())
    assert found == sorted([
        ("a", "title", "collection_anchor+landing_confirmed", "2024-01-02", "collection_card_text+landing_confirmed", ""), ("a", "other", "collection_anchor+landing_confirmed", "2024-01-02", "landing_main_time", "title conflict between collection and landing"),
        ("a", "Title", "landing_main_h1", "2024-01-03", "collection_card_text+landing_confirmed", "publication date conflict between collection and landing"), ("a", "Title", "landing_main_h1", "2024-01-02", "landing_main_time", ""),
        ("b", "Title", "collection_anchor+landing_confirmed", "2024-01-02", "landing_main_time", ""), ("b", "x", "landing_main_h1", "2024-01-02", "landing_main_time", ""),
        ("c", "Title", "collection_anchor+landing_confirmed", "2024-01-02", "collection_card_text+landing_confirmed", "missing landing publication date confirmation"),
        ("c", "Title", "collection_anchor+landing_confirmed", "None", "", "missing publication date provenance"), ("d", "Title", "collection_anchor+landing_confirmed", "2024-01-02", "landing_main_time", "missing landing title confirmation"),
        ("d", "", "", "2024-01-02", "landing_main_time", "missing title provenance"),
    ])


FEEDS = {
    "amp": "<rss version='2.0'><channel><title>c</title><item><title>A &amp; b</title><link>https://x.example/?a=1&amp;b=2</link></item></channel></rss>",
    "self": "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title type='html'>T &lt;b&gt;</title><link rel='self' href='https://x.example/self'/><link rel='alternate' type='text/html' href='https://x.example/page'/><updated>2024</updated></entry></feed>",
    "pdf": "<rss xmlns:a='http://www.w3.org/2005/Atom'><channel><item><title>P</title><link>https://x.example/page</link><enclosure url='https://x.example/f.PDF?x=1' type='Application/pdf' length='1'/></item></channel></rss>",
    "link": "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>L</title><link href='https://x.example/page'/><link rel='related' href='https://x.example/r.pdf' type='application/pdf'/></entry></feed>",
    "rdf": "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' xmlns:dc='d'><channel><title>c</title></channel><item><title>R</title><link>https://x.example/r</link><dc:date>2024-05-06</dc:date></item></rdf:RDF>",
    "guid": "<rss><channel><item><title>G</title><guid>https://x.example/g</guid></item><item><title>no</title><guid isPermaLink='false'>https://x.example/h</guid></item></channel></rss>",
    "cdata": "<?xml version='1.0' encoding='utf-8'?>\n<rss><channel><item><title><![CDATA[A & b]]></title><link> https://x.example/c </link><pubDate>Mon</pubDate></item></channel></rss>",
    "prefix": "<atom:feed xmlns:atom='http://www.w3.org/2005/Atom'><atom:entry><atom:title>N</atom:title><atom:link href='https://x.example/n'/></atom:entry></atom:feed>",
    "broken": "<rss><channel><item><title>B & c &nbsp;</title><link>https://x.example/?a=1&b=2</link></item><item><title>cut off",
    "none": "<rss><channel><title>x</title></channel></rss>",
    "text": "no feed at all",
    "empty": "",
    "null": None,
}


def test_feeds_as_they_come(spark):
    bodies = spark.createDataFrame([(k, v) for k, v in FEEDS.items()], "name string, xml string")
    found = {(r["name"], r["title"], r["link"], r["published"]) for r in pages.feed_entries(bodies).collect()}
    assert found == {
        ("amp", "A & b", "https://x.example/?a=1&b=2", None), ("self", "T <b>", "https://x.example/page", "2024"), ("pdf", "P", "https://x.example/f.PDF?x=1", None), ("link", "L", "https://x.example/r.pdf", None),
        ("rdf", "R", "https://x.example/r", "2024-05-06"), ("guid", "G", "https://x.example/g", None), ("cdata", "A & b", "https://x.example/c", "Mon"), ("prefix", "N", "https://x.example/n", None),
        ("broken", "B & c &nbsp;", "https://x.example/?a=1&b=2", None),
    }
    health = {r["name"]: (r["entries"], r["error"]) for r in pages.feed_health(bodies).collect()}
    assert health["none"] == (0, "no entries") and health["text"] == health["empty"] == health["null"] == (0, "no feed") and health["broken"][0] == 1 and health["guid"] == (2, None)


def test_a_batch_of_pages_is_read_in_small_pieces(spark):
    """Pages of 100 kB each: what leaves the reader at once stays near a megabyte of markup, however many rows a batch has."""
    html = "<main><h1>T</h1>" + "<p>x <a href='/l'>y</a>" * 5_000 + "</main>"
    df = spark.range(40, numPartitions=1).select("id", F.lit(html).alias("html"), F.lit("https://s.example/").alias("url"))
    def of(markup):
        import pyarrow as pa

        return pa.array(range(len(markup)), pa.int64()), [pa.array([len(markup)] * len(markup), pa.int32())]

    sizes = {r["n"] for r in nodes.each_page(df, "html", of, "n int").collect()}
    assert max(sizes) * len(html) <= nodes.PIECE_BYTES + len(html)
    assert pages.anchors(df).count() == 200_000 and nodes.node_rows(df.limit(2)).count() == 2 * (3 + 5_000 * 4)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= nodes.BATCH_ROWS
