"""Pages as nodes: a row for each element and text of a page, and what selectors pick from them.

A page's nodes stand in document order. `pre` is a node's place there, `last` the place of the last node inside it (its own
if there is none), so a node lies in another if its pre is within the other's pre + 1 .. last."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and whose text no reader sees.
RAW = frozenset(("script", "style"))
#: Tags of nodes that are no elements.
TEXT, HIDDEN = "#text", "#raw"

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)\s*(=)?\s*")
_BARE = re.compile(r"[^\s>]*")
#: What a page repeats around its content; `margin` counts the elements of these around a node.
MARGINS = ("nav", "footer")
#: Rows of an Arrow batch of pages, and the bytes of markup whose nodes are held as Python values at once.
BATCH_ROWS, PIECE_BYTES = 500, 1 << 20
NODE = "array<struct<pre: int, last: int, parent: int, depth: int, margin: int, tag: string, attributes: map<string, string>, text: string>>"


@dataclass
class Page:
    """The nodes of one page while it is read from left to right, each character once or twice."""

    last: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    margin: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    open: list[int] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    pending: list[str] = field(default_factory=list)

    def add(self, tag: str, attributes: dict[str, str], text: str | None) -> int:
        self.last.append(len(self.tag))
        self.parent.append(self.open[-1] if self.open else -1)
        self.depth.append(len(self.open))
        self.margin.append(sum(self.counts.get(m, 0) for m in MARGINS))
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        return len(self.tag) - 1

    def flush(self, tag: str = TEXT) -> None:
        text = "".join(self.pending)
        self.pending.clear()
        if text.strip():
            self.add(tag, {}, text if tag == HIDDEN else unescape(text))

    def begin(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        self.flush()
        at = self.add(tag, attributes, None)
        if not closed and tag not in VOID:
            self.open.append(at)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        """Ends the innermost open element of the tag and all inside it; an end without a beginning is nothing."""
        self.flush()
        while self.counts.get(tag):
            at = self.open.pop()
            self.last[at] = len(self.tag) - 1
            self.counts[self.tag[at]] -= 1
            if self.tag[at] == tag:
                return

    def close(self) -> None:
        self.flush()
        for at in self.open:
            self.last[at] = len(self.tag) - 1


def _attributes(html: str, at: int, quotes: dict[str, int]) -> tuple[dict[str, str], int, bool]:
    """Attributes from a place after a tag's name, the place after its >, and whether it ends in />. A quote that is never closed ends at the next blank or >."""
    found: dict[str, str] = {}
    while at < len(html):
        m = _ATTRIBUTE.match(html, at)
        if not m:
            stop = html.find(">", at)
            return found, len(html) if stop < 0 else stop + 1, html[at : max(stop, at)].strip().endswith("/")
        name, at, value = m[1].lower(), m.end(), ""
        if m[2]:
            quote = html[at : at + 1]
            if quote in quotes and quotes[quote] > at:
                stop = html.index(quote, at + 1)
                value, at = html[at + 1 : stop], stop + 1
            else:
                at += quote in quotes
                value = _BARE.match(html, at)[0]
                at += len(value)
        found[name] = unescape(value)
    return found, at, False


def read(html: str) -> Page:
    """Markup of any kind as a tree: void elements hold nothing, unclosed ones end with what holds them, a tag that the text breaks off is left out."""
    page, at, n = Page(), 0, len(html)
    quotes = {q: html.rfind(q) for q in "\"'"}
    last_bracket, last_comment = html.rfind(">"), html.rfind("-->")
    while at < n:
        tag = html.find("<", at)
        if tag < 0:
            tag = n
        page.pending.append(html[at:tag])
        if tag >= n:
            break
        at, kind = tag + 1, html[tag + 1 : tag + 2]
        if html.startswith("!--", at):
            page.flush()
            at = html.index("-->", tag + 2) + 3 if last_comment >= tag + 2 else n
        elif kind and kind in "!?/" and at + 1 < n:
            if kind == "/" and (m := _NAME.match(html, at + 1)):
                page.end(m[0].lower())
            at = html.index(">", at) + 1 if last_bracket > at else n
        elif m := _NAME.match(html, at):
            name = m[0].lower()
            attributes, at, closed = _attributes(html, m.end(), quotes)
            if at >= n and not html.endswith(">"):
                break
            page.begin(name, attributes, closed)
            if name in RAW and not closed:
                stop = re.compile(rf"</{name}(?=[\s/>]|$)", re.I).search(html, at)
                page.pending.append(html[at : stop.start() if stop else n])
                page.flush(HIDDEN)
                at = stop.start() if stop else n
        else:
            page.pending.append("<")
    page.close()
    return page


def _listed(html: pa.Array) -> pa.Array:
    pages = [None if h is None else read(h) for h in html.to_pylist()]
    own = [p for p in pages if p]
    ints = lambda name: pa.array([x for p in own for x in getattr(p, name)], pa.int32())
    maps = pa.array([list(a.items()) for p in own for a in p.attributes], pa.map_(pa.string(), pa.string()))
    pre = pa.array(np.concatenate([np.zeros(0, np.int32), *[np.arange(len(p.tag), dtype=np.int32) for p in own]]))
    strings = [pa.array([x for p in own for x in getattr(p, name)], pa.string()) for name in ("tag", "text")]
    rows = pa.StructArray.from_arrays([pre, ints("last"), ints("parent"), ints("depth"), ints("margin"), strings[0], maps, strings[1]], ["pre", "last", "parent", "depth", "margin", "tag", "attributes", "text"])
    sizes = [None if p is None else len(p.tag) for p in pages]
    cuts = np.concatenate([[0], np.cumsum([s or 0 for s in sizes])])
    offsets = pa.array(cuts.astype(np.int32), mask=np.array([s is None for s in sizes] + [False]))
    return pa.ListArray.from_arrays(offsets, rows)


def nodes(html: Column | str) -> Column:
    """The nodes of a page in document order; null for null, none for an empty text.

    Characters are decoded, tags and names of attributes in lower case, the last of repeated attributes counts. Texts of
    white space alone are left out; what scripts and styles hold has the tag #raw."""
    return F.arrow_udf(_listed, NODE)(html)


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches at BATCH_ROWS rows at most, as rows are whole pages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def each_page(pages: DataFrame, html_col: str, of: Callable[[pa.Array], tuple[pa.Array, list[pa.Array]]], fields: str) -> DataFrame:
    """The other columns of pages with the fields of the rows that `of` gives for an array of markup: their places in it, and a column for each field.

    Pages are read in pieces of PIECE_BYTES, a larger page alone, so memory doesn't grow with the rows of a batch.
    html_col may hold structs whose first field is the markup."""
    small_batches(pages.sparkSession)
    others = [c for c in pages.columns if c != html_col]
    kinds = StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            markup = batch.column(0)
            sizes = pc.fill_null(pc.binary_length(markup.field(0) if pa.types.is_struct(markup.type) else markup), 0).to_pylist()
            start = total = 0
            for k, size in enumerate([*sizes, None]):
                if k > start and (size is None or total + size > PIECE_BYTES):
                    piece = batch.slice(start, k - start)
                    places, columns = of(piece.column(0))
                    yield pa.RecordBatch.from_arrays([*(c.take(places) for c in piece.columns[1:]), *columns], names=[*others, *kinds.names])
                    start, total = k, 0
                total += size or 0

    schema = StructType([pages.schema[c] for c in others] + kinds.fields)
    return pages.select(html_col, *others).mapInArrow(run, schema)


def node_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The other columns of pages with pre, last, parent, depth, margin, tag, attributes and text of each node."""

    def of(html: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
        found = _listed(html)
        return pc.list_parent_indices(found), found.flatten().flatten()

    return each_page(pages, html_col, of, NODE.removeprefix("array<struct<").removesuffix(">>"))


def texts_between(page: Page, own: list[int]) -> list[str]:
    """The texts of nodes of one kind, in order, each piece set off by a blank; a text ends where the next node of its kind begins, so unclosed ones cost no more than the page."""
    ends = [min(page.last[at], after - 1) for at, after in zip(own, [*own, len(page.tag)][1:], strict=True)]
    return [shown(page, at + 1, end) for at, end in zip(own, ends, strict=True)]


def shown(page: Page, start: int, end: int, margin: int | None = None) -> str:
    """The texts of the nodes from a place to another, outside margins beyond so many."""
    return " ".join(page.text[k] for k in range(start, end + 1) if page.tag[k] == TEXT and (margin is None or page.margin[k] <= margin))


def stamps(page: Page, start: int, end: int) -> list[str]:
    """The datetime values of the time elements from a place to another."""
    return [page.attributes[k]["datetime"] for k in range(start, end + 1) if page.tag[k] == "time" and "datetime" in page.attributes[k]]


def around(page: Page, at: int, most: int) -> list[int]:
    """Up to `most` elements around a node, the nearest first."""
    out: list[int] = []
    while len(out) < most and (at := page.parent[at]) >= 0:
        out.append(at)
    return out


def inside(page: Column, node: Column) -> Column:
    """The nodes inside a node, in order."""
    return F.slice(page, node["pre"] + 2, node["last"] - node["pre"])


def text_of(found: Column) -> Column:
    """What a reader sees of nodes: their texts, with one blank between words."""
    return T.fold_space(F.array_join(F.transform(F.filter(found, lambda n: n["tag"] == TEXT), lambda n: n["text"]), " "))


_COMPOUND = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<part>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\s\]"']+))\s*)?\]""")


def _step(shape: str, start: int) -> tuple[Column, int]:
    """The test of one compound selector (tag, #id, .class, [attribute]) and where it ends."""
    tests, at = [~F.col("tag").isin(TEXT, HIDDEN)], start
    value = lambda name: F.try_element_at("attributes", F.lit(name))
    words = lambda name: F.split(F.trim(F.regexp_replace(F.coalesce(value(name), F.lit("")), r"\s+", " ")), " ")
    while (m := _COMPOUND.match(shape, at)) and (at == start or not m["tag"]):
        at = m.end()
        if m["tag"]:
            tests += [F.col("tag") == m["tag"].lower()] if m["tag"] != "*" else []
        elif m["id"]:
            tests.append(value("id") == m["id"])
        elif m["part"]:
            tests.append(F.array_contains(words("class"), m["part"]))
        else:
            name, v = m["name"].lower(), next((m[k] for k in ("v1", "v2", "v3") if m[k] is not None), None)
            has = value(name).isNotNull()
            how = {
                "=": lambda: value(name) == v, "~=": lambda: F.array_contains(words(name), v), "|=": lambda: (value(name) == v) | value(name).startswith(f"{v}-"),
                "^=": lambda: value(name).startswith(v) & F.lit(v != ""), "$=": lambda: value(name).endswith(v) & F.lit(v != ""), "*=": lambda: value(name).contains(v) & F.lit(v != ""),
            }
            tests.append(has & how[m["how"]]() if m["how"] else has)
    if at == start:
        raise ValueError(f"invalid selector '{shape}' at {start}")
    test = tests[0]
    for t in tests[1:]:
        test = test & F.coalesce(t, F.lit(False))
    return test, at


def steps(selector: str) -> list[list[tuple[str, Column]]]:
    """A selector's alternatives, each as (combinator, test): ' ' for a node inside, '>' for a child. Other forms raise ValueError."""
    out, at, shape = [[]], 0, selector.strip()
    how = " "
    while True:
        test, at = _step(shape, at)
        out[-1].append((how, test))
        gap = re.compile(r"\s*([>,])\s*|\s+").match(shape, at)
        if at == len(shape):
            return out
        if not gap:
            raise ValueError(f"invalid selector '{selector}' at {at}")
        at, how = gap.end(), " " if gap[1] in (None, ",") else ">"
        if gap[1] == ",":
            out.append([])


def select(rows: DataFrame, page_cols: list[str], selector: str, out: str = "selected") -> DataFrame:
    """Node rows with a column that tells which of them a selector picks; page_cols tell the pages apart.

    For a node inside another, the largest `last` of the nodes that the earlier part picked before it must reach it, as
    intervals are nested: one ordered pass over a page. A child looks its parent up by page and place."""
    before = Window.partitionBy(*page_cols).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    picked = F.lit(False)
    columns = rows.columns
    for a, alternative in enumerate(steps(selector)):
        flag = f"_m{a}"
        for k, (how, test) in enumerate(alternative):
            if k == 0:
                rows = rows.withColumn(flag, test)
            elif how == " ":
                rows = rows.withColumn(flag, test & F.coalesce(F.max(F.when(F.col(flag), F.col("last"))).over(before) >= F.col("pre"), F.lit(False)))
            else:
                above = rows.where(flag).select(*[F.col(c).alias(f"_p_{c}") for c in page_cols], F.col("pre").alias("_above"))
                on = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in page_cols] + [F.col("parent") == F.col("_above")]
                found = rows.join(above, on, "left")
                rows = found.withColumn(flag, test & F.col("_above").isNotNull()).select(*[c for c in rows.columns if c != flag], flag)
        picked = picked | F.col(flag)
    return rows.withColumn(out, picked).select(*columns, out)


def ancestors(page: Column, node: Column, most: int) -> Column:
    """Up to `most` elements around a node, the nearest first."""
    none = F.array().cast(NODE)

    def climb(acc: Column, _: Column) -> Column:
        at = F.when(F.size(acc) == 0, node["parent"]).otherwise(F.element_at(acc, -1)["parent"])
        return F.when(at >= 0, F.concat(acc, F.array(F.get(page, at)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), none, climb)
