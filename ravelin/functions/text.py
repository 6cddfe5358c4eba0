"""Strings: pattern escapes, folding, defanging, sanitising, truncating."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition without marks is one other character, those characters, and what Latin letters and numbers become that fall into several."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or not unicodedata.decomposition(c):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if len(plain) == 1 and plain != c and c.lower() == c:
            single[c] = plain
        elif len(plain) > 1 and c.lower() == c and (code < 0x370 or 0x1E00 <= code < 0x1F00 or 0x2100 <= code < 0x2190 or 0xFB00 <= code <= 0xFB06):
            several[c] = plain
    return "".join(single), "".join(single.values()), several


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escape(value: Column) -> Column:
    """A value inside a quoted pattern literal: backslashes first, then quotes."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def unescape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\'"), F.lit("'")), F.lit("\\\\"), F.lit("\\"))


def value_of_pattern(pattern: Column) -> Column:
    """The literal of a pattern, unescaped; a pattern without one as it is.

    It is cut out between its quotes in a copy where escaped signs are masked, as patterns with a repeated group recurse."""
    masked = F.replace(F.replace(pattern, F.lit("\\\\"), F.lit("\1\1")), F.lit("\\'"), F.lit("\1\1"))
    start = F.instr(masked, "= '") + 3
    size = F.instr(F.substring(masked, start, F.length(masked)), "'") - 1
    return F.when((start > 3) & (size >= 0), unescape(F.substring(pattern, start, size))).otherwise(pattern)


def fold_space(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold_accents(text: Column) -> Column:
    """Lower case in compatibility form without combining marks (NFKD): by one table of single characters, and one replacement each for the rare ligatures."""
    source, plain, several = _folds()
    text = F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), source, plain)
    parts = text
    for c, new in several.items():
        parts = F.replace(parts, F.lit(c), F.lit(new))
    return F.when(text.rlike("[" + "".join(several) + "]"), parts).otherwise(text)


def quoted(value: Column) -> Column:
    """A pattern that matches a value letter by letter, whatever it holds."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def name_key(name: Column) -> Column:
    """How names are compared: one blank between words, one leading article less, no punctuation at the ends, lower case."""
    bare = F.regexp_replace(fold_space(name), r"(?i)^(?:the|los|las|el|la)\s+", "")
    return F.lower(F.regexp_replace(bare, r"(?U)^[^\w]+|[^\w]+$", ""))


def refang(text: Column) -> Column:
    """Defanged addresses in their usual form; clean text stays as it is, and twice is as once.

    Forms: hxxp(s), [.] (.) {.} [dot] (dot), [at] (at) [@], [:] and [://]."""
    steps = (
        (r"(?i)\bhxxp(s?)", "http$1"),
        (r"(?i)\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?", "."),
        (r"(?i)\s?[\[({]\s?(?:@|at)\s?[\])}]\s?", "@"),
        (r"\[:\]", ":"),
        (r"\[://\]", "://"),
    )
    for pattern, new in steps[:1]:
        text = F.when(text.rlike("(?i)hxxp"), F.regexp_replace(text, pattern, new)).otherwise(text)
    open_ = text.rlike(r"(?i)[\[({]\s?(?:[.@:]|dot|at)")
    out = text
    for pattern, new in steps[1:]:
        out = F.regexp_replace(out, pattern, new)
    return F.when(open_, out).otherwise(text)


def clean(value: Column, most: int = 80) -> Column:
    """Control characters as blanks, cut to a length."""
    return F.substring(F.regexp_replace(value, r"[\x00-\x1f\x7f]", " "), 1, most)


def sanitize_error(message: Column, most: int = 500) -> Column:
    """One line, secrets redacted, cut to a length."""
    hidden = F.regexp_replace(fold_space(message), r"(?i)\b(token|password|authorization)\b(\s*[:=]\s*)(?:bearer\s+)?\S+", "$1$2[redacted]")
    return F.substring(hidden, 1, most)


def truncate_words(text: Column, most: int = 320, keep: int = 300) -> Column:
    """Texts of more than `most` words as their first `keep` words and an ellipsis."""
    words = F.split(fold_space(text), " ")
    return F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, 1, keep), " "), F.lit("..."))).otherwise(text)


def strip_fences(text: Column) -> Column:
    """Text inside a Markdown code fence."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\s*\n?|\n?```\s*$", ""))


def sections(text: Column) -> Column:
    """Paragraphs: parts between blank lines that aren't blank."""
    return F.filter(F.split(text, r"\n\s*\n+"), lambda s: F.trim(s) != "")


def line_at(text: Column, at: Column) -> Column:
    """The line around a 0-based place."""
    before = F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)
    return F.concat(before, F.substring_index(F.substring(text, at + 1, F.length(text)), "\n", 1))


def occurrences(text: Column, value: Column) -> Column:
    """0-based places of a literal, without overlaps, in order."""
    pieces = F.split(text, quoted(value), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        here = acc["at"] + F.length(piece)
        return F.struct((here + F.length(value)).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    inner = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    none = F.array().cast("array<int>")
    return F.when(F.coalesce(value, F.lit("")) == "", none).otherwise(F.aggregate(inner, start, step, lambda acc: acc["out"]))


def contexts(text: Column, value: Column, radius: int = 350) -> Column:
    """Around each occurrence of a literal, up to `radius` characters of its paragraph on either side."""

    def inside(section: Column) -> Column:
        def around(at: Column) -> Column:
            left = F.greatest(at - radius, F.lit(0))
            right = F.least(at + F.length(value) + radius, F.length(section))
            return F.substring(section, left + 1, right - left)

        return F.transform(occurrences(section, value), around)

    return F.flatten(F.transform(sections(text), inside))


def mentions(text: Column, name: Column) -> Column:
    """Whether a name stands in the text, in any case, and not inside a word. Texts without its letters need no pattern, which is built for each name."""
    shape = F.concat(F.lit(r"(?U)(?<!\w)"), quoted(F.lower(name)), F.lit(r"(?!\w)"))
    return (name != "") & F.contains(F.lower(text), F.lower(name)) & F.call_function("regexp", F.lower(text), shape)


def has_markdown(text: Column) -> Column:
    return text.rlike(r"(?m)^\s*#{1,6}\s|\*\*|^\s*[-*]\s+|^\s*\d+\.\s+")


def report_lines(text: Column) -> Column:
    """Lines of a report with whether each is a heading; bold marks and heading marks are removed."""

    def line(raw: Column) -> Column:
        shape = F.trim(raw)
        heading = shape.rlike(r"^#{1,6}\s+\S") | shape.rlike(r"^\*\*[^*]+\*\*:?$")
        bare = F.regexp_replace(F.regexp_replace(shape, r"^#{1,6}\s+", ""), r"\*\*", "")
        return F.struct(heading.alias("heading"), bare.alias("line"))

    return F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["line"] != "")
