"""Quality rules, line first, in DataFrame operations only.

Each line is judged by rules on punctuation, navigation and boilerplate; lines that fail are removed, and a
document that loses too much of its text is rejected. Counts over the whole text can reject it before that.
Three-word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh

SYMBOLS = "#*$%&|<>"
#: Signs of lines that belong to a site and not to its text, in English, German, French and Spanish; a dot stands for an accented letter.
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|under the \S+ licen[sc]e|copyright \(c\)|terms of (?:use|service)|privacy policy|cookie|subscribe to|click here|enable javascript|lorem ipsum|"
    r"alle rechte vorbehalten|lizenziert unter|nutzungsbedingungen|datenschutzerkl.rung|jetzt abonnieren|hier klicken|javascript aktivieren|"
    r"tous droits r.serv.s|sous licence|conditions d.utilisation|politique de confidentialit.|abonnez-vous|cliquez ici|activer javascript|"
    r"todos los derechos reservados|bajo la licencia|t.rminos de (?:uso|servicio)|pol.tica de privacidad|suscr.base|haga clic aqu.|habilitar? javascript"
)
#: A line fails with as many symbols as this share of its words, and so with exclamation marks or separators.
HEAVY = 0.3
#: A line of fewer words fails unless it ends like a sentence.
SHORT_LINE = 4
ENDS = r"[.!?:;\x22')\]”»…。！？]\s*$"
#: A document is rejected when more than this share of its words stood on failed lines.
MOST_LOST = 0.5


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line with so many words fails a rule."""
    punctuation = (_without(line, SYMBOLS) >= words * HEAVY) | (_without(line, "!") >= words * HEAVY)
    navigation = (_without(line, "|»›•") >= words * HEAVY) | ((words < SHORT_LINE) & ~line.rlike(ENDS))
    return punctuation | navigation | line.rlike(BOILERPLATE)


def _lines(text: Column) -> Column:
    """(line, words) of each line that has a word; no word goes over a line's end."""
    words = lambda x: F.filter(F.split(x, SPACE + "+"), lambda w: w != "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("words"))), lambda x: F.size(x["words"]) > 0)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that stand in the text twice or more."""

    def covered(windows: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            near = lambda k: F.coalesce(F.get(windows, k)["h"] == x["h"], F.lit(False))
            return near(i - 1) | near(i + 1)

        places = F.sort_array(F.transform(F.filter(windows, again), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

        def step(acc: Column, i: Column) -> Column:
            return F.struct((acc["n"] + i + 3 - F.greatest(i, acc["upto"])).alias("n"), (i + 3).alias("upto"))

        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def count(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def among(h: Column) -> Column:
            windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(windows, covered))

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(hashes, among))

    return _let(words, count)


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, cleaned and kept.

    cleaned is the text without the lines that failed. Null texts have no words and no lines, so they fail.
    Columns of docs with one of these names are replaced; repeated rows each come back."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def parts(lines: Column) -> Column:
        judged = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"), line_fails(x["line"], F.size(x["words"])).alias("fails")))

        def sums(j: Column) -> Column:
            lost = F.aggregate(F.filter(j, lambda x: x["fails"]), F.lit(0), lambda acc, x: acc + x["n"])
            dup = F.size(j) - F.size(F.array_distinct(F.transform(j, lambda x: x["line"])))
            return F.struct(lost.alias("lost"), dup.alias("dup"), F.array_join(F.transform(F.filter(j, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"))

        words = _let(F.flatten(F.transform(lines, lambda x: x["words"])), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again")))
        return F.struct(words.alias("words"), _let(judged, sums).alias("lines"))

    (own,) = fresh(docs, "parts")
    out = docs.withColumn(own, _let(_lines(text), parts))
    own_words, own_lines = F.col(own)["words"], F.col(own)["lines"]
    out = out.withColumns(
        {
            "n_words": own_words["n"].cast("bigint"),
            "word_chars": (F.length(text) - _without(text, " \t\n\x0b\x0c\r")).cast("bigint"),
            "n_symbols": _without(text, SYMBOLS).cast("bigint"),
            "n_dup_lines": own_lines["dup"].cast("bigint"),
            "n_repeat_words": own_words["again"].cast("bigint"),
            "lost_words": own_lines["lost"].cast("bigint"),
            "cleaned": own_lines["cleaned"],
        }
    )
    out = out.drop(own).withColumn("base_failed", (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.col("n_words") * MOST_LOST))
