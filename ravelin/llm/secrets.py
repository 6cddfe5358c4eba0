"""Secret scans over a content-addressed ledger, in DataFrame operations only.

Every text version is addressed by its SHA-256. A ledger holds an entry for each blob and rule version that has scanned
it, with the spans found; only pairs that it lacks are scanned, each blob once however many rows carry it. The findings of
the versions that are asked for are then joined back to all rows of the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, table_path

SPAN = "struct<start:int,rank:int,kind:string,stop:int>"
SPANS = f"array<{SPAN}>"
LEDGER = f"blob string, rule string, spans {SPANS}"
#: Spans that are put together at once.
RUN = 256
#: Hashes of blobs that are sent to all executors at most (8 bytes each).
MOST_SENT = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern (Java), the group that is the secret, and the characters that this must have."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds, in the order in which they are listed at equal starts.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:passw(?:or)?d|secret|token|api_?key)[\x22']?\x20*[:=]", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 0, 16),
)
#: Kinds that the scan adds.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", 1, r"\bgh[oprsu]_[A-Za-z0-9]{36,}", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("chat_token", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("web_token", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
)
RULES = BASE_RULES + MORE_RULES


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _gather(count: Column, kind: str, step) -> Column:
    """(at, out) after step(at, i) -> (at, items) for each i under count; out holds all items in order.

    Items are put together in runs of RUN, and the runs at the end, so long texts don't copy all items at each step."""
    empty = F.array().cast(f"array<{kind}>")

    def run(at: Column, first: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            to, items = step(acc["at"], i)
            return F.struct(to.alias("at"), F.concat(acc["out"], items).alias("out"))

        return F.aggregate(F.sequence(first, F.least(first + RUN, count) - 1), F.struct(at.alias("at"), empty.alias("out")), one)

    def join(acc: Column, k: Column) -> Column:
        return _let(run(acc["at"], k * RUN), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    runs = F.sequence(F.lit(0), ((count - 1) / RUN).cast("int"))
    return F.aggregate(runs, start, join, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """All spans of a rule, in code points, from the pieces between its matches."""
    none = F.array().cast(SPANS)
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("secret"),
        F.split(text, rule.pattern, -1).alias("between"),
    )

    def walk(m: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column]:
            begin = at + F.length(m["between"][i])
            end = begin + F.length(m["found"][i])
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("stop"))
            return end, F.when(F.length(m["secret"][i]) >= rule.least, F.array(span)).otherwise(none)

        return F.when(F.size(m["found"]) > 0, _gather(F.size(m["found"]), SPAN, step)["out"]).otherwise(none)

    return F.when(text.rlike(rule.hint), _let(parts, walk)).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The entries that a ledger lacks: (blob, rule, spans), one for each text of docs and rule version, spans maybe empty.

    ledger: earlier entries, or None. Null texts are empty texts. Each blob is scanned once by a rule version, whatever rows it has."""
    rows = docs.select(F.xxhash64(id_col).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("blob", blob_id(F.col("_text")))
    names = F.array(*[F.lit(r.name) for r in rules])
    first = rows.groupBy("blob").agg(F.min("_row").alias("_row"))
    if ledger is None:
        todo = first.withColumn("todo", names)
    else:
        pairs = first.withColumn("rule", F.explode(names)).join(ledger.select("blob", "rule"), ["blob", "rule"], "left_anti")
        todo = pairs.groupBy("blob", "_row").agg(F.collect_set("rule").alias("todo"))
    # joined on a hash of the id too: the rows of a blob that many documents share don't meet in one task
    texts = rows.join(todo, ["blob", "_row"]).groupBy("blob", "_row").agg(F.first("_text").alias("_text"), F.first("todo").alias("todo"))
    entry = lambda r, k: F.struct(F.lit(r.name).alias("rule"), F.array_sort(_spans(F.col("_text"), r, k)).alias("spans"))
    entries = F.array_compact(F.array(*[F.when(F.array_contains("todo", r.name), entry(r, k)) for k, r in enumerate(rules)]))
    return texts.select("blob", F.explode(entries).alias("e")).select("blob", "e.rule", "e.spans")


def update(path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger at a path in a folder that all share, after what it lacked for docs and rules has been appended to it.

    A run that ends early leaves entries that the next one needn't make again; running twice scans nothing the second time."""
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.schema(LEDGER).parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None
    scan(docs, id_col, text_col, rules, known).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """(blob, spans) of the texts of docs and of the ledger at `path` that have spans for the rules, sorted by start, then order of the rules."""
    ledger = update(path or table_path(docs.sparkSession, "ledger"), docs, id_col, text_col, rules)
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    found = ledger.where(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0)).select("blob", "rule", F.explode("spans").alias("s"))
    # spans are ordered by the rules of this call, and an entry that two runs made at once counts once
    ranked = F.struct(F.col("s.start").alias("start"), rank[F.col("rule")].alias("rank"), F.col("s.kind").alias("kind"), F.col("s.stop").alias("stop"))
    # stored, so that a join deals out both sides itself and can split the rows of a blob that many documents share
    return stored(found.groupBy("blob").agg(F.sort_array(F.collect_set(ranked)).alias("spans")), "found")


def with_spans(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of docs, with all its columns and the `spans` that found_in gave for its text; a column of docs that is called spans is replaced."""
    rows = docs.drop("spans")
    of, blob, own = fresh(rows, "blob", "found_blob", "found_spans")
    rows = rows.withColumn(of, blob_id(F.col(text_col)))
    found = found.select(F.col("blob").alias(blob), F.col("spans").alias(own))
    return rows.join(found, F.col(of) == F.col(blob), "left").withColumn("spans", F.coalesce(own, F.array().cast(SPANS))).drop(of, blob, own)


def parted(docs: DataFrame, found: DataFrame, text_col: str = "text", most: int = MOST_SENT) -> tuple[DataFrame, DataFrame | None]:
    """The rows of docs that may have spans, and the others: no row of those need move to meet its findings.

    Hashes of the blobs with findings go to all executors; if they are more than `most`, all rows are in the first part."""
    if found.count() > most:
        return docs, None
    (at,) = fresh(docs, "blob_hash")
    sent = F.broadcast(found.select(F.xxhash64("blob").alias(at)))
    rows = docs.withColumn(at, F.xxhash64(blob_id(F.col(text_col))))
    return rows.join(sent, at, "left_semi").drop(at), rows.join(sent, at, "left_anti").drop(at)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """Every row of docs, with all its columns and `spans` (sorted by start, then order of the rules).

    Only the given versions of rules count, whatever else the ledger at `path` holds (without a path it is one of this
    call's own). A column of docs that is called spans is replaced. Rows with empty or null texts have no spans."""
    return with_spans(docs, found_in(docs, id_col, text_col, rules, path), text_col)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by [kind of its first span]."""

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        s = spans[i]
        piece = F.array(F.substring(text, at + 1, s["start"] - at), F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.greatest(at, s["stop"]), F.when(s["start"] >= at, piece).otherwise(F.array().cast("array<string>"))

    done = _let(_gather(F.size(spans), "string", step), lambda r: F.concat(F.array_join(r["out"], ""), F.substring(text, r["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
