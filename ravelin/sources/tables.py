"""Tables of the platform: catalogs, sources, limits on bodies, incremental address intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

CATALOG = StructType([StructField("category", StringType()), StructField("id", StringType()), StructField("name", StringType()), StructField("aliases", ArrayType(StringType()))])
#: Bounds on what is read.
MAX_BODY_BYTES, MAX_TEXT_CHARS, MAX_PAGES = 50_000_000, 4_000_000, 500


def catalog(spark: SparkSession, name: str | None) -> DataFrame:
    """The catalog table, or an empty one if there is none: then nothing resolves and all candidates are queued."""
    if name and spark.catalog.tableExists(name):
        return spark.table(name).select("category", "id", "name", "aliases")
    return spark.createDataFrame([], CATALOG)


def within_bounds(bodies: DataFrame, content_col: str = "content") -> DataFrame:
    return bodies.where(F.octet_length(content_col) <= MAX_BODY_BYTES)


def page_texts(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """The text of a paged document: its non-empty pages in order, by lines; null if blank; bounded like a reader's."""
    kept = pages.where((F.col(page_col) <= MAX_PAGES) & (F.trim(text_col) != ""))
    parts = kept.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct(page_col, text_col))).alias("p"))
    text = F.substring(F.array_join(F.transform("p", lambda x: x[text_col]), "\n"), 1, MAX_TEXT_CHARS)
    return parts.select(doc_col, F.nullif(F.trim(text), F.lit("")).alias("text"))


#: The choices of a feed of address intelligence.
FEED_TYPES = ("benign", "malicious", "suspicious", "benign+malicious", "malicious+suspicious", "benign+suspicious+malicious", "all")


def feed_query(feed_type: str, classification: Column, seen: Column, now: Column) -> Column:
    """Rows of the chosen classes that were seen in the last day."""
    kind = feed_type.lower()
    if kind not in FEED_TYPES:
        raise ValueError(f"feed type must be one of {', '.join(FEED_TYPES)}")
    recent = seen > now - F.expr("interval 1 day")
    return recent if kind == "all" else recent & classification.isin(*kind.split("+"))


def after_cursor(rows: DataFrame, cursor: Column, seen_col: str = "last_seen") -> DataFrame:
    """Rows beyond the cursor; rows whose time can't be read are left out."""
    return rows.where(F.col(seen_col).isNotNull() & (F.col(seen_col) > cursor))


def cursors(state: DataFrame, now: Column) -> DataFrame:
    """Last run and most recent time, a day and thirty days back where none is known."""
    return state.select("*", F.coalesce("last_run", now - F.expr("interval 1 day")).alias("run_from"), F.coalesce("most_recent", now - F.expr("interval 30 days")).alias("seen_from"))


def windows(spark: SparkSession, start: str, end: str, days: int = 30) -> DataFrame:
    """Half-open date windows that cover start..end by calendar year; none is empty."""
    years = spark.sql(f"select explode(sequence(year(date'{start}'), year(date'{end}'))) as y")
    first, last = F.make_date("y", F.lit(1), F.lit(1)), F.least(F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)), F.date_add(F.lit(end).cast("date"), 0))
    steps = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.datediff(last, first) - 1) / days), F.lit(-1)).cast("int")))
    rows = years.where(F.datediff(last, first) > 0).select(first.alias("f"), last.alias("l"), steps.alias("k"))
    return rows.select(F.date_add("f", F.col("k") * days).alias("window_start"), F.least(F.date_add("f", (F.col("k") + 1) * days), F.col("l")).alias("window_end"))
