"""The knowledge graph as tables of nodes and edges: targeting axes, compositions, clocks, checks after writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Caps of names by category, and relations that have no time of their own.
CAPS = {"actor": 5, "malware": 5, "sector": 8, "country": 15, "cve": 15}
TIMELESS = ("related-to", "part-of", "located-at", "belongs-to", "subtechnique-of", "derived-from", "duplicate-of", "based-on")


def axes(members: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Targeting edges (doc, from_name, to_name, axis) of resolved members (doc, category, name).

    Actors and malware with sectors, actors with countries, and actors with vulnerabilities only where the document
    has a single actor. A document needs an actor with some target, or malware with a sector. Members are capped
    before (CAPS), so a document's sets are small and it yields some hundred edges at most: one shuffle brings the
    members of a document together, the pairs are made inside its row. Members without a name are left out."""
    sets = members.groupBy(doc).agg(*[F.collect_set(F.when(F.col("category") == k, F.col("name"))).alias(f"_{k}") for k in CAPS])

    def pairs(one: str, other: str) -> Column:
        edge = lambda a, b: F.struct(a.alias("from_name"), b.alias("to_name"), F.lit(f"{one}-{other}").alias("axis"))
        return F.flatten(F.transform(f"_{one}", lambda a: F.transform(f"_{other}", lambda b: edge(a, b))))

    alone = F.when(F.size("_actor") == 1, pairs("actor", "cve"))
    edges = F.array_compact(F.array(pairs("actor", "sector"), pairs("malware", "sector"), pairs("actor", "country"), alone))
    return sets.select(doc, F.explode(F.flatten(edges)).alias("e")).select(doc, "e.*")


def indicates(indicators: DataFrame, techniques: DataFrame, doc: str = "doc_id") -> DataFrame:
    """indicates edges between the indicators and the techniques of a document."""
    return indicators.select(doc, F.col("id").alias("from_id")).join(techniques.select(doc, F.col("id").alias("to_id")), doc).select("from_id", "to_id", F.lit("indicates").alias("relationship_type")).distinct()


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    key = ["from_id", "to_id", "relationship_type"]
    return edges.unionByName(new.select(*edges.columns).join(edges, key, "left_anti").dropDuplicates(key))


def reports(objects: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The distinct objects of each document's report, sorted."""
    return objects.distinct().groupBy(doc).agg(F.sort_array(F.collect_set("object_id")).alias("object_refs"))


def histogram(rows: DataFrame, by: str, top: int) -> DataFrame:
    """The most frequent values and the total (whose value is TOTAL)."""
    counts = rows.rollup(by).agg(F.count("*").alias("n"), F.grouping(by).alias("_all"))
    named = counts.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "n", "_all")
    return named.orderBy(F.desc("_all"), F.desc("n"), by).limit(top + 1).drop("_all")


def connectivity(edges: DataFrame, least: int = 20, exact: bool = False, error: float = 0.01) -> DataFrame:
    """Distinct entities of each class at the ends of edges, for classes with more than `least`.

    Approximate by default, as each class then needs one small sketch; exact counts shuffle each entity once."""
    ends = edges.select(F.explode("connections").alias("c")).select("c.internal_id", F.explode("c.types").alias("type"))
    count = F.count_distinct("internal_id") if exact else F.approx_count_distinct("internal_id", error)
    return ends.groupBy("type").agg(count.alias("entities")).where(F.col("entities") > least)


def readiness(nodes: DataFrame, edges: DataFrame, needs: tuple[int, int, int, int] = (100, 1000, 10_000, 1000)) -> DataFrame:
    """Counts that a loaded graph must reach, and whether it does: groups, techniques, uses edges, uses edges from malware."""
    n = nodes.agg(F.count_if(F.col("entity_type") == "Intrusion-Set").alias("groups"), F.count_if(F.col("entity_type") == "Attack-Pattern").alias("techniques"))
    malware = F.exists("connections", lambda c: (c["role"] == "uses_from") & F.array_contains(F.transform(c["types"], F.lower), "malware"))
    uses = F.col("relationship_type") == "uses"
    e = edges.agg(F.count_if(uses).alias("uses"), F.count_if(uses & malware).alias("malware_uses"))
    both = n.crossJoin(e)  # one row each
    checks = [F.col(c) >= least for c, least in zip(("groups", "techniques", "uses", "malware_uses"), needs, strict=True)]
    return both.withColumn("ready", checks[0] & checks[1] & checks[2] & checks[3])


def clock_collapse(rows: DataFrame, by: str, age: str, created: str, limit: float = 0.9) -> DataFrame:
    """How often the day of a row's own clock is just the day it was written, and the verdict; nulls are counted apart."""
    same = F.to_date(age) == F.to_date(created)
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.count_if(F.col(age).isNull()).alias("nulls"))
    share = F.when(F.col("n") > 0, F.col("same") / F.col("n")).otherwise(0.0)
    return out.select(by, "n", "same", "nulls", F.round(share, 6).alias("share"), F.when(share >= limit, "COLLAPSED").otherwise("ok").alias("verdict"))


def by_year(rows: DataFrame, by: str, at: str) -> DataFrame:
    return rows.groupBy(by, F.year(at).alias("year")).agg(F.count("*").alias("n"))


def sentinels(edges: DataFrame, by: str = "relationship_type", at: str = "start_time", limit: float = 0.5) -> DataFrame:
    """The share of edges whose time is the sentinel of 1970, and an alert for relations that should have one."""
    out = edges.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.year(at) == 1970).alias("sentinel"))
    share = F.col("sentinel") / F.col("n")
    return out.select(by, "n", "sentinel", F.round(share, 6).alias("share"), (~F.col(by).isin(*TIMELESS) & (share > limit)).alias("alert"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.greatest(F.lit(0), F.count("*") - 1).cast("bigint").alias("extra")).where("extra > 0")


def differences(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that are missing from what was stored, and rows that are there beyond what was expected."""
    stored = stored.select(*expected.columns)
    return expected.exceptAll(stored).withColumn("side", F.lit("missing")).unionByName(stored.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def top_targets(edges: DataFrame, kind: str = "uses", top: int = 5) -> DataFrame:
    return edges.where(F.col("relationship_type") == kind).groupBy("to_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to_id").limit(top)


def relation_count(edges: DataFrame, sources: DataFrame, targets: DataFrame, kind: str = "indicates") -> DataFrame:
    """How many different edges of a kind connect the given ends."""
    rows = edges.where(F.col("relationship_type") == kind).join(sources.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(targets.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return rows.agg(F.count_distinct("id").alias("n"))


def write_once(objects: DataFrame, key: str = "standard_id") -> DataFrame:
    return objects.dropDuplicates([key])


def wrong_types(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows of another type than the one asked for: a filter that was silently ignored."""
    return rows.where(~F.col("entity_type").eqNullSafe(F.lit(wanted)))


def node_dump(nodes: DataFrame, wanted: str) -> DataFrame:
    return nodes.where(F.col("entity_type") == wanted).orderBy("internal_id").limit(1).select(F.to_json(F.struct("*")).alias("object"))
