"""From documents and proposed candidates to grounded indicators, with the reason for each rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import names as N
from ..functions import text as T

#: Cues of bulletins, on text without case and accents.
MALICIOUS = r"\b(?:indicators?|iocs?|malicious|malicioso(?:s|a|as)?|payloads?|phishing|suplantacion|c2|command(?:\s+and|-and-)control|comando\s+y\s+control|attack\s+artifacts?|artefactos?\s+de\s+ataque|compromised|comprometid[oa]s?)\b"
REFERENCE = r"\b(?:vendors?|fabricantes?|security\s+pages?|paginas?\s+de\s+seguridad|updates?|actualizaciones?|patch(?:es)?|parches?|advisories?|boletines?|references?|referencias?|more\s+information|mas\s+informacion)\b"
INACTIVE = (
    r"(?:no\s+(?:evidence|signs?)\s+of\s+active\s+exploitation|no\s+active\s+exploitation|not\s+(?:aware|known)\s+.{0,40}active\s+exploitation|not\s+been\s+exploited\s+in\s+the\s+wild|"
    r"(?:no\s+(?:hay|existe)|sin)\s+evidencia\s+de\s+explotacion\s+activa|no\s+se\s+ha\s+(?:observado|detectado)\s+explotacion\s+activa|no\s+hay\s+explotacion\s+activa|no\s+.{0,40}explotad[oa]\s+activamente)"
)
_HEAD = r"^(?:[a-z0-9]+[.)]\s*)?"
_SOURCES = r"fuentes?\s+de\s+informacion|sources?|references?|referencias?"
SOURCE_HEADING = _HEAD + rf"(?:{_SOURCES})(?:\s*:|\s*$)"
ANY_HEADING = (
    _HEAD + rf"(?:{_SOURCES}|indicadores?\s+de\s+compromiso(?:\s*\(iocs?\))?|iocs?|recomendaciones?|conclusiones?|anexos?|impacto|solucion|descripcion|detalle(?:s)?|vulnerabilidades?|alerta\s+integrada\s+de)\s*:?\s*$"
)
REACH = 4000


def harvest(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, type, value, pos): hashes that stand in the refanged text, in the order in which they are harvested."""
    return docs.select(doc, F.posexplode(I.hashes(T.refang(F.col(text)))).alias("pos", "x")).select(doc, "x.type", "x.value", "pos")


def unite(proposed: DataFrame, harvested: DataFrame) -> DataFrame:
    """Proposed candidates, then harvested ones, as one list with rank."""
    columns = ("doc_id", "type", "value", "pos")
    return proposed.select(*columns, F.lit(0).alias("rank")).unionByName(harvested.select(*columns, F.lit(1).alias("rank")))


def _reference_spans(text: Column) -> Column:
    """Start and end of each section of sources: from its heading to the next heading, at most so many characters on."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, stop: int, line: string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        stop = acc["at"] + F.length(line) + 1
        row = F.struct(acc["at"].alias("start"), stop.alias("stop"), T.fold_accents(F.trim(line)).alias("line"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = F.aggregate(lines, start, step, lambda acc: acc["out"])
    heads = F.filter(rows, lambda r: r["line"].rlike(ANY_HEADING) | r["line"].rlike(SOURCE_HEADING))

    def span(h: Column) -> Column:
        later = F.filter(heads, lambda x: (x["start"] > h["start"]) & x["line"].rlike(ANY_HEADING))
        limit = F.least(F.length(text), h["stop"] + REACH)
        return F.struct(h["start"].alias("start"), F.least(limit, F.coalesce(F.array_min(F.transform(later, lambda x: x["start"])), limit)).alias("stop"))

    return F.transform(F.filter(heads, lambda h: h["line"].rlike(SOURCE_HEADING)), span)


def bulletin_rejection(kind: Column, value: Column, text: Column) -> Column:
    """Why a bulletin's candidate is dropped, or null: it stands only among the sources, or in no malicious context and only where no exploitation is known, or only as a reference."""
    spans, at = _reference_spans(text), T.occurrences(text, value)
    inside = F.forall(at, lambda p: F.exists(spans, lambda s: (p >= s["start"]) & (p < s["stop"])) & ~T.fold_accents(T.line_at(text, p)).rlike(MALICIOUS))
    around = F.transform(T.contexts(text, value), T.fold_accents)
    every = lambda cue: F.forall(around, lambda c: c.rlike(cue))
    return (
        F.when((F.size(at) > 0) & (F.size(spans) > 0) & inside, "bulletin_reference_section")
        .when((F.size(around) == 0) | F.exists(around, lambda c: c.rlike(MALICIOUS)), None)
        .when(every(INACTIVE), "bulletin_no_active_exploitation")
        .when(kind.isin("url", "domain") & every(REFERENCE), "bulletin_reference_only")
    )


def judge(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Each candidate (doc_id, type, value, pos, rank) with its refanged value and a reason, null if it is kept.

    docs: doc_id, text, source_type. Grounding is against the refanged text; a domain that stands only in addresses
    becomes those addresses; per document each type and value counts once, at its first place."""
    once = candidates.select("doc_id", "type", T.refang(F.trim("value")).alias("value"), "rank", "pos")
    once = once.groupBy("doc_id", "type", "value").agg(F.min(F.struct("rank", "pos")).alias("at"))
    lists = once.groupBy("doc_id").agg(F.collect_list(F.struct("type", "value", "at")).alias("_given"))
    # all candidates of a document meet its text in one row, so the text moves once
    rows = docs.select("doc_id", T.refang(F.col("text")).alias("_text"), "source_type").join(lists, "doc_id")
    text, bulletin = F.col("_text"), F.col("source_type") == "bulletin"

    def named(c: Column) -> Column:
        mails = F.when(c["type"] == "domain", I.salvage_emails(c["value"], text))
        own = lambda kind, value: F.struct(kind.alias("type"), value.alias("value"), c["at"].alias("at"))
        return F.coalesce(F.transform(mails, lambda m: own(F.lit("email"), m)), F.array(own(c["type"], c["value"])))

    def judged(c: Column) -> Column:
        kind, value = c["type"], c["value"]
        policy = F.when(bulletin, bulletin_rejection(kind, value, text))
        reason = F.when(value == "", "empty").when(~F.contains(text, value), "ungrounded").when(~I.has_shape(kind, value), "shape").otherwise(policy)
        return F.struct(kind.alias("type"), value.alias("value"), c["at"].alias("at"), reason.alias("reason"))

    each = rows.select("doc_id", F.explode(F.transform(F.flatten(F.transform("_given", named)), judged)).alias("c")).select("doc_id", "c.*")
    out = each.groupBy("doc_id", "type", "value").agg(F.min("at").alias("at"), F.first("reason").alias("reason"))
    return out.select("doc_id", "type", "value", F.col("at.rank").alias("rank"), F.col("at.pos").alias("pos"), "reason")


def indicators(judged: DataFrame) -> DataFrame:
    kept = judged.where("reason is null")
    return kept.select("doc_id", "type", "value", I.pattern_of(F.col("type"), F.col("value")).alias("pattern"), I.observable_of(F.col("type")).alias("observable_type"))


def grounded_names(names: DataFrame, docs: DataFrame) -> DataFrame:
    """Names (doc_id, category, name) that are well-formed and stand in their document at word boundaries, in any case.

    All names of a document meet its text in one row, which is read once. A document's names are those that were proposed
    for it; repeated rows stay."""
    columns = names.columns
    good = names.where(I.is_valid_name(F.col("name"), F.col("category")) & (F.col("name") != ""))
    lists = good.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in columns if c != "doc_id"])).alias("_given"))
    rows = docs.select("doc_id", "text").join(lists, "doc_id")
    hits = N.stand_in(F.col("text"), F.transform("_given", lambda g: g["name"]))
    each = rows.select("doc_id", "_given", hits.alias("_hits")).select("doc_id", F.explode(F.arrays_zip("_given", "_hits")).alias("x")).where("x._hits")
    return each.select("doc_id", "x._given.*").select(*columns)


def catalog_mentions(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc_id, category, id, name): the entries of a closed catalog (category, id, name, aliases) that stand in a text by name or alias, each once for a document."""
    spelled = catalog.select("category", "id", "name", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_spelled"))
    spelled = spelled.where(F.col("_spelled") != "").withColumn("_spelled", F.lower("_spelled")).distinct()
    hits = N.mentioned(docs, spelled, name_col="_spelled")
    return hits.join(spelled, "_spelled").select("doc_id", "category", "id", "name").distinct()


def cited(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities whose value isn't blank and whose quote stands in the document, white space folded."""
    rows = entities.join(docs.select("doc_id", T.fold_space(F.col("text")).alias("_text")), "doc_id")
    quote = T.fold_space(F.coalesce("quote", F.lit("")))
    return rows.where((quote != "") & (F.coalesce(F.trim("value"), F.lit("")) != "") & F.contains(F.col("_text"), quote)).drop("_text")


def cited_relations(relations: DataFrame, kept: DataFrame, docs: DataFrame) -> DataFrame:
    """Relations whose quote stands in the document and both of whose ends were kept."""
    ends = kept.select("doc_id", "id")
    rows = relations.join(docs.select("doc_id", T.fold_space(F.col("text")).alias("_text")), "doc_id").where(F.contains(F.col("_text"), T.fold_space(F.col("quote")))).drop("_text")
    return rows.join(ends.withColumnRenamed("id", "source"), ["doc_id", "source"], "left_semi").join(ends.withColumnRenamed("id", "target"), ["doc_id", "target"], "left_semi")


def flat(entities: DataFrame) -> DataFrame:
    """Per document the distinct values of each type of entity, sorted; techniques and sectors in lower case, indicators only with their kind, vulnerabilities left to the harvest."""
    kind = F.col("type")
    value = F.when(kind.isin("attack-pattern", "sector"), F.lower("value")).otherwise(F.col("value"))
    pick = lambda name: F.sort_array(F.collect_set(F.when(kind == name, value)))
    iocs = F.sort_array(F.collect_set(F.when((kind == "indicator") & F.col("ioc_type").isNotNull(), F.struct("ioc_type", "value"))))
    return entities.groupBy("doc_id").agg(iocs.alias("indicators"), pick("threat-actor").alias("actors"), pick("malware").alias("malware"), pick("sector").alias("sectors"), pick("country").alias("countries"), pick("attack-pattern").alias("techniques"))


#: Fixed value: a vulnerability id whose number may be broken over lines, as in text from a PDF.
#: An id may be broken over lines; after ten breaks it has more digits than any id, so more aren't looked for (an open number of them recurses).
CVE_FORM = r"(?i)(?<![A-Za-z0-9])CVE\s*-\s*[0-9]{4}\s*-\s*[0-9]+(?:(?:\r?\n[ \t]*|­[ \t\r\n]*|[-‐-―]\r?\n[ \t]*)[0-9]+){0,10}(?![A-Za-z0-9])"


def cve_candidates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, id, raw_forms, occurrence_count, offsets, first): the vulnerability ids of a text with the places of their forms."""
    t = F.col(text)
    found, between = F.regexp_extract_all(t, F.lit(f"({CVE_FORM})"), F.lit(1)), F.transform(F.split(t, CVE_FORM, -1), lambda x: F.length(x))
    rows = docs.select(doc, F.monotonically_increasing_id().alias("_row"), found.alias("f"), between.alias("b")).where("size(f) > 0")
    each = rows.select(doc, "_row", F.posexplode(F.arrays_zip("f", F.slice("b", F.lit(1), F.size("f")).alias("b"))).alias("pos", "x")).select(doc, "_row", "pos", F.col("x.f").alias("raw"), F.col("x.b").alias("gap"))
    end = F.sum(F.col("gap") + F.length("raw")).over(Window.partitionBy("_row").orderBy("pos")).cast("int")
    each = each.withColumn("end", end).select(doc, F.struct((F.col("end") - F.length("raw")).alias("start"), "end", "raw").alias("m"))
    bare = F.upper(F.regexp_replace(F.regexp_replace("m.raw", r"\r?\n[ \t]*|­[ \t\r\n]*|[-‐-―]\r?\n[ \t]*", "\u0001"), r"\s+", ""))
    year, number = F.regexp_extract(bare, r"CVE\u0001?-\u0001?([0-9]{4})", 1), F.regexp_replace(F.regexp_extract(bare, r"([0-9\u0001]+)$", 1), "\u0001", "")
    each = each.withColumn("id", F.concat_ws("-", F.lit("CVE"), year, number)).where(F.col("id").rlike(r"^CVE-[0-9]{4}-[0-9]{4,10}$"))
    spots = F.sort_array(F.collect_list(F.struct("m.start", "m.end", "m.raw")))
    out = each.groupBy(doc, "id").agg(spots.alias("s"))
    return out.select(doc, "id", F.array_distinct(F.transform("s", lambda x: x["raw"])).alias("raw_forms"), F.size("s").alias("occurrence_count"), F.transform("s", lambda x: F.struct(x["start"], x["end"])).alias("offsets"), F.get("s", F.lit(0))["start"].alias("first"))


def may_target(actors: Column, malware: Column, sectors: Column, countries: Column, cves: Column, url: Column) -> Column:
    """Whether a document's counts allow targeting edges: an actor with any target, or malware with a sector, and a web source."""
    return ((actors > 0) & ((sectors > 0) | (countries > 0) | (cves > 0)) | (malware > 0) & (sectors > 0)) & url.rlike("^https?://")
